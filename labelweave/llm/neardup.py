"""Near-duplicates by SetSketch registers: bands give candidates, a joint likelihood weeds them, full sets decide.

A document is the set of its distinct word shingles. Each of its registers is the minimum of an exponential variable over
the set, kept as a truncated power of a base near 1, so sketches merge by maximum and two registers are equal about as
often as the sets' Jaccard similarity says. Groups of registers are bands; documents that share a band are candidates.

Equal sets are one class, so copies cost nothing further. Then, in two passes,

1. every class is checked on full sets against one partner, the head of a bucket with which it shares most bands; in a
   group of thousands of near copies this joins nearly all, with one check for each;
2. buckets that still hold several components are compared in whole: their classes, gathered into connected clusters, are
   dealt out in blocks by hash, and each pair of blocks meets in one task, which weeds pairs by registers and names the
   rows that have a pair left. Only their texts are fetched, and a task for each such pair of blocks checks on full sets and
   returns the links that join components. Blocks of a cluster's largest component don't meet each other. No pair is listed
   outside a task, and no bucket is capped. Work in this pass grows with the size of a cluster times that of all its
   components but the largest; what it holds at a time doesn't.

With 40 bands of 4 registers, a pair of similarity 0.75 shares no band with probability 2.5e-7; the registers weed a true
pair with one of about 1e-5.

A text of fewer words than a shingle has is one shingle; without words, or null, it is linked with nothing. Very long
texts are read in whole, one at a time. Repeated rows get equal results. The texts of one doc_id are one document: what
is linked with any of them is in its component; only its rows without words stand alone. Ids are of any type that has an
order; a null one is a document less than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, written

#: Bands, registers in each, base of the registers, documents in a block, words whose hashes a worker keeps, bytes of full sets that a block task keeps.
BANDS, ROWS, BASE, BLOCK, CACHE, SETS = 40, 4, 1.001, 128, 400_000, 1 << 26
#: A pair goes to the check if its estimate is at most so far below the threshold: over 4 standard deviations.
MARGIN = 0.15
_U = np.uint64
_MIX = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
_words: dict[bytes, int] = {}


def shingle_set(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of text; words are split at ASCII white space, A-Z are lower-cased."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.empty(0, _U)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], _U)
    try:
        h = np.fromiter(map(_words.__getitem__, words), _U, len(words))
    except KeyError:
        if len(_words) > CACHE:
            _words.clear()
        for w in words:
            if w not in _words:
                _words[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(_words.__getitem__, words), _U, len(words))
    n = len(h) - size + 1
    v = h[:n] * _MIX[0]
    for k in range(1, size):
        v = (v ^ (v >> _U(29))) * _MIX[k % len(_MIX)] + h[k : n + k]
    v ^= v >> _U(32)
    v *= _MIX[0]
    return np.unique(v ^ (v >> _U(29)))


def _seeds(m: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20)
    return r.integers(0, 2**63, m, dtype=_U), r.integers(0, 2**63, m, dtype=_U) | _U(1)


def registers(s: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """SetSketch of a set, as unsigned 16-bit: 1 - log of the least exponential variable, truncated. The larger, the more elements."""
    low = np.full(len(seeds[0]), 2**64 - 1, _U)
    for i in range(0, len(s), 512):
        low = np.minimum(low, ((s[i : i + 512, None] ^ seeds[0]) * seeds[1]).min(0))
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2**64)
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)) + 2**12, 0, 2**16 - 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union."""
    return np.maximum(a, b)


def likely(more: np.ndarray, less: np.ndarray, equal: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity by the largest joint likelihood, from how many registers of the first are greater, less and equal, and the sets' sizes."""
    u, v = a / (a + b), b / (a + b)
    top = np.minimum(u / v, v / u)
    p = lambda x: -np.log(np.maximum(1e-12, 1 - x * (BASE - 1) / BASE)) / np.log(BASE)
    best, at = np.full(len(u), -np.inf), np.zeros(len(u))
    for step in np.linspace(0, 1, 101):
        j = step * top
        plus, minus = p(np.maximum(u - v * j, 1e-12)), p(np.maximum(v - u * j, 1e-12))
        ll = more * np.log(plus) + less * np.log(minus) + equal * np.log(np.maximum(1 - plus - minus, 1e-12))
        at, best = np.where(ll > best, j, at), np.maximum(ll, best)
    return at


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketched(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id (null without shingles), registers."""
    import xxhash

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds(BANDS * ROWS)
        for b in batches:
            n, ids, regs = [], [], []
            for lo in range(0, b.num_rows, 256):
                for t in b.column(2).slice(lo, 256).to_pylist():
                    s = shingle_set(t, size)
                    n.append(len(s))
                    ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    regs.append(registers(s, seeds).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "text_hash", "n_shingles", "set_id", "registers"])

    return _hashed(docs).mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, set_id binary, registers binary")


def _hashed(docs: DataFrame) -> DataFrame:
    return id_text(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def roots(parents: DataFrame) -> DataFrame:
    """node, root of a forest of rows (node, up), one for each node that has a parent: the end of its path.

    Paths halve in each round; a round joins as many rows as there are nodes.
    """
    now = written(parents.select("node", F.col("up").alias("root")), "roots")
    while True:
        up = now.select(F.col("node").alias("root"), F.col("root").alias("to"))
        now = written(now.join(up, "root", "left").select("node", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the least node that can be reached over edges (a, b); nodes without edges don't appear.

    Each round takes the least label among neighbours, then the label of the label, so rounds grow with the logarithm of
    the longest path. Tables between rounds are written, so joins shuffle both sides and a hub can be split.
    """
    both = edges.where("a <> b").select("a", "b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("comp")), "labels")
    while True:
        near = both.join(now.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("least"))
        new = now.join(near, now["node"] == near["a"], "left").select("node", F.col("comp").alias("old"), F.least("comp", "least").alias("comp"))
        new = written(new, "labels")
        jump = new.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        now = written(new.join(jump, "comp").select("node", "old", F.col("to").alias("comp")), "labels")
        if now.where("comp <> old").isEmpty():
            return now.select("node", "comp")
        now = now.select("node", "comp")


def classes(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept.

    Other columns of docs go; their names clash with nothing.
    """
    tasks = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketch = written(sketched(docs, size), "sketches")
    some = sketch.where("set_id is not null")
    # copies of a set become one row within each task, before the shuffle
    reps = some.groupBy("set_id").agg(F.min(F.struct("doc_id", "text_hash", "n_shingles", "registers")).alias("r"))
    reps = written(reps.select("set_id", F.monotonically_increasing_id().alias("node"), "r.*"), "classes")

    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("registers", b * (2 * ROWS) + 1, F.lit(2 * ROWS)))))
    keys = reps.select(band.alias("key"), "node")
    heads = written(keys.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last").select("key", "head"), "heads")
    buckets = written(keys.join(heads, "key"), "buckets")
    partner = buckets.where("node <> head").groupBy("node", "head").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.max_by("head", F.struct("n", -F.col("head"))).alias("head"))
    partner = written(partner, "partners")

    busy = buckets.select("node").distinct().join(reps.select("node", F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")), "node")
    text = _hashed(docs)
    active = text.join(busy, text["doc_id"].eqNullSafe(busy["_doc"]) & (text["text_hash"] == busy["_hash"])).groupBy("node").agg(F.first("text").alias("text"))
    active = written(active, "texts")
    pairs = partner.join(active, "node").select("node", "head", F.col("text").alias("left"))
    pairs = pairs.join(active.select(F.col("node").alias("head"), F.col("text").alias("right")), "head").select("node", "head", "left", "right")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [linked(shingle_set(b.column(2)[i].as_py(), size), shingle_set(b.column(3)[i].as_py(), size), percent) for i in range(b.num_rows)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["node", "up"])

    # a head is less than all others of its bucket, so what the first pass links is a forest
    labels = roots(written(pairs.mapInArrow(check, "node long, up long"), "links"))

    tagged = buckets.join(labels, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    tagged = written(tagged, "tagged")
    mixed = tagged.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key", "low")
    # a node has at most as many buckets as there are bands; one edge from each of them to the least says all that edges between all of them would
    mixed = tagged.join(written(mixed, "mixed"), "key").groupBy("node").agg(F.min("comp").alias("comp"), F.min("low").alias("least"), F.collect_set("low").alias("lows"))
    mixed = written(mixed, "mixed")
    joined = mixed.select(F.explode(F.array_distinct(F.concat("lows", F.array("comp")))).alias("a"), F.col("least").alias("b"))
    cluster = components(joined.where("a <> b").distinct()).select(F.col("node").alias("comp"), F.col("comp").alias("cluster"))
    members = written(mixed.select("node", "comp").join(cluster, "comp"), "members")

    # the rows of a cluster's largest component need not meet each other, only those of the others
    sizes = members.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("cluster").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = written(sizes.select("cluster", "main", blocks(F.col("most")).alias("inner"), blocks(F.col("n") - F.col("most")).alias("outer")), "blocks")
    is_main, h = F.col("comp") == F.col("main"), F.xxhash64("node")
    block = F.when(is_main, F.pmod(h, F.col("inner"))).otherwise(F.col("inner") + F.pmod(h, F.col("outer"))).cast("int")
    others = F.sequence(F.when(is_main, F.col("inner")).otherwise(0), F.col("inner") + F.col("outer") - 1)
    members = members.join(sizes, "cluster").select("node", "comp", "cluster", block.alias("block"), others.alias("others"))
    members = written(members.join(reps.select("node", "n_shingles", "registers"), "node"), "members")
    met = members.withColumn("other", F.explode("others"))
    met = met.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp", "n_shingles", "registers")
    # written, as ranges are found by reading the rows twice; few bytes but much work: as many tasks as there are, not as few as their bytes need
    maybe = written(met, "met").repartitionByRange(tasks, "cluster", "i", "j").groupBy("cluster", "i", "j").applyInPandas(lambda p: _maybe(p, percent), "cluster long, i int, j int, node long")
    again = written(maybe, "maybe").join(members.drop("others", "cluster"), "node").join(active, "node")
    more = again.repartitionByRange(tasks, "cluster", "i", "j").groupBy("cluster", "i", "j").applyInPandas(lambda p: _met(p, percent, size), "a long, b long")

    # what joins components of the first pass: a component's name is one of its nodes
    more = written(more, "more")
    twice = written(some.groupBy("doc_id").agg(F.min(F.xxhash64("set_id")).alias("a"), F.max(F.xxhash64("set_id")).alias("b")).where("a <> b").select(F.col("doc_id").alias("_doc")), "twice")
    if not twice.isEmpty():  # the texts of one doc_id are one document
        own = some.join(twice, F.col("doc_id").eqNullSafe(F.col("_doc"))).select(F.struct("doc_id").alias("doc"), "set_id").distinct().join(reps.select("set_id", "node"), "set_id")
        own = written(own.join(labels, "node", "left").select("doc", F.coalesce("root", "node").alias("a")).distinct(), "own")
        more = more.unionByName(own.join(own.groupBy("doc").agg(F.min("a").alias("b")), "doc").select("a", "b"))
    last = components(more).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    named = reps.select("set_id", "doc_id", "node").join(labels, "node", "left").select("set_id", "doc_id", F.coalesce("root", "node").alias("comp"))
    named = written(named.join(last, "comp", "left").select("set_id", "doc_id", F.coalesce("to", "comp").alias("comp")), "named")
    least = named.groupBy("comp").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nameless"), F.count(F.lit(1)).alias("n"))
    least = written(least.where("n > 1").select("comp", F.when(~F.col("nameless"), F.col("least")).alias("least"), F.lit(True).alias("more")), "least")
    named = named.join(least, "comp", "left").select("set_id", F.when(F.col("more"), F.col("least")).otherwise(F.col("doc_id")).alias("least"), F.lit(True).alias("named"))
    out = sketch.select("doc_id", "n_shingles", "set_id").join(written(named, "named"), "set_id", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("named"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


class _Sides:
    """Two blocks, or one twice, and which of their pairs may be links by size, registers and component."""

    def __init__(self, p: pd.DataFrame, percent: int):
        self.percent, self.inner = percent, p["i"].iloc[0] == p["j"].iloc[0]
        both = (p, p) if self.inner else (p[p["block"] == p["i"]], p[p["block"] == p["j"]])
        self.rows = [x.sort_values("node", ignore_index=True) for x in both]
        self.some = all(len(x) for x in self.rows)
        self.regs = [np.frombuffer(b"".join(x["registers"]), np.uint16).reshape(len(x), BANDS * ROWS).astype(np.int32) for x in self.rows]
        self.n = [x["n_shingles"].to_numpy(np.float64) for x in self.rows]
        self.comp = [x["comp"].to_numpy() for x in self.rows]

    def beside(self, i: int) -> np.ndarray:
        """Rows of the second block that may be linked with row i of the first."""
        n, comp = self.n, self.comp
        may = np.flatnonzero((comp[1] != comp[0][i]) & (100 * np.minimum(n[1], n[0][i]) >= self.percent * np.maximum(n[1], n[0][i])))
        if self.inner:
            may = may[may > i]
        d = self.regs[0][i] - self.regs[1][may]
        equal = (d == 0).sum(1)
        keep = np.flatnonzero(equal >= (self.percent / 100 - 2 * MARGIN) * d.shape[1])
        if not len(keep):
            return keep
        may, d, equal = may[keep], d[keep], equal[keep]
        j = likely((d > 0).sum(1), (d < 0).sum(1), equal, np.full(len(may), n[0][i]), n[1][may])
        return may[j >= self.percent / 100 - MARGIN]


def _maybe(p: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The rows of two blocks, or of one, whose texts are needed: each has a pair that may be a link."""
    s = _Sides(p, percent)
    hits: list[set[int]] = [set(), set()]
    for i in range(len(s.rows[0]) if s.some else 0):
        near = s.beside(i)
        if len(near):
            hits[0].add(int(s.rows[0]["node"].iloc[i]))
            hits[1].update(s.rows[1]["node"].iloc[near].tolist())
    nodes = sorted(hits[0] | hits[1])
    out = pd.DataFrame({"node": nodes}, dtype="int64")
    return out.assign(cluster=p["cluster"].iloc[0], i=p["i"].iloc[0], j=p["j"].iloc[0])[["cluster", "i", "j", "node"]]


def _met(p: pd.DataFrame, percent: int, size: int) -> pd.DataFrame:
    """Links between the components of two blocks, or within one, that no link found before joins."""
    s = _Sides(p, percent)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while x in parent:
            x = parent[x]
        return x

    sets: dict[int, np.ndarray] = {}
    held = 0

    def full(k: int) -> np.ndarray:
        """The set of row k of the second block; what is kept of them is bounded by bytes."""
        nonlocal held
        if k not in sets:
            if held > SETS:
                sets.clear()
                held = 0
            sets[k] = shingle_set(s.rows[1]["text"].iloc[k], size)
            held += sets[k].nbytes
        return sets[k]

    found = []
    for i in range(len(s.rows[0]) if s.some else 0):
        own, one = None, int(s.comp[0][i])
        for k in s.beside(i):
            a, b = root(one), root(int(s.comp[1][k]))
            if a == b:
                continue
            own = shingle_set(s.rows[0]["text"].iloc[i], size) if own is None else own
            if linked(own, full(int(k)), percent):
                parent[max(a, b)] = min(a, b)
                found.append((one, int(s.comp[1][k])))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")
