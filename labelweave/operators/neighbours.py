"""All-pairs joins and nearest neighbours within datasets.

Pairs are met in blocks: rows are dealt to blocks by hash, and each pair of blocks of a dataset is one equi-join key, so
the work of one large dataset spreads over all tasks and neither side is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels

#: Rows of a block that are compared with another block's at a time, and fewest blocks of a table, so that there are tasks.
BLOCK, FEWEST = 1024, 4
#: Rows of a block that are compared with BLOCK of another at a time, and whose pairs leave together; fewer at a time are subtracted: what numpy holds then stays near the caches.
TALL, STEP = 64, 16
#: Pairs that come before they are turned round: Parquet's snappy then stores a distance once (256 bytes, of longer runs some are missed), and its run lengths an id.
RUN = 32
#: Pairs of rows that are worth a task, and most tasks.
WORTH, TASKS = 1 << 20, 10_000
#: Rows of a block where pairs or only least distances leave it as they are found, rows of it that go into one matrix product (8 MB), and pairs that are looked at again at a time.
WIDE, STRIP, MANY = 4096, 256, 1 << 14
#: Bytes of the vectors that rows are compared with in one task of knn, fewest and most columns of them that go into one matrix product (8 MB).
STRIPE, FIRST, LAST = 1 << 25, 1024, 4096
#: Keeps the deal of blocks apart from samples that were drawn by the plain hash of the id.
_SALT = 77


def blocks_for(n: int) -> int:
    """Blocks of a dataset of n rows: none much over BLOCK rows, whatever n."""
    return max(FEWEST, -(-n // BLOCK))


def _blocks(df: DataFrame, by: str, blocks: int | None) -> int:
    """blocks, or as many as the largest dataset needs; one count."""
    return blocks or blocks_for(df.groupBy(by).count().agg(F.max("count")).first()[0] or 0)


def _block(df: DataFrame, key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(_SALT), df[key]), F.lit(blocks)).cast("int")


def block_pairs(left: DataFrame, right: DataFrame, by: str, key: str, blocks: int, half: bool = False) -> DataFrame:
    """Every row of left beside every row of right of the same `by`, columns prefixed a_ and b_.

    half: left and right are one table; each unordered pair of rows comes once, and no row beside itself.
    """
    a, b = (df.select(F.col(by).alias("_by"), _block(df, key, blocks).alias("_own"), *[F.col(c).alias(f"{side}_{c}") for c in df.columns]) for df, side in ((left, "a"), (right, "b")))
    over = F.sequence(F.col("_own") if half else F.lit(0), F.lit(blocks - 1))
    under = F.sequence(F.lit(0), F.col("_own") if half else F.lit(blocks - 1))
    a = a.withColumn("_j", F.explode(over)).withColumnRenamed("_own", "_i")
    b = b.withColumn("_i", F.explode(under)).withColumnRenamed("_own", "_j")
    out = a.join(b, ["_by", "_i", "_j"])
    if half:
        out = out.where((F.col("_i") < F.col("_j")) | (F.col(f"a_{key}") < F.col(f"b_{key}")))
    return out.drop("_by", "_i", "_j")


def _grid_of_blocks(df: DataFrame, by: str, key: str, value: str, blocks: int) -> DataFrame:
    """Each row once for each block that its own one meets, as (by, i, j) with i <= j, and whether it is of block i."""
    rows = df.select(F.col(by).alias("dataset"), _block(df, key, blocks).alias("_own"), F.col(key).alias("id"), F.col(value).alias("features"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return rows.select("dataset", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), (F.col("_own") <= F.col("_other")).alias("_first"), "id", "features")


def distances(df: DataFrame, f, by: str = "dataset", key: str = "id", value: str = "features", blocks: int | None = None, other: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(by, i, j, d): f of all pairs, of one table both ways round with 0 for itself, or of df with other.

    Of one table each unordered pair of rows is computed once and mirrored. Measures that kernels.blockwise knows are computed
    block by block by numpy, others as expressions. Where f gives a struct (d, flip), flip is a column too, I for a row
    and itself. digits: d is rounded to so many, once for a pair and its mirror.
    """
    if kernels.blockwise(f):
        return _distances_of_blocks(df, other, f, by, key, value, blocks, digits)
    blocks = _blocks(df, by, blocks)
    if digits is not None:
        return distances(df, f, by, key, value, blocks, other).withColumn("d", F.round("d", digits) + F.lit(0.0))
    right = other if other is not None else df
    pairs = block_pairs(df.select(by, key, value), right.select(by, key, value), by, key, blocks, half=other is None)
    out = pairs.select(F.col(f"a_{by}").alias(by), F.col(f"a_{key}").alias("i"), F.col(f"b_{key}").alias("j"), f(F.col(f"a_{value}"), F.col(f"b_{value}")).alias("d"))
    flips = isinstance(out.schema["d"].dataType, T.StructType)
    d = ["d.d", "d.flip"] if flips else ["d"]
    if other is not None:
        return out.select(by, "i", "j", *d)
    both = out.select(by, F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p"), "d").select(by, "p.i", "p.j", *d)
    itself = df.select(by, F.col(key).alias("i"), F.col(key).alias("j"), F.lit(0.0).alias("d"), *([F.lit("I").alias("flip")] if flips else []))
    return both.unionByName(itself)


def _full(c: Column, kind: T.DataType) -> Column:
    """Whether an array, and each array in it, holds no NULL."""
    return F.coalesce(F.forall(c, lambda x: _full(x, kind.elementType)), F.lit(False)) if isinstance(kind, T.ArrayType) else c.isNotNull()


def _rectangle_of_blocks(df: DataFrame, other: DataFrame, by: str, key: str, value: str, blocks: int):
    """Each row of df beside each block of other, and the other way round, as (by, i, j); features are NULL where any number in them is."""
    sides = []
    for t, first in ((df, True), (other, False)):
        features = F.when(_full(F.col(value), t.schema[value].dataType), F.col(value))
        rows = t.where(F.col(by).isNotNull()).select(F.col(by).alias("dataset"), _block(t, key, blocks).alias("_own"), F.lit(first).alias("_first"), F.col(key).alias("id"), features.alias("features"))
        each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        sides.append(rows.withColumn("_j", each).withColumnRenamed("_own", "_i") if first else rows.withColumn("_i", each).withColumnRenamed("_own", "_j"))
    return sides[0].unionByName(sides[1])


def _stacked(t: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """ids, arrays of any depth as one (empty ones left out), and which rows have one."""
    a = t["features"].combine_chunks()
    ids, there = t["id"].combine_chunks(), np.asarray(a.is_valid())
    a, shape = a.drop_null(), [int(there.sum())]
    while pa.types.is_list(a.type) or pa.types.is_large_list(a.type):
        sizes = pc.list_value_length(a).to_numpy(zero_copy_only=False)
        if len(sizes) and sizes.min() != sizes.max():
            raise ValueError(f"vectors of {sizes.min()} and of {sizes.max()} numbers")
        shape.append(int(sizes[0]) if len(sizes) else 0)
        a = a.flatten()
    return ids, a.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(shape), there


def _met(df: DataFrame, other: DataFrame | None, by: str, value: str, blocks: int | None) -> tuple[int, int]:
    """Blocks, and tasks for what meets between them: 0 where there is little. One count.

    A row moves once for each block that its own one meets, so blocks are as large as WIDE, or STRIPE bytes of vectors.
    """
    sides = [df] if other is None else [df, other]
    kind, sizes = df.schema[value].dataType.elementType, []
    numbers = F.size(F.flatten(value) if isinstance(kind, T.ArrayType) else F.col(value))
    for k, t in enumerate(sides):
        sizes.append(t.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.max(numbers).alias("_f")).select(by, *[F.lit(0).alias(f"_{j}") if j != k else F.col("_n").alias(f"_{j}") for j in range(len(sides))], "_f"))
    each = sizes[0] if other is None else sizes[0].unionByName(sizes[1]).groupBy(by).agg(F.max("_0").alias("_0"), F.max("_1").alias("_1"), F.max("_f").alias("_f"))
    a, b = F.col("_0").cast("double"), F.col("_0" if other is None else "_1").cast("double")
    most, pairs, datasets, long = each.agg(F.max(F.greatest(a, b)), F.sum(a * b), F.count(F.lit(1)), F.max("_f")).first()
    side = min(WIDE, max(BLOCK, STRIPE // (8 * max(1, long or 0))))
    blocks = blocks or max(FEWEST, -(-int(most or 0) // side))
    tasks = int(min((pairs or 0) // WORTH, 2 * datasets * blocks * (blocks + 1), TASKS))
    return blocks, max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if tasks > 1 else 0


def _distances_of_blocks(df: DataFrame, other: DataFrame | None, f, by: str, key: str, value: str, blocks: int | None, digits: int | None) -> DataFrame:
    f, alone = kernels.blockwise(f), other is None
    probe = f(*[np.zeros((1, 1, 1) if isinstance(df.schema[value].dataType.elementType, T.ArrayType) else (1, 1))] * 2)
    flips = isinstance(probe, tuple)
    kinds = [df.schema[by].dataType.simpleString(), df.schema[key].dataType.simpleString(), (df if alone else other).schema[key].dataType.simpleString()]
    names = [by, "i", "j", "d"] + ["flip"] * flips
    letters = pa.array(list(kernels.FLIPS))

    def of(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        if flips:
            return f(x, y)
        return np.concatenate([f(x[lo : lo + STEP], y) for lo in range(0, len(x), STEP)]), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of TALL rows with BLOCK others at a time, so the pairs of two blocks are never held together.

        Of one table RUN pairs of a row come, then the same turned round.
        """
        t = pa.Table.from_batches(batches)
        inner = alone and t["_i"][0] == t["_j"][0]
        t = t.sort_by("id")
        a = t if inner else t.filter(t["_first"])
        ids, x, xs = _stacked(a)
        jds, y, ys = (ids, x, xs) if inner else _stacked(t.filter(pc.invert(t["_first"])))
        name = t["dataset"][:1].combine_chunks().take(pa.array(np.zeros(2 * TALL * BLOCK, dtype=int)))
        row, column = np.cumsum(xs) - 1, np.cumsum(ys) - 1
        codes = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False)  # in the order of the ids
        every, after = (ids if inner else pa.concat_arrays([ids, jds])) if alone else None, 0 if inner else len(ids)

        def batch(i: pa.Array, j: pa.Array, d: np.ndarray, none: np.ndarray | None, flip: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([name[: len(d)], i, j, pa.array(d, mask=none)] + [letters.take(pa.array(flip))] * flips, names=names)

        if inner:
            for lo in range(0, len(ids), TALL):
                n = len(ids[lo : lo + TALL])
                yield batch(ids[lo : lo + n], ids[lo : lo + n], np.zeros(n), None, np.full(n, kernels.FLIPS.index("I"), dtype=np.int8))
        for left in range(0, len(jds), BLOCK):
            c = np.arange(left, min(left + BLOCK, len(jds)))
            order = np.argsort(np.concatenate([c // RUN * 2 + k for k in range(1 + alone)]), kind="stable")
            for lo in range(0, min(len(ids), c[-1]) if inner else len(ids), TALL):
                r = np.arange(lo, min(lo + TALL, len(ids)))
                there, others = xs[r], ys[c]
                whole = there.all() and others.all()
                d, flip = np.zeros((len(r), len(c))), np.zeros((len(r), len(c)), dtype=np.int8)
                if there.any() and others.any():
                    got = of(x[row[r[there]]], y[column[c[others]]])
                    where = np.ix_(there, others)
                    d[where] = got[0] if digits is None else kernels.half_up(got[0], digits)
                    if flips:
                        flip[where] = got[1]
                own = None
                if inner and not (codes[r[-1]] < codes[c[0]] if flips else r[-1] < c[0]):  # each pair once, as between blocks; images of one id are none
                    own = codes[r][:, None] < codes[c] if flips else r[:, None] < c
                    if not own.any():
                        continue

                mine = None if own is None else np.concatenate([own, own], 1)[:, order]  # of one table, so turned round too

                def spread(v: np.ndarray, turned: np.ndarray | None = None) -> np.ndarray:
                    """What is of pairs and, by default the same, of pairs turned round, in the order they leave."""
                    w = np.concatenate([v, v if turned is None else turned], 1)[:, order] if alone else v  # noqa: B023
                    return w.ravel() if mine is None else w[mine]

                near, far = (np.broadcast_to(v, d.shape).astype(np.int32) for v in (r[:, None], c + (after if alone else 0)))
                i, j = (ids if every is None else every).take(pa.array(spread(near, far))), (jds if every is None else every).take(pa.array(spread(far, near)))
                yield batch(i, j, spread(d), None if whole else spread(~(there[:, None] & others)), spread(flip))

    blocks, tasks = _met(df, other, by, value, blocks)
    if alone:
        whole = df.where(F.col(by).isNotNull()).withColumn(value, F.when(_full(F.col(value), df.schema[value].dataType), F.col(value)))
        grid = _grid_of_blocks(whole, by, key, value, blocks)
    else:
        grid = _rectangle_of_blocks(df, other, by, key, value, blocks)
    if tasks:
        grid = grid.repartition(tasks, "dataset", "_i", "_j")
    return grid.groupBy("dataset", "_i", "_j").applyInArrow(run, f"{by} {kinds[0]}, i {kinds[1]}, j {kinds[2]}, d double" + ", flip string" * flips)


def _near(x: np.ndarray, y: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Strip by strip of x: rows of x, rows of y and their squared Euclidean distances, by row of x, with all that may be among the k nearest of it.

    A matrix product finds which may be, so far as its rounding can tell; only those are subtracted and squared. Where numbers
    aren't finite, these are all pairs.
    """
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    plain, doubt = not np.isfinite(xx.sum() + yy.sum()), 1e-14 * (x.shape[1] + 8) * (xx + yy.max())  # far above the error of either way
    for lo in range(0, len(x), STRIP):
        part = slice(lo, lo + STRIP)
        if plain:
            may = np.ones((len(x[part]), len(y)), dtype=bool)
        else:
            rough = yy - 2 * (x[part] @ y.T)  # the row's own square is the same for all
            kth = rough.min(1) if k == 1 else np.partition(rough, k - 1, axis=1)[:, k - 1]
            may = rough <= (kth + doubt[part])[:, None]
        r, c = np.nonzero(may)
        r += lo
        yield r, c, np.concatenate([((x[r[at : at + MANY]] - y[c[at : at + MANY]]) ** 2).sum(1) for at in range(0, len(r), MANY)])


def _least(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row of x the least squared Euclidean distance of a row of y, NaN where there is no other."""
    return np.concatenate([np.fmin.reduceat(d, np.flatnonzero(np.diff(r, prepend=-1))) for r, _, d in _near(x, y, 1)])


def least(df: DataFrame, other: DataFrame, by: str = "dataset", key: str = "id", value: str = "features", blocks: int | None = None) -> DataFrame:
    """(by, i, n, d): for each i of df with what the same dataset has in other, the number of pairs and the least squared Euclidean distance.

    What distances(df, ..., other=other) gives, summed up where blocks meet, so what moves is a row for each i and block and
    never a row for each pair. A vector that is NULL or holds one counts, at no distance.
    """
    blocks = blocks or max(FEWEST, -(-(df.unionByName(other).groupBy(by).count().agg(F.max("count")).first()[0] or 0) // WIDE))
    kinds = [df.schema[c].dataType.simpleString() for c in (by, key)]

    def run(t: pa.Table) -> pa.Table:
        ids, x, xs = _stacked(t.filter(t["_first"]))
        jds, y, _ = _stacked(t.filter(pc.invert(t["_first"])))
        there, d = np.zeros(len(ids), dtype=bool) | (xs & (len(y) > 0)), np.zeros(len(ids))
        if there.any():
            d[there] = _least(x, y)
        n = len(ids) if len(jds) else 0
        columns = [t["dataset"].combine_chunks().take(pa.array(np.zeros(n, dtype=int))), ids[:n], pa.array(np.full(n, len(jds), dtype=np.int64)), pa.array(d[:n], mask=~there[:n])]
        return pa.Table.from_arrays(columns, names=[by, "i", "n", "d"])

    met = _rectangle_of_blocks(df, other, by, key, value, blocks).groupBy("dataset", "_i", "_j").applyInArrow(run, f"{by} {kinds[0]}, i {kinds[1]}, n long, d double")
    return met.groupBy(by, "i").agg(F.sum("n").alias("n"), F.min("d").alias("d"))


def nearest(edges: DataFrame, k: int = 5, symmetric: str | None = None, by: str = "dataset") -> DataFrame:
    """The k edges of least d from each i, of equal ones those of the smallest j. i itself is among them where it is an edge.

    symmetric: None leaves them as they are; union adds each edge's reverse; intersection keeps those found from both ends.
    """
    w = Window.partitionBy(by, "i").orderBy("d", "j")
    kept = edges.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).select(by, "i", "j", "d")
    if symmetric is None:
        return kept
    if symmetric == "union":
        both = kept.select(by, F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p"), "d")
        return both.groupBy(by, F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(F.min("d").alias("d"))
    if symmetric == "intersection":
        turned = kept.select(by, F.col("j").alias("i"), F.col("i").alias("j"), "d")
        return kept.join(turned.select(by, "i", "j"), [by, "i", "j"])
    raise ValueError(f"symmetric is None, union or intersection, not {symmetric!r}")


def _closest(x: np.ndarray, y: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Strip by strip of x: rows of x, for each the k nearest rows of y, of equal ones the first, and their squared Euclidean distances.

    Columns come in growing chunks, in their order. A matrix product finds which of a chunk may be nearer than the k found so
    far, so far as its rounding can tell; only those are subtracted and squared. Vectors that aren't finite meet all others.
    """
    m, sizes = min(k, len(y)), [(t * t).sum(1) for t in (x, y)]
    (xx, yy), (oddx, oddy) = sizes, [~(t < 1e300) for t in sizes]
    doubt = 1e-14 * (x.shape[1] + 8) * (xx + yy[~oddy].max(initial=0.0))  # far above the error of either way
    left = np.column_stack([np.where(oddx[:, None], 0.0, -2 * x), np.ones(len(x))])  # the row's own square is the same for all
    right = np.column_stack([np.where(oddy[:, None], 0.0, y), np.where(oddy, np.inf, yy)]).T
    edges = [0]
    while edges[-1] < len(y):
        edges.append(min(len(y), edges[-1] + min(LAST, max(FIRST, edges[-1]))))
    for lo in range(0, len(x), STRIP):
        part = slice(lo, lo + STRIP)
        n = len(xx[part])
        most, found = np.full(n, np.inf), [np.empty(0, dtype=int), np.empty(0, dtype=int), np.empty(0)]
        for start, stop in zip(edges, edges[1:]):
            rough = left[part] @ right[:, start:stop]
            if not start and m < stop:
                most = np.partition(rough, m - 1, axis=1)[:, m - 1] + doubt[part]
            may = rough <= most[:, None]
            may[oddx[part]] = True
            may[:, oddy[start:stop]] = True
            r, c = np.nonzero(may)
            if not len(r):
                continue
            a, b = r + lo, c + start
            d = np.concatenate([((x[a[at : at + MANY]] - y[b[at : at + MANY]]) ** 2).sum(1) for at in range(0, len(r), MANY)])
            r, c, d = (np.concatenate(t) for t in zip(found, (r, b, d)))
            order = np.lexsort((c, d, r))
            r, c, d = r[order], c[order], d[order]
            count = np.bincount(r, minlength=n)
            first = np.cumsum(count) - count
            near = np.arange(len(r)) - first[r] < m
            full = count >= m
            kth = d[first[full] + m - 1]
            most[full] = np.where(kth == 0, -np.inf, np.where(np.isnan(kth), np.inf, kth - xx[part][full] + doubt[part][full]))  # nothing after k copies is nearer
            found = [r[near], c[near], d[near]]
        yield found[0] + lo, found[1], found[2]


def knn(df: DataFrame, k: int = 5, symmetric: str | None = None, blocks: int | None = None) -> DataFrame:
    """nearest() by squared Euclidean distance of (dataset, id, features), fused with the distances. Ids are of any type that has an order.

    A task compares a block of rows with a stripe of the dataset, so many bytes of vectors at most (one count), so what it
    holds doesn't grow with the dataset. It gives only the k nearest of each row, so what is shuffled is k rows for a row and
    stripe, and each vector once for each block and stripe; not all pairs. Grouped Arrow batches: products of matrices are
    what numpy does best. blocks: so many blocks, and stripes, instead.
    """
    stripes = blocks
    if blocks is None:
        most, numbers = df.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("f")).agg(F.max("n"), F.max("f")).first()
        wide = max(FIRST, STRIPE // (8 * max(1, numbers or 0)))
        blocks, stripes = max(2 * FEWEST, -(-(most or 0) // max(FIRST, wide // 4))), max(1, -(-(most or 0) // wide))
    rows = df.select("dataset", F.col("id"), "features")
    block, stripe, every = _block(df, "id", blocks), _block(df, "id", stripes), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = rows.select("*", block.alias("_i"), F.lit(True).alias("_first")).withColumn("_j", every(stripes))
    others = rows.select("*", stripe.alias("_j"), F.lit(False).alias("_first")).withColumn("_i", every(blocks))
    kinds = [df.schema[c].dataType.simpleString() for c in ("dataset", "id")]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        (ids, x, xs), (jds, y, ys) = (_stacked(s) for s in (t.filter(t["_first"]), t.filter(pc.invert(t["_first"]))))
        if not (xs.all() and ys.all()):
            raise ValueError(f"a row of dataset {t['dataset'][0]} has no vector")
        with np.errstate(invalid="ignore"):
            found = list(_closest(x, y, k)) if len(x) and len(y) else []
        r, c, d = (np.concatenate(p) for p in zip(*found)) if found else (np.empty(0, dtype=int), np.empty(0, dtype=int), np.empty(0))
        name = t["dataset"].combine_chunks().take(pa.array(np.zeros(len(r), dtype=int)))
        return pa.Table.from_arrays([name, ids.take(pa.array(r)), jds.take(pa.array(c)), pa.array(d)], names=["dataset", "i", "j", "d"])

    met = own.unionByName(others).groupBy("dataset", "_i", "_j").applyInArrow(run, f"dataset {kinds[0]}, i {kinds[1]}, j {kinds[1]}, d double")
    return nearest(met, k, symmetric)


def report(edges: DataFrame, truth: DataFrame, pred: DataFrame | None = None, prop: DataFrame | None = None, k: int = 10, by: str = "dataset", errors: bool = False) -> DataFrame:
    """(by, id, truth, prediction, propagated, neighbours) for ids with a truth; neighbours is an array, nearest first, N/A where nothing is known.

    truth, pred, prop: (by, id, label).
    """
    info = truth.select(by, "id", F.col("label").cast("string").alias("truth"))
    for name, t in (("prediction", pred), ("propagated", prop)):
        info = info.join(t.select(by, "id", F.col("label").cast("string").alias(name)), [by, "id"], "full") if t is not None else info.withColumn(name, F.lit(None).cast("string"))
    near = nearest(edges, k, by=by)
    other = info.select(by, F.col("id").alias("j"), *[F.coalesce(c, F.lit("N/A")).alias(c) for c in ("prediction", "propagated", "truth")])
    near = near.join(other, [by, "j"], "left")
    cell = F.struct("d", F.col("j").alias("id"), *[F.coalesce(c, F.lit("N/A")).alias(c) for c in ("prediction", "propagated", "truth")])
    lists = near.groupBy(by, F.col("i").alias("id")).agg(F.sort_array(F.collect_list(cell)).alias("neighbours"))
    known = info.where(F.col("truth").isNotNull())
    if errors:
        miss = lambda c: F.coalesce(F.col(c) != F.col("truth"), F.lit(False))
        known = known.where(miss("prediction") | miss("propagated"))
    return known.join(lists, [by, "id"], "left")
