"""Dictionaries of code words and histograms over them.

Words are counted as (id, scale, word) rows. A dictionary is small by its parameter (substring_count words of a scale at
most), so it goes along with the tasks; a word's nearest entries are found once for each distinct word.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chains

#: Most words of a scale that selection compares with each other on the driver.
MOST = 5000


def words(codes: DataFrame, n: int, normalise: bool = False, training: bool = True) -> DataFrame:
    """(id, scale, word) rows of the windows of (id, scale, code)."""
    make = chains.training_words if training else chains.projection_words
    out = codes.select("id", "scale", F.explode(make(F.col("code"), n)).alias("word"))
    return out.withColumn("word", chains.normalised(F.col("word"))) if normalise else out


def histogram(rows: DataFrame) -> DataFrame:
    """(scale, word, count)."""
    return rows.groupBy("scale", "word").agg(F.count(F.lit(1)).alias("count"))


def grouped_histogram(rows: DataFrame, group: str, groups: list) -> DataFrame:
    """(scale, word, count, group<g>..., idf); idf is the log of groups over groups that have the word."""
    out = rows.groupBy("scale", "word").agg(
        F.count(F.lit(1)).alias("count"),
        *[F.count(F.when(F.col(group) == g, 1)).alias(f"group{g}") for g in groups],
        F.log(F.lit(float(len(groups))) / F.count_distinct(group)).alias("idf"),
    )
    return out


def idf(rows: DataFrame, group: str) -> DataFrame:
    """(scale, word, count, idf) for groups too many to list."""
    n = rows.groupBy("scale").agg(F.count_distinct(group).alias("_n"))
    out = rows.groupBy("scale", "word").agg(F.count(F.lit(1)).alias("count"), F.count_distinct(group).alias("_df"))
    return out.join(F.broadcast(n), "scale").select("scale", "word", "count", F.log(F.col("_n") / F.col("_df")).alias("idf"))


def top_words(hist: DataFrame, n: int | None, score: Column) -> DataFrame:
    """(scale, rank, word, score): the n best of each scale, of equal ones the first by spelling; None keeps all."""
    w = Window.partitionBy("scale").orderBy(F.desc("score"), "word")
    out = hist.withColumn("score", score).withColumn("rank", F.row_number().over(w) - 1)
    return (out if n is None else out.where(F.col("rank") < n)).select("scale", "rank", "word", "score")


def distance_matrix(entries: list[str]) -> np.ndarray:
    a = np.array([list(w.encode()) for w in entries])
    return (a[:, None, :] != a[None, :, :]).sum(2)


def greedy_cover(d: np.ndarray, threshold: float) -> list[int]:
    """Entries that together lie within the threshold of all: always the one that covers most, of equal ones the first."""
    near, left, out = d < threshold, np.ones(len(d), bool), []
    while left.any():
        gain = near[:, left].sum(1)
        best = int(gain.argmax())
        if not gain[best]:
            out += [int(i) for i in np.flatnonzero(left)]
            break
        out.append(best)
        left &= ~near[best]
    return sorted(out)


def medoids(d: np.ndarray, k: int, passes: int = 10, seed: int = 0) -> tuple[list[int], np.ndarray]:
    """(medoids, index of each row's one), the least sum of distances of so many random starts."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(passes):
        m = np.sort(rng.permutation(len(d))[:k])
        while True:
            own = d[:, m].argmin(1)
            new = np.sort([np.flatnonzero(own == c)[d[np.ix_(own == c, own == c)].sum(1).argmin()] if (own == c).any() else m[c] for c in range(len(m))])
            if (new == m).all():
                break
            m = new
        error = d[np.arange(len(d)), m[own]].sum()
        if best is None or error < best[0]:
            best = (error, [int(x) for x in m], own)
    return best[1], best[2]


def shared_counts(d: np.ndarray, picked: list[int]) -> list[float]:
    """For each picked entry, the rows it is nearest to; ties are shared."""
    near = d[:, picked] == d[:, picked].min(1, keepdims=True)
    return [float(x) for x in (near / near.sum(1, keepdims=True)).sum(0)]


def select_entries(d: np.ndarray, method: str, threshold: float = 3, size: int = 100, seed: int = 0) -> tuple[list[int], list[float]]:
    """(entries, counts) by method: vq (a cover within the threshold), cluster (k medoids) or random."""
    if method == "vq":
        picked = greedy_cover(d, threshold)
    elif method == "cluster":
        picked, own = medoids(d, min(size, len(d)), seed=seed)
        return picked, [float((own == c).sum()) for c in range(len(picked))]
    elif method == "random":
        picked = [int(x) for x in np.random.default_rng(seed).permutation(len(d))[:size]]
    else:
        raise ValueError(method)
    return picked, shared_counts(d, picked)


def train(codes: DataFrame, n: int, count: int, selection: str = "tf", method: str = "vq", normalise: bool = False, labels: DataFrame | None = None, **kwargs) -> DataFrame:
    """Dictionary (scale, word_idx, word, count). selection: tf, tfidf-embryos (each id a group) or tfidf-classes (labels: id, label).

    Counting is distributed; the best `count` words of each scale, a parameter, come to the driver for selection, whose
    work grows with their square.
    """
    if not count or count > MOST:
        raise ValueError(f"count is a number up to {MOST}")
    rows = words(codes, n, normalise)
    if selection == "tf":
        best = top_words(histogram(rows), count, F.col("count").cast("double"))
    else:
        group = "id" if selection == "tfidf-embryos" else "label"
        rows = rows if group == "id" else rows.join(labels.select("id", "label"), "id")
        best = top_words(idf(rows, group), count, F.col("count") * F.col("idf"))
    by_scale: dict = {}
    for r in best.orderBy("scale", "rank").collect():
        by_scale.setdefault(r["scale"], []).append(r["word"])
    out = []
    for scale, entries in by_scale.items():
        picked, counts = select_entries(distance_matrix(entries), method, **kwargs)
        out += [(scale, k, entries[i], c) for k, (i, c) in enumerate(zip(picked, counts))]
    kind = codes.schema["scale"].dataType.simpleString()
    return codes.sparkSession.createDataFrame(out, f"scale {kind}, word_idx int, word string, count double")


def nearest_entries(distinct: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(scale, word, word_idx, share): all entries at the least Hamming distance of each word, sharing 1.

    The dictionary comes to the driver, small by its parameter; words are compared with it in Arrow batches.
    """
    entries: dict = {}
    for r in dictionary.orderBy("scale", "word_idx").collect():
        entries.setdefault(r["scale"], ([], []))
        entries[r["scale"]][0].append(r["word_idx"])
        entries[r["scale"]][1].append(list(r["word"].encode()))
    entries = {s: (np.array(k), np.array(w, np.uint8)) for s, (k, w) in entries.items()}

    @F.pandas_udf("array<int>")
    def best(scale: pd.Series, word: pd.Series) -> pd.Series:
        out = []
        for s, w in zip(scale, word):
            k, e = entries[s]
            d = (e != np.frombuffer(w.encode(), np.uint8)).sum(1)
            out.append(k[d == d.min()].tolist())
        return pd.Series(out)

    out = distinct.withColumn("best", best("scale", "word"))
    return out.select("scale", "word", F.explode("best").alias("word_idx"), (1.0 / F.size("best")).alias("share"))


def bag_of_words(codes: DataFrame, dictionary: DataFrame, n: int, normalise: bool = False) -> DataFrame:
    """(id, scale, word_idx, value): shares summed over all windows, each scale of an id adding up to 1; only entries that occur."""
    rows = words(codes, n, normalise, training=False).groupBy("id", "scale", "word").agg(F.count(F.lit(1)).alias("n"))
    near = nearest_entries(rows.select("scale", "word").distinct(), dictionary)
    hist = rows.join(near, ["scale", "word"]).groupBy("id", "scale", "word_idx").agg(F.sum(F.col("n") * F.col("share")).alias("v"))
    return hist.select("id", "scale", "word_idx", (F.col("v") / F.sum("v").over(Window.partitionBy("id", "scale"))).alias("value"))


def vectors(bag: DataFrame, dictionary: DataFrame) -> tuple[list[str], DataFrame]:
    """(names, table of id, features): the bag as arrays over all scales and entries, 0 where there is none."""
    sizes = {r["scale"]: r["n"] for r in dictionary.groupBy("scale").agg(F.count(F.lit(1)).alias("n")).orderBy("scale").collect()}
    base, names = {}, []
    for s, n in sizes.items():
        base[s] = len(names)
        names += [f"s{s:02d}i{k:03d}" for k in range(n)]
    start = F.element_at(F.create_map(*[F.lit(x) for kv in base.items() for x in kv]), F.col("scale"))
    m = bag.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct((start + F.col("word_idx")).cast("int"), "value"))).alias("m"))
    return names, m.select("id", F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("features"))
