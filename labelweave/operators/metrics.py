"""Confusion matrices, accuracies, agreement and ranking curves, as aggregates that combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import in_ranges, offsets

TINY = 1e-10


def _labels(df: DataFrame, labels: list[int]) -> DataFrame:
    return df.sparkSession.createDataFrame([(int(x),) for x in labels], "label int")


def class_counts(df: DataFrame, labels: list[int], column: str = "label") -> DataFrame:
    """(label, n) for each listed label, 0 too."""
    n = df.groupBy(F.col(column).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return _labels(df, labels).join(n, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def distinct_labels(df: DataFrame) -> DataFrame:
    """Labels that occur as truth or as prediction."""
    return df.select(F.col("truth").alias("label")).union(df.select(F.col("pred").alias("label"))).distinct()


def confusion(df: DataFrame, labels: list[int] | None = None, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """(by, truth, pred, n) over all pairs of labels, 0 too.

    Rows with a label outside the list are dropped or, if strict, an error. Without a list, all labels that occur.
    """
    by, spark = by or [], df.sparkSession
    cells = df.groupBy(*by, F.col("truth").cast("int").alias("truth"), F.col("pred").cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    if labels is None:
        labels = sorted(r[0] for r in distinct_labels(df).where("label is not null").collect())
    elif strict:
        known = F.col("truth").isin(labels) & F.col("pred").isin(labels)
        cells = cells.withColumn("n", F.when(known, F.col("n")).otherwise(F.raise_error(F.lit("a label is not listed")).cast("long")))
    grid = spark.createDataFrame([(int(t), int(p)) for t in labels for p in labels], "truth int, pred int")
    if by:
        grid = df.select(*by).distinct().join(F.broadcast(grid))  # as many rows as there are pairs of labels for each group
    return grid.join(cells, [*by, "truth", "pred"], "left").select(*by, "truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def row_normalised(cm: DataFrame) -> DataFrame:
    """cm with recall and precision of each cell."""
    over = lambda c: F.sum("n").over(Window.partitionBy(c))
    return cm.withColumns({"recall": F.col("n") / (over("truth") + TINY), "precision": F.col("n") / (over("pred") + TINY)})


def accuracy(df: DataFrame, *by: str) -> DataFrame:
    """Share of equal labels, over n + 1e-10."""
    return df.groupBy(*by).agg((F.sum(F.when(F.col("truth") == F.col("pred"), 1).otherwise(0)) / (F.count(F.lit(1)) + TINY)).alias("accuracy"))


def recall_precision(df: DataFrame, labels: list[int]) -> DataFrame:
    """(label, recall, precision), over the support + 1e-10."""
    cm = confusion(df, labels)
    hit = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0))
    r = cm.groupBy(F.col("truth").alias("label")).agg((hit / (F.sum("n") + TINY)).alias("recall"))
    p = cm.groupBy(F.col("pred").alias("label")).agg((hit / (F.sum("n") + TINY)).alias("precision"))
    return r.join(p, "label")


def label_recall(df: DataFrame, labels: list[int], *by: str) -> DataFrame:
    """(by, label, recall), NULL without support; the confusion matrix's rows."""
    cm = confusion(df, labels, list(by))
    hit = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0))
    return cm.groupBy(*by, F.col("truth").alias("label")).agg((hit / F.nullif(F.sum("n"), F.lit(0))).alias("recall"))


def evaluation(df: DataFrame, labels: list[int], *by: str) -> DataFrame:
    """(by, sample_acc, label_acc): trace over sum, and the mean recall of labels with support."""
    inside = df.where(F.col("truth").isin(labels) & F.col("pred").isin(labels))
    sample = inside.groupBy(*by).agg(F.avg((F.col("truth") == F.col("pred")).cast("int")).alias("sample_acc"))
    label = label_recall(df, labels, *by).groupBy(*by).agg(F.avg("recall").alias("label_acc"))
    return sample.join(label, list(by)) if by else sample.join(F.broadcast(label))


def pooled(df: DataFrame, labels: list[int], by: str = "dataset") -> DataFrame:
    """One row over all datasets: sample_acc of the summed matrix, set_acc the mean over datasets, label_acc the mean over labels of the mean over datasets with support."""
    inside = df.where(F.col("truth").isin(labels) & F.col("pred").isin(labels))
    each = inside.groupBy(by).agg(F.sum((F.col("truth") == F.col("pred")).cast("int")).alias("hits"), F.count(F.lit(1)).alias("n"))
    sample = each.agg((F.sum("hits") / F.sum("n")).alias("sample_acc"), F.avg(F.col("hits") / F.col("n")).alias("set_acc"))
    label = label_recall(df, labels, by).groupBy("label").agg(F.avg("recall").alias("recall")).agg(F.avg("recall").alias("label_acc"))
    return sample.join(F.broadcast(label))


def agreement(pairs: DataFrame, labels: list[int]) -> DataFrame:
    """Of two annotators' labels (a, b): n, accuracy over all that both rated, label_acc."""
    df = pairs.select(F.col("a").alias("truth"), F.col("b").alias("pred"))
    known = F.col("truth").isin(labels)
    acc = df.agg(F.count(F.lit(1)).alias("n_both"), F.avg(F.when(known & (F.col("truth") == F.col("pred")), 1.0).otherwise(0.0)).alias("accuracy"))
    return acc.join(F.broadcast(label_recall(df, labels).agg(F.avg("recall").alias("label_acc"))))


def pair_jaccard(df: DataFrame) -> DataFrame:
    """Jaccard coefficient of two partitions over pairs of rows, from one pass of grouping sets."""
    g = df.groupingSets([["truth", "pred"], ["truth"], ["pred"]], "truth", "pred").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    part = lambda k: F.sum(F.when(F.col("g") == k, pairs).otherwise(0.0))
    return g.agg((part(0) / (part(1) + part(2) - part(0) + TINY)).alias("jaccard"))


def histogram(df: DataFrame, value: str, by: str, low: float, high: float, bins: int = 10) -> DataFrame:
    """(by, bin, n): equal bins from low to high, the last one closed."""
    bin_ = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)).cast("int"), F.lit(bins - 1))
    return df.where((F.col(value) >= low) & (F.col(value) <= high)).groupBy(by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _ranked(df: DataFrame, *by: str) -> DataFrame:
    """(by, score, tp, fp) running over distinct scores from the highest; scores are summed up first, so the window has as many rows as there are scores.

    Without groups, scores are dealt out by ranges, and each range goes on from the sums of those before.
    """
    s = df.groupBy(*by, "score").agg(F.sum(F.col("y").cast("long")).alias("p"), F.sum(1 - F.col("y").cast("long")).alias("n"))
    w = lambda *part: Window.partitionBy(*part).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if by:
        return s.select(*by, "score", F.sum("p").over(w(*by)).alias("tp"), F.sum("n").over(w(*by)).alias("fp"))
    s = in_ranges(s, F.desc("score"))
    before = offsets(s.groupBy("_part").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n")), ["_p", "_n"])
    s = s.join(F.broadcast(before), "_part")  # a row for each range
    return s.select("score", (F.sum("p").over(w("_part")) + F.col("_p")).alias("tp"), (F.sum("n").over(w("_part")) + F.col("_n")).alias("fp"))


def roc(df: DataFrame, *by: str) -> DataFrame:
    """(by, score, fpr, tpr) of rows y (0 or 1), score, with the point (0, 0); no rows for a group of one class."""
    r = _ranked(df, *by)
    ends = r.groupBy(*by).agg(F.max("tp").alias("_p"), F.max("fp").alias("_n")).where("_p > 0 and _n > 0")
    r = r.join(ends, list(by)) if by else r.join(F.broadcast(ends))
    start = ends.select(*by, F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(r.select(*by, "score", (F.col("fp") / F.col("_n")).alias("fpr"), (F.col("tp") / F.col("_p")).alias("tpr")))


def precision_recall(df: DataFrame, *by: str) -> DataFrame:
    """(by, score, precision, recall), and a last point of recall 0 with the precision of the highest score."""
    r = _ranked(df, *by)
    ends = r.groupBy(*by).agg(F.max("tp").alias("_p"), F.max("fp").alias("_n")).where("_p > 0 and _n > 0")
    r = r.join(ends, list(by)) if by else r.join(F.broadcast(ends))
    r = r.select(*by, "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("_p")).alias("recall"))
    top = r.groupBy(*by).agg(F.lit(None).cast("double").alias("score"), F.max_by("precision", "score").alias("precision"), F.lit(0.0).alias("recall"))
    return r.unionByName(top)


def area(curve: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """(by, auc) by trapezoids over the points in order of x, then y.

    Without groups, points are dealt out by ranges, and the first of a range follows the last of the one before.
    """
    xy = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    if by:
        before = F.lag(xy).over(Window.partitionBy(*by).orderBy(x, y))
    else:
        curve = in_ranges(curve.select(x, y), x, y)
        ends = curve.groupBy("_part").agg(F.max(xy).alias("_end"))
        ends = ends.select("_part", F.lag("_end").over(Window.orderBy("_part")).alias("_end"))  # a row for each range
        curve = curve.join(F.broadcast(ends), "_part")
        before = F.coalesce(F.lag(xy).over(Window.partitionBy("_part").orderBy(x, y)), F.col("_end"))
    steps = curve.select(*by, x, y, before.alias("_b"))
    return steps.groupBy(*by).agg(F.sum((F.col(x) - F.col("_b.x")) * (F.col(y) + F.col("_b.y")) / 2).alias("auc"))


def average_curve(curves: DataFrame, x: str, y: str, by: str, n: int = 1000) -> DataFrame:
    """(x, y): curves, each linear between its points and constant beyond, averaged on n places from 0 to 1.

    Each piece of a curve makes the places it covers, so work is the number of places, not places times points.
    """
    w = Window.partitionBy(by).orderBy(x, y)
    first, last = F.row_number().over(w) == 1, F.lead(x).over(w).isNull()
    pieces = curves.select(by, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"), first.alias("first"), last.alias("last"))
    at = lambda c: c * (n - 1)
    lo = F.when(F.col("first"), 0).otherwise(F.floor(at(F.col("x0"))).cast("int") + 1)
    hi = F.when(F.col("last"), n - 1).otherwise(F.least(F.floor(at(F.col("x1"))).cast("int"), F.lit(n - 1)))
    g = pieces.withColumn("_k", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))))
    px = F.col("_k") / F.lit(n - 1)
    value = F.when(px <= F.col("x0"), F.col("y0")).when(F.col("last"), F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (px - F.col("x0")) / (F.col("x1") - F.col("x0")))
    return g.groupBy(by, "_k").agg(F.min_by(value, F.col("x0")).alias("v")).groupBy("_k").agg(F.avg("v").alias(y)).select((F.col("_k") / F.lit(n - 1)).alias(x), y)


def grid_scores(cv: DataFrame, *params: str) -> DataFrame:
    """(params, mean, std): scores over datasets, population standard deviation."""
    return cv.groupBy(*params).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def best_point(scores: DataFrame, *params: str) -> DataFrame:
    """The parameters of the highest mean, of equal ones the first in the order of the parameters by name and value."""
    order = [F.asc(p) for p in sorted(params)]
    return scores.orderBy(F.desc("mean"), *order).limit(1)


def grid_table(cv: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    """Mean scores, one parameter down and one across."""
    return cv.groupBy(rows).pivot(columns, values).agg(F.avg("score"))


def argmax(df: DataFrame, key: str, group: str = "class", score: str = "prob") -> DataFrame:
    """(key, group): that of the highest score, of equal ones the smallest."""
    return df.groupBy(key).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(group).alias("g"))).alias("_m")).select(key, F.col("_m.g").alias(group))
