"""Joins by id: aligned, ordered by a list of values, with defaults, first match, and existence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class NotAligned(ValueError):
    """Two tables that should hold the same ids don't."""


def aligned(left: DataFrame, right: DataFrame, on: str | list[str] = "id") -> DataFrame:
    """Inner join of tables that must hold the same keys; a key on one side alone is an error. One job checks it."""
    keys = [on] if isinstance(on, str) else on
    marks = left.select(*keys, F.lit(1).alias("_a")).join(right.select(*keys, F.lit(1).alias("_b")), keys, "full")
    if alone := marks.where("_a is null or _b is null").limit(3).collect():
        raise NotAligned(f"{keys}: {[tuple(r)[: len(keys)] for r in alone]} on one side only")
    return left.join(right, keys)


def with_truth(pred: DataFrame, truth: DataFrame, on: str | list[str] = "id") -> DataFrame:
    """Predictions with the truth of their keys; one that has none is an error, further truth goes."""
    keys = [on] if isinstance(on, str) else on
    return aligned(pred, truth.join(pred.select(*keys), keys, "left_semi"), keys)


def select_ordered(data: DataFrame, values: DataFrame, field: str = "id", order: str = "ord") -> DataFrame:
    """Rows of data whose field is among values (field, ord), in the order of ord; what is missing is skipped. field must be unique in data.

    The result is sorted, so only take it as a whole where an order is needed.
    """
    twice = data.join(values.select(field), field, "left_semi").groupBy(field).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{field} {twice[0][0]} occurs more than once")
    return data.join(values.select(field, order), field).orderBy(order).drop(order)


def present(data: DataFrame, field: str, values: DataFrame) -> DataFrame:
    """Rows whose field is among the values."""
    return data.join(values.select(field).distinct(), field, "left_semi")


def with_default(left: DataFrame, right: DataFrame, on: str, columns: list[str], default: str = "N/A") -> DataFrame:
    """left with columns of right as text, and the default where right has no such row or value."""
    extra = right.select(on, *[F.col(c).cast("string").alias(c) for c in columns])
    return left.join(extra, on, "left").select(*[F.col(c) for c in left.columns], *[F.coalesce(c, F.lit(default)).alias(c) for c in columns])


def with_sentinel(ids: DataFrame, truth: DataFrame, sentinel: int = 255) -> DataFrame:
    """(id, value): label - 1 for each id, the sentinel for one without a label or below 1."""
    value = F.col("label") - 1
    return ids.select("id").join(truth.select("id", "label"), "id", "left").select("id", F.when(value >= 0, value).otherwise(sentinel).cast("int").alias("value"))


def first_match(left: DataFrame, right: DataFrame, on: str, by: list[Column | str]) -> DataFrame:
    """left with the first row of right, in the order `by`, for each key; an aggregate, so copies combine before the shuffle."""
    cols = [c for c in right.columns if c != on]
    best = right.groupBy(on).agg(F.min(F.struct(*by, *[F.col(c).alias(f"_{c}") for c in cols])).alias("_m"))
    return left.join(best.select(on, *[F.col(f"_m._{c}").alias(c) for c in cols]), on)


def any_of(left: DataFrame, right: DataFrame, on: str, flag: Column, name: str) -> DataFrame:
    """left with whether any row of right with its key has the flag; false where there is none."""
    some = right.groupBy(on).agg(F.bool_or(flag).alias(name))
    return left.join(some, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def bad_outline(data: DataFrame, blur: DataFrame, objects: DataFrame, components: DataFrame, limit: float = 1.46128831851) -> DataFrame:
    """data (obj, ...) with blurred, touching and bad_outline, either of them.

    blur: obj, measure; objects: obj, bbox; components: bbox, cut. An object's first row counts.
    """
    out = first_match(data, blur.select("obj", "measure"), "obj", ["measure"]).withColumn("blurred", F.col("measure") < limit).drop("measure")
    out = first_match(out, objects.select("obj", "bbox"), "obj", ["bbox"])
    out = any_of(out, components, "bbox", F.col("cut"), "touching").drop("bbox")
    return out.withColumn("bad_outline", F.col("blurred") | F.col("touching"))


def only_errors(df: DataFrame, truth: str = "truth", pred: str = "pred", prop: str = "prop") -> DataFrame:
    """Rows with a known truth that a prediction, before or after propagation, misses."""
    wrong = lambda c: F.coalesce(F.col(c) != F.col(truth), F.lit(False))
    return df.where(F.col(truth).isNotNull() & (wrong(pred) | wrong(prop)))


def both_rated(a: DataFrame, b: DataFrame, unrated: int = 0) -> DataFrame:
    """(id, a, b): what two annotators both rated."""
    return a.where(F.col("label") != unrated).select("id", F.col("label").alias("a")).join(b.where(F.col("label") != unrated).select("id", F.col("label").alias("b")), "id")


def numbered(df: DataFrame, *by: str) -> DataFrame:
    """df with pos, from 0, within the groups of `by[:-1]` in the order of `by[-1]`."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*by[:-1]).orderBy(by[-1])) - 1)
