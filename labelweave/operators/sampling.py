"""Samples, balanced classes, folds and synthetic mixtures. A seed and a hash of the id give the order, so results repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import numbered


def order_of(key: str, seed: int = 0) -> Column:
    """A reproducible order by chance: MD5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def subsample(df: DataFrame, size: int | float | str, key: str = "id", seed: int = 0) -> DataFrame:
    """Exactly so many rows; as text with a point, or a float, so large a part of them, rounded to even."""
    part = isinstance(size, float) or isinstance(size, str) and "." in size
    n = round(df.count() * float(size)) if part else int(size)
    return df.orderBy(order_of(key, seed), key).limit(n)


def balanced(df: DataFrame, label: str = "label", key: str = "id", count: int | None = None, seed: int = 0) -> DataFrame:
    """Classes of equal size. Without a count, the size of the smallest; with one, larger classes are sampled down to it
    and smaller ones keep all their rows and repeat some by chance.

    Rows are numbered by ranges, so no class meets in one task as a whole.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    if count is None:
        count = sizes.agg(F.min("_n")).first()[0] or 0
    kept = numbered(df, "_k", label, order_of(key, seed), key).where(F.col("_k") <= count)
    lack = sizes.where(F.col("_n") < count).select(label, "_n", F.explode(F.sequence(F.lit(1), F.lit(count) - F.col("_n"))).alias("_r"))
    pick = lack.select(label, (F.pmod(F.xxhash64(label, "_r", F.lit(seed)), F.col("_n")) + 1).cast("int").alias("_k"))
    return kept.unionByName(kept.join(pick, [label, "_k"]).select(kept.columns)).drop("_k")


def folds(df: DataFrame, k: int, label: str = "label", key: str = "id", seed: int = 0) -> DataFrame:
    """df with fold, 0 to k - 1, each class spread evenly. Rows are numbered by ranges, so no class meets in one task as a whole."""
    return numbered(df, "_n", label, order_of(key, seed), key).withColumn("fold", ((F.col("_n") - 1) % k).cast("int")).drop("_n")


def drawn_class(u: Column, priors: list[float]) -> Column:
    """1 + how many cumulative priors, scaled to end at 1, lie below u."""
    total, acc, out = sum(priors), 0.0, F.lit(1)
    for p in priors:
        acc += p
        out = out + (u > acc / total).cast("int")
    return F.least(out, F.lit(len(priors)))


def mixture(spark: SparkSession, n: int, priors: list[float], means: list[list[float]], sigmas: list[list[float]], feature_dims: int, weight_dims: int, noise_dims: int = 0, seed: int = 0) -> tuple[dict, DataFrame]:
    """(meta, table of id, class and f00...) of a Gaussian mixture; means and sigmas by dimension, then class."""
    dims = len(means)
    if dims != len(sigmas) or dims != feature_dims + weight_dims + noise_dims:
        raise ValueError("dimensions don't add up")
    names = [f"f{d:02d}" for d in range(dims)]
    noise = names[feature_dims + weight_dims :]
    df = spark.range(n).withColumn("class", drawn_class(F.rand(seed), priors))
    at = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("class") - 1)
    df = df.select("id", "class", *[(at(means[d]) + at(sigmas[d]) * F.randn(seed + 1 + d)).alias(names[d]) for d in range(dims)])
    meta = {"priors": priors, "means": means, "sigmas": sigmas, "class_labels": {k: f"C{k:02d}" for k in range(1, len(priors) + 1)}}
    return meta | {"feature_names": names[:feature_dims] + noise, "weight_names": names[feature_dims : feature_dims + weight_dims] + noise, "truth": "class"}, df
