"""Feature methods by name: what training prepares is kept with its arguments, so that prediction makes the same features."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import dictionary
from ..sources import listfile


@dataclass
class Prepared:
    """A method, its arguments, the features' names and, for code words, the dictionary."""

    method: str
    args: dict
    names: list[str]
    entries: DataFrame | None = None


def _pregenerated(data: DataFrame, names: list[str] | None = None) -> Prepared:
    return Prepared("pregenerated", {}, names or [c for c in data.columns if c != "id"])


def _chaincode(data: DataFrame, word: int, count: int, labels: DataFrame | None = None, **args) -> Prepared:
    entries = dictionary.train(data, word, count, labels=labels, **args)
    sizes = {r["scale"]: r["count"] for r in entries.groupBy("scale").count().collect()}
    names = [f"s{s:02d}i{k:03d}" for s in sorted(sizes) for k in range(sizes[s])]
    return Prepared("chaincode", {"word": word, "normalise": args.get("normalise", False)}, names, entries)


PREPARE = {"pregenerated": _pregenerated, "chaincode": _chaincode}


def prepare(kind: str, data: DataFrame, **args) -> Prepared:
    """By kind. pregenerated: data has a column for each feature; chaincode: data is (id, scale, code), and a dictionary is trained."""
    if kind not in PREPARE:
        raise ValueError(f"no features by the name of {kind}")
    return PREPARE[kind](data, **args)


def compute(prepared: Prepared, data: DataFrame) -> DataFrame:
    """(id, features) by the prepared method, in the order of its names."""
    if prepared.method == "pregenerated":
        return listfile.features(data, prepared.names)
    bag = dictionary.bag_of_words(data, prepared.entries, prepared.args["word"], prepared.args["normalise"])
    return dictionary.vectors(bag, prepared.entries)[1]


def save(prepared: Prepared, spark: SparkSession, path: str) -> None:
    meta = {"method": prepared.method, "args": prepared.args, "names": prepared.names, "entries": prepared.entries is not None}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    if prepared.entries is not None:
        prepared.entries.write.mode("overwrite").parquet(f"{path}/entries")


def load(spark: SparkSession, path: str) -> Prepared:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return Prepared(meta["method"], meta["args"], meta["names"], spark.read.parquet(f"{path}/entries") if meta["entries"] else None)
