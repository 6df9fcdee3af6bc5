"""Tables between steps, in the folder that the driver and all executors share, and rows numbered without a task that holds them all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine, where that is unset, a folder of our own. A cluster without it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='labelweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df computed once; a lost executor costs tasks of later steps only, and the plan starts anew."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """df as a table bucketed and sorted by keys: joins by them read it where it lies, and only the other side moves.

    The catalogue knows the table only until its plan has been made.
    """
    spark, own = df.sparkSession, uuid.uuid4().hex
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"labelweave_{own}"
    out = df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("compression", "zstd").option("path", f"{shared_dir(spark)}/bucketed-{own}")
    out.format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def in_ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with _part, computed once: its rows dealt to partitions by ranges of the order, equal ones together, _part rising with it."""
    return kept(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def offsets(parts: DataFrame, sums: list[str], *by: str) -> DataFrame:
    """parts (_part, by, sums), a row for each range, with the sums over earlier ranges in their place."""
    below = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    return parts.select("_part", *by, *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(c) for c in sums])


def numbered(df: DataFrame, name: str, by: str, *order: Column | str) -> DataFrame:
    """df with row numbers from 1 within each value of by, in the order given.

    Ranges are numbered each by itself and moved on by the sizes of those before, so a value that all rows share spreads
    over all tasks. What is broadcast has a row for each range and each value that begins or goes on in it: at most as many
    as there are ranges and values together.
    """
    rows = in_ranges(df, by, *order)
    before = offsets(rows.groupBy("_part", by).agg(F.count(F.lit(1)).alias("_before")), ["_before"], by)
    own = F.row_number().over(Window.partitionBy("_part", by).orderBy(*order))
    before = before.withColumnRenamed(by, "_by").withColumnRenamed("_part", "_range")
    joined = rows.withColumn("_own", own).join(before, (F.col("_part") == F.col("_range")) & F.col(by).eqNullSafe(F.col("_by")))
    return joined.select(*df.columns, (F.col("_own") + F.col("_before")).alias(name))
