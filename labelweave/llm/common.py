"""Helpers that the text operators share: input columns, the shared folder, and segment cutting."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a row group of tables between steps: a writer holds one in memory.
ROW_GROUP = 16 << 20


#: Rows and bytes of a batch of whole texts on its way to Python, which the JVM and the worker both hold.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is computed within hands texts to Python in batches of BATCH; the session's own settings return afterwards."""
    own = {k: spark.conf.get(k, None) for k in BATCH}
    try:
        for k, v in BATCH.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in own.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text of docs, a null text as the empty one; other columns go."""
    return docs.select("doc_id", *more, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def free(df: DataFrame, name: str) -> str:
    """name, with as many lines before it as make it differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def file_at(spark: SparkSession, path: str):
    """The store of path, and path, as Spark's own readers see them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or, on one machine, a folder of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='labelweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that every later use reads the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """df written as a table in the shared folder and read back, without what the planner knew of its partitioning."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, what: str, key: str) -> DataFrame:
    """df written as a table bucketed by key in the shared folder: a join by key reads it where it lies and shuffles the other side alone.

    The catalogue knows the table only until its plan has been made; the files stay.
    """
    spark, own = df.sparkSession, uuid.uuid4().hex
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"labelweave_{what}_{own}", f"{shared_dir(spark)}/{what}-{own}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).option("path", path).bucketBy(n, key).format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


#: White space of the pre-token pattern (the Unicode property White_Space); fixed values.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD = re.compile(f" (?=[{SPACES}])| \\Z|\0")
_CUT = re.compile(f"(?= [^{SPACES}])")


def segment_keys(text: str) -> list[str]:
    """text cut before each space that a non-space follows, where every byte-level pre-token pattern also cuts.

    A key stands for its segment: a space and the key, or, behind a leading NUL, the rest of the key as it is.
    """
    if _ODD.search(text):
        return ["\0" + x for x in _CUT.split(text) if x]
    keys = text.split(" ")
    if keys[0]:
        keys[0] = "\0" + keys[0]
        return keys
    return keys[1:]


def segment_of(key: str) -> str:
    return key[1:] if key[:1] == "\0" else " " + key
