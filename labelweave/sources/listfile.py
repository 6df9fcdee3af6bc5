"""List files: tab-separated tables with YAML metadata in comment lines, and what is read from and written to them.

A list file becomes a DataFrame and a dict. Columns are read as strings unless a schema is given, so ids such as 001
stay as they are. `.gz` files are read as they come.
"""

from __future__ import annotations

from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Meta = dict[str, Any]


def read_meta(spark: SparkSession, path: str) -> Meta:
    """YAML of all lines that start with #, wherever they stand."""
    lines = spark.read.text(path).where(F.col("value").startswith("#")).select(F.col("_metadata.file_path").alias("f"), "value")
    return yaml.safe_load("\n".join(r["value"][1:] for r in lines.collect())) or {}


def dump_meta(meta: Meta) -> str:
    """The comment lines for meta, an empty one last."""
    text = yaml.safe_dump(meta, default_flow_style=None, allow_unicode=True, sort_keys=True) if meta else ""
    return "".join(f"#{line}\n" for line in [*text.splitlines(), ""])


def read_args(path: str) -> Meta:
    """Parameters of a method, from a YAML file on the driver."""
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def overlaid(*metas: Meta | None) -> Meta:
    """Later ones win."""
    out: Meta = {}
    for m in metas:
        out |= m or {}
    return out


def cleaned(args: Meta) -> Meta:
    """args without the keys that it names as not to be written."""
    gone = {*args.get("unserialized", ()), "unserialized"}
    return {k: v for k, v in args.items() if k not in gone}


def assert_unique(df: DataFrame, key: str = "id") -> DataFrame:
    """df, once its key has been found to be there and unique; one job."""
    if key not in df.columns:
        raise ValueError(f"no column {key}")
    if twice := df.groupBy(key).count().where("count > 1").limit(3).collect():
        raise ValueError(f"{key} is not unique: {[r[key] for r in twice]}")
    return df


def read_list(spark: SparkSession, path: str, schema: StructType | str | None = None, check: bool = True) -> tuple[Meta, DataFrame]:
    """(meta, table); names in lower case, id unique."""
    reader = spark.read.option("sep", "\t").option("comment", "#").option("header", True).option("enforceSchema", False)
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    return read_meta(spark, path), assert_unique(df) if check else df


def write_list(df: DataFrame, path: str, meta: Meta | None = None, columns: list[str] | None = None, single: bool = False) -> None:
    """TSV below path, id first, and the metadata as a comment-only part beside it, so read_list gets both back."""
    names = ["id", *[c for c in (columns or df.columns) if c != "id"]]
    out = df.select(*[F.col(c).cast("string") for c in names])
    (out.coalesce(1) if single else out).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "part-meta.csv")
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    stream.write(bytearray((dump_meta(cleaned(meta or {})) + "\t".join(names) + "\n").encode()))
    stream.close()


def truth(meta: Meta, df: DataFrame) -> tuple[DataFrame, dict[int, str]]:
    """(id, label) and the labels' names, by the column that meta names as truth."""
    name = meta["truth"]
    return df.select("id", F.col(name).cast("int").alias("label")), meta[f"{name}_labels"]


def features(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(id, features): the named columns, or all but id, as one array of doubles."""
    return df.select("id", F.array(*[F.col(f"`{c}`").cast("double") for c in names or [c for c in df.columns if c != "id"]]).alias("features"))


def weights(df: DataFrame) -> DataFrame:
    """Edges (i, j, d) of a square table whose columns are named by ids; infinite entries are no edges."""
    cols = [c for c in df.columns if c != "id"]
    long = df.select("id", *[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot("id", cols, "j", "d")
    return long.where((F.col("d") < float("inf")) & ~F.isnan("d")).select(F.col("id").cast("string").alias("i"), "j", "d")


def square(edges: DataFrame, ids: list[str]) -> DataFrame:
    """The square table of edges for export; what is no edge is infinite. As wide as there are ids, so for small graphs."""
    wide = edges.groupBy(F.col("i").cast("string").alias("id")).pivot("j", [str(i) for i in ids]).agg(F.first("d"))
    return wide.fillna(float("inf"))


def read_variants(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV files of differing columns and column order, by name; files whose name holds # are left out.

    The header lines, one for each file, are grouped on the driver, then each kind of header is read once.
    """
    from pathlib import PurePosixPath

    kept = sorted(p for p in paths if "#" not in PurePosixPath(p).name)
    if not kept:
        raise RuntimeError("no input files match")
    kinds: dict[str, list[str]] = {}
    lines = spark.read.text(kept).select(F.col("_metadata.file_path").alias("f"), "value", F.monotonically_increasing_id().alias("n"))
    for r in lines.groupBy("f").agg(F.min_by("value", "n").alias("head")).collect():
        kinds.setdefault(r["head"].strip().lower(), []).append(r["f"])
    out = None
    for head, files in sorted(kinds.items()):
        part = spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in head.split(","))).csv(files)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern of the store matches, in order; none is an error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    if not (paths := sorted(f.getPath().toString() for f in found)):
        raise RuntimeError(f"no input files match {pattern}")
    return paths


def read_outlines(spark: SparkSession, blur: str, objects: str, components: str, measure: str = "measure") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Side tables of outlines: (obj, measure) of a list file, (obj, bbox) and (bbox, cut) of files separated by semicolons."""
    csv = lambda p: (d := spark.read.option("sep", ";").option("header", True).csv(p)).toDF(*[c.strip().lower() for c in d.columns])
    table = read_list(spark, blur, check=False)[1]
    cut = F.lower(F.trim("cut")).isin("1", "true", "t", "yes")
    return table.select("obj", F.col(measure).cast("double").alias("measure")), csv(objects).select("obj", "bbox"), csv(components).select("bbox", cut.alias("cut"))


#: Stage names and their labels; None and what is left out below marks rows to drop. Fixed values.
STAGES = {"unknown": None, "stuff": None, "damaged": None, "unfertilized": None, "": None, "1-3": None, "4-6": 1, "7-8": 2, "9-10": 3, "11-12": 4, "13-14": 5, "15-16": 6}
#: Numbers of repeated scans; fixed values.
RESCANS = {"rescan": 1, "rescan2": 2, "rescan3": 3}


def composite_id(dirname: Column, number: Column) -> Column:
    """number + 10000 * (suffix + 100 * (plate + 1000000 * date)) of a folder [..]/yyyymmdd[-rescanN]/plate[~Letter], as DECIMAL(38, 0): it exceeds 64 bits."""
    big = lambda c: c.cast("decimal(38,0)")
    part = lambda group: F.regexp_extract(dirname, r"(?:^|/)([0-9]+)(?:-(rescan[23]?))?/([0-9]+)(?:~([A-Z]))?$", group)
    again = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RESCANS.items() for x in kv]), F.nullif(part(2), F.lit(""))), F.lit(0))
    suffix = F.when(part(4) == "", 0).otherwise(F.ascii(part(4)) - 64)
    date = part(1).cast("long") * 10 + again
    return big(big(number.cast("long")) + big(big(suffix) + big(big(part(3).cast("long")) + big(date) * 1000000) * 100) * 10000)


def relabelled(df: DataFrame, column: str, labels: dict[str, int | None], to: str = "label") -> DataFrame:
    """Rows whose value has a label, with it; a value that labels doesn't know is an error."""
    known = {k: v for k, v in labels.items() if v is not None}
    value = F.coalesce(F.col(column), F.lit(""))
    mapped = F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), value)
    checked = F.when(~value.isin(*labels), F.raise_error(F.concat(F.lit("unknown value "), value)).cast("int")).otherwise(mapped)
    return df.withColumn(to, checked).where(F.col(to).isNotNull())


def converted(rows: DataFrame, truth_column: str | None = "stage", prefix: str = "") -> tuple[Meta, DataFrame]:
    """(meta, table of id, mask, image and the truth) from rows of dirname, metasys_id and a stage, in order of id.

    A folder that all rows share goes to the prefix, else it is put before each file name.
    """
    df = rows.withColumn("id", composite_id(F.col("dirname"), F.col("metasys_id")))
    if truth_column:
        df = relabelled(df, truth_column, STAGES, "_label")
    few = df.select("dirname").distinct().limit(2).collect()
    number = F.lpad(F.col("metasys_id").cast("int").cast("string"), 4, "0")
    name = lambda kind: F.concat(F.lit("obj"), number, F.lit(f"-{kind}.png"))
    put = (lambda c: F.concat_ws("/", "dirname", c)) if len(few) > 1 else (lambda c: c)
    if len(few) == 1:
        prefix += few[0]["dirname"]
    meta: Meta = {"mask_prefix": prefix, "image_prefix": prefix}
    cols = ["id", put(name("mask")).alias("mask"), put(name("bri")).alias("image")]
    if truth_column:
        meta |= {"truth": truth_column, f"{truth_column}_labels": {v: k for k, v in STAGES.items() if v is not None}}
        cols.append(F.col("_label").alias(truth_column))
    return meta, df.select(*cols).orderBy("id")


def split_by_directory(df: DataFrame, path: str) -> None:
    """One folder for each exact dirname."""
    df.write.mode("overwrite").option("header", True).partitionBy("dirname").csv(path)


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content of binary files; decoding is up to the caller, as no image library is at hand."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime", "content")


def newest(df: DataFrame) -> DataFrame:
    """The latest modification time among the files behind df."""
    return df.select(F.max("_metadata.file_modification_time").alias("newest"))


def cached(spark: SparkSession, path: str, build, args: Meta) -> DataFrame:
    """The table that build() makes, kept below path under a key of args, so other args never meet an old result."""
    import hashlib
    import json

    at = f"{path}/{hashlib.sha256(json.dumps(args, sort_keys=True, default=str).encode()).hexdigest()[:16]}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def read_config(path: str) -> dict[str, dict[str, str]]:
    """Sections of an INI file."""
    import configparser

    c = configparser.ConfigParser()
    if not c.read(path):
        raise FileNotFoundError(path)
    return {s: dict(c[s]) for s in c.sections()}
