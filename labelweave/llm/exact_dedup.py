"""Exact dedup against a persistent digest index, by DataFrame operations only.

The index is a table bucketed by digest and sorted within buckets, at a path by which any later session finds it again. A
batch of new documents is first reduced to one row per digest (a hash aggregate that combines within each task, so copies
are few rows before they are shuffled), then deduplicated against the index by a sort-merge anti-join, for which the index
needs no shuffle, and what is new is appended in the same layout. Digests that the index held are appended too, as rows
that only count: so the size of a group and its largest doc_id are those of all batches. Two texts count as equal if their
SHA-256 digests are; nothing is normalised.

Null text: the empty one. Very long texts are digested in whole and never shuffled. Of equal texts the largest doc_id
stays; a repeated row with that id stays once. Null doc_id is less than any other. Across batches, what an earlier one
kept stays, as it is out already: fresh() gives nothing for its digest, while groups() tells the largest doc_id so far.
Other columns of docs stay in fresh() and dedup(), whatever their names, and go in groups().
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_GROUP, file_at, free, id_text, shared_dir, written


def digests(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, digest (binary SHA-256 of the UTF-8 text)."""
    return id_text(docs, *more).select("doc_id", *more, F.unhex(F.sha2("text", 256)).alias("digest"))


def grouped(digested: DataFrame) -> DataFrame:
    """One row per digest: keep_id, the largest doc_id, group_size, and copies, how many rows have keep_id."""
    return _best(digested.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("size")))


def _best(rows: DataFrame) -> DataFrame:
    best = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "n")).alias("best"), F.sum("size").alias("group_size"))
    return best.select("digest", F.col("best.doc_id").alias("keep_id"), "group_size", F.col("best.n").alias("copies"))


class DigestIndex:
    """Digests of all documents so far, as a table at path in so many buckets. A path that holds an index is opened as it is, with its own buckets.

    Only one session appends at a time; a batch that fails leaves the index as it was, and one that is appended twice
    counts twice, but keeps no document that it would not have kept.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, name: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}"
        self.name = name or f"labelweave_digests_{hashlib.sha256(self.path.encode()).hexdigest()[:24]}"
        self.buckets, self.kind = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "bigint"
        if self.exists():
            fs, at = file_at(spark, f"{self.path}/_layout.json")
            layout = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(fs.open(at), "UTF-8"))
            self.buckets, self.kind = layout["buckets"], layout["doc_id"]

    def exists(self) -> bool:
        fs, at = file_at(self.spark, f"{self.path}/_layout.json")
        return fs.exists(at)

    def _registered(self) -> str:
        """The table's name, known to this session's catalogue."""
        if not self.spark.catalog.tableExists(self.name):
            columns = f"digest binary, keep_id {self.kind}, group_size bigint, copies bigint, new boolean"
            self.spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        return self.name

    def digests(self) -> DataFrame:
        """Each digest once, in the layout that needs no shuffle by digest."""
        return self.spark.table(self._registered()).where("new").select("digest")

    def read(self) -> DataFrame:
        """digest, keep_id, group_size, copies over all batches; no shuffle."""
        rows = self.spark.table(self._registered()).groupBy("digest", F.col("keep_id").alias("doc_id"))
        return _best(rows.agg(F.sum("copies").alias("n"), F.sum("group_size").alias("size")))

    def append(self, docs: DataFrame) -> None:
        """Deduplicate docs, among themselves and against the index, add the digests that are new and count those that are not."""
        self._add(written(grouped(digests(docs)), "batch"))

    def _add(self, batch: DataFrame) -> None:
        new = batch.withColumn("new", F.lit(True))
        if self.exists():
            new = batch.hint("merge").join(self.digests(), "digest", "left_anti").withColumn("new", F.lit(True))
            held = batch.hint("merge").join(self.digests(), "digest", "left_semi").withColumn("new", F.lit(False))
            new = written(new.unionByName(held), "added")
        else:
            self.kind = batch.schema["keep_id"].dataType.simpleString()
        rows = new.repartition(self.buckets, "digest").write.mode("append").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).format("parquet")
        if self.exists():
            self._registered()
        rows.bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)
        fs, at = file_at(self.spark, f"{self.path}/_layout.json")
        if not fs.exists(at):
            out = fs.create(at)
            out.writeBytes(json.dumps({"buckets": self.buckets, "doc_id": self.kind}))
            out.close()


def _kept(docs: DataFrame, index: DigestIndex) -> tuple[DataFrame, DataFrame]:
    """Of each digest of docs the row that would stay, and those rows of docs, with all columns, whose digest the index lacks."""
    digest, keep = free(docs, "_digest"), free(docs, "_keep")
    marked = docs.withColumns({digest: F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))})
    batch = written(grouped(marked.select("doc_id", F.col(digest).alias("digest"))), "batch")
    kept = batch
    if index.exists():
        kept = written(batch.hint("merge").join(index.digests(), "digest", "left_anti"), "kept")

    def rows_of(some: DataFrame) -> DataFrame:
        ids = some.select(F.col("keep_id").alias(keep), F.col("digest").alias(digest))
        return marked.join(ids, (marked[digest] == ids[digest]) & marked["doc_id"].eqNullSafe(ids[keep]), "left_semi")

    again = kept.where("copies > 1")
    if again.isEmpty():
        return batch, rows_of(kept).select(*docs.columns)
    # only rows that are repeated are brought together
    return batch, rows_of(kept.where("copies = 1")).unionByName(rows_of(again).dropDuplicates(["doc_id", digest])).select(*docs.columns)


def fresh(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Rows of docs that stay, with all columns: of each digest that the index lacks, the one of the largest doc_id.

    The index stays as it is: append() docs once the rows are written, so that a job that fails loses none.
    """
    return _kept(docs, index)[1]


def dedup(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """As fresh(), with docs added to the index at once: for a caller that writes the rows before anything else can fail."""
    batch, rows = _kept(docs, index)
    index._add(batch)
    return rows


def labelled(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """For every row of docs, all of which the index has: doc_id, keep_id, group_size, kept, text_sha256.

    The index's groups are written, so that the join shuffles both sides and Spark can split a digest with very many rows.
    """
    state = written(index.read(), "groups")
    best = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    rows = digests(docs).join(state, "digest", "left").where(~best | (F.col("copies") == 1)).withColumn("kept", best)
    flags = F.concat(F.array(F.lit(True)), F.array_repeat(F.lit(False), F.col("copies").cast("int") - 1))
    again = state.where("copies > 1").select("digest", F.col("keep_id").alias("doc_id"), "keep_id", "group_size", F.explode(flags).alias("kept"))  # repetitions of a kept row
    out = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")]
    return rows.select(*out).unionByName(again.select(*out))


def groups(docs: DataFrame) -> DataFrame:
    """labelled() by way of a new index of docs alone."""
    index = DigestIndex(docs.sparkSession)
    index.append(docs)
    return labelled(docs, index)
