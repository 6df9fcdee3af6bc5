"""Documents to packed training sequences: toxicity, exact dedup, near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents, and works on all that it is given; all but
the last return those columns, and any others that docs has, whatever their names. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import exact_dedup, neardup, packing, secrets, toxicity
from labelweave.llm.catalogue import BYTE_JSON, vocabulary
from labelweave.llm.common import free, read, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxicity.fit(docs, toxicity.labelled(read(spark, sf_dir, "labels")))
    whole = free(docs, "_row")
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias(whole))
    return toxicity.score(rows, model, whole).where("score < 0.5").select(f"{whole}.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, index: exact_dedup.DigestIndex | None = None) -> DataFrame:
    """Of equal texts the one of the largest doc_id stays, and none whose text the index has."""
    return exact_dedup.fresh(docs, index or exact_dedup.DigestIndex(spark))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one of the smallest doc_id stays."""
    name = free(docs, "_kept")
    kept = neardup.classes(docs).where("kept").select(F.col("doc_id").alias(name))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept[name]), "left_semi")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are overwritten and n_chars counted anew; the documents stay."""
    ledger = secrets.Ledger(spark)
    ledger.scan(docs)
    whole = free(docs, "_row")
    old = lambda c: F.col(f"{whole}.`{c}`")
    found = ledger.findings(docs.select("text", F.struct(*docs.columns).alias(whole)), whole)
    text = secrets.masked(old("text"), F.col("findings"))
    some = F.size("findings") > 0
    new = {"text": F.when(some, text).otherwise(old("text")), "n_chars": F.when(some, F.length(text).cast("long")).otherwise(old("n_chars"))}
    return found.select(*[new.get(c, old(c)).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each packed piece, with its ids."""
    pieces = packing.pack(docs, vocabulary(BYTE_JSON))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "ids")


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near-dedup", drop_near_copies), ("secret scans", mask_secrets), ("packing", pack)]

#: SQL cannot express the toxicity model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, index: exact_dedup.DigestIndex | None = None) -> DataFrame:
    """All stages over documents. An index of earlier corpora takes up this one's digests once its distinct texts are written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        more = {"index": index} if index is not None and stage is drop_copies else {}
        docs = written(stage(spark, docs, sf_dir, **more), name.replace(" ", "-"))
        if more:
            index.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
