"""Canonical exact digests of documents, by DataFrame operations only.

A text's canonical form is NFKC of its case-folded NFKC, with each run of white space as one space and none at the ends.
Its digest is two xxhash64 with different seeds. Documents are grouped by it, and inside a group of more than one the
canonical bytes are compared; where they differ, the fingerprints of that group are told apart by a part of the SHA-256
of the canonical text, so equal fingerprints mean equal canonical texts. The likeness of two fingerprints is 1 or 0.

Null text: the empty one. Very long texts go through in whole, one row at a time; other columns of docs go, their names
clash with nothing. doc_id is a whole number. Rows of equal doc_id and text are one document, which gets as many equal rows; documents of
equal doc_id and different text follow each other by a hash of the text; a null doc_id is less than any other.
The id -2**63 is taken for a null one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, written

_LEAST = -(2**63)


def canonical(text: Column) -> Column:
    """ICU, which Spark itself uses for collations, normalises and folds; texts of ASCII alone need only lower case."""
    call = lambda cls, name, c: F.call_function("reflect", F.lit(cls), F.lit(name), c, F.lit(True))
    nfkc = lambda c: call("com.ibm.icu.text.Normalizer", "compose", c)
    full = nfkc(call("com.ibm.icu.lang.UCharacter", "foldCase", nfkc(text)))
    folded = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(full)
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """h1, h2: wide xxhash; s: what tells texts apart should both be equal."""
    return F.struct(F.xxhash64(F.lit(1), canon).alias("h1"), F.xxhash64(F.lit(2), canon).alias("h2"), F.substring(F.sha2(canon, 256), 1, 16).alias("s"))


def _wide(d: Column) -> Column:
    return F.struct(d["h1"].alias("h1"), d["h2"].alias("h2"))


def fingerprint(d: Column, collided: Column) -> Column:
    h = F.lower(F.concat(F.lpad(F.hex(d["h1"]), 16, "0"), F.lpad(F.hex(d["h2"]), 16, "0")))
    return F.when(collided, F.concat(h, F.lit("-"), d["s"])).otherwise(h)


def successors(keys: DataFrame) -> DataFrame:
    """Each row of keys (kid, hash unique) with next_kid, next_hash and next_*: the row that follows in order, the first one after the last.

    Keys alone are sorted by range and numbered through, partition by partition; rows meet their successors by number.
    """
    more = [c for c in keys.columns if c not in ("kid", "hash")]
    nth = F.monotonically_increasing_id()
    k = keys.repartitionByRange("kid", "hash").sortWithinPartitions("kid", "hash")
    k = written(k.select("*", F.shiftright(nth, 33).alias("_part"), nth.bitwiseAND(2**33 - 1).alias("_nth")), "keys")
    parts = k.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    below = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are partitions
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = written(parts.select("_part", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_before"), F.sum("_n").over(everything).alias("_all")), "parts")
    k = k.join(parts, "_part").withColumn("_nth", F.col("_before") + F.col("_nth"))
    to = k.select(F.col("_nth").alias("_next"), F.col("kid").alias("next_kid"), F.col("hash").alias("next_hash"), *[F.col(c).alias(f"next_{c}") for c in more])
    return k.withColumn("_next", (F.col("_nth") + 1) % F.col("_all")).join(to, "_next").drop("_next", "_nth", "_part", "_before", "_all")


def fingerprints(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) characters replaced by the first as many of the next document. Whole
    texts are shuffled once; that exchange is used for both joins, and between them only those first characters move.
    """
    kind = docs.schema["doc_id"].dataType
    d = id_text(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("kid"), F.xxhash64("text").alias("hash"), "text")
    keys = d.select("kid", "hash", F.length("text").alias("n"), digest(canonical(F.col("text"))).alias("own"))
    keys = written(keys.groupBy("kid", "hash", "n", "own").agg(F.count(F.lit(1)).alias("copies")), "digests")
    # written, so that the join shuffles both sides and Spark can split the rows of a digest that very many documents have
    shared = written(keys.groupBy(_wide(F.col("own")).alias("w")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("w", F.lit(True).alias("shared")), "shared")
    asked = keys.drop("copies").withColumn("w", _wide(F.col("own"))).join(shared, "w", "left").drop("w")
    asked = written(successors(asked).drop("next_n", "next_shared"), "successors")
    asked = asked.withColumn("k", F.floor(F.col("n") / 4).cast("int"))
    to = asked.select(F.col("next_kid").alias("kid"), F.col("next_hash").alias("hash"), F.struct("kid", "hash", "n", "k", "own", "next_own", "shared").alias("by"))
    begins = d.join(to, ["kid", "hash"]).select("by.*", F.substring("text", F.lit(1), F.col("by.k")).alias("begin"))
    if not keys.where("copies > 1").isEmpty():
        begins = begins.dropDuplicates(["kid", "hash"])
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - F.col("k")), F.col("begin"))
    # a text's canonical form is made again only where bytes are to be compared; whole texts end here
    whole = d.join(begins, ["kid", "hash"]).withColumns({"edited": edited}).withColumns({"edited_canon": canonical(F.col("edited"))}).withColumns({"changed": digest(F.col("edited_canon"))})
    out = whole.select(
        F.when(F.col("kid") != _LEAST, F.col("kid")).cast(kind).alias("doc_id"), "n", F.sha2("edited", 256).alias("edited_sha256"), "own", "next_own", "changed",
        F.when(F.col("own") == F.col("changed"), canonical(F.col("text")) == F.col("edited_canon")).otherwise(False).alias("same"), F.when(F.col("shared"), canonical(F.col("text"))).alias("bytes"))
    out = written(out, "fingerprints")
    variants = out.where(F.col("bytes").isNotNull()).groupBy(_wide(F.col("own")).alias("w"), "bytes").agg(F.lit(1).alias("_")).groupBy("w").agg(F.count(F.lit(1)).alias("_n"))
    collided = written(variants.where("_n > 1").select("w"), "collided")
    flags = {}
    if not collided.isEmpty():
        for side in ("own", "changed"):
            out = out.join(collided.select(F.col("w").alias(f"_w_{side}"), F.lit(True).alias(f"_{side}")), _wide(F.col(side)) == F.col(f"_w_{side}"), "left")
            flags[side] = F.coalesce(F.col(f"_{side}"), F.lit(False))
    flag = lambda side: flags.get(side, F.lit(False))
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256",
        fingerprint(F.col("own"), flag("own")).alias("fingerprint"), fingerprint(F.col("changed"), flag("changed")).alias("edited_fingerprint"),
        F.col("same").cast("double").alias("near_edited"), (F.col("own") == F.col("next_own")).cast("double").alias("near_next"))
