"""The queries of this subpackage, opN_<name>, and their SQL for an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, fingerprints, fstcount, neardup, packing, quality, secrets, toxicity
from .common import read

#: Files of public tokenizers.
BYTE_RANKS, BYTE_JSON, PIECES = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe.round_trip(read(spark, sf_dir, "documents"), vocabulary(BYTE_RANKS), public_tokenizers.PATTERN)
    said = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    ratings = toxicity.labelled(read(spark, sf_dir, "labels")).select("doc_id", F.col("quality").alias("grade"))
    out = quality.score(docs, quality.fit(docs, ratings))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "expected_grade", "tail_prob", (F.col("tail_prob") >= 0.5).alias("kept"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def deliveries(docs: DataFrame) -> list[DataFrame]:
    """All rows of docs in two deliveries, as they might come in one after the other: the smaller ids, then the others and those without one."""
    if not (middle := docs.approxQuantile("doc_id", [0.5], 0.01)):
        return [docs]
    early = F.coalesce(F.col("doc_id") < middle[0], F.lit(False))
    return [docs.where(early), docs.where(~early)]


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second delivery meets the index that the first one filled; every row of both is in the result."""
    docs = read(spark, sf_dir, "documents")
    index = exact_dedup.DigestIndex(spark)
    for part in deliveries(docs):
        index.append(part)
    return exact_dedup.labelled(docs, index)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the second delivery only texts that the first one did not hold are scanned; every row of both is in the result."""
    docs = read(spark, sf_dir, "documents")
    ledger = secrets.Ledger(spark)
    for part in deliveries(docs):
        ledger.scan(part)
    found = ledger.findings(docs, "doc_id")
    count = lambda rule: F.size(F.filter("findings", lambda x: x["rule"] == rule)).cast("long").alias(f"n_{rule}")
    return found.select(
        "doc_id", *map(count, secrets.BASE),
        F.sha2(secrets.joined(F.col("findings"), secrets.BASE), 256).alias("base_sha256"),
        secrets.joined(F.col("findings")).alias("spans"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fstcount.count_tokens(read(spark, sf_dir, "documents"), vocabulary(PIECES))
    return n.withColumn("over_limit", F.col("n_tokens") > 4096)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    out = chat.format_conversations(rows.unionByName(own))
    out = out.select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learnt"), F.length("formatted").alias("n"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.col("n").cast("long").alias("formatted_chars"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), vocabulary(BYTE_JSON))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.labelled(read(spark, sf_dir, "labels")))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_quality, op3_fingerprints, op4_exact_dedup, op5_secret_scans, op6_token_counts, op7_minhash_near_dedup, op8_chat_formatting, op9_packing, op10_toxicity)}

ORACLE = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW g AS (PARTITION BY t)""",
    "op7_minhash_near_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
        n AS (SELECT d.doc_id, count(s.s) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY 1),
        e AS (
            SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
            JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * m >= 75 * (na.n + nb.n - m)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
        SELECT n.doc_id, n.n AS n_shingles, c.c AS component_id, c.c = n.doc_id AS kept FROM n JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) c ON c.a = n.doc_id""",
    "op8_chat_formatting": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        r AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS goes_on,
                     length(replace(replace(text, '\', '\b'), '<', '\l')) AS n,
                     length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) AS m FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(n + CASE WHEN goes_on THEN 6 ELSE m + 14 END) AS BIGINT) AS formatted_chars
        FROM r GROUP BY conv_id""",
}
