"""Byte-level BPE by a global shuffle of distinct words, and decoding by a join with the token-byte table.

1. Documents are read in chunks. Each chunk lists its distinct pre-tokens with their positions in that list, and each
   document as positions; the table is written, so that both later uses read the same chunks, in buckets, so that the
   documents' positions need no shuffle.
2. The lists are exploded and dealt out by pre-token, so all occurrences of one meet, sorted, and it is encoded once in
   the whole job. A very frequent word comes once from each chunk, not once for each use, so no task gets more than others.
3. The ids go back to their chunks, where each document is put together by position.
4. For decoding, each chunk meets the token-byte table of its vocabulary, which has one row of as many entries as the
   vocabulary has tokens and so can be broadcast.

Null or empty text: no ids. A very long text is a chunk by itself. Repeated rows are encoded each by themselves. Other
columns of docs go; their names clash with nothing.
"""

from __future__ import annotations

import array
import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, id_text, segment_keys, segment_of, small_batches

#: Characters of a chunk (a longer document is a chunk by itself), and rows that the encoder packs together.
CHUNK, PACK = 32_000_000, 400_000
#: Bits of a place that are a position in a chunk's list, and of a chunk's number that count those of a task.
_POS, _SEQ = 30, 12


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def _squeeze(a) -> bytes:
    """Unsigned 32-bit integers, byte plane by byte plane, compressed."""
    import zstandard

    planes = np.ascontiguousarray(np.asarray(a, np.uint32)).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).reshape(-1))


def _spread(b: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def _ragged(flat: np.ndarray, lengths: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows `pick` of a ragged array, flat, and their lengths."""
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    n = lengths[pick].astype(np.int64)
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[pick] - (ends - n), n)
    return flat[at], n


def _chunks(batches: Iterator[pa.RecordBatch], pattern: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    import regex
    from pyspark import TaskContext

    split = regex.compile(pattern).findall
    task, seq = TaskContext.get().partitionId(), 0
    ids: list = []
    lengths: list[int] = []
    stream: list[np.ndarray] = []
    keys: dict[str, int] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal seq, size
        words: dict[str, int] = {}
        flat, n, names = array.array("I"), array.array("I"), list(keys)
        whole = np.concatenate(stream) if stream else np.empty(0, np.uint32)
        keys.clear(), stream.clear()  # the list and the one array hold all of them
        order = np.argsort(-np.bincount(whole, minlength=len(names)), kind="stable")  # frequent segments get small numbers, which pack well
        rank = np.empty(len(names), np.uint32)
        rank[order] = np.arange(len(names), dtype=np.uint32)
        if len(whole):
            np.take(rank, whole, out=whole, mode="clip")
        for k in map(names.__getitem__, order):
            parts = (" " + k,) if k.isalpha() else split(segment_of(k))  # letters behind a space are one pre-token
            n.append(len(parts))
            for w in parts:  # 0 stands for a pre-token that comes for the first time
                known = words.get(w)
                flat.append(0 if known is None else known + 1)
                if known is None:
                    words[w] = len(words)
        if len(words) >= 1 << _POS or seq >= 1 << _SEQ or task >= 1 << (63 - _POS - _SEQ):
            raise OverflowError("a chunk has too many pre-tokens, a task too many chunks, or the job too many tasks to be numbered")
        one = pa.RecordBatch.from_arrays([
            pa.array([(task << _SEQ) + seq], pa.int64()), pa.array([list(words)], pa.list_(pa.string())), pa.array([_squeeze(flat)], pa.binary()), pa.array([_squeeze(n)], pa.binary()),
            pa.array([ids], pa.list_(kind)), pa.array([_squeeze(lengths)], pa.binary()), pa.array([_squeeze(whole)], pa.binary())],
            ["chunk", "words", "part", "parts", "doc_ids", "lengths", "stream"])
        seq, size = seq + 1, 0
        ids.clear(), lengths.clear()
        return one

    for b in batches:
        for lo in range(0, b.num_rows, 256):
            for i, text in zip(b.column(0).slice(lo, 256).to_pylist(), b.column(1).slice(lo, 256).to_pylist()):
                if ids and size + len(text) > CHUNK:
                    yield flush()
                found = segment_keys(text) if text else []
                ids.append(i)
                lengths.append(len(found))
                stream.append(np.fromiter((keys.setdefault(k, len(keys)) for k in found), np.uint32, len(found)))
                size += len(text)
    if ids:
        yield flush()


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Rows of place and pre-token, sorted by the latter, to rows of chunk, positions, numbers of ids and ids."""
    encode = _encoding(path, pattern).encode_ordinary
    last, ids = None, []
    place, flat, n = [], [], []
    rows = 0

    def flush() -> pa.RecordBatch:
        where, lengths, all_ids = np.concatenate(place), np.array(n, np.int64), np.array(flat, np.uint32)
        order = np.argsort(where, kind="stable")
        chunk = where[order] >> _POS
        cuts = np.flatnonzero(np.diff(chunk)) + 1
        out = []
        for part in np.split(order, cuts):
            some, k = _ragged(all_ids, lengths, part)
            out.append((int(where[part[0]] >> _POS), _squeeze(where[part] & ((1 << _POS) - 1)), _squeeze(k), _squeeze(some)))
        cols = list(zip(*out))
        place.clear(), flat.clear(), n.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["chunk", "pos", "n", "ids"])

    for b in batches:
        place.append(b.column(0).to_numpy())
        for w in b.column(1).to_pylist():
            if w != last:
                last, ids = w, encode(w)
            flat += ids
            n.append(len(ids))
        rows += b.num_rows
        if rows >= PACK:
            rows = 0
            yield flush()
    if n:
        yield flush()


def token_bytes(spark: SparkSession, path: str, vocabulary: str) -> DataFrame:
    """The token-byte table: one row for a vocabulary, with the bytes of each id in order."""
    table = ranks(path)
    by_id = [b""] * (max(table.values()) + 1)
    for b, i in table.items():
        by_id[i] = b
    return spark.createDataFrame([(vocabulary, [bytearray(b) for b in by_id])], "vocabulary string, tokens array<binary>")


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """For each row of docs: doc_id, ids (array of int), decoded (binary, from the ids alone).

    rank_file: base64 tokens and ranks; pattern: what a pre-token is.
    """
    spark, field = docs.sparkSession, docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    kind, name = to_arrow_type(field), field.simpleString()
    chunks = id_text(docs).mapInArrow(
        lambda b: _chunks(b, pattern, kind), f"chunk long, words array<string>, part binary, parts binary, doc_ids array<{name}>, lengths binary, stream binary")
    with small_batches(spark):
        chunks = bucketed(chunks.withColumn("vocabulary", F.lit(rank_file)), "chunks", "chunk")
    words = chunks.select("chunk", F.posexplode("words").alias("pos", "word")).select((F.shiftleft("chunk", _POS) + F.col("pos")).alias("place"), "word")
    back = words.repartition("word").sortWithinPartitions("word").mapInArrow(lambda b: _encoded(b, rank_file, pattern), "chunk long, pos binary, n binary, ids binary")
    packs = back.groupBy("chunk").agg(F.collect_list(F.struct("pos", "n", "ids")).alias("packs"))
    whole = chunks.drop("words").join(packs, "chunk", "left")
    whole = whole.join(F.broadcast(token_bytes(spark, rank_file, rank_file)), "vocabulary")
    cols = ["part", "parts", "doc_ids", "lengths", "stream", "packs", "tokens"]
    return whole.select(*cols).mapInArrow(lambda b: _assembled(b, kind), f"doc_id {name}, ids array<int>, decoded binary")


def _assembled(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            row = {c: b.column(c)[i] for c in b.schema.names}
            packs = row["packs"].as_py() or []
            pos = [_spread(p["pos"]) for p in packs]
            order = np.argsort(np.concatenate(pos)) if pos else np.empty(0, np.int64)
            each = np.concatenate([_spread(p["n"]) for p in packs]) if pos else np.empty(0, np.int64)
            flat = np.concatenate([_spread(p["ids"]) for p in packs]) if pos else np.empty(0, np.uint32)
            word_ids, word_n = _ragged(flat, each, order)  # by position in the chunk's list
            part, parts = _spread(row["part"].as_py()).astype(np.int64) - 1, _spread(row["parts"].as_py())
            part[part < 0] = np.arange((part < 0).sum())
            key_ids, _ = _ragged(word_ids, word_n, part)
            key_n = np.add.reduceat(np.concatenate([word_n[part], [0]]), np.concatenate([[0], np.cumsum(parts)[:-1]]).astype(np.int64)) if len(parts) else parts
            doc_ids, lengths, stream = row["doc_ids"].values, _spread(row["lengths"].as_py()).astype(np.int64), _spread(row["stream"].as_py())
            ends = np.cumsum(lengths)
            tokens = row["tokens"].values
            for lo in range(0, len(lengths), 512):
                hi = min(lo + 512, len(lengths))
                first = ends[lo] - lengths[lo]
                ids, n = _ragged(key_ids, key_n, stream[first : ends[hi - 1]])
                total = np.concatenate([[0], np.cumsum(n)])
                cut = np.concatenate([[0], total[ends[lo:hi] - first]]).astype(np.int32)
                decoded = tokens.take(pa.array(ids.astype(np.int64)))
                at = np.frombuffer(decoded.buffers()[1], np.int32)[decoded.offset : decoded.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
                data = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(np.ascontiguousarray(at[cut])), decoded.buffers()[2] if len(ids) else pa.py_buffer(b"")])
                yield pa.RecordBatch.from_arrays([doc_ids.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cut), pa.array(ids.astype(np.int32))), data], ["doc_id", "ids", "decoded"])
