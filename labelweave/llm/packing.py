"""Packing by power-of-two decomposition: no sequence holds tokens of two documents and none needs padding.

A document's token ids, with the end id, are cut into as many pieces of max_len as fit and then into pieces whose
lengths are the powers of two in the binary form of what is left, the longest first. Each piece is a sequence by
itself; bucket is the base-2 logarithm of its length, by which batches of equal lengths are formed. Nothing is shuffled:
pieces and buckets follow from each document alone, so one hot source or very long document moves no other row.

Null or empty text: one piece that holds the end id. Very long texts are encoded in parts and packed whole. Repeated rows
are packed each by themselves. Other columns of docs go; their names clash with nothing.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

#: Characters of a text that are encoded at once where it can be cut, and bytes of ids that are gathered before they go out.
PART, HELD = 1 << 18, 1 << 24
#: What a byte-level pre-tokenizer takes for one pre-token; fixed value.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def _tokenizer(path: str):
    """The library's tokenizer, the strings of its added tokens, and a faster encoder where the file allows one."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return tok, [x.content for x in tok.get_added_tokens_decoder().values()], _ranked(path)


def _letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 is itself, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranked(path: str):
    """tiktoken's encoding of the same tokens, if ids rank merges and nothing but plain byte-level BPE is asked for; else None."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor")
    plain = plain and not spec.get("truncation") and not spec.get("padding") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    if not plain or any(model["vocab"].get(m) != 256 + k for k, m in enumerate(merges)):
        return None
    letters = _letters()
    added = {x["content"] for x in spec.get("added_tokens") or []}
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    return tiktoken.Encoding("packing", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(merges) else None


def _parts(text: str) -> Iterator[str]:
    """A long text cut before spaces that letters stand on both sides of, where pre-tokens end; one without them stays whole."""
    lo = 0
    while len(text) - lo > PART:
        at = text.find(" ", lo + PART)
        while at >= 0 and not (text[at - 1].isalpha() and text[at + 1 : at + 2].isalpha()):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[lo:at]
        lo = at
    yield text[lo:] if lo else text


def encoder(path: str) -> Callable[[str], list[np.ndarray]]:
    """A function from a text to its ids as tokenizers gives them, in unsigned 32-bit arrays.

    tiktoken does the work, which has the same pre-tokens and merges and takes a third of the time. Texts that hold the
    string of an added token, and parts that its expressions give up on, such as a million spaces, go to the library.
    """
    tok, added, fast = _tokenizer(path)

    def library(text: str) -> np.ndarray:
        return np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(text: str) -> list[np.ndarray]:
        if fast is None or any(x in text for x in added):
            return [library(text)]
        out = []
        for part in _parts(text):
            try:
                out.append(fast.encode_to_numpy(part, disallowed_special=()).astype(np.uint32, copy=False))
            except ValueError:
                out.append(library(part))
        return out

    return encode


def pieces(n: int, max_len: int) -> Iterator[tuple[int, int]]:
    """Start and length of each piece of n tokens; max_len is a power of two."""
    start = 0
    while n - start >= max_len:
        yield start, max_len
        start += max_len
    left, size = n - start, max_len
    while left:
        size >>= 1
        if left & size:
            yield start, size
            start += size
            left -= size


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, max_len: int = 2048) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, bucket, sequence_id, offset, ids (packed little-endian uint32).

    tokenizer: a file of the tokenizers library. sequence_id is unique; offset is 0, as each sequence is one piece.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, encode = np.array([end_id], np.uint32), encoder(tokenizer)
        for batch in batches:
            ids = batch.column(0)
            row, start, length, total, data, held = [], [], [], [], [], 0

            def flush() -> pa.RecordBatch:
                """The pieces of a document follow each other, so their ids are one run of bytes."""
                at = np.concatenate([[0], np.cumsum(length)]) * 4
                whole = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.concatenate(data))])
                return pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), whole.cast(pa.binary())], ["doc_id", "start", "length", "doc_tokens", "ids"])

            for lo in range(0, batch.num_rows, 256):
                for i, text in enumerate(batch.column(1).slice(lo, 256).to_pylist(), lo):
                    own = [*encode(text), end]
                    n = sum(map(len, own))
                    data += own
                    held += n
                    for s, k in pieces(n, max_len):
                        row.append(i)
                        start.append(s)
                        length.append(k)
                        total.append(n)
                    if 4 * held > HELD or len(data) > 2000:
                        yield flush()
                        held = 0
                        for x in (row, start, length, total, data):
                            x.clear()
            if row:
                yield flush()

    out = id_text(docs).mapInArrow(run, f"doc_id {kind.simpleString()}, start long, length long, doc_tokens long, ids binary")
    return out.select(
        "doc_id", "start", "length", "doc_tokens", F.log2("length").cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids",
    )
