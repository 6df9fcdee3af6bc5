"""Token counts by a finite-state transducer compiled from a BPE vocabulary of pieces.

The transducer reads a text character by character. The token that ends at a position is the longest piece there that the
encoding up to its start can stand before, which is decided for pairs of pieces alone. So all that the merges can still
depend on is the longest suffix that starts a piece, and, for each position within it, the last token of the encoding up
to there and how its count compares with the present one: that is a state. They are finitely many, as pieces are of
bounded length; equal ones are one object, compiled as texts reach them as long as there is room. Each transition carries the change in the number
of tokens, and a text's count is the sum over its path. A path keeps its state only.

Where no piece has two neighbouring characters side by side, as before a space, nothing merges across: the transducer is
back in its first state, which is called a reset. Sums of paths from reset to reset are kept for short words.

A chunk of text is a map of states: what stands before its first reset, the count from there to its last reset, and what
stands behind. Whatever the state before the chunk, its map gives the count and the state behind. Such maps compose
associatively. Long texts are cut into chunks that different tasks read; maps are composed in groups of neighbours by
tasks of their own, then the groups' maps of a document, as a scan does. Only text without any reset, such as one letter
a million times, is carried along in a map as text, and so meets in the document's last task.

Null or empty text: 0 tokens. Repeated rows are counted each by themselves. Other columns of docs go; their names clash
with nothing.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

SPACE = "\u2581"
#: Bytes, by estimate, of words' counts and of nodes that a worker keeps, then it starts anew; of compiled states, beyond which others are followed without
#: being kept: memory is bounded, not results. Longest word kept.
WORDS, NODES, STATES, WORD = 160 << 20, 160 << 20, 24 << 20, 64
#: Characters of a chunk, and maps that one task composes: FAN * FAN chunks are more than the longest string has.
CHUNK, FAN = 1 << 16, 256


class _Node:
    """What the characters just read can still be part of: the longest of their suffixes that starts a piece.

    ends: for each piece (or single character) that ends here, the longest first, its length, id, count and the answers known about what fits before it.
    """

    __slots__ = ("ends", "next", "text")

    def __init__(self, text: str):
        self.text, self.next, self.ends = text, {}, []


class _State:
    """A node, and for each position from the start of its text to its end the last token up to there and that count less the present one."""

    __slots__ = ("less", "next", "node", "tokens")

    def __init__(self, node: _Node, tokens: tuple[int, ...], less: tuple[int, ...]):
        self.node, self.tokens, self.less = node, tokens, less
        self.next: dict[str, tuple[_State, int]] = {}


class Transducer:
    """Pieces with scores (the higher is merged first); a character outside them counts as its UTF-8 bytes. Compiled as texts reach its states."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.prefixes = {p[:i] for p in scores for i in range(1, len(p) + 1)}
        self.beside = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.held = self.size = self.compiled = 0
        self.root = _Node("")
        self.nodes: dict[str, _Node] = {"": self.root}
        self.pieces: dict[str, tuple[int, int, int, dict[int, bool]]] = {}
        self.names: list[str] = []
        self.first = _State(self.root, (-1,), (0,))
        self.states = {("", (-1,), (0,)): self.first}

    def merged(self, text: str) -> list[str]:
        """Encoding of a short text by its definition: merge the adjacent pair of the highest score, the leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def piece(self, text: str) -> tuple[int, int, int, dict[int, bool]]:
        """Length, id, count, answers. Id -1 stands for nothing before the piece."""
        if (found := self.pieces.get(text)) is None:
            known = {-1: len(text) == 1 or self.merged(text) == [text]}
            found = self.pieces[text] = (len(text), len(self.names), 1 if text in self.scores else len(text.encode()), known)
            self.names.append(text)
            self.size += 600
        return found

    def step(self, at: _Node, c: str) -> _Node:
        text = at.text + c
        while text and text not in self.prefixes:
            text = text[1:]
        if (node := self.nodes.get(text)) is None:
            node = self.nodes[text] = _Node(text)
            node.ends = [self.piece(text[i:]) for i in range(len(text) - 1) if text[i:] in self.scores]
            if text:
                node.ends.append(self.piece(text[-1]))
            self.size += 500
        if not text:  # a character that starts no piece: its own end, reached by its own transition
            node = _Node("")
            node.next, node.ends = self.root.next, [self.piece(c)]
        at.next[c] = node
        self.size += 100
        return node

    def fits(self, before: int, piece: int) -> bool:
        """Whether the encoding of both texts side by side is these two pieces."""
        a, b = self.names[before], self.names[piece]
        self.size += 100
        return self.merged(a + b) == [a, b]

    def follow(self, at: _State, c: str) -> tuple[_State, int]:
        """The transition by c, compiled: the next state, and by how much the count changes."""
        node = at.node.next.get(c) or self.step(at.node, c)
        for n, piece, count, known in node.ends:
            before = at.tokens[-n]
            ok = known.get(before)
            if ok is None:
                ok = known[before] = self.fits(before, piece)
            if ok:
                break
        change = at.less[-n] + count
        kept = len(at.tokens) - len(node.text)
        key = (node.text, (*at.tokens[kept:], piece), (*[x - change for x in at.less[kept:]], 0))
        if (state := self.states.get(key)) is None:
            state = self.states[key] = _State(node, *key[1:])
            self.compiled += 600 + 32 * len(key[1])
        at.next[c] = state, change
        self.compiled += 200
        return state, change

    def onward(self, at: _State, text: str, i: int) -> int:
        """What text adds from position i on, by the same transitions, without keeping states."""
        tokens, counts, node = list(at.tokens), list(at.less), at.node
        for c in text[i:]:
            node = node.next.get(c) or self.step(node, c)
            for n, piece, count, known in node.ends:
                before = tokens[-n]
                ok = known.get(before)
                if ok is None:
                    ok = known[before] = self.fits(before, piece)
                if ok:
                    break
            tokens.append(piece)
            counts.append(counts[-n] + count)
            if len(tokens) > 4096:  # what a state holds is left
                del tokens[: -1 - len(node.text)], counts[: -1 - len(node.text)]
        return counts[-1]

    def run(self, text: str) -> int:
        """Sum of the transitions' counts over text, from the first state."""
        state, n = self.first, 0
        for i, c in enumerate(text):
            to = state.next.get(c)
            if to is None:
                if self.compiled > STATES:
                    return n + self.onward(state, text, i)
                to = self.follow(state, c)
            state, change = to
            n += change
        return n

    def reset(self, text: str, lo: int = 1) -> int:
        """The first reset at or behind position lo, or the end of text."""
        beside = self.beside
        for i in range(lo, len(text)):
            if text[i - 1 : i + 1] not in beside:
                return i
        return len(text)

    def last_reset(self, text: str) -> int:
        """The last reset, or 0."""
        return next((i for i in range(len(text) - 1, 0, -1) if text[i - 1 : i + 1] not in self.beside), 0)

    def word(self, text: str) -> int:
        """Count of a text that starts and ends at a reset; sums of short ones are kept."""
        if len(text) <= WORD:
            n = self.words[text] = self.run(text)
            self.held += 160 + 2 * len(text)
            return n
        n, lo = 0, 0
        while lo < len(text):
            hi = self.reset(text, lo + 1)
            n += self.run(text[lo:hi])
            lo = hi
            if self.size > NODES:
                self.forget()
        return n


@functools.cache
def transducer(path: str) -> Transducer:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    return Transducer({p.id_to_piece(i): p.get_score(i) for i in ids})


_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def words(text: str) -> list[str]:
    """Parts of a text with visible spaces, each with the spaces before it; a part ends at a reset, as no piece has a space behind another character."""
    return _WORD.findall(text)


def total(t: Transducer, parts: list[str]) -> int:
    """Count of parts that each start and end at a reset."""
    try:
        cache = t.words
        return sum([cache[w] for w in parts])
    except KeyError:
        pass
    if t.held > WORDS or t.size > NODES:
        t.forget()
    n, cache = 0, t.words
    for w in parts:
        k = cache.get(w)
        if k is None:
            k = t.word(w)
            cache = t.words
        n += k
    return n


Map = tuple[str, int, str | None]


def chunk_map(t: Transducer, text: str) -> Map:
    """(head, count, tail) of a chunk: what stands before the first reset, the tokens up to the last one, what follows. tail is None if there is no reset."""
    first = t.reset(text)
    if first >= len(text):
        return text, 0, None
    last = t.last_reset(text)
    return text[:first], total(t, words(text[first:last])), text[last:]


def compose(t: Transducer, a: Map, b: Map) -> Map:
    """The map of two neighbouring chunks; associative, ("", 0, None) is neutral. The text at the seam may hold resets of its own."""
    if a[2] is not None and b[2] is not None:
        return a[0], a[1] + total(t, words(a[2] + b[0])) + b[1], b[2]
    head, count, tail = chunk_map(t, (a[0] if a[2] is None else a[2]) + b[0])
    if a[2] is None and b[2] is None:
        return head, count, tail
    if a[2] is None:
        return (head, b[1], b[2]) if tail is None else (head, count + total(t, words(tail)) + b[1], b[2])
    return (a[0], a[1], head) if tail is None else (a[0], a[1] + total(t, words(head)) + count, tail)


def folded(t: Transducer, maps: list[Map]) -> Map:
    """The maps of neighbouring chunks as one, pair by pair, level by level."""
    while len(maps) > 1:
        maps = [compose(t, *maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0] if maps else ("", 0, None)


def tokens(t: Transducer, whole: Map) -> int:
    """Tokens of a text by its map, from the first state."""
    return total(t, words(whole[0])) + whole[1] + total(t, words(whole[2] or ""))


def composed(t: Transducer, maps: list[Map]) -> int:
    """Tokens of the text that the maps of its chunks make up."""
    return tokens(t, folded(t, maps))


def count(t: Transducer, text: str) -> int:
    """Tokens of a whole text: a space goes before it, as the library puts one."""
    if not text:
        return 0
    if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
        return total(t, words(SPACE + text.replace(" ", SPACE)))
    return total(t, [*map(SPACE.__add__, text.split(" "))])


def count_tokens(docs: DataFrame, model: str, chunk_chars: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of docs. model: a file of sentencepiece, BPE with byte fallback.

    Texts of over chunk_chars characters are cut and their chunks dealt out to all tasks; the others stay where they are read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = id_text(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    long = F.length("text") > chunk_chars
    row = f"row struct<doc_id:{kind},hash:long,nth:long>, n_bytes long, k int"
    state = ["head", "count", "tail"]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for b in batches:
            n = [count(t, x) for lo in range(0, b.num_rows, 256) for x in b.column(2).slice(lo, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text = SPACE + b.column(2)[i].as_py().replace(" ", SPACE)
                for lo in range(0, len(text), 64 * chunk_chars):
                    parts = [text[at : at + chunk_chars] for at in range(lo, min(len(text), lo + 64 * chunk_chars), chunk_chars)]
                    at = pa.array([i] * len(parts), pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(range(lo // chunk_chars, lo // chunk_chars + len(parts)), pa.int32()), pa.array(parts, pa.string())], ["row", "n_bytes", "k", "part"])

    def as_maps(b: pa.RecordBatch, maps: list[Map]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *[pa.array([m[c] for m in maps], x) for c, x in enumerate(kinds)]], ["row", "n_bytes", "k", *state])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for b in batches:
            yield as_maps(b, [chunk_map(t, x.as_py()) for x in b.column(3)])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for b in batches:
            yield as_maps(b, [folded(t, [tuple(x[c] for c in state) for x in m.as_py()]) for m in b.column(3)])

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for b in batches:
            n = [tokens(t, tuple(b.column(c)[i].as_py() for c in (2, 3, 4))) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    few = rows.where(~long).select("doc_id", "n_bytes", "text").mapInArrow(short, f"doc_id {kind}, n_bytes long, n_tokens long")
    name = F.struct("doc_id", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("nth"))  # a document's chunks share it
    chunks = rows.where(long).select(name.alias("row"), "n_bytes", "text").mapInArrow(cut, f"{row}, part string")
    maps = chunks.repartition("row", "k").mapInArrow(mapped, f"{row}, head string, count long, tail string")
    for _ in range(2):
        near = maps.groupBy("row", "n_bytes", F.expr(f"k div {FAN}").cast("int").alias("group")).agg(F.sort_array(F.collect_list(F.struct("k", *state))).alias("maps"))
        maps = near.select("row", "n_bytes", F.col("group").alias("k"), "maps").mapInArrow(join, f"{row}, head string, count long, tail string")
    many = maps.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", *state).mapInArrow(end, f"doc_id {kind}, n_bytes long, n_tokens long")
    return few.unionByName(many)
