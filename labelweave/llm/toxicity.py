"""Toxicity by a learnt lexicon, Levenshtein automata over its trie, and the context of each hit.

Fitting takes a bounded, hash-ordered sample of labelled documents. Its lexicon holds words and word stems that tell the
classes apart; a trie of them is intersected with the automaton of one edit, so that a misspelled term is found too, and
the pairs of trie node and edit count that a word reaches are compiled into one deterministic automaton, state by state
as words need them. Hits are weighed by how they stand: within quotation marks or beside words of reporting they count
apart from those that are said outright. A logistic regression over these counts gives the score.

Scoring shuffles nothing: the model is a few hundred terms at most and goes along with the tasks.
Null or empty text: the score of a text without hits. Very long texts are read in whole. Repeated rows are scored alike; a
labelled doc_id with several texts is learnt from the least of them. Without labels of both classes every score is below
one half. Other columns of docs go or, if named in keep, stay; doc_id and score are names of the result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, id_text

#: Most labelled documents of each class that fitting reads, most terms it keeps, bytes, by estimate, of the words that a worker keeps, and the longest of them.
SAMPLE, TERMS, CACHE, LONG = 4000, 400, 192 << 20, 64
#: Shortest stem, least toxic documents that support a term, as a number and as a share of them, least log-odds of a term, and of one that is kept beside others, least length for a misspelling.
STEM, SUPPORT, SHARE, ODDS, SURE, FUZZY = 4, 4, 0.01, 3.5, 5.0, 5
_WORD = re.compile(r"\w+")
_QUOTES = "\"'“”‘’«»„`"
#: Words that report what another said, in the languages of the corpus; fixed values.
_REPORTS = frozenset("said says quoted quote wrote called calls word term insult insulted dit disait cite mot sagte sagt schrieb zitat wort dijo dice cita palabra".split())
WINDOW = 5


class Lexicon:
    """terms: text to whether it is a stem (may go on) or a whole word."""

    def __init__(self, terms: dict[str, bool]):
        self.terms = list(terms)
        self.child: list[dict[str, int]] = [{}]
        self.end: list[tuple[int, bool] | None] = [None]
        self.depth_ok: list[bool] = [False]  # below: a term long enough to be misspelled
        for k, (term, stem) in enumerate(terms.items()):
            at, path = 0, [0]
            for c in term:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.end.append(None)
                    self.depth_ok.append(False)
                at = self.child[at][c]
                path.append(at)
            self.end[at] = (k, stem)
            for n in path:
                self.depth_ok[n] |= len(term) >= FUZZY
        # a state of the automaton: sets of (node, edits), closed under skipped letters; what it has accepted; transitions
        self.states: dict[frozenset, int] = {}
        self.known: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.stem_hit: list[tuple[int, int] | None] = []
        self.word_hit: list[tuple[int, int] | None] = []
        self.start = self._state(frozenset({(0, 0)}))
        self.seen: dict[str, tuple[int, int] | None] = {}
        self.held = 0

    def _state(self, pairs: frozenset) -> int:
        closed = set(pairs)
        for node, edits in pairs:
            if edits == 0 and node and self.depth_ok[node]:
                closed |= {(n, 1) for n in self.child[node].values()}
        key = frozenset(closed)
        if (found := self.states.get(key)) is not None:
            return found
        self.states[key] = len(self.known)
        self.known.append(key)
        self.next.append({})
        ends = sorted((edits, self.end[node][0], self.end[node][1]) for node, edits in key if self.end[node] and (edits == 0 or len(self.terms[self.end[node][0]]) >= FUZZY))
        self.word_hit.append((ends[0][1], ends[0][0]) if ends else None)
        stems = [e for e in ends if e[2]]
        self.stem_hit.append((stems[0][1], stems[0][0]) if stems else None)
        return len(self.known) - 1

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, edits in self.known[state]:
            if (n := self.child[node].get(c)) is not None:
                out.add((n, edits))
            if edits == 0 and node and self.depth_ok[node]:
                out.add((node, 1))  # a letter too many
                out |= {(n, 1) for n in self.child[node].values()}  # another letter
        out = self.next[state][c] = self._state(frozenset(out))
        return out

    def look(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the closest term that word is, or, for stems, begins with; the first letter must be right."""
        state, stem = self.start, None
        for c in word:
            state = self.next[state].get(c, -1) if c in self.next[state] else self._step(state, c)
            if not self.known[state]:
                break
            if (hit := self.stem_hit[state]) and (stem is None or hit[1] < stem[1]):
                stem = hit
        else:
            whole = self.word_hit[state]
            if whole and (stem is None or whole[1] <= stem[1]):
                return whole
        return stem

    def hit(self, word: str) -> tuple[int, int] | None:
        try:
            return self.seen[word]
        except KeyError:
            found = self.look(word)
        if len(word) <= LONG:
            if self.held > CACHE:
                self.seen.clear()
                self.held = 0
            self.seen[word] = found
            self.held += 150 + 2 * len(word)
        return found


@dataclass
class Model:
    terms: dict[str, bool]
    odds: dict[str, float]
    weights: list[float] = field(default_factory=list)
    _lexicon: Lexicon | None = None

    @property
    def lexicon(self) -> Lexicon:
        if self._lexicon is None:
            self._lexicon = Lexicon(self.terms)
        return self._lexicon

    def __getstate__(self):
        return self.__dict__ | {"_lexicon": None}

    def features(self, text: str) -> list[float]:
        """1; said outright: log of 1 + exact hits, misspelled hits, different terms, hits per 100 words; quoted: exact, misspelled."""
        low, lex = text.lower(), self.lexicon
        words = _WORD.findall(low)
        if not any([lex.hit(w) for w in set(words)]):
            return [1.0] + [0.0] * 6
        marks = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(low)]
        plain, fuzzy, quoted, quoted_fuzzy, terms = 0.0, 0.0, 0.0, 0.0, set()
        for i, (a, b, w) in enumerate(marks):
            if (hit := lex.hit(w)) is None:
                continue
            apart = self._quotes(low, marks, i, a, b)
            if hit[1] == 0:
                plain, quoted = plain + (not apart), quoted + apart
            else:
                fuzzy, quoted_fuzzy = fuzzy + (not apart), quoted_fuzzy + apart
            if hit[1] == 0:
                terms.add(hit[0])
        return [1.0, math.log1p(plain), math.log1p(fuzzy), math.log1p(len(terms)), math.log1p(100 * plain / len(words)), math.log1p(quoted), math.log1p(quoted_fuzzy)]

    @staticmethod
    def _quotes(low: str, marks: list, i: int, a: int, b: int) -> bool:
        """Whether the hit stands in quotation marks that open and close within the window, or beside a word of reporting."""
        lo, hi = marks[max(0, i - WINDOW)][0], marks[min(len(marks) - 1, i + WINDOW)][1]
        if any(w in _REPORTS for _, _, w in marks[max(0, i - WINDOW) : i + WINDOW + 1]):
            return True
        return any(q in _QUOTES for q in low[max(0, lo - 1) : a]) and any(q in _QUOTES for q in low[b : hi + 1])

    def score(self, text: str) -> float:
        z = sum(w * x for w, x in zip(self.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _families(vocabulary: list[set[str]]) -> list[bool]:
    """For each set of words, whether it is unlike all before it: near copies would pass a chance word off as a term.

    Two sets are alike if three of eight least hashes agree.
    """
    rng = np.random.default_rng(8)
    salts = [(int(a) | 1, int(b)) for a, b in rng.integers(0, 2**32, (8, 2))]
    seen: dict[tuple[int, int], int] = {}
    out = []
    for k, words in enumerate(vocabulary):
        h = np.array([zlib.crc32(w.encode()) for w in words] or [k], np.uint64)
        least = [(i, int((((h ^ np.uint64(b)) * np.uint64(a)) & np.uint64(2**32 - 1)).min())) for i, (a, b) in enumerate(salts)]
        votes = Counter(seen[x] for x in least if x in seen)
        out.append(not votes or max(votes.values()) < 3)
        for x in least:
            seen.setdefault(x, k)
    return out


def learn_terms(texts: list[str], toxic: list[bool]) -> Model:
    """Words, or the shortest stems, that occur in toxic documents far more often than in the others."""
    counts = {True: Counter(), False: Counter()}
    first = dict(zip([k for k, x in enumerate(toxic) if x], _families([set(_WORD.findall(t.lower())) for t, x in zip(texts, toxic) if x])))
    texts, toxic = [t for k, t in enumerate(texts) if first.get(k, True)], [x for k, x in enumerate(toxic) if first.get(k, True)]
    one: dict[str, str] = {}  # each word once in memory
    vocabulary = [{one.setdefault(w, w) for w in _WORD.findall(t.lower())} for t in texts]
    n = {x: sum(t == x for t in toxic) for x in (True, False)}
    whole = Counter()
    for words, x in zip(vocabulary, toxic):
        if x:
            whole.update(words)
            counts[True].update({w[:k] for w in words for k in range(STEM, min(len(w), 12) + 1)})
    support = max(SUPPORT, SHARE * n[True])
    maybe = {p for p, c in counts[True].items() if c >= support}
    for words, x in zip(vocabulary, toxic):
        if not x:
            counts[False].update({p for w in words for k in range(STEM, min(len(w), 12) + 1) if (p := w[:k]) in maybe})

    def odds(p: str) -> float:
        a, b = counts[True][p], counts[False][p]
        return math.log((a + 0.1) / (n[True] - a + 1)) - math.log((b + 0.1) / (n[False] - b + 1))

    good = {p: o for p in maybe if (o := odds(p)) >= ODDS}
    has = [{p for w in words for k in range(STEM, min(len(w), 12) + 1) if (p := w[:k]) in good} for words, x in zip(vocabulary, toxic) if x]
    gain, cover = Counter(p for d in has for p in d), [0] * len(has)
    strong = max(support, 0.025 * n[True])
    terms: dict[str, bool] = {}
    while len(terms) < TERMS and gain:
        p = max(gain, key=lambda p: (gain[p], len(p), p))  # of equal ones the longest
        if gain[p] < support:
            break
        best = max((w for w in whole if w.startswith(p)), key=lambda w: (whole[w], -len(w), w), default=p)
        terms[best if whole[best] >= 0.9 * counts[True][p] else p] = whole[best] < 0.9 * counts[True][p]
        for x in [x for x in gain if x.startswith(p) or p.startswith(x) and counts[True][x] <= 1.1 * counts[True][p]]:
            del gain[x]
        for i, d in enumerate(has):
            if p in d:
                cover[i] += 1
                if cover[i] == 2:  # found well enough: what else stands in it may be chance
                    gain.subtract(x for x in d if x in gain and (counts[True][x] < strong or good[x] < SURE))
    return Model(terms, {p: good.get(p, ODDS) for p in terms})


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50, stands: np.ndarray | None = None) -> list[float]:
    """Logistic regression by Newton steps, the classes as frequent as they are; stands: for how many documents each row stands."""
    w = np.zeros(x.shape[1])
    n = np.ones(len(y)) if stands is None else stands
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (n * (p - y)) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from rows of labels (doc_id, toxic 0 or 1) and the documents they name: at most `sample` of each class, in an order by hash,
    weighed in the regression by how many labelled documents of the class each stands for.

    The sampled ids are at most 2 * sample and so can be broadcast; their texts, as many, come to the driver.
    """
    named = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = None
    for x in (True, False):
        part = named.where((F.col("toxic") >= 1) if x else (F.col("toxic") < 1)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        some = part if some is None else some.unionByName(part)
    chosen = [(r[0], r[1] >= 1) for r in some.select("doc_id", "toxic").collect()]
    size = {bool(x): n for x, n in named.groupBy(F.col("toxic") >= 1).count().collect()}
    stands = {x: size.get(x, 0) / max(1, sum(t == x for _, t in chosen)) for x in (True, False)}
    ids = docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("_id", named.schema["doc_id"].dataType), T.StructField("_toxic", T.BooleanType())]))
    rows = id_text(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.bool_or("_toxic").alias("_toxic")).collect()
    rows.sort(key=lambda r: r[0])
    texts, toxic = [r[1] for r in rows], [bool(r[2]) for r in rows]
    model = learn_terms(texts, toxic)
    x = np.array([model.features(t) for t in texts]).reshape(len(texts), 7)
    model.weights = fit_weights(x, np.array(toxic, float), stands=np.array([stands[t] for t in toxic])) if 0 < sum(toxic) < len(toxic) else [-5.0] + [0.0] * 6
    return model


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id, keep and score, 0 to 1."""
    import copy

    text = free(docs, "_text")
    rows = docs.select("doc_id", *keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(text))
    schema = rows.drop(text).schema.add("score", "double")
    model = copy.copy(model)
    model._lexicon = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(t) for lo in range(0, b.num_rows, 256) for t in b.column(b.num_columns - 1).slice(lo, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def labelled(labels: DataFrame) -> DataFrame:
    """The labels that fitting may use: crc32 of the doc_id as text, mod 5, is not 0."""
    return labels.where(~held_out())


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
