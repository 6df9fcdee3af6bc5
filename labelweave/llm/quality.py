"""Quality by ordinal regression: hashed-text weights shared by all grades, and ordered thresholds between them.

The cumulative-link model says P(grade > k) = 1 / (1 + exp(threshold_k - w.x)) for each step k between neighbouring
grades, with one w and thresholds that rise. It yields the expected grade and the probability of the tail from a chosen
grade on, by which documents are selected. x holds relative frequencies of hashed byte trigrams and a few shape figures.

Fitting reads a bounded, hash-ordered sample of rated documents, in which each grade weighs as much as all its rated
documents; with two grades the model is a logistic regression.
Scoring shuffles nothing and reads whole texts, very long ones too. Null or empty text: x is 0, the score follows from the
thresholds. Repeated rows are scored alike; a doc_id that is rated and has several texts is learnt from the least of them.
Without any rating, scores are null; with a single grade, that is the expected one and sure. Other columns of docs go;
their names clash with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_text

#: Hashed dimensions, shape figures, and the most rated documents of each grade that fitting reads.
DIMS, SHAPES, SAMPLE = 1 << 16, 5, 2000
SCALE = 40.0


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct dimensions of a text and their values."""
    x = np.frombuffer(text.encode(), np.uint8)
    n = len(x) - 2
    if n < 1:
        return np.empty(0, np.int64), np.empty(0)
    v = x.astype(np.uint32)
    h = ((v[:-2] << 16 | v[1:-1] << 8 | v[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    at, count = np.unique(h, return_counts=True)
    letters = ((x | 32) >= 97) & ((x | 32) <= 122) | (x >= 128)
    shape = [1.0, len(at) / n**0.5 / 10, ((x >= 65) & (x <= 90)).mean(), (~letters & (x > 32)).mean() * 2, (x <= 32).mean()]
    return np.concatenate([at.astype(np.int64), DIMS + np.arange(SHAPES)]), np.concatenate([SCALE * count / n, shape])


@dataclass
class Model:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str) -> np.ndarray:
        """P(grade > k) for each step between grades; falls from step to step."""
        at, value = features(text)
        return 1 / (1 + np.exp(np.clip(self.thresholds - self.weights[at] @ value, -40, 40)))


def fit_sparse(rows: list[tuple[np.ndarray, np.ndarray]], grades: list[int], ridge: float = 1e-3, rounds: int = 150, rate: float = 0.3, weights: list[float] | None = None) -> Model:
    """Likelihood of the grades by Adam; thresholds are a first one and positive gaps, so they stay in order.

    weights: for how many documents each row stands, one if not given.
    """
    levels = sorted(set(grades))
    y = np.searchsorted(levels, grades)
    k = len(levels) - 1
    if k < 1:
        return Model(levels, np.zeros(DIMS + SHAPES), np.zeros(0))
    row = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    at, value = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows])
    p = np.zeros(DIMS + SHAPES + k)  # weights, first threshold, logs of the gaps
    part = np.ones(len(y)) if weights is None else np.array(weights, float)
    part /= part.sum()
    share = np.array([(y > j) @ part for j in range(k)])
    start = np.log((1 - share) / share)
    p[DIMS + SHAPES] = start[0]
    p[DIMS + SHAPES + 1 :] = np.log(np.maximum(np.diff(start), 1e-2))
    m, v = np.zeros_like(p), np.zeros_like(p)
    side = y[:, None] > np.arange(k)[None, :]
    for t in range(1, rounds + 1):
        gaps = np.exp(p[DIMS + SHAPES + 1 :])
        theta = p[DIMS + SHAPES] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(row, p[at] * value, len(rows))
        over = 1 / (1 + np.exp(np.clip(theta[None, :] - z[:, None], -40, 40)))
        upper = np.concatenate([np.ones((len(y), 1)), over, np.zeros((len(y), 1))], 1)
        i = np.arange(len(y))
        like = np.maximum(upper[i, y] - upper[i, y + 1], 1e-9)
        slope = np.concatenate([np.zeros((len(y), 1)), over * (1 - over), np.zeros((len(y), 1))], 1)
        dz = -(slope[i, y] - slope[i, y + 1]) / like * part
        d_theta = np.zeros(k)
        for j in range(k):  # a threshold bears on the grades on either side of it
            d_theta[j] = (np.where(y == j + 1, slope[:, j + 1], 0) - np.where(y == j, slope[:, j + 1], 0)) @ (part / like)
        g = np.concatenate([np.bincount(at, dz[row] * value, DIMS + SHAPES) + ridge * p[: DIMS + SHAPES], [d_theta.sum()], np.cumsum(d_theta[::-1])[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= rate / (1 + t / 50) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    gaps = np.exp(p[DIMS + SHAPES + 1 :])
    return Model(levels, p[: DIMS + SHAPES], p[DIMS + SHAPES] + np.concatenate([[0], np.cumsum(gaps)]))


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from ratings (doc_id, grade): at most `sample` documents of each grade, in an order by hash, weighed by how many it stands for; a repeated rating counts with its highest grade."""
    named = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    chosen: list = []
    stands: dict[int, float] = {}
    for g, n in named.groupBy("grade").count().collect():
        some = named.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
        chosen, stands[g] = chosen + some, n / max(1, len(some))
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], T.StructType([T.StructField("_id", named.schema["doc_id"].dataType), T.StructField("_grade", T.IntegerType())]))
    rows = id_text(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_grade").alias("_grade")).collect()
    rows.sort(key=lambda r: r[0])
    return fit_sparse([features(r[1]) for r in rows], [r[2] for r in rows], weights=[stands[r[2]] for r in rows])


def score(docs: DataFrame, model: Model, at_least: int | None = None) -> DataFrame:
    """doc_id, expected_grade, tail_prob: the probability of grade at_least (the highest, if not given) or more."""
    cut = model.grades.index(at_least if at_least is not None else model.grades[-1]) if model.grades else None
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    schema = rows.select("doc_id").schema.add("expected_grade", "double").add("tail_prob", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: the hashed dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        steps = np.diff(m.grades)
        for b in batches:
            if cut is None:
                none = pa.nulls(b.num_rows, pa.float64())
                yield pa.RecordBatch.from_arrays([b.column(0), none, none], ["doc_id", "expected_grade", "tail_prob"])
                continue
            tails = [m.tails(t) for lo in range(0, b.num_rows, 256) for t in b.column(1).slice(lo, 256).to_pylist()]
            mean = [float(m.grades[0] + t @ steps) for t in tails]
            tail = [float(t[cut - 1]) if cut else 1.0 for t in tails]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mean, pa.float64()), pa.array(tail, pa.float64())], ["doc_id", "expected_grade", "tail_prob"])

    return rows.mapInArrow(run, schema)
