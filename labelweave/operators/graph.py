"""Spreading class scores over a similarity graph: harmonic functions and the quadratic criterion.

Nodes are (dataset, id, y array, e array), one entry for each class; edges are (dataset, i, j, w), symmetric, without
loops. Three solvers agree: sparse and dense solve a dataset's system with numpy in a grouped function; iterate repeats a
sparse step over edges as joins and sums, for graphs of any size. solve_exact takes the one that a dataset's size asks for.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from . import metrics
from .storage import bucketed, kept

#: Most nodes of a dataset whose dense matrix one task may hold (72 MB), and steps between checkpoints. Larger datasets are solved until no score
#: moves by more than CLOSE in a step, for so many steps at most, beyond which it is an error.
DENSE, EVERY, CLOSE, MOST = 3000, 5, 1e-8, 5000
#: Most edges of a dataset of over DENSE nodes that one task may hold (48 MB, and some columns of that length); further ones are iterated as joins.
SPARSE = 2_000_000


def edge_weights(edges: DataFrame, bandwidth: float) -> DataFrame:
    """(dataset, i, j, w) of distances: exp(-d * bandwidth), no loops."""
    return edges.where("i <> j").select("dataset", "i", "j", kernels.weight(F.col("d"), F.lit(bandwidth)).alias("w"))


def require_symmetric(edges: DataFrame) -> DataFrame:
    """edges, once each has been found to have its reverse; one job."""
    turned = edges.select("dataset", F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("_w"))
    odd = edges.join(turned, ["dataset", "i", "j"], "left").where("_w is null or abs(w - _w) > 1e-9").limit(1).collect()
    if odd:
        raise ValueError(f"the graph is not symmetric at {odd[0][:3]}")
    return edges


def one_vs_rest(pred: DataFrame, classes: list[int], method: str = "harmonic", unary_weight: float = 1.0) -> DataFrame:
    """Nodes of predictions (dataset, id, pred, probs array): y is 0 or 1 (-1 or 1 for general), e the weight of the unary."""
    y = [(F.col("pred") == c).cast("double") for c in classes]
    if method == "general":
        return pred.select("dataset", "id", F.array(*[2 * x - 1 for x in y]).alias("y"), F.col("probs").alias("e"))
    return pred.select("dataset", "id", F.array(*y).alias("y"), F.transform("probs", lambda p: F.exp(unary_weight * p)).alias("e"))


def dense(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, y: np.ndarray, e: np.ndarray, method: str, unary_weight: float = 1.0, smoothness: float = 1e-2, regularisation: float = 1e-1) -> np.ndarray:
    """Scores, a column for each class. harmonic: (D - W + E) f = E y; general: (uw S + sw L + sw reg I) f = S y, as (f + 1) / 2; hard: rows whose e is positive keep y."""
    m = np.zeros((n, n))
    np.add.at(m, (i, j), w)
    lap = np.diag(m.sum(1)) - m
    if method == "hard":
        known = e[:, 0] > 0
        f = y.copy()
        if (~known).any():
            f[~known] = np.linalg.solve(lap[np.ix_(~known, ~known)], -lap[np.ix_(~known, known)] @ y[known])
        return f
    f = np.empty_like(y)
    for c in range(y.shape[1]):
        if method == "harmonic":
            f[:, c] = np.linalg.solve(lap + np.diag(e[:, c]), e[:, c] * y[:, c])
        else:
            a = unary_weight * np.diag(e[:, c]) + smoothness * lap + smoothness * regularisation * np.eye(n)
            f[:, c] = (np.linalg.solve(a, e[:, c] * y[:, c]) + 1) / 2
    return f


def sparse(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, y: np.ndarray, e: np.ndarray, method: str, unary_weight: float = 1.0, smoothness: float = 1e-2, regularisation: float = 1e-1, most: int = MOST, close: float = CLOSE) -> np.ndarray | None:
    """What dense gives, of edges alone: conjugate gradients, scaled by the diagonal. None where a step from the result would still move a score by more than close.

    Where no known node can be reached, hard gives 0, as iterate does.
    """
    deg, spread = np.bincount(i, w, n), (lambda x: np.bincount(i, w * x[j], n))
    f = np.empty_like(y)
    for c in range(y.shape[1]):
        free, off, fixed = np.ones(n, dtype=bool), 1.0, np.zeros(n)
        if method == "hard":
            free = ~(e[:, 0] > 0)
            fixed = np.where(free, 0.0, y[:, c])
            diag, b = np.where(free, deg, 0.0), np.where(free, spread(fixed), 0.0)
        elif method == "harmonic":
            diag, b = deg + e[:, c], e[:, c] * y[:, c]
        else:
            off = smoothness
            diag, b = unary_weight * e[:, c] + smoothness * deg + smoothness * regularisation, e[:, c] * y[:, c]
        scale = np.divide(1.0, diag, out=np.zeros(n), where=diag != 0)
        times = lambda x: np.where(free, diag * x - off * spread(x), 0.0)  # noqa: E731, B023
        x, r = np.zeros(n), b
        z = p = scale * r
        rz = r @ z
        for _ in range(most):
            if not np.abs(z).max(initial=0.0) > close * 1e-4:
                break
            q = times(p)
            a = rz / (p @ q)
            x, r = x + a * p, r - a * q
            z, before = scale * r, rz
            rz = r @ z
            p = z + rz / before * p
        if not np.abs(scale * (b - times(x))).max(initial=0.0) <= close:
            return None
        f[:, c] = (x + 1) / 2 if method == "general" else x + fixed
    return f


def solved(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, y: np.ndarray, e: np.ndarray, method: str, limits: tuple[int, int, float], **params: float) -> np.ndarray | None:
    """Scores by sparse; where those don't stand still, by dense, unless there are too many nodes for it. limits: DENSE, MOST and CLOSE of the driver."""
    largest, most, close = limits
    with np.errstate(all="ignore"):
        f = sparse(n, i, j, w, y, e, method, **params, most=most, close=close)
    return dense(n, i, j, w, y, e, method, **params) if f is None and n <= largest else f


def by_size(nodes: DataFrame, edges: DataFrame) -> list[tuple[DataFrame | None, DataFrame | None]]:
    """Nodes and edges of datasets of up to DENSE nodes, of those of up to SPARSE edges, and of larger ones; None where there are none. One count of nodes; edges are computed once."""
    over = kept(nodes.groupBy("dataset").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > DENSE).select("dataset"))
    if over.isEmpty():
        return [(nodes, edges), (None, None), (None, None)]
    edges = kept(edges)
    large = kept(edges.join(over, "dataset", "left_semi").groupBy("dataset").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SPARSE).select("dataset"))
    some = over.join(large, "dataset", "left_anti")
    out = [tuple(t.join(over, "dataset", "left_anti") for t in (nodes, edges))]
    return out + [(None, None) if names.isEmpty() else tuple(t.join(names, "dataset", "left_semi") for t in (nodes, edges)) for names in (some, large)]


def _whole(df: DataFrame, column: str) -> DataFrame:
    """df, computed once, if it has a value in the column everywhere: where solved has none, scores still moved."""
    df = kept(df)
    if odd := df.where(F.col(column).isNull()).select("dataset").limit(1).collect():
        raise ArithmeticError(f"scores of dataset {odd[0][0]} still move after {MOST} steps; a graph must be symmetric")
    return df


def solve_exact(nodes: DataFrame, edges: DataFrame, method: str = "harmonic", **params: float) -> DataFrame:
    """(dataset, id, scores). Each dataset of up to DENSE nodes or SPARSE edges is one task's; larger ones are iterated until their scores stand still."""
    kinds = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in ("dataset", "id"))
    limits = DENSE, MOST, CLOSE

    def run(v: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("dataset", "id", "scores")})
        at = pd.Series(range(len(v)), index=v["id"])
        i, j = at.reindex(g["i"]).to_numpy(), at.reindex(g["j"]).to_numpy()
        f = solved(len(v), i.astype(int, copy=False), j.astype(int, copy=False), g["w"].to_numpy(), np.stack(v["y"]), np.stack(v["e"]), method, limits, **params)
        return pd.DataFrame({"dataset": v["dataset"].astype(object), "id": v["id"].astype(object), "scores": [None] * len(v) if f is None else list(f)})

    (small, own), (some, theirs), (large, rest) = by_size(nodes, edges.select("dataset", "i", "j", "w"))
    solve = lambda v, g: v.groupBy("dataset").cogroup(g.groupBy("dataset")).applyInPandas(run, f"{kinds}, scores array<double>")
    out = solve(small, own)
    if some is not None:
        out = out.unionByName(_whole(solve(some, theirs), "scores"))
    if large is not None:
        classes = large.select(F.max(F.size("y"))).first()[0]
        out = out.unionByName(iterate(large, rest, classes, None, method, **params))
    return out


def iterate(nodes: DataFrame, edges: DataFrame, classes: int, steps: int | None, method: str = "harmonic", unary_weight: float = 1.0, smoothness: float = 1e-2, regularisation: float = 1e-1) -> DataFrame:
    """(dataset, id, scores) after so many Jacobi steps from 0 (hard: from y of the known nodes); None for as many as scores need to stand still.

    All classes go in one step; degrees are summed once. Edges lie in buckets by their end, so only the state moves; it is
    checkpointed now and then, so a lost executor costs a few steps and the plan stays short.
    """
    cs = range(classes)
    edges = bucketed(edges.select("dataset", "i", "j", "w"), "dataset", "j")  # every step reads them
    deg = edges.groupBy("dataset", F.col("i").alias("id")).agg(F.sum("w").alias("deg"))
    state = nodes.select("dataset", "id", *[F.col("y")[c].alias(f"y{c}") for c in cs], *[F.col("e")[c].alias(f"e{c}") for c in cs]).join(deg, ["dataset", "id"], "left").fillna(0.0, ["deg"])
    state = state.withColumns({f"f{c}": F.when(F.col(f"e{c}") > 0, F.col(f"y{c}")).otherwise(0.0) if method == "hard" else F.lit(0.0) for c in cs})
    sw, reg = smoothness, smoothness * regularisation
    state = kept(state)
    step = 0
    while steps is None or step < steps:
        step += 1
        f = state.select("dataset", F.col("id").alias("j"), *[f"f{c}" for c in cs])
        sums = edges.join(f, ["dataset", "j"]).groupBy("dataset", F.col("i").alias("id")).agg(*[F.sum(F.col("w") * F.col(f"f{c}")).alias(f"s{c}") for c in cs])
        state = state.join(sums, ["dataset", "id"], "left").fillna(0.0, [f"s{c}" for c in cs])
        new = {}
        for c in cs:
            y, e, s, d = (F.col(f"{k}{c}" if k != "deg" else k) for k in ("y", "e", "s", "deg"))
            if method == "harmonic":
                new[f"f{c}"] = (s + e * y) / (d + e)
            elif method == "general":
                new[f"f{c}"] = (e * y + sw * s) / (unary_weight * e + sw * d + reg)
            else:
                new[f"f{c}"] = F.when(e > 0, y).otherwise(F.coalesce(s / F.nullif(d, F.lit(0.0)), F.lit(0.0)))
        look = steps is None and step % EVERY == 0
        moved = F.greatest(*[F.abs(new[f"f{c}"] - F.col(f"f{c}")) for c in cs], F.lit(0.0)) if look else F.lit(0.0)
        state = state.withColumns(new | {"_moved": moved}).drop(*[f"s{c}" for c in cs])
        if step % EVERY == 0:
            state = kept(state)
        if look and (state.agg(F.max("_moved")).first()[0] or 0.0) <= CLOSE:
            break
        if steps is None and step >= MOST:
            raise ArithmeticError(f"scores still move after {step} steps")
        state = state.drop("_moved")
    out = [(F.col(f"f{c}") + 1) / 2 if method == "general" else F.col(f"f{c}") for c in cs]
    return state.select("dataset", "id", F.array(*out).alias("scores"))


def class_mass(scores: DataFrame, nodes: DataFrame) -> DataFrame:
    """Scores of unknown nodes scaled so that each class has the mass it has among the known ones, plus one; two aggregates and a join of one row for a dataset. Scores are computed once."""
    scores = kept(scores)
    known = nodes.where(F.col("e")[0] > 0).select("dataset", F.posexplode("y").alias("c", "v")).groupBy("dataset", "c").agg((F.sum("v") + 1).alias("q"))
    free = scores.join(nodes.where(F.col("e")[0] > 0).select("dataset", "id"), ["dataset", "id"], "left_anti")
    long = free.select("dataset", "id", F.posexplode("scores").alias("c", "v"))
    mass = long.groupBy("dataset", "c").agg(F.sum("v").alias("m")).join(known, ["dataset", "c"]).select("dataset", "c", F.coalesce(F.col("q") / F.nullif(F.col("m"), F.lit(0.0)), F.lit(0.0)).alias("k"))
    out = long.join(mass, ["dataset", "c"]).groupBy("dataset", "id").agg(F.sort_array(F.collect_list(F.struct("c", (F.col("v") * F.col("k")).alias("v")))).alias("s"))
    return out.select("dataset", "id", F.transform("s", lambda x: x["v"]).alias("scores"))


def decided(scores: DataFrame, classes: list[int]) -> DataFrame:
    """(dataset, id, pred, pred_argmax, prob<c>): the class of the highest score, of equal ones the first."""
    best = F.get(F.array(*map(F.lit, classes)), (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))
    return scores.select("dataset", "id", best.alias("pred"), best.alias("pred_argmax"), *[F.col("scores")[k].alias(f"prob{c}") for k, c in enumerate(classes)])


def grid(points: dict[str, list[float]]) -> list[dict[str, float]]:
    """All combinations, in the order of the parameters by name."""
    out: list[dict[str, float]] = [{}]
    for name in sorted(points):
        out = [p | {name: v} for p in out for v in points[name]]
    return out


#: What a grid point is scored by: of rows of truth and pred, one number.
SCORING = {"accuracy": lambda truth, pred: (truth == pred).sum() / (len(truth) + metrics.TINY)}


def train(pred: DataFrame, distances: DataFrame, truth: DataFrame, classes: list[int], points: dict[str, list[float]], method: str = "harmonic", scoring: str = "accuracy") -> DataFrame:
    """(dataset, bandwidth, unary_weight, score): the score on the truth for every grid point and dataset.

    A dataset is shipped once, to a task that solves it for one grid point after the other; the points of those of over DENSE
    nodes and SPARSE edges are iterated, one after the other. A dataset with a truth that has no prediction is an error.
    """
    point = [(float(p.get("bandwidth", 1.0)), float(p.get("unary_weight", 1.0))) for p in grid(points)]
    known = truth.select("dataset", "id", F.col("label").alias("truth"))
    if alone := known.join(pred.select("dataset").distinct(), "dataset", "left_semi").join(pred, ["dataset", "id"], "left_anti").limit(3).collect():
        raise ValueError(f"no prediction for {[tuple(r)[:2] for r in alone]}")
    (small, own), (some, theirs), (large, rest) = by_size(pred.join(known, ["dataset", "id"], "left"), distances.where("i <> j").select("dataset", "i", "j", "d"))
    limits, kind = (DENSE, MOST, CLOSE), pred.schema["dataset"].dataType.simpleString()
    score = SCORING[scoring]

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("dataset", "bandwidth", "unary_weight", "score")})
        at = pd.Series(range(len(p)), index=p["id"])
        i, j, d = at[q["i"]].to_numpy(), at[q["j"]].to_numpy(), q["d"].to_numpy()
        hard, probs = np.stack([p["pred"].to_numpy() == c for c in classes], 1).astype(float), np.stack(p["probs"])
        t = p["truth"].to_numpy(dtype=float)
        has, out = ~np.isnan(t), []
        for bandwidth, uw in point:
            y, unary = (2 * hard - 1, probs) if method == "general" else (hard, np.exp(uw * probs))
            f = solved(len(p), i, j, np.exp(-d * bandwidth), y, unary, method, limits, unary_weight=uw)
            out.append((p["dataset"].iloc[0], bandwidth, uw, None if f is None else float(score(t[has], np.array(classes)[f.argmax(1)][has]))))
        return pd.DataFrame(out, columns=["dataset", "bandwidth", "unary_weight", "score"]).astype({"dataset": object})

    solve = lambda v, e: v.groupBy("dataset").cogroup(e.groupBy("dataset")).applyInPandas(run, f"dataset {kind}, bandwidth double, unary_weight double, score double")
    parts = [solve(small, own)]
    if some is not None:
        parts.append(_whole(solve(some, theirs), "score"))
    if large is None:
        return reduce(DataFrame.unionByName, parts)
    if scoring != "accuracy":
        raise ValueError(f"datasets of over {DENSE} nodes and {SPARSE} edges are scored by accuracy alone")
    e, large = kept(rest), kept(large)
    for bandwidth, uw in point:
        s = iterate(one_vs_rest(large, classes, method, uw), edge_weights(e, bandwidth), len(classes), None, method, uw)
        judged = decided(s, classes).join(large.where("truth is not null").select("dataset", "id", "truth"), ["dataset", "id"])
        parts.append(metrics.accuracy(judged, "dataset").select("dataset", F.lit(bandwidth).alias("bandwidth"), F.lit(uw).alias("unary_weight"), F.col("accuracy").alias("score")))
    return reduce(DataFrame.unionByName, parts)


def save_propagator(spark, path: str, best: dict[str, float], classes: list[int], method: str = "harmonic", seed: int | None = None) -> None:
    """What the grid search found, without the scores it found it by."""
    import json

    meta = {"bandwidth": float(best["bandwidth"]), "unary_weight": float(best["unary_weight"]), "classes": list(classes), "method": method, "seed": seed}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(path)


def load_propagator(spark, path: str) -> dict:
    import json

    return json.loads(spark.read.text(path).first()[0])


def apply_propagator(propagator: dict, pred: DataFrame, distances: DataFrame) -> DataFrame:
    """(dataset, id, pred, pred_argmax, prob<c>) of predictions spread over the graph of distances by a propagator's parameters."""
    classes, method = propagator["classes"], propagator["method"]
    nodes = one_vs_rest(pred, classes, method, propagator["unary_weight"])
    params = {"unary_weight": propagator["unary_weight"]} if method == "general" else {}
    return decided(solve_exact(nodes, edge_weights(distances, propagator["bandwidth"]), method, **params), classes)
