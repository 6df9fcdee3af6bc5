"""The whole chain on one table of vectors: distances, nearest neighbours, weights, propagation, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify, graph, metrics, neighbours


def masked_predictions(vectors: DataFrame, classes: list[int], known: str) -> DataFrame:
    """(dataset, id, pred, probs): the label where `known` holds, else the first class with uniform probabilities."""
    is_known = F.expr(known)
    probs = [F.when(is_known, F.when(F.col("label") == c, 1.0).otherwise(0.0)).otherwise(1.0 / len(classes)) for c in classes]
    return vectors.select("dataset", "id", F.when(is_known, F.col("label")).otherwise(F.lit(-1)).alias("pred"), F.array(*probs).alias("probs"))


def propagate(pred: DataFrame, edges: DataFrame, classes: list[int], bandwidth: float, unary_weight: float = 1.0, method: str = "harmonic", steps: int | None = None) -> DataFrame:
    """Scores of predictions over distance edges: exact, or by so many steps."""
    nodes = graph.one_vs_rest(pred, classes, method, unary_weight)
    w = graph.edge_weights(edges, bandwidth)
    return graph.iterate(nodes, w, len(classes), steps, method, unary_weight) if steps else graph.solve_exact(nodes, w, method, unary_weight=unary_weight) if method == "general" else graph.solve_exact(nodes, w, method)


def synthetic(table: DataFrame, meta: dict, coarse_c: list[float], k: int = 5, points: dict | None = None, seed: int = 0) -> dict[str, DataFrame]:
    """From a generated mixture to the evaluation of the classifier and of propagation; the first half trains, the second tests."""
    labels = sorted(meta["class_labels"])
    arrays = table.select("id", F.col("class").alias("label"), F.array(*meta["feature_names"]).alias("features"), F.array(*meta["weight_names"]).alias("weights"))
    half = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(2))
    model = classify.train(arrays.where(half == 0), coarse_c, seed=seed)
    test = arrays.where(half == 1).withColumn("dataset", F.lit("test"))
    pred = classify.predict(model, test, labels).withColumn("dataset", F.lit("test"))
    edges = neighbours.knn(test.select("dataset", "id", F.col("weights").alias("features")), k, "union")
    probs = pred.select("dataset", "id", "pred", F.array(*[f"prob{c}" for c in labels]).alias("probs"))
    truth = test.select("dataset", "id", "label")
    best = {"bandwidth": 1.0, "unary_weight": 1.0}
    if points:
        cv = graph.train(probs, edges, truth, labels, points)
        best = metrics.best_point(metrics.grid_scores(cv, *sorted(points)), *points).first().asDict()
    spread = graph.decided(propagate(probs, edges, labels, best["bandwidth"], best["unary_weight"]), labels)
    side = lambda p: metrics.evaluation(p.join(truth.withColumnRenamed("label", "truth"), ["dataset", "id"]), labels)
    return {"classifier": side(pred), "propagated": side(spread), "predictions": pred, "spread": spread}
