"""Training and applying a probabilistic classifier on feature arrays.

The default is multinomial logistic regression of pyspark.ml, whose probabilities drive propagation. Linear support vector
machines, one against the rest for each class, get theirs from a sigmoid over margins of rows that the machine didn't see.
Weights by class, or balanced samples, even the classes out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics, sampling


@dataclass
class Classifier:
    """model's k-th class is classes[k]."""

    model: LogisticRegressionModel | list[LinearSVCModel]
    classes: list[int]
    c: float
    scores: dict[float, float]
    seed: int | None = None
    sigmoids: list[tuple[float, float]] | None = None
    features: dict | None = None


def _weighted(df: DataFrame) -> DataFrame:
    """Weights by which all classes count alike."""
    n = df.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return df.join(F.broadcast(n.join(F.broadcast(total)).select("label", (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))), "label")


def _fit(df: DataFrame, classes: list[int], c: float) -> LogisticRegressionModel:
    index = F.array_position(F.array(*map(F.lit, classes)), F.col("label")) - 1
    rows = _weighted(df).select(index.cast("double").alias("index"), array_to_vector("features").alias("vector"), "weight")
    return LogisticRegression(featuresCol="vector", labelCol="index", weightCol="weight", family="multinomial", standardization=False, regParam=1.0 / (c * max(1, df.count())), maxIter=60).fit(rows)


def _machine(df: DataFrame, positive: int, c: float) -> LinearSVCModel:
    """One class against the rest, both weighing alike."""
    rows = _weighted(df.select("features", (F.col("label") == positive).cast("int").alias("label")))
    rows = rows.select(F.col("label").cast("double").alias("index"), array_to_vector("features").alias("vector"), "weight")
    return LinearSVC(featuresCol="vector", labelCol="index", weightCol="weight", standardization=False, regParam=1.0 / (c * max(1, df.count())), maxIter=20).fit(rows)


def _margin(model: LinearSVCModel, df: DataFrame, *keep: str) -> DataFrame:
    out = model.transform(df.select(*keep, array_to_vector("features").alias("vector")))
    return out.select(*keep, vector_to_array("rawPrediction")[1].alias("margin"))


def _sigmoid(df: DataFrame, positive: int, c: float, k: int) -> tuple[float, float]:
    """Slope and offset by which a margin becomes a probability, from margins out of fold (df has fold)."""
    parts = []
    for f in range(k):
        rest = df.where(F.col("fold") != f)
        if rest.agg(F.count_distinct(F.col("label") == positive)).first()[0] == 2:
            parts.append(_margin(_machine(rest, positive, c), df.where(F.col("fold") == f), "label"))
    if not parts:
        return 1.0, 0.0
    rows = reduce(DataFrame.unionByName, parts).select((F.col("label") == positive).cast("double").alias("index"), array_to_vector(F.array("margin")).alias("vector"))
    m = LogisticRegression(featuresCol="vector", labelCol="index", standardization=False, regParam=1e-6, maxIter=50).fit(rows)
    return float(m.coefficients[0]), float(m.intercept)


def _machines(df: DataFrame, classes: list[int], c: float, k: int) -> tuple[list[LinearSVCModel], list[tuple[float, float]]]:
    return [_machine(df, x, c) for x in classes], [_sigmoid(df, x, c, k) for x in classes]


def predict(classifier: Classifier, df: DataFrame, labels: list[int]) -> DataFrame:
    """(id, pred, pred_argmax, prob<label>...); a label that training never saw has probability 0."""
    at = F.array(*map(F.lit, classifier.classes))
    if classifier.sigmoids is None:
        out = classifier.model.transform(df.select("id", array_to_vector("features").alias("vector"))).withColumn("p", vector_to_array("probability"))
        pred = F.get(at, F.col("prediction").cast("int"))
    else:
        out = df.select("id", array_to_vector("features").alias("vector"))
        for x, m in enumerate(classifier.model):
            out = m.transform(out).withColumn(f"m{x}", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "prediction")
        margins = F.array(*[F.col(f"m{x}") for x in range(len(classifier.model))])
        each = F.array(*[1 / (1 + F.exp(-(a * F.col(f"m{x}") + b))) for x, (a, b) in enumerate(classifier.sigmoids)])
        sum_ = F.aggregate(each, F.lit(1e-12), lambda s, v: s + v)
        out = out.select("id", F.transform(each, lambda v: v / sum_).alias("p"), margins.alias("m"))
        pred = F.get(at, (F.array_position("m", F.array_max("m")) - 1).cast("int"))
    p = F.col("p")
    best = F.get(at, (F.array_position(p, F.array_max(p)) - 1).cast("int"))
    probs = [p[classifier.classes.index(x)].alias(f"prob{x}") if x in classifier.classes else F.lit(0.0).alias(f"prob{x}") for x in sorted(labels)]
    return out.select("id", pred.alias("pred"), best.alias("pred_argmax"), *probs)


#: What a value of C is scored by, from rows of truth and pred.
SCORING = {"accuracy": lambda pairs: metrics.accuracy(pairs).first()[0]}


def train(df: DataFrame, coarse_c: list[float] = (1.0,), k: int = 5, balance: int | bool | None = None, seed: int = 0, method: str = "logistic", scoring: str = "accuracy") -> Classifier:
    """Classifier of (id, features, label). coarse_c is searched by k stratified folds and a score, of equal ones the first; then all rows are fitted.

    balance: True for classes as small as the smallest, a number for classes of that size. method: logistic or svm.
    """
    if method not in ("logistic", "svm"):
        raise ValueError(method)
    if balance:
        df = sampling.balanced(df, count=None if balance is True else int(balance), seed=seed)
    df = sampling.folds(df.select("id", "features", F.col("label").cast("int").alias("label")), k, seed=seed).cache()

    def fitted(rows: DataFrame, c: float, sigmoids: bool) -> Classifier:
        if method == "logistic":
            return Classifier(_fit(rows, classes, c), classes, c, {}, seed)
        if not sigmoids:  # the highest margin decides
            return Classifier([_machine(rows, x, c) for x in classes], classes, c, {}, seed, [(1.0, 0.0)] * len(classes))
        machines, curves = _machines(rows, classes, c, k)
        return Classifier(machines, classes, c, {}, seed, curves)

    try:
        classes = [r[0] for r in df.select("label").distinct().orderBy("label").collect()]
        scores: dict[float, float] = {}
        for c in coarse_c if len(coarse_c) > 1 else []:
            parts = []
            for f in range(k):
                test = df.where(F.col("fold") == f)
                pred = predict(fitted(df.where(F.col("fold") != f), c, False), test, classes)
                parts.append(SCORING[scoring](pred.join(test.select("id", F.col("label").alias("truth")), "id")))
            scores[c] = sum(parts) / k
        out = fitted(df, max(scores, key=scores.get) if scores else coarse_c[0], True)
        out.scores = scores
        return out
    finally:
        df.unpersist()


def train_svm(df: DataFrame, *args, **kwargs) -> Classifier:
    return train(df, *args, method="svm", **kwargs)


def save(classifier: Classifier, path: str) -> None:
    """The model, and beside it all that using it takes: classes, parameters, seed, and how its features were made."""
    import json

    spark = SparkSession.getActiveSession()
    for k, m in enumerate(classifier.model if classifier.sigmoids else [classifier.model]):
        m.write().overwrite().save(f"{path}/model-{k}")
    meta = {k: getattr(classifier, k) for k in ("classes", "c", "seed", "sigmoids", "features")} | {"scores": list(classifier.scores.items())}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark, path: str) -> Classifier:
    import json

    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta["sigmoids"] is None:
        model = LogisticRegressionModel.load(f"{path}/model-0")
    else:
        model = [LinearSVCModel.load(f"{path}/model-{k}") for k in range(len(meta["classes"]))]
    sigmoids = meta["sigmoids"] and [tuple(x) for x in meta["sigmoids"]]
    return Classifier(model, meta["classes"], meta["c"], {c: s for c, s in meta["scores"]}, meta["seed"], sigmoids, meta["features"])


#: Methods by name.
CLASSIFIERS = {"logistic": train, "svm": train_svm}
