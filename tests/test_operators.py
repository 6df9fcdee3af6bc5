"""Formulae on small cases, properties, and agreement of the solvers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.functions import chains, kernels
from labelweave.operators import classify, dictionary, graph, joins, metrics, neighbours, raster, sampling
from labelweave.plans import experiment
from labelweave.sources import listfile


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "d"), [("ba", "abc", 2), ("fee", "deed", 2), ("abcd", "bacde", 2), ("", "ab", 2), ("ca", "abc", 3), ("same", "same", 0)])
def test_edit_distance(a, b, d):
    assert kernels.edit_distance(a, b) == d


def test_edit_distance_column(spark):
    df = spark.createDataFrame([("ca", "abc"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(kernels.damerau_levenshtein(F.col("a"), F.col("b"))).collect()] == [3, None]


def test_hamming_needs_equal_lengths(spark):
    assert one(spark, kernels.hamming(F.lit(""), F.lit(""))) == 0
    assert one(spark, kernels.positional_jaccard(F.lit("0123"), F.lit("0120"))) == 0.25
    with pytest.raises(Exception, match="different length"):
        one(spark, kernels.hamming(F.lit("a"), F.lit("ab")))


def test_constant_images_correlate(spark):
    a = F.array(F.lit(1.0), F.lit(1.0))
    assert one(spark, kernels.ncc(a, a)) == 1.0
    assert one(spark, kernels.weighted_jaccard(F.array(F.lit(0.0)), F.array(F.lit(0.0)))) == 0.0


@pytest.mark.parametrize("measure", ["SSD", "NSSD", "NCCone", "NCCplusok", "Jaccard", "NCConeproj", "SSDproj", "NSSDhproj", "cosine"])
def test_image_distance(spark, measure):
    r = np.random.default_rng(3)
    a, b = r.random((4, 3)), r.random((4, 3))
    base = measure.removesuffix("hproj").removesuffix("proj")
    norm = (lambda x: (x - x.mean()) / max(x.std(), 1e-20)) if base in kernels.NORMALISED else (lambda x: x)

    def core(x, y):
        n = (x * y).sum() / x.size
        return {"SSD": ((x - y) ** 2).sum(), "NSSD": ((x - y) ** 2).sum(), "NCCone": (1 - n) / 2, "NCCplusok": 1 - n if n > 0 else 1.0, "Jaccard": 1 - np.minimum(x, y).sum() / np.maximum(x, y).sum(), "cosine": 1 - (x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum())}[base]

    if measure.endswith("hproj"):
        left, tries = norm(a.mean(0)), {"I": norm(b.mean(0)), "H": norm(b.mean(0))[::-1]}
    elif measure.endswith("proj"):
        left, h, v = np.r_[norm(a.mean(0)), norm(a.mean(1))], norm(b.mean(0)), norm(b.mean(1))
        tries = {"I": np.r_[h, v], "V": np.r_[h, v[::-1]], "H": np.r_[h[::-1], v], "X": np.r_[h[::-1], v[::-1]]}
    else:
        left, tries = norm(a).ravel(), {k: norm(x).ravel() for k, x in {"I": b, "V": b[::-1], "H": b[:, ::-1], "X": b[::-1, ::-1]}.items()}
    want = min((core(left, x), k) for k, x in tries.items())
    image = lambda m: F.array(*[F.array(*map(F.lit, map(float, r))) for r in m])
    got = one(spark, kernels.image_distance(image(a), image(b), measure, rotations=True))
    assert got["flip"] == want[1] and got["d"] == pytest.approx(max(want[0], 0), abs=1e-9)


def test_chain_of_a_square(spark):
    pts = [(0, 0), (0, 1), (1, 1), (1, 0)]
    b = F.array(*[F.struct(F.lit(y).alias("a"), F.lit(x).alias("b")) for y, x in pts])
    assert one(spark, chains.from_boundary(b)) == [0, 2, 4, 6]
    closed = F.array(*[F.struct(F.lit(y).alias("a"), F.lit(x).alias("b")) for y, x in [*pts, pts[0]]])
    assert one(spark, chains.from_boundary(closed)) == [0, 2, 4, 6]
    with pytest.raises(Exception, match="8-connected"):
        one(spark, chains.from_boundary(F.array(*[F.struct(F.lit(y).alias("a"), F.lit(x).alias("b")) for y, x in [(0, 0), (0, 2)]])))


def test_unwrapping(spark):
    codes = [0, 7, 1, 5, 1, 0, 4, 0]
    want = list(codes)
    for i in range(1, len(codes)):
        want[i] = codes[i] + 8 * int(np.round((want[i - 1] - codes[i]) / 8))
    assert one(spark, chains.unwrapped(F.array(*map(F.lit, codes)))) == want
    assert one(spark, chains.to_string(chains.from_string(F.lit("0127")))) == "0127"
    assert one(spark, chains.from_string(F.lit(""))) == []


def test_windows(spark):
    assert one(spark, chains.training_words(F.lit("01234"), 3)) == ["012", "123", "234", "340", "401", "012"]
    assert one(spark, chains.projection_words(F.lit("01234"), 3)) == ["012", "123", "234", "340", "401"]


def test_normalised_goes_right_and_up(spark):
    for code in ("444", "5", "03", "666", "321"):
        out = one(spark, chains.normalised(F.lit(code)))
        assert sum(chains.DX[int(c)] for c in out) >= 0 and sum(chains.DY[int(c)] for c in out) >= 0


def test_list_file_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("001", "a", 1), ("002", None, 2)], "id string, name string, stage int")
    meta = {"truth": "stage", "stage_labels": {1: "one", 2: "two"}, "secret": 1, "unserialized": ["secret"]}
    listfile.write_list(df, str(tmp_path / "x"), meta)
    back_meta, back = listfile.read_list(spark, str(tmp_path / "x"))
    assert back_meta == {"truth": "stage", "stage_labels": {1: "one", 2: "two"}}
    assert sorted((r["id"], r["name"], r["stage"]) for r in back.collect()) == [("001", "a", "1"), ("002", None, "2")]
    label, names = listfile.truth(back_meta, back)
    assert names[2] == "two" and label.where("id = '002'").first()["label"] == 2


def test_ids_must_be_unique(spark):
    with pytest.raises(ValueError, match="not unique"):
        listfile.assert_unique(spark.createDataFrame([(1,), (1,)], "id int"))


def test_header_variants_and_conversion(spark, tmp_path):
    (tmp_path / "a.csv").write_text("dirname,metasys_id,stage,orientation\r\n20130311/012713,0029,4-6,unknown\r\n20130311/012713,7,unknown,unknown\r\n")
    (tmp_path / "b.csv").write_text("stage,metasys_id,dirname\n15-16,541,20120907-rescan2/013456~B\n")
    (tmp_path / "c#.csv").write_text("bad\n")
    rows = listfile.read_variants(spark, [str(tmp_path / f) for f in ("a.csv", "b.csv", "c#.csv")])
    meta, out = listfile.converted(rows)
    got = [(str(r["id"]), r["mask"], r["stage"]) for r in out.collect()]
    assert got == [(str(541 + 10000 * (2 + 100 * (13456 + 1000000 * 201209072))), "20120907-rescan2/013456~B/obj0541-mask.png", 6), (str(29 + 10000 * (100 * (12713 + 1000000 * 201303110))), "20130311/012713/obj0029-mask.png", 1)]
    assert meta["stage_labels"][6] == "15-16"
    with pytest.raises(Exception, match="unknown value"):
        listfile.converted(rows.withColumn("stage", F.lit("odd")))[1].collect()


def test_aligned_joins_reject_missing_ids(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, 5)], "id int, v int")
    with pytest.raises(joins.NotAligned):
        joins.aligned(a, b)
    assert joins.select_ordered(b, spark.createDataFrame([(2, 0), (1, 1)], "id int, ord int")).collect()[0]["v"] == 5


def test_knn_properties(spark):
    r = np.random.default_rng(1)
    x = r.random((60, 3))
    df = spark.createDataFrame([("d", i, [float(v) for v in row]) for i, row in enumerate(x)], "dataset string, id long, features array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(d[i], kind="stable")[:4]}
    for blocks in (1, 5):
        assert {(r["i"], r["j"]) for r in neighbours.knn(df, 4, blocks=blocks).collect()} == want
    union = {(r["i"], r["j"]) for r in neighbours.knn(df, 4, "union").collect()}
    assert union == want | {(j, i) for i, j in want}
    assert {(r["i"], r["j"]) for r in neighbours.knn(df, 4, "intersection").collect()} == {(i, j) for i, j in want if (j, i) in want}
    assert {(r["i"], r["j"]) for r in neighbours.nearest(neighbours.distances(df, kernels.squared_euclidean), 4).collect()} == want


@pytest.mark.parametrize("method", ["harmonic", "general"])
def test_steps_agree_with_exact(spark, method):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(0, i, [float(v) for v in row], int(i % 3)) for i, row in enumerate(r.random((12, 2)))], "dataset int, id long, features array<double>, label int")
    pred = experiment.masked_predictions(df, [0, 1, 2], "id % 2 = 0")
    edges = neighbours.knn(df, 4, "union")
    read = lambda t: {x["id"]: x["scores"] for x in t.collect()}
    exact = read(experiment.propagate(pred, edges, [0, 1, 2], 1.0, method=method))
    steps = read(experiment.propagate(pred, edges, [0, 1, 2], 1.0, method=method, steps=40 if method == "harmonic" else 60))
    assert all(steps[k] == pytest.approx(v, abs=1e-5) for k, v in exact.items())
    if method == "harmonic":
        assert all(-1e-9 <= s <= 1 + 1e-9 for v in exact.values() for s in v)


def test_extended_system_equals_closed_form():
    r = np.random.default_rng(4)
    n = 6
    w = r.random((n, n))
    w = (w + w.T) / 2
    np.fill_diagonal(w, 0)
    y, e = (r.random(n) > 0.5).astype(float), np.exp(r.random(n))
    big = np.zeros((2 * n, 2 * n))
    big[n:, n:], big[n:, :n], big[:n, n:] = w, np.diag(e), np.diag(e)
    lap = np.diag(big.sum(0)) - big
    want = -np.linalg.solve(lap[n:, n:], lap[n:, :n] @ y)
    i, j = np.nonzero(w)
    assert graph.dense(n, i, j, w[i, j], y[:, None], e[:, None], "harmonic")[:, 0] == pytest.approx(want)


def test_odd_graphs_are_rejected(spark):
    with pytest.raises(ValueError, match="not symmetric"):
        graph.require_symmetric(spark.createDataFrame([(0, 1, 2, 0.5)], "dataset int, i int, j int, w double"))


def test_folds_and_balance(spark):
    df = spark.createDataFrame([(i, int(i < 10)) for i in range(50)], "id long, label int")
    sizes = sampling.folds(df, 5).groupBy("fold", "label").count().collect()
    assert {r["count"] for r in sizes if r["label"] == 1} == {2} and {r["count"] for r in sizes if r["label"] == 0} == {8}
    assert {r["count"] for r in sampling.balanced(df).groupBy("label").count().collect()} == {10}
    assert {r["count"] for r in sampling.balanced(df, count=20).groupBy("label").count().collect()} == {20}
    assert sampling.subsample(df, "0.5").count() == 25 and sampling.subsample(df, "7").count() == 7


def test_mixture_and_classifier(spark, tmp_path):
    meta, df = sampling.mixture(spark, 300, [1, 1], [[0.0, 6.0]], [[1.0, 1.0]], 1, 0, seed=3)
    assert meta["feature_names"] == ["f00"] and meta["class_labels"] == {1: "C01", 2: "C02"}
    rows = df.select("id", F.array("f00").alias("features"), F.col("class").alias("label"))
    model = classify.train(rows, [0.1, 10.0], k=3)
    classify.save(model, str(tmp_path / "m"))
    out = classify.predict(classify.load(spark, str(tmp_path / "m")), rows, [1, 2, 3])
    assert out.where("prob3 <> 0").count() == 0
    acc = metrics.accuracy(out.join(rows.select("id", F.col("label").alias("truth")), "id")).first()[0]
    assert acc > 0.97


def test_selection_of_entries():
    words = ["0000", "0001", "7777", "7776", "3333"]
    d = dictionary.distance_matrix(words)
    assert dictionary.greedy_cover(d, 2) == [0, 2, 4]
    picked, counts = dictionary.select_entries(d, "vq", threshold=2)
    assert sum(counts) == pytest.approx(5)
    assert sorted(dictionary.select_entries(d, "cluster", size=3)[1]) == [1, 2, 2]
    assert len(dictionary.select_entries(d, "random", size=2)[0]) == 2


def test_bags_add_up(spark):
    codes = spark.createDataFrame([(1, 2, "01234567"), (2, 2, "00000000")], "id long, scale int, code string")
    d = dictionary.train(codes, 3, 5, "tf", "random", size=3)
    bag = dictionary.bag_of_words(codes, d, 3)
    assert all(r["s"] == pytest.approx(1) for r in bag.groupBy("id").agg(F.sum("value").alias("s")).collect())
    names, v = dictionary.vectors(bag, d)
    assert names[0] == "s02i000" and all(sum(r["features"]) == pytest.approx(1) for r in v.collect())


def test_components_and_contours():
    m = np.array([[1, 1, 0, 0], [1, 1, 0, 1], [0, 0, 0, 1]], bool)
    assert raster.label_components(m).max() == 2
    assert raster.opened(m, 3).sum() == 4 and raster.opened(m, 5).sum() == 0
    c = raster.contour(m)
    assert sorted(c) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    ring = np.ones((5, 5), bool)
    ring[1:4, 1:4] = False
    assert len(raster.contour(ring)) == 16


def test_curves(spark):
    one_class = spark.createDataFrame([(1, 0.5), (1, 0.2)], "y int, score double")
    assert metrics.roc(one_class).count() == 0
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, score double")
    assert metrics.area(metrics.roc(df), "fpr", "tpr").first()["auc"] == pytest.approx(0.75)
    c = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 1.0), ("b", 0.0, 1.0), ("b", 1.0, 1.0)], "k string, x double, y double")
    got = {round(r["x"], 3): r["y"] for r in metrics.average_curve(c, "x", "y", "k", 11).collect()}
    assert got[0.5] == pytest.approx(0.75) and len(got) == 11
