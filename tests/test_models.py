import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import cluster, gmm, impute, linear, nn, trees, tune
from brindle.operators.base import model_load, model_save
from brindle.sources.tables import in_memory
from brindle.streaming import online

N = None
HOLES = [[1, 10.5], [1.5, N], [1.8, 8], [1.7, 15], [3.2, 40], [N, N], [3.3, 38], [N, -2.3], [5.2, -2.4]]


def column(df, name):
    return [r[name] for r in df.orderBy("_id").collect()]


def test_kmeans(spark):
    df = in_memory(spark, [[1, 10.5], [1.5, 10.8], [1.8, 8], [1.7, 15], [3.2, 40], [3.6, 32], [3.3, 38], [5.1, -2.3], [5.2, -2.4]], ["a", "b"])
    m = cluster.KMeansClusterer().fit(df, ["a", "b"])
    assert column(m.predict(), "prediction") == [2, 2, 2, 2, 3, 3, 3, 1, 1] == column(m.predict(df), "prediction")
    assert m.fit(df, ["a", "b"]).info()["fitted_records"] == 18
    assert len(set(column(cluster.KMedoidsClusterer().fit(df, ["a", "b"]).predict(), "prediction"))) > 1


@pytest.mark.parametrize("kind,want", [(gmm.SphericalGaussian, 14.155186593170251), (gmm.DiagonalGaussian, 14.588514438886131), (gmm.FullGaussian, 11.166652292936876)])
def test_mixture_imputer(spark, kind, want):
    df = in_memory(spark, HOLES, ["a", "b"])
    m = impute.GaussianMixtureImputer(mixtures=[kind() for _ in range(3)], initialisation_strategy="grid").fit(df, ["a", "b"])
    assert column(m.predict(), "b")[1] == pytest.approx(want, rel=1e-7)
    if kind is gmm.DiagonalGaussian:
        assert m.info()["BIC"] == pytest.approx(114.1492467835965)


def test_mixture_imputer_from_kmeans(spark):
    df = in_memory(spark, [[2, N, 10], [2000, 4000, 10000], [2000, 4000, 10000], [3, 5, 12], [4, 8, 20], [2000, 4000, 8000], [1, 5, 8]], ["a", "b", "c"])
    m = impute.GaussianMixtureImputer(n_classes=2).fit(df, ["a", "b", "c"])
    assert column(m.predict(), "b")[0] == pytest.approx(6.0) and m.info()["lL"] == pytest.approx(-163.12896063447343) and m.info()["BIC"] == pytest.approx(351.5547532066659)


def test_simple_imputer(spark):
    df = in_memory(spark, [[2, N, 10], [20, 40, 100]], ["a", "b", "c"])
    assert column(impute.SimpleImputer().fit(df, ["a", "b", "c"]).predict(), "b") == [40, 40]
    assert column(impute.SimpleImputer(norm=1).fit(df, ["a", "b", "c"]).predict(), "b")[0] == pytest.approx(4.044943820224719)


def test_other_imputers(spark):
    rows = [[float(i), 2.0 * i if i % 4 else N, "x" if i > 10 else "y"] for i in range(1, 21)]
    df = in_memory(spark, rows, ["a", "b", "c"], ["double", "double", "string"])
    for m in (impute.GeneralImputer(estimator=trees.DecisionTreeEstimator()), impute.RandomForestImputer(n_trees=5, recursive_passages=2)):
        got = m.fit(df, ["a", "b", "c"]).predict()
        assert got.count() == 20 and got.where("b is null").count() == 0 and m.info()["n_imputed_values"] == 5
        assert [r["b"] for r in got.where("_id % 4 = 0").orderBy("_id").collect()][0] == 2.0


FRUIT = [["Green", 3.0, "Apple"], ["Yellow", 3.0, "Apple"], ["Red", 1.0, "Grape"], ["Red", 1.0, "Grape"], ["Yellow", 3.0, "Lemon"]]


def test_tree_classes(spark):
    df = in_memory(spark, FRUIT, ["c1", "c2", "y"], ["string", "double", "string"])
    m = trees.DecisionTreeEstimator().fit(df, ["c1", "c2"], "y")
    assert column(m.predict_ignoring(df, ["c2"]), "prediction")[4] == pytest.approx({"Grape": 0.5, "Lemon": 0.25, "Apple": 0.25})
    assert column(m.predict_ignoring(df, ["c1"]), "prediction")[4] == pytest.approx({"Lemon": 1 / 3, "Apple": 2 / 3})
    assert m.info()["avg_depth"] == pytest.approx(8 / 3) and m.info()["max_reached_depth"] == 3
    view = trees.wrap(m.par["trees"][0], ["c1", "c2"], ["Apple", "Grape", "Lemon"])
    assert [v.value() for v in view] == ["c2 == 1.0?", "{'Grape': 1.0}", "c1 == Yellow?", "{'Apple': 0.5, 'Lemon': 0.5}", "{'Apple': 1.0}"]
    assert len(view.children()) == 2 and view.children()[0].children() == []
    assert m.nodes(spark).count() == 5 and "Is c2 == 1.0" in m.to_text() and trees.to_dot(m.par["trees"][0]).startswith("digraph")


NUMBERS = [[a, b, 2 * a - b + 3] for a, b in [(1.8, 2.5), (0.5, 20.5), (0.6, 18.0), (0.7, 22.8), (0.4, 31.0), (1.7, 3.7)]]


@pytest.mark.parametrize("local_rows", [50_000, 3])
def test_tree_numbers(spark, local_rows):
    df = in_memory(spark, NUMBERS, ["a", "b", "y"])
    m = trees.DecisionTreeEstimator(max_depth=10, local_rows=local_rows).fit(df, ["a", "b"], "y")
    assert column(m.predict(), "prediction") == pytest.approx([3.4, -17.45, -13.8, -17.45, -27.2, 3.4])


def test_mixed_and_missing(spark):
    df = in_memory(spark, [[2, 4, 10, "aaa", 10], [200, 400, 1000, "zzzz", 1000]], ["a", "b", "c", "d", "y"], ["double"] * 3 + ["string", "double"])
    m = trees.DecisionTreeEstimator().fit(df, ["a", "b", "c", "d"], "y")
    assert column(m.predict(df), "prediction") == [505, 505]
    gaps = in_memory(spark, [[N if i % 5 == 0 else float(i), float(i > 20)] for i in range(40)], ["a", "y"])
    assert trees.DecisionTreeEstimator().fit(gaps, ["a"], "y").predict().where("prediction is null").count() == 0


def test_forest(spark):
    df = spark.range(120).select(F.col("id").alias("_id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b")).withColumn("y", F.when(F.col("a") > 3, "x").otherwise("z"))
    m = trees.RandomForestEstimator(n_trees=8, oob=True, beta=1.0, max_features=2).fit(df, ["a", "b"], "y")
    assert m.info()["oob_error"] < 0.05 and m.predict().where("prediction['x'] > 0.5 and y = 'x' or prediction['z'] > 0.5 and y = 'z'").count() == 120


def test_forest_stops_where_another_tree_splits(spark):
    df = spark.range(400).select(F.col("id").alias("_id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b")).withColumn("y", F.when(F.col("a") > 3, "x").otherwise("z"))
    m = trees.RandomForestEstimator(n_trees=6, max_depth=3, max_features=1, local_rows=20).fit(df, ["a", "b"], "y")
    assert all(leaf.prediction is not None for tree in m.par["trees"] for leaf in trees.leaves(tree))
    assert m.predict().where("abs(aggregate(map_values(prediction), 0D, (a, b) -> a + b) - 1) < 1e-9").count() == 400


@pytest.mark.parametrize("label", ["y", "k"])
def test_missing_rows_are_dealt_alike_at_every_size(spark, label):
    rows = [[N if i % 3 == 0 else float(i * 7 % 40), N if i % 4 == 1 else "pqr"[i % 3], 1e6 + (i * 7 % 40) * 2.0 + i % 3, "s" if i * 7 % 40 > 17 else "t"] for i in range(90)]
    df = in_memory(spark, rows, ["a", "c", "y", "k"], ["double", "string", "double", "string"])
    for criterion in (None, "entropy" if label == "k" else "variance", own_gini if label == "k" else own_variance):
        small, large = (trees.DecisionTreeEstimator(max_depth=2, splitting_criterion=criterion, local_rows=n).fit(df, ["a", "c"], label).par["trees"][0] for n in (1000, 50))
        assert str(small.question) == str(large.question) and small.p_true == pytest.approx(large.p_true, abs=0.1)
        assert large.true.npoints + large.false.npoints == 90 and large.true.prediction is not None


def own_gini(counts):
    p = counts / np.maximum(counts.sum(-1, keepdims=True), 1)
    return (p * (1 - p)).sum(-1)


def own_variance(moments):
    n = np.maximum(moments[..., 0], 1)
    return moments[..., 2] / n - (moments[..., 1] / n) ** 2


@pytest.mark.parametrize("kind", [gmm.GaussianMixtureRegressor, gmm.GaussianMixtureRegressor2])
def test_regressors_of_documented_example(spark, kind):
    x = [[1.1, 10.1], [0.9, 9.8], [10.0, 1.1], [12.1, 0.8], [0.8, 9.8]]
    df = in_memory(spark, [[a, b, 2 * a - b] for a, b in x], ["a", "b", "y"])
    m = kind(n_classes=2).fit(df, ["a", "b"], ["y"])
    assert [p[0] if isinstance(p, list) else p for p in column(m.predict(), "prediction")] == pytest.approx([-8.033333333333333] * 2 + [21.15] * 2 + [-8.033333333333333], abs=1e-6)
    one = column(m.predict(in_memory(spark, [[11.0, 0.9]], ["a", "b"])), "prediction")[0]
    assert (one[0] if isinstance(one, list) else one) == pytest.approx(21.15, abs=1e-6)


TRAIN = [[0.1, 0.2, 0.3], [0.3, 0.5, 0.8], [0.4, 0.1, 0.5], [0.5, 0.4, 0.9], [0.7, 0.9, 1.6], [0.2, 0.1, 0.3]]
TEST = [[0.5, 0.6, 1.1], [0.14, 0.2, 0.36], [0.3, 0.7, 1.0], [2.0, 4.0, 6.0]]


@pytest.mark.parametrize("optimiser,want", [(nn.SGD(eta=lambda t: 1 / (1 + t), multiplicative=1.0), 1.599729991966362), (nn.ADAM(), 0.9497779759064725)])
def test_network_from_given_weights(spark, optimiser, want):
    layers = [nn.DenseLayer(2, 3, np.tanh, w=np.ones((3, 2)), wb=np.zeros(3)), nn.DenseNoBiasLayer(3, 2, nn.relu, w=np.ones((2, 3))), nn.DenseLayer(2, 1, nn.identity, w=np.ones((1, 2)), wb=[0.0])]
    m = nn.NeuralNetworkEstimator(layers=layers, batch_size=1, shuffle=False, epochs=100, opt_alg=optimiser, onfail="continue").fit(in_memory(spark, TRAIN, ["a", "b", "y"]), ["a", "b"], "y")
    test = np.array(TEST)
    assert m.par["nn"].loss(test[:, :2], test[:, 2:]) == pytest.approx(want)


def test_learnable_arithmetic():
    a, b = nn.Learnable([[1.0, 2.0]], [4.0]), nn.Learnable([[3.0, 2.0]], [16.0])
    assert a + b == sum([a, b]) == nn.Learnable([[4.0, 4.0]], [20.0]) and b - a == nn.Learnable([[2.0, 0.0]], [12.0]) == -(a - b)
    assert a * b == nn.Learnable([[3.0, 4.0]], [64.0]) and b / a == nn.Learnable([[3.0, 1.0]], [4.0]) and 2 * a / 4 == a * 0.5 and b.sqrt().data[1] == 4.0
    assert 1 - a == nn.Learnable([[0.0, -1.0]], [-3.0]) and 4 / a == nn.Learnable([[4.0, 2.0]], [1.0]) and a != nn.Learnable([[1.0, 2.0]])
    with pytest.raises(ValueError):
        a + nn.Learnable([1.0])
    assert [d.shape for d in nn.DenseLayer(2, 3).get_learnable().data] == [(3, 2), (3,)]


def test_kernel_perceptron_in_order():
    x = np.array([[3, 4, 5], [5, 3, 5], [3, 7, 2], [8, 5, 3], [4, 2, 3], [3, 2, 1], [8, 3, 4], [3, 5, 1], [1, 9, 3], [4, 2, 1]], float)
    fresh = np.array([[3, 7, 2], [2, 2, 3], [3, 2, 2], [4, 1, 2], [4, 3, 2]], float)
    score = lambda v: 0.5 * v[:, 0] + 0.2 * v[:, 1] ** 2 + 0.3 * v[:, 2] + 1
    y, want = (np.where(score(v) > np.median(score(v)), 1, -1) for v in (x, fresh))
    a, _, _ = linear.kernel_perceptron_binary(x, y, np.ones(len(x)), kernel=linear.radial, epochs=1000, shuffle=False, seed=1)
    got = np.where(linear.radial(fresh, x) @ (y * a) > 0, 1, -1)
    assert got.tolist() == [1, -1, -1, -1, -1] and (got != want).mean() == pytest.approx(0.2)


def test_regressors(spark):
    df = in_memory(spark, [[1.1, 0.1, 2.1], [1.2, 0.2, 2.2], [10.5, 1.0, 20.0], [10.6, 1.1, 20.1]], ["a", "b", "y"])
    for kind in (gmm.GaussianMixtureRegressor, gmm.GaussianMixtureRegressor2):
        got = column(kind(n_classes=2).fit(df, ["a", "b"], ["y"]).predict(), "prediction")
        assert got == pytest.approx([2.15, 2.15, 20.05, 20.05], abs=0.1)


@pytest.mark.parametrize("kind", [linear.PerceptronClassifier, linear.PegasosClassifier, linear.KernelPerceptronClassifier])
def test_linear(spark, tmp_path, kind):
    df = in_memory(spark, [[a, b, c] for a, b, c in [(1, 1, "s"), (1.5, 1, "s"), (1, 2, "s"), (5, 5, "b"), (6, 5, "b"), (5, 7, "b")]], ["a", "b", "y"], ["double", "double", "string"])
    m = kind(epochs=100, shuffle=False).fit(df, ["a", "b"], "y")
    assert all(max(p, key=p.get) == y for p, y in zip(column(m.predict(), "prediction"), column(df, "y"), strict=True))
    assert sum(column(m.predict(df), "prediction")[0].values()) == pytest.approx(1)
    model_save(spark, str(tmp_path / "m"), m=m)
    assert column(model_load(spark, str(tmp_path / "m"), "m").predict(df), "prediction") == column(m.predict(), "prediction")


def test_networks(spark):
    df = in_memory(spark, NUMBERS, ["a", "b", "y"])
    m = nn.NeuralNetworkEstimator(epochs=200, opt_alg=nn.ADAM(eta=lambda t: 0.01)).fit(df, ["a", "b"], "y")
    assert m.info()["final_loss"] < m.info()["loss_per_epoch"][0] / 4 and m.fit(df, ["a", "b"], "y").info()["nepochs"] == 400
    assert nn.NeuralNetworkEstimator(epochs=2, parallel=2).fit(df, ["a", "b"], "y").predict().count() == 6
    a = nn.AutoEncoder(epochs=40, encoded_size=1, onfail="continue").fit(df, ["a", "b"])
    assert len(column(a.predict(), "encoded")[0]) == 1 and len(column(a.inverse_transform(a.predict()), "decoded")[0]) == 2


@pytest.mark.parametrize("kind", [nn.NeuralNetworkEstimator, nn.AutoEncoder])
def test_networks_train_on_many_rows(spark, kind):
    df = spark.range(500_100).select(F.col("id").alias("_id"), F.sin("id").alias("a"), F.cos("id").alias("b")).withColumn("y", F.col("a") - F.col("b"))
    m = kind(epochs=1, batch_size=8192, cache=False).fit(df, ["a", "b"], *["y"][: kind.supervised])
    assert m.info()["fitted_records"] == 500_100 and len(m.info()["loss_per_epoch"]) == 2
    with pytest.raises(ValueError):
        kind(epochs=1, max_rows=10).fit(df, ["a", "b"], *["y"][: kind.supervised])


def test_dense_steps_are_those_of_the_layers():
    class Adam(nn.ADAM):  # another class, so it takes the way of any optimiser
        pass

    x = np.random.default_rng(1).normal(size=(103, 3))
    weights = []
    for opt in (nn.ADAM(), Adam()):
        net = nn.Network([nn.DenseLayer(3, 4, nn.relu), nn.DenseNoBiasLayer(4, 4, np.tanh), nn.DenseLayer(4, 3, nn.identity)])
        losses, ok = nn.train(net, x, x[:, ::-1], epochs=7, batch_size=10, opt=opt)
        weights.append([p.ravel().tolist() for layer in net.get_params() for p in layer] + [losses])
    assert all(a == pytest.approx(b, rel=1e-9) for a, b in zip(*weights, strict=True))


def test_search(spark):
    df = spark.range(60).select(F.col("id").alias("_id"), (F.col("id") % 7).cast("double").alias("a"), F.sin("id").alias("b")).withColumn("y", F.col("a") * 3 + F.col("b") * 0.1)
    assert tune.FeatureRanker(model=trees.DecisionTreeEstimator(), nsplits=2).fit(df, ["b", "a"], "y").predict() == ["b", "a"]
    m = trees.DecisionTreeEstimator(autotune=True, tunemethod=tune.SuccessiveHalvingSearch({"max_depth": [1, 8]}, res_shares=[0.5, 1.0])).fit(df, ["a", "b"], "y")
    assert m.hpar.max_depth == 8 and tune.l2loss_by_cv(m, df, ["a", "b"], "y", nsplits=2) < 5


def test_ranker_takes_all_rows(spark):
    df = spark.range(10_500).select(F.col("id").alias("_id"), (F.col("id") % 7).cast("double").alias("a"), F.sin("id").alias("b")).withColumn("y", F.col("a") * 3 + F.col("b") * 0.1)
    for options, n in (({}, 10_500), ({"sample_max": 0.5}, 5250), ({"sample_max": 2000}, 2000)):
        seen = []

        def fit(m, d, x, y, seen=seen):
            seen.append(d.count())
            m.fit(d, x, y)

        r = tune.FeatureRanker(model=trees.DecisionTreeEstimator(max_depth=3), nsplits=2, fit_function=fit, **options).fit(df, ["b", "a"], "y")
        assert sum(seen) == n == r.info()["fitted_records"] and r.predict() == ["b", "a"]


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    df = in_memory(spark, [[1.0], [2.0], [9.0], [10.0]], ["a"])
    df.write.parquet(src)
    m = cluster.KMeansClusterer(n_classes=2, cache=False)
    stream = spark.readStream.schema(df.schema).parquet(src)
    online.fit_stream(m, stream, ["a"], checkpoint=str(tmp_path / "c"), save_to=str(tmp_path / "models")).awaitTermination()
    assert [p[0] for p in m.par["representatives"]] == [1.5, 9.5] and "model_0" in model_load(spark, str(tmp_path / "models"))
    q = online.running_mean(stream, "a").writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("running").first()["mean"] == 5.5


def test_leaves_have_no_candidates(spark, monkeypatch):
    df = spark.range(400).select(F.col("id").alias("_id"), F.sin("id").alias("a"), F.cos("id").alias("b")).withColumn("y", F.when(F.col("a") > 0, "x").otherwise("z"))
    met, real = [], trees.best_splits
    monkeypatch.setattr(trees, "best_splits", lambda rows, *args: met.append(rows.count()) or real(rows, *args))
    assert trees.DecisionTreeEstimator(max_depth=1, local_rows=20).fit(df, ["a", "b"], "y").info()["avg_depth"] == 1 and not met
    m = trees.DecisionTreeEstimator(max_depth=5, local_rows=20).fit(df, ["a", "b"], "y")
    assert met == [400] and m.info()["max_reached_depth"] == 2  # both sides have one label


def test_rows_are_scored_together(spark):
    df = spark.range(300).select(F.col("id").alias("_id"), F.when(F.col("id") % 11 != 0, F.sin("id")).alias("a"), (F.col("id") % 30).cast("double").alias("b"), (F.col("id") % 4).cast("string").alias("c")).withColumn("y", F.col("b") + F.coalesce("a", F.lit(0.0)))
    m = trees.RandomForestEstimator(n_trees=3, max_depth=4, oob=True, beta=1.0).fit(df, ["a", "b", "c"], "y")
    for ignored in ((), (1,)):
        got = m.predict_ignoring(df, ["b"] if ignored else []).where("a is not null").collect()
        want = [trees.combine([trees.walk(t, [r["a"], r["b"], r["c"]], frozenset(ignored))[0] for t in m.par["trees"]], m.par["weights"]) for r in got]
        assert len(got) == 272 and [r["prediction"] for r in got] == pytest.approx(want)
    assert 0 < m.info()["oob_error"] < 1 and m.predict().where("prediction is null").count() == 0


def test_nearest_number_by_number(spark):
    from brindle.functions import arrays, distances

    n = float("nan")
    df = in_memory(spark, [[1.0, 2.0], [2.0, 2.0], [3.0, 2.0], [n, 2.0], [None, 2.0]], ["a", "b"])
    for d in (distances.l1_distance, distances.l2_distance, distances.cosine_distance):
        a, b = distances.nearest_of([F.col("a"), F.col("b")], [[1.0, 2.0], [3.0, 2.0]], d), distances.nearest(arrays.vector(["a", "b"]), [[1.0, 2.0], [3.0, 2.0]], d)
        got = df.select(a.alias("a"), b.alias("b")).collect()
        assert [r["a"] for r in got] == [r["b"] for r in got] and got[4]["a"] == 0
