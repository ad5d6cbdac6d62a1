import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import activations as act
from brindle.functions import arrays, distances, pmf
from brindle.operators import cluster, measures, nn, stats
from brindle.sources.tables import in_memory


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


CASES = [
    (lambda x: act.celu(x, 0.1), -1, -0.09999546000702375), (lambda x: act.elu(x, 0.1), -1, -0.06321205588285576), (act.sigmoid, 1, 0.7310585786300049), (act.softplus, 1, 1.3132616875182228),
    (act.mish, 1, 0.8650983882673103), (act.dmish, 1, 1.0490362200997922), (act.dtanh, 1, 0.41997434161402614), (act.dsigmoid, 1, 0.19661193324148188), (act.relu, -1, 0.0), (act.drelu, 1, 1.0),
    (act.plu, -1, -1.0), (act.dplu, 0.5, 1.0), (act.delu, 1, 1.0), (act.dcelu, 1, 1.0), (act.didentity, 7, 1.0), (act.dsoftplus, 0, 0.5),
]


@pytest.mark.parametrize("f,x,want", CASES)
def test_scalars(spark, f, x, want):
    assert value(spark, f(F.lit(float(x)))) == pytest.approx(want, rel=1e-12)


def test_vectors(spark):
    assert value(spark, act.softmax(vec(2, 3, 4), 0.1)) == pytest.approx([0.3006096053557272, 0.3322249935333472, 0.36716540111092544])
    assert value(spark, act.pool1d(vec(1, 2, 3, 4, 5, 6))) == [2, 3, 4, 5] and value(spark, act.pool1d(vec(1, 2, 3, 4, 5, 6), 3, F.array_max)) == [3, 4, 5, 6]
    assert value(spark, act.pool1d(vec(1, 2))) == []
    assert value(spark, act.dmaximum(vec(1, 4, 4))) == [0, 1, 0] and value(spark, act.dmean(vec(1, 2))) == [0.5, 0.5]
    jac = np.array(value(spark, act.dsoftmax(vec(1, 2))))
    assert jac == pytest.approx(act.jacobian(lambda z: np.exp(z) / np.exp(z).sum(), np.array([1.0, 2.0])), abs=1e-6)
    assert value(spark, arrays.lse(vec(1000, 1000))) == pytest.approx(1000 + math.log(2))
    assert act.match_known_derivatives(act.relu) is act.drelu and act.match_known_derivatives(print) is None
    assert act.parallel_seeds(5, 2) == [5, 5] and act.parallel_seeds(5, 2, True) == [15, 25]
    assert np.abs(act.xavier_init(3, 3)).max() <= 1.0


def test_losses(spark):
    assert value(spark, distances.crossentropy(vec(1, 0, 0), vec(0.8, 0.001, 0.001), vec(2, 1, 1))) == pytest.approx(0.4462871026284194)
    assert value(spark, distances.cosine_distance(vec(1, 0), vec(0, 1))) == pytest.approx(1) and math.isnan(value(spark, distances.cosine_distance(vec(0, 0), vec(0, 1))))
    assert value(spark, distances.kl_divergence(vec(0.5, 0.5), vec(0.5, 0.5))) == pytest.approx(0, abs=1e-9)
    assert value(spark, distances.huber_loss(F.lit(2.0), 1.0)) == 1.5 and value(spark, distances.pinball(F.lit(-2.0), 0.25)) == 1.5
    assert value(spark, distances.polynomial_kernel(vec(1, 2), vec(3, 4), 1.0, 2)) == 144.0
    assert value(spark, distances.nearest(vec(0.0), [[1.0], [-1.0]])) == 1 and value(spark, distances.nearest(vec(float("nan")), [[1.0]])) == 0


def test_pmf(spark):
    m = F.create_map(F.lit("b"), F.lit(0.4), F.lit("a"), F.lit(0.4), F.lit("c"), F.lit(0.2))
    assert value(spark, pmf.mode_of_map(m)) == "a" and value(spark, pmf.accuracy_of_map(F.lit("b"), m, 2)) == 1.0 and value(spark, pmf.accuracy_of_map(F.lit("z"), m)) == 0.0
    df = spark.createDataFrame([({"a": 0.5, "b": 0.5}, 1.0), ({"b": 1.0}, 3.0)], "p map<string,double>, w double")
    assert pmf.mean_of_maps(df, "p", weight=F.col("w")).first()["pmf"] == {"a": 0.125, "b": 0.875}


def test_measures(spark):
    y = in_memory(spark, [[a, b] for a, b in zip("aaabbccc", "bbaccaac", strict=True)], ["y", "h"], ["string", "string"])
    assert measures.accuracy(y, "y", "h") == 0.25 and measures.accuracy(y, "y", "h", ignore_labels=True) == 0.75
    obs, est = [-2, 5, 6, 0, 3, 5, -10, 15, -5], [0, 4, 5, 1, 2, 4, -8, 18, -6]
    df = in_memory(spark, [[a, b] for a, b in zip(obs, est, strict=True)], ["y", "h"])
    assert measures.mase(df, "y", "h").first()["mase"] == pytest.approx(0.2647058823529412)
    d = [[0, 2, 3, 4], [2, 0, 1, 2], [3, 1, 0, 1.5], [4, 2, 1.5, 0]]
    pairs = spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(d) for j, v in enumerate(r)], "i long, j long, distance double")
    classes = spark.createDataFrame([(0, 1), (1, 2), (2, 2), (3, 2)], "i long, label int")
    got = [r["silhouette"] for r in measures.silhouette(pairs, classes).orderBy("i").collect()]
    assert got == pytest.approx([0.0, 1 - 1.5 / 2, 1 - 1.25 / 3, 1 - 1.75 / 4])


def test_confusion(spark):
    df = in_memory(spark, [[a, b] for a, b in zip([0, 1, 2, 2, 0], [0, 0, 2, 1, 0], strict=True)], ["y", "y_hat"], ["int", "int"])
    m = measures.ConfusionMatrix().fit(df)
    i = m.info()
    assert i["precision"] == pytest.approx([2 / 3, 0, 1]) and i["recall"] == [1, 0, 0.5] and i["specificity"] == pytest.approx([2 / 3, 0.75, 1]) and i["accuracy"] == 0.6
    assert i["mean_precision"] == pytest.approx((0.5555555, 0.6666667), abs=1e-6) and i["mean_f1score"] == pytest.approx((0.4888889, 0.5866667), abs=1e-6)
    assert m.fit(df).info()["fitted_records"] == 10 and "accuracy" in m.report()


def test_stats(spark):
    got = stats.goodness_of_fit([205, 26, 25, 19], [0.72, 0.07, 0.12, 0.09])
    assert got["testValue"] == pytest.approx(5.889610389610388) and got["p_value"] == pytest.approx(0.1171061913085063)
    assert stats.welch_satterthwaite(0.85**2, 0.95**2, 20, 20) > 30 and stats.sterling(5, 2) == 15
    ks = stats.ks_test(in_memory(spark, [[0.8], [0.7], [0.4], [0.7], [0.2]], ["v"]), "v", lambda c: c)
    assert ks["testValue"] == pytest.approx(0.6708203932499368)
    assert stats.ks_exact_cdf(0.5, 2) == pytest.approx(0.5, abs=0.01) and stats.kolmogorov_cdf(1.3581) == pytest.approx(0.95, abs=1e-3)
    df = in_memory(spark, [[float(v)] for v in range(101)], ["v"])
    assert stats.find_quantile(df, "v", 0.5) == pytest.approx(50, abs=0.5)
    assert stats.goodness_of_fit_support(df.withColumn("k", F.col("v") % 2), "k", {0.0: 0.5, 1.0: 0.5})["rejectedH0"] is False


def test_layers_against_differences():
    rng = np.random.default_rng(0)
    for layer, shape in [
        (nn.DenseLayer(3, 2, np.tanh), (4, 3)), (nn.DenseNoBiasLayer(3, 2, nn.sigmoid), (4, 3)), (nn.VectorFunctionLayer(3), (4, 3)), (nn.ScalarFunctionLayer(3, nn.mish), (4, 3)),
        (nn.GroupedLayer([nn.DenseLayer(2, 2, np.tanh), nn.ReplicatorLayer(1)]), (4, 3)), (nn.ConvLayer((5, 4), (3, 3), 2, 3, f=np.tanh), (2, 5, 4, 2)), (nn.PoolingLayer((4, 4), (2, 2), 2), (2, 4, 4, 2)),
        (nn.PoolingLayer((4, 4), (2, 2), 2, f="mean"), (2, 4, 4, 2)), (nn.ReshaperLayer((3, 2)), (2, 3, 2)),
    ]:
        x = rng.normal(size=shape)
        out = layer.forward(x)
        assert out.shape[1:] == layer.size()[1]
        g = rng.normal(size=out.shape)
        dx, dw = layer.backward(x, g)
        e = 1e-6
        for i in list(np.ndindex(*shape))[:8]:
            step = np.zeros(shape)
            step[i] = e
            assert ((layer.forward(x + step) - layer.forward(x - step)) * g).sum() / (2 * e) == pytest.approx(dx[i], abs=1e-5)
        for k, p in enumerate(layer.get_params()):
            i = (0,) * p.ndim
            old = p[i]
            p[i] = old + e
            up = layer.forward(x)
            p[i] = old - e
            down = layer.forward(x)
            p[i] = old
            assert ((up - down) * g).sum() / (2 * e) == pytest.approx(dw[k][i], abs=1e-5)


def test_reshaper_is_column_major():
    x = np.arange(6.0).reshape(1, 2, 3)
    assert nn.ReshaperLayer((2, 3)).forward(x)[0].tolist() == [0, 3, 1, 4, 2, 5]
    assert nn.ReshaperLayer((6,), (2, 3)).forward(np.array([[0, 3, 1, 4, 2, 5.0]]))[0].tolist() == x[0].tolist()


def test_optimisers():
    x, y = np.array([[1.0], [2.0], [3.0], [4.0]]), np.array([[2.0], [4.0], [6.0], [8.0]])
    for opt in (nn.SGD(eta=lambda t: 0.01, multiplicative=1.0), nn.ADAM(eta=lambda t: 0.05)):
        net = nn.Network([nn.DenseLayer(1, 1, seed=1)])
        losses, ok = nn.train(net, x, y, epochs=1500, batch_size=2, opt=opt)
        assert losses[-1] < 0.01 and ok


def test_sums_on_a_line(spark):
    df = spark.range(600).select(F.col("id").alias("i"), F.array(F.pmod(F.xxhash64("id"), F.lit(900_000)) / 100.0).alias("x"), (F.col("id") % 3).cast("int").alias("label"))
    other = lambda x, y: distances.l1_distance(x, y) + 0.0  # noqa: E731  (not known, so met pair by pair)
    a, b = ({r["i"]: r["silhouette"] for r in measures.silhouette_of_rows(df, d).collect()} for d in (distances.l1_distance, other))
    assert len(a) == 600 and a == pytest.approx(b, abs=1e-9)
    plane = df.withColumn("x", F.concat("x", F.array(F.lit(0.0))))
    assert {r["i"]: r["silhouette"] for r in measures.silhouette_of_rows(plane, distances.l2_distance).collect()} == pytest.approx(a, abs=1e-9)
    medoids = [cluster.kmedoids_update(rows, "i", "x", "label", d).orderBy("label").select("label", "i", F.round("cost", 4)).collect() for rows, d in ((df, distances.l1_distance), (df, other), (plane, distances.l2_distance))]
    assert medoids[0] == medoids[1] == medoids[2]


def test_equal_costs_go_to_the_first_member(spark):
    # the two middle values have equal sums, which sums of doubles in another order miss by more than nine decimals tell
    df = spark.range(4000).select((3999 - F.col("id")).alias("i"), F.array(F.col("id") * 1013 / 100.0 + 0.1).alias("x"), F.lit(1).alias("k"))
    got = cluster.kmedoids_update(df, "i", "x", "k", distances.l1_distance).first()
    assert got["i"] == 1999 and got["cost"] == pytest.approx(1013 / 100 * 4_000_000)


def test_pairs_meet_in_many_parts(spark):
    df = spark.range(300).select("id", F.array(F.col("id") / 7.0).alias("x"))
    got = measures.pairwise(df, "id", "x")
    assert got.rdd.getNumPartitions() > 16 and got.count() == 90_000
    want = {(i, j): abs(i / 7 - j / 7) for i in range(300) for j in range(300)}
    assert {(r["i"], r["j"]): r["distance"] for r in got.collect()} == pytest.approx(want)
