import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from brindle.operators import adapters as A
from brindle.operators import nn


def rows(spark):
    d = spark.range(60).select(F.col("id").alias("_id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5 / 2).alias("b"))
    return d.withColumn("y", F.when(F.col("a") > 3, "x").otherwise("z")).withColumn("t", F.col("a") * 2 + F.col("b")).withColumn("u", -F.col("a"))


def test_pipeline(spark):
    d = rows(spark).withColumn("b", F.when(F.col("_id") % 6 != 0, F.col("b")))
    got = Pipeline(stages=[A.SimpleImputer(["b"]), A.StandardScaling(["a", "b"]), A.DecisionTreeClassifier(["a", "b"], "y")]).fit(d).transform(d)
    assert got.where("b is null").count() == 0 and got.where("prediction[y] > 0.9").count() == 60


@pytest.mark.parametrize("stage", [A.PerceptronClassifier, A.PegasosClassifier, A.KernelPerceptronClassifier, A.RandomForestClassifier])
def test_classifiers(spark, stage):
    d = rows(spark).where("_id < 35")
    got = stage(["a", "b"], "y", **({"epochs": 50} if stage is not A.RandomForestClassifier else {"n_trees": 5})).fit(d).transform(d)
    assert got.where("prediction[y] >= 0.5").count() > 25


@pytest.mark.parametrize("stage", [A.DecisionTreeRegressor, A.RandomForestRegressor, A.GaussianMixtureRegressor, A.NeuralNetworkRegressor])
def test_regressors(spark, stage):
    d = rows(spark)
    more = {A.RandomForestRegressor: {"n_trees": 5, "max_features": 2}, A.NeuralNetworkRegressor: {"epochs": 60, "opt_alg": nn.ADAM(eta=lambda t: 0.01)}, A.GaussianMixtureRegressor: {"n_classes": 4, "maximum_iterations": 20}}.get(stage, {})
    got = stage(["a", "b"], "t", **more).fit(d).transform(d)
    assert got.agg(F.avg(F.abs(F.col("t") - F.col("prediction")))).first()[0] < 2.5
    with pytest.raises(TypeError):
        stage(["a", "b"], "y").fit(d)


def test_several_targets(spark):
    d = rows(spark)
    for stage, more in ((A.MultitargetGaussianMixtureRegressor, {"n_classes": 2, "maximum_iterations": 5}), (A.MultitargetNeuralNetworkRegressor, {"epochs": 5})):
        got = stage(["a", "b"], ["t", "u"], **more).fit(d).transform(d)
        assert got.where("size(prediction) = 2").count() == 60
        with pytest.raises(TypeError):
            stage(["a", "b"], "t")


def test_clusterers_and_codes(spark):
    d = rows(spark)
    for stage in (A.KMeansClusterer, A.KMedoidsClusterer):
        m = stage(["a"], n_classes=2).fit(d)
        assert m.transform(d).select("prediction").distinct().count() == 2 and m.distances(d).where("size(distances) = 2").count() == 60
    assert A.GaussianMixtureClusterer(["a"], n_classes=2, maximum_iterations=5).fit(d).transform(d).where("size(prediction) = 2").count() == 60
    m = A.AutoEncoder(["a", "b"], epochs=3, encoded_size=1, onfail="continue").fit(d)
    assert m.inverse_transform(m.transform(d)).where("size(decoded) = 2").count() == 60


def test_imputers(spark):
    d = rows(spark).withColumn("b", F.when(F.col("_id") % 6 != 0, F.col("b")))
    for stage, more in ((A.GaussianMixtureImputer, {"n_classes": 2, "maximum_iterations": 3}), (A.RandomForestImputer, {"n_trees": 3}), (A.GeneralImputer, {})):
        m = stage(["a", "b"], **more).fit(d)
        assert m.transform(d).where("b is null").count() == 0 and m.report()["n_imputed_values"] == 10


def test_network_classifier(spark):
    d = rows(spark)
    m = A.NeuralNetworkClassifier(["a", "b"], "y", epochs=60, opt_alg=nn.ADAM(eta=lambda t: 0.01)).fit(d)
    assert m.transform(d).where("prediction[y] > 0.5").count() > 50
    with pytest.raises(ValueError):
        A.NeuralNetworkClassifier(["a", "b"], "y", categories=["x"]).fit(d)
    other = A.NeuralNetworkClassifier(["a", "b"], "y", categories=["x"], handle_unknown="infrequent", epochs=2).fit(d).transform(d)
    assert set(other.first()["prediction"]) == {"x", "other"}
