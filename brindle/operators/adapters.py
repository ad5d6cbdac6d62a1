"""The models as stages of a ``pyspark.ml.Pipeline``.

Each name is an estimator: it is given the feature columns, for supervised models
the label column or columns, and hyper-parameters of the model it wraps. What it
fits is a transformer that adds ``prediction`` (imputers fill their columns, the
autoencoder adds ``encoded``).
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.ml import Estimator, Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import pmf
from brindle.operators import cluster, gmm, impute, linear, nn, prep, trees
from brindle.operators.base import Model


class Fitted(Transformer):
    """A fitted model in a pipeline."""

    def __init__(self, model: Model, after: Callable[[DataFrame], DataFrame] | None = None):
        super().__init__()
        self.model, self.after = model, after

    def _transform(self, dataset: DataFrame) -> DataFrame:
        got = self.model.transform(dataset)
        return self.after(got) if self.after else got

    def inverse_transform(self, dataset: DataFrame) -> DataFrame | None:
        return self.model.inverse_transform(dataset)

    def distances(self, dataset: DataFrame) -> DataFrame:
        """Of clusterers: the distance of each row to every representative."""
        return self.model.distances(dataset)

    def report(self) -> dict[str, Any]:
        return self.model.info()


class Adapter(Estimator):
    """Base of the stages; subclasses name the model, how many labels it takes and defaults that differ."""

    wraps: type[Model]
    labels = 0  # 0, 1, or 2 for several
    defaults: dict[str, Any] = {}
    numeric_label = False

    def __init__(self, columns: Sequence[str], label: str | Sequence[str] | None = None, **hyper: Any):
        super().__init__()
        if (label is None) != (self.labels == 0):
            raise TypeError(f"{type(self).__name__} takes {'no' if self.labels == 0 else 'a'} label")
        several = isinstance(label, (list, tuple))
        if self.labels and several != (self.labels == 2):
            raise TypeError(f"{type(self).__name__} takes {'a list of labels' if self.labels == 2 else 'one label'}")
        self.columns, self.label, self.hyper = list(columns), label, {"cache": False} | self.defaults | hyper

    def _fit(self, dataset: DataFrame) -> Fitted:
        if self.numeric_label:
            for x in [self.label] if self.labels == 1 else self.label:
                if not isinstance(dataset.schema[x].dataType, T.NumericType):
                    raise TypeError(f"{type(self).__name__} needs numbers in {x}")
        model = self.wraps(**copy.copy(self.hyper))
        return Fitted(model.fit(dataset, self.columns, *self._labels()))

    def _labels(self) -> list:
        return [] if self.labels == 0 else [self.label]


def _stage(name: str, wraps: type[Model], labels: int = 0, numeric_label: bool = False, **defaults: Any) -> type[Adapter]:
    doc = f"``{wraps.__name__}`` as a pipeline stage."
    return type(name, (Adapter,), {"wraps": wraps, "labels": labels, "numeric_label": numeric_label, "defaults": defaults, "__doc__": doc, "__module__": __name__})


PerceptronClassifier = _stage("PerceptronClassifier", linear.PerceptronClassifier, 1)
KernelPerceptronClassifier = _stage("KernelPerceptronClassifier", linear.KernelPerceptronClassifier, 1)
PegasosClassifier = _stage("PegasosClassifier", linear.PegasosClassifier, 1)
DecisionTreeRegressor = _stage("DecisionTreeRegressor", trees.DecisionTreeEstimator, 1, True)
DecisionTreeClassifier = _stage("DecisionTreeClassifier", trees.DecisionTreeEstimator, 1, force_classification=True)
RandomForestRegressor = _stage("RandomForestRegressor", trees.RandomForestEstimator, 1, True)
RandomForestClassifier = _stage("RandomForestClassifier", trees.RandomForestEstimator, 1, force_classification=True)
KMeansClusterer = _stage("KMeansClusterer", cluster.KMeansClusterer)
KMedoidsClusterer = _stage("KMedoidsClusterer", cluster.KMedoidsClusterer)
GaussianMixtureClusterer = _stage("GaussianMixtureClusterer", gmm.GaussianMixtureClusterer)
MultitargetGaussianMixtureRegressor = _stage("MultitargetGaussianMixtureRegressor", gmm.GaussianMixtureRegressor, 2, True)
SimpleImputer = _stage("SimpleImputer", impute.SimpleImputer)
GaussianMixtureImputer = _stage("GaussianMixtureImputer", impute.GaussianMixtureImputer)
RandomForestImputer = _stage("RandomForestImputer", impute.RandomForestImputer)
GeneralImputer = _stage("GeneralImputer", impute.GeneralImputer)
NeuralNetworkRegressor = _stage("NeuralNetworkRegressor", nn.NeuralNetworkEstimator, 1, True)
MultitargetNeuralNetworkRegressor = _stage("MultitargetNeuralNetworkRegressor", nn.NeuralNetworkEstimator, 2, True, epochs=300)
AutoEncoder = _stage("AutoEncoder", nn.AutoEncoder)


class GaussianMixtureRegressor(Adapter):
    """One target."""

    wraps, labels, numeric_label = gmm.GaussianMixtureRegressor, 1, True

    def _labels(self) -> list:
        return [[self.label]]


class StandardScaling(Adapter):
    """Z-scores of the columns."""

    wraps = prep.Scaler


class NeuralNetworkClassifier(Adapter):
    """A network with one output a class and softmax at the end; the prediction is a map of probabilities.

    ``categories`` fixes the classes (else those of the rows, in order of first sight by ``id_col``); a label
    outside them is an error, or with ``handle_unknown="infrequent"`` counts as ``other_categories_name``."""

    wraps, labels = nn.NeuralNetworkEstimator, 1

    def __init__(self, columns: Sequence[str], label: str, *, categories: Sequence[Any] | None = None, handle_unknown: str = "error", other_categories_name: Any = "other", id_col: str = "_id", **hyper: Any):
        super().__init__(columns, label, **({"loss": nn.crossentropy} | hyper))
        self.categories, self.handle_unknown, self.other, self.id_col = categories, handle_unknown, other_categories_name, id_col

    def _fit(self, dataset: DataFrame) -> Fitted:
        y = F.col(self.label)
        classes = list(self.categories) if self.categories else [r[0] for r in dataset.where(y.isNotNull()).groupBy(self.label).agg(F.min(self.id_col).alias("_first")).orderBy("_first").select(self.label).collect()]
        if self.categories and self.handle_unknown == "error" and not dataset.where(~y.isin(classes)).isEmpty():
            raise ValueError(f"labels outside {classes}")
        known = [F.coalesce(y == c, F.lit(False)).cast("double") for c in classes]
        if self.handle_unknown == "infrequent":
            known.append((~F.coalesce(y.isin(classes), F.lit(False))).cast("double"))
            classes = [*classes, self.other]
        names = [f"_class_{i}" for i in range(len(known))]
        rows = dataset.where(y.isNotNull()).withColumns(dict(zip(names, known, strict=True)))
        model = self.wraps(**copy.copy(self.hyper)).fit(rows, self.columns, names)
        turn = lambda df: df.withColumn("prediction", pmf.from_arrays(classes, F.col("prediction") if len(names) > 1 else F.array("prediction")))
        return Fitted(model, turn)
