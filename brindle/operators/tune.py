"""Cross-validation, hyper-parameter search and the ranking of features."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.base import FIXED_SEED, AutoTuneMethod, Model, shuffled_key
from brindle.operators.measures import sobol_index
from brindle.operators.prep import DataSampler, KFold, numbered


def cross_validation(f: Callable[[DataFrame, DataFrame], Any], df: DataFrame, sampler: DataSampler | None = None, return_statistics: bool = True) -> Any:
    """``f(train, validation)`` on each fold: mean and standard deviation, or all results."""
    got = [f(a, b) for a, b in (sampler or KFold()).split(df)]
    if not return_statistics:
        return got
    values = np.asarray(got, float)
    return values.mean(0), values.std(0, ddof=1) if len(values) > 1 else np.zeros_like(values[0])


def l2loss(model: Model, valid: DataFrame, columns: Sequence[str], label: str | None) -> float:
    """Root of the squared error over the rows: of labels, of one-hot labels against PMFs, or of the rows rebuilt."""
    if label is None:
        again = model.inverse_transform(model.transform(valid))
        if again is None or "decoded" not in again.columns:
            raise ValueError("a model without labels needs an inverse")
        gap = sum((F.pow(F.get("decoded", F.lit(i)) - F.col(c), F.lit(2.0)) for i, c in enumerate(columns[1:], 1)), F.pow(F.get("decoded", F.lit(0)) - F.col(columns[0]), F.lit(2.0)))
        s, n = again.agg(F.sum(gap), F.count(F.lit(1))).first()
        return math.sqrt(s) / n if n else math.inf
    rows = model.transform(valid)
    p, y = F.col("prediction"), F.col(label)
    if isinstance(rows.schema["prediction"].dataType, T.MapType):
        own = F.coalesce(F.try_element_at(p, y), F.lit(0.0))
        square = F.aggregate(F.map_values(p), F.lit(0.0), lambda a, v: a + v * v) - own * own + (1 - own) * (1 - own)
    else:
        square = F.pow(y - p, F.lit(2.0))
    s, n, bad = rows.agg(F.sum(square), F.count(F.lit(1)), F.count_if(square.isNull())).first()
    return math.inf if bad or not n else math.sqrt(s) / n


def l2loss_by_cv(model: Model, df: DataFrame, columns: Sequence[str], label: str | None = None, nsplits: int = 5, nrepeats: int = 1, seed: int = FIXED_SEED, id_col: str = "_id") -> float:
    def one(a: DataFrame, b: DataFrame) -> float:
        m = model.copy()
        m.opt.autotune = m.opt.cache = False
        m.fit(a, columns, label) if label else m.fit(a, columns)
        return l2loss(m, b, columns, label)

    return float(cross_validation(one, df, KFold(nsplits, nrepeats, seed=seed, id_col=id_col))[0])


def candidates(ranges: dict[str, Sequence[Any]]) -> list[dict[str, Any]]:
    return [dict(zip(ranges, values, strict=True)) for values in itertools.product(*ranges.values())]


def _share(df: DataFrame, share: float, n: int, seed: int, id_col: str) -> DataFrame:
    """A share of the rows, at least ten, by hash of the id."""
    want = min(n, max(10, round(share * n)))
    rows = numbered(df, shuffled_key(seed, id_col), F.col(id_col))
    return rows.where(F.col("_n") < want).drop("_n").persist()


@dataclass
class GridSearch(AutoTuneMethod):
    """Every combination on a share of the rows; the least loss wins."""

    hpranges: dict[str, Sequence[Any]] = field(default_factory=dict)
    res_share: float = 0.1
    loss: Callable = l2loss_by_cv
    threads: int = 4

    def _losses(self, model: Model, rows: DataFrame, args, tried: list[dict], seed: int) -> list[float]:
        def one(k: int) -> float:
            m = model.copy().set_hyperparameters(tried[k])
            m.opt.seed = seed + 10 * (k + 1)
            try:
                return self.loss(m, rows, *args)
            except (ValueError, ArithmeticError):
                return math.inf

        with ThreadPoolExecutor(self.threads) as pool:  # each submits its own small jobs
            return list(pool.map(one, range(len(tried))))

    def tune(self, model: Model, df: DataFrame, *args: Any, id_col: str = "_id", **kwargs: Any) -> None:
        tried = candidates(self.hpranges)
        if not tried:
            return
        rows = _share(df, self.res_share, df.count(), model.opt.seed, id_col)
        losses = self._losses(model, rows, args, tried, model.opt.seed)
        rows.unpersist()
        model.set_hyperparameters(tried[int(np.argmin(losses))])


@dataclass
class SuccessiveHalvingSearch(GridSearch):
    """Rounds on growing shares; each keeps the best ones."""

    res_shares: Sequence[float] = (0.08, 0.1, 0.13, 0.15, 0.2, 0.3, 0.4)

    def tune(self, model: Model, df: DataFrame, *args: Any, id_col: str = "_id", **kwargs: Any) -> None:
        tried = candidates(self.hpranges)
        if not tried:
            return
        n, total, rounds = df.count(), len(tried), len(self.res_shares)
        shrink = total ** (1 / rounds)
        for e, share in enumerate(self.res_shares, 1):
            rows = _share(df, share, n, model.opt.seed + e, id_col)
            losses = self._losses(model, rows, args, tried, model.opt.seed)
            rows.unpersist()
            keep = max(1, round(total / shrink**e))
            tried = [tried[i] for i in sorted(range(len(tried)), key=lambda i: (losses[i], i))[:keep]]
            if len(tried) == 1:
                break
        model.set_hyperparameters(tried[0])


def default_ranges(model: Model, n_columns: int) -> dict[str, Sequence[Any]]:
    """What is searched where the model's method names nothing."""
    from brindle.operators import gmm, linear, nn, trees

    if isinstance(model, trees.RandomForestEstimator):
        return {"n_trees": [10, 20, 30], "max_depth": [5, 10, None], "min_records": [2, 5], "beta": [0.0, 0.1]}
    if isinstance(model, trees.DecisionTreeEstimator):
        return {"max_depth": [5, 10, None], "min_gain": [0.0, 0.1, 0.5], "min_records": [2, 3, 5], "max_features": [None, max(1, round(math.sqrt(n_columns)))]}
    if isinstance(model, gmm._GMM):
        return {"n_classes": [2, 3, 4, 5], "mixtures": [gmm.SphericalGaussian, gmm.DiagonalGaussian, gmm.FullGaussian], "initialisation_strategy": ["grid", "kmeans"]}
    if isinstance(model, nn.NeuralNetworkEstimator):
        return {"epochs": [50, 100, 200], "batch_size": [4, 8, 16, 32], "shuffle": [True, False]}
    if isinstance(model, linear.PegasosClassifier):
        return {"epochs": [50, 100, 1000], "learning_rate_multiplicative": [0.1, 0.5, 1.0], "shuffle": [True, False]}
    if isinstance(model, linear.KernelPerceptronClassifier):
        return {"epochs": [20, 50, 100], "kernel": [linear.radial, linear.polynomial], "shuffle": [True, False]}
    if isinstance(model, linear.PerceptronClassifier):
        return {"epochs": [50, 100, 1000], "shuffle": [True, False], "return_mean_hyperplane": [True, False]}
    return {}


def autotune(model: Model, df: DataFrame, *args: Any, **kwargs: Any) -> None:
    """What a first fit runs if the option asks for it; fewer than ten rows are left as they are."""
    if df.limit(10).count() < 10:
        return
    method = getattr(model.hpar, "tunemethod", None) or SuccessiveHalvingSearch(hpranges=default_ranges(model, len(args[0]) if args else 1))
    method.tune(model, df, *args, **kwargs)


# ---------------------------------------------------------------- features


@dataclass
class RankerHyper:
    model: Model | None = None
    metric: str = "sobol"  # sobol, mda
    refit: bool = False
    force_classification: bool = False
    recursive: bool = False
    nsplits: int = 5
    nrepeats: int = 1
    sample_min: float = 100  # rows, or their share if a float
    sample_max: float = 1.0
    fit_function: Callable | None = None  # fit(model, df, columns, label)
    predict_function: Callable | None = None  # predict(model, df), adds prediction
    ignore_dims_keyword: str = "ignore_dims"


class FeatureRanker(Model):
    """Columns from least to most important, by what predictions or losses change without them."""

    Hyper = RankerHyper
    supervised = True

    def _sample(self, df: DataFrame, id_col: str) -> tuple[DataFrame, int]:
        """The rows to rank on, all unless the caller gives a limit, and how many they are."""
        n = df.count()
        want = max(round(x * n) if isinstance(x, float) else x for x in (self.hpar.sample_min, self.hpar.sample_max))
        return (df, n) if want >= n else (df.orderBy(shuffled_key(self.opt.seed, id_col), id_col).limit(want), want)

    def _model(self) -> Model:
        from brindle.operators.trees import RandomForestEstimator

        m = self.hpar.model.copy() if self.hpar.model is not None else RandomForestEstimator(force_classification=self.hpar.force_classification)
        m.opt.cache = False
        return m

    def _scores(self, df: DataFrame, columns: list[str], label: str, tested: list[str], id_col: str) -> dict[str, dict[str, float]]:
        h = self.hpar
        fit = h.fit_function or (lambda m, d, x, y: m.fit(d, x, y))
        predict = h.predict_function or (lambda m, d: m.transform(d))
        out = {c: {"loss": [], "sobol": []} for c in tested}
        base: list[float] = []
        for k, (a, b) in enumerate(KFold(h.nsplits, h.nrepeats, seed=self.opt.seed, id_col=id_col).split(df)):
            m = self._model()
            fit(m, a, columns, label)
            b = b.persist()
            full = predict(m, b).withColumnRenamed("prediction", "_full").persist()
            base.append(self._loss(full, label, "_full"))
            for j, c in enumerate(tested):
                if h.refit:
                    other = self._model()
                    fit(other, a, [x for x in columns if x != c], label)
                    got = predict(other, full)
                elif hasattr(m, "predict_ignoring") and h.predict_function is None:
                    got = m.predict_ignoring(full, [c])
                else:
                    # the column of another row, by two orders of the same rows
                    left = numbered(full, F.col(id_col))
                    right = numbered(full.select(id_col, F.col(c).alias("_other")), shuffled_key(self.opt.seed + 100 * k + j, id_col), F.col(id_col)).select("_n", "_other")
                    got = predict(m, left.join(right, "_n").drop("_n", c).withColumnRenamed("_other", c))
                out[c]["loss"].append(self._loss(got, label, "prediction"))
                out[c]["sobol"].append(self._sobol(got))
            full.unpersist()
            b.unpersist()
        self._base = float(np.mean(base))
        return {c: {n: float(np.mean(v)) for n, v in x.items()} for c, x in out.items()}

    @staticmethod
    def _is_pmf(rows: DataFrame, column: str) -> bool:
        return isinstance(rows.schema[column].dataType, T.MapType)

    def _loss(self, rows: DataFrame, label: str, column: str) -> float:
        p, y = F.col(column), F.col(label)
        if self._is_pmf(rows, column):
            return rows.agg(F.avg(1 - F.coalesce(F.try_element_at(p, y), F.lit(0.0)))).first()[0]
        return rows.agg(F.avg(F.pow(y - p, F.lit(2.0)))).first()[0]

    def _sobol(self, rows: DataFrame) -> float:
        if not self._is_pmf(rows, "prediction"):
            return sobol_index(rows, "_full", "prediction")
        keys = sorted(r[0] for r in rows.select(F.explode(F.map_keys("_full"))).distinct().collect())
        dense = lambda c: F.array(*[F.coalesce(F.try_element_at(F.col(c), F.lit(k)), F.lit(0.0)) for k in keys])
        return sobol_index(rows.select(dense("_full").alias("a"), dense("prediction").alias("b")), "a", "b", is_pmf=True)

    def _fit(self, df: DataFrame, columns: Sequence[str], label: str, id_col: str = "_id") -> None:
        columns, (rows, n_rows) = list(columns), self._sample(df, id_col)
        rows = rows.persist()
        metric = "sobol" if self.hpar.metric == "sobol" else "loss"
        ranked: list[str] = []
        left, scores = list(columns), {}
        while left:
            got = self._scores(rows, left if self.hpar.recursive else columns, label, left, id_col)
            for c in left:
                scores.setdefault(c, got[c])
            order = sorted(left, key=lambda c: (got[c][metric], columns.index(c)))
            if not self.hpar.recursive:
                ranked = order
                break
            ranked.append(order[0])
            scores[order[0]] = got[order[0]]
            left.remove(order[0])
            if len(left) == 1:
                ranked += left
                break
        rows.unpersist()
        self.par = {"rank": ranked}
        self._info = {"fitted_records": n_rows, "xndims": len(columns), "loss_all_cols": self._base, "loss_by_col": {c: s["loss"] for c, s in scores.items()}, "sobol_by_col": {c: s["sobol"] for c, s in scores.items()}}

    def predict(self, df: DataFrame | None = None):
        return self.par["rank"] if self.fitted else super().predict()


