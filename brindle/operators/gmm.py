"""Gaussian mixtures fitted by expectation maximisation, with missing values.

A row's responsibilities are one array expression over the literal parameters;
each iteration is one aggregate of weighted sums, without a shuffle of rows. Sums
are taken about the columns' means, so variances keep their digits.

Mixtures without given variances of kind "diagonal" share one variance vector
(the last mixture's), as published results do; ``tied_variances=False`` gives each its own.
"""

from __future__ import annotations

import copy
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations_with_replacement
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.arrays import bind, lse
from brindle.operators.base import Model
from brindle.operators.cluster import KMeansClusterer, grid
from brindle.operators.measures import aic, bic

_LOG2PI = float(np.log(2 * np.pi))
_EPS = float(np.finfo(float).eps)


class Mixture:
    """Base of mixtures; ``mean`` and ``var`` are given or set by the fit."""

    def __init__(self, mean=None, var=None):
        self.mean = None if mean is None else np.asarray(mean, float)
        self.var = None if var is None else np.asarray(var, float)

    def log_density(self, x: list[Column], patterns: list[tuple[int, ...]]) -> Column:
        raise NotImplementedError

    @staticmethod
    def npar(k: int, d: int) -> int:
        raise NotImplementedError

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.mean}, {self.var})"


def _observed(x: Column, term: Column) -> Column:
    return F.when(x.isNotNull(), term).otherwise(0.0)


class SphericalGaussian(Mixture):
    def log_density(self, x, patterns):
        v = float(self.var)
        terms = [_observed(c, F.lit(-0.5 * (_LOG2PI + np.log(v))) - (c - float(m)) * (c - float(m)) * (0.5 / v)) for c, m in zip(x, self.mean, strict=True)]
        return sum(terms[1:], terms[0])

    @staticmethod
    def npar(k, d):
        return k * d + k

    @staticmethod
    def start(variances, k, floor, cov):
        return np.array(max(floor, float(np.mean(variances)) / k**2))

    @staticmethod
    def update(s, mean, floor, cov):
        num = sum(s.square(i, mean[i]) for i in range(len(mean)))
        den = sum(s.w[i] for i in range(len(mean)))
        return np.array(num / den if den > 0 and num / den > floor else floor)


class DiagonalGaussian(Mixture):
    def log_density(self, x, patterns):
        terms = [_observed(c, F.lit(-0.5 * (_LOG2PI + np.log(float(v)))) - (c - float(m)) * (c - float(m)) * (0.5 / float(v))) for c, m, v in zip(x, self.mean, self.var, strict=True)]
        return sum(terms[1:], terms[0])

    @staticmethod
    def npar(k, d):
        return 2 * k * d

    @staticmethod
    def start(variances, k, floor, cov):
        return np.maximum(floor, variances)

    @staticmethod
    def update(s, mean, floor, cov):
        return np.array([max(s.square(i, mean[i]) / s.w[i], floor) if s.w[i] > 0 else floor for i in range(len(mean))])


class FullGaussian(Mixture):
    """The density of the observed columns, one quadratic form for each pattern of missing values there is."""

    def log_density(self, x, patterns):
        out = None
        for p in patterns:
            if not p:
                continue
            i = np.array(p)
            var = self.var[np.ix_(i, i)]
            var = var + max(_EPS, -2 * float(np.linalg.eigvalsh((var + var.T) / 2).min())) * np.eye(len(i))
            inv, logdet = np.linalg.inv(var), float(np.log(max(np.linalg.det(var), _EPS)))
            d = [x[j] - float(self.mean[j]) for j in p]
            form = [d[a] * d[b] * float(inv[a, b]) for a in range(len(p)) for b in range(len(p))]
            value = F.lit(-0.5 * (len(p) * _LOG2PI + logdet)) - 0.5 * sum(form[1:], form[0])
            if len(patterns) == 1:
                return value
            cond = sum((F.when(x[j].isNotNull(), 1 << j).otherwise(0) for j in range(1, len(x))), F.when(x[0].isNotNull(), 1).otherwise(0)) == sum(1 << j for j in p)
            out = F.when(cond, value) if out is None else out.when(cond, value)
        return F.lit(0.0) if out is None else out.otherwise(F.lit(0.0))

    @staticmethod
    def npar(k, d):
        return k * d + k * (d * d + d) // 2

    @staticmethod
    def start(variances, k, floor, cov):
        out = np.full((len(variances),) * 2, cov)
        np.fill_diagonal(out, np.maximum(floor, variances))
        return out

    @staticmethod
    def update(s, mean, floor, cov):
        d = len(mean)
        out = np.zeros((d, d))
        for i in range(d):
            for j in range(i + 1):
                low = floor if i == j else cov
                w = s.pair_w(i, j)
                out[i, j] = out[j, i] = max(s.cross(i, j, mean) / w, low) if w > 0 else low
        return out


class _Sums:
    """Weighted sums of one mixture about the shift."""

    def __init__(self, row: dict, k: int, d: int, shift: np.ndarray, full: bool):
        self.row, self.k, self.shift, self.full = row, k, shift, full
        self.w = [row[f"w{k}_{i}"] or 0.0 for i in range(d)]
        self.x = [row[f"x{k}_{i}"] or 0.0 for i in range(d)]

    def mean(self, i: int) -> float:
        return self.x[i] / self.w[i] + self.shift[i]

    def square(self, i: int, mean: float) -> float:
        m = mean - self.shift[i]
        return max(0.0, (self.row[f"q{self.k}_{i}"] or 0.0) - 2 * m * self.x[i] + m * m * self.w[i])

    def pair_w(self, i: int, j: int) -> float:
        return self.row[f"pw{self.k}_{j}_{i}"] or 0.0

    def cross(self, i: int, j: int, mean) -> float:
        r, key = self.row, f"{self.k}_{j}_{i}"
        a, b = mean[j] - self.shift[j], mean[i] - self.shift[i]
        return (r["pq" + key] or 0.0) - a * (r["pb" + key] or 0.0) - b * (r["pa" + key] or 0.0) + a * b * (r["pw" + key] or 0.0)


@dataclass
class Fit:
    priors: list[float]
    mixtures: list[Mixture]
    log_likelihood: float
    bic: float
    aic: float
    iterations: int
    tied: set[int] = field(default_factory=set)
    #: priors and mixtures of the last E-step, before the last M-step: those of the fitted rows' responsibilities
    before: tuple[list[float], list[Mixture]] | None = None


def posteriors(x: list[Column], priors: Sequence[float], mixtures: Sequence[Mixture], patterns: list[tuple[int, ...]]) -> tuple[Column, Column]:
    """Responsibilities of a row and its log-likelihood; a row without values has the priors and no likelihood."""
    z = F.array(*[F.lit(float(np.log(p + 1e-16))) + m.log_density(x, patterns) for p, m in zip(priors, mixtures, strict=True)])
    some = x[0].isNotNull()
    for c in x[1:]:
        some = some | c.isNotNull()
    p = F.when(some, bind(z, lambda v: bind(lse(v), lambda s: F.transform(v, lambda e: F.exp(e - s))))).otherwise(F.array(*[F.lit(float(q)) for q in priors]))
    return p, F.when(some, lse(z)).otherwise(0.0)


def missing_patterns(df: DataFrame, columns: Sequence[str]) -> list[tuple[int, ...]]:
    """The sets of observed columns there are, at most 2 to the number of columns."""
    code = sum((F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(columns[1:], 1)), F.when(F.col(columns[0]).isNotNull(), 1).otherwise(0))
    return [tuple(i for i in range(len(columns)) if r[0] >> i & 1) for r in df.select(code.alias("c")).distinct().orderBy("c").collect()]


def em(df: DataFrame, columns: Sequence[str], mixtures: list[Mixture], priors: list[float] | None = None, *, tol: float = 1e-6, minimum_variance: float = 0.05, minimum_covariance: float = 0.0, strategy: str = "kmeans", max_iter: int = 5000, tied_variances: bool = True, tied: set[int] | None = None) -> Fit:
    columns, k, d = list(columns), len(mixtures), len(columns)
    mixtures = copy.deepcopy(mixtures)
    kind = type(mixtures[0])
    full = kind is FullGaussian
    priors = list(priors) if priors else [1 / k] * k
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).persist()
    try:
        x = [F.col(c) for c in columns]
        stats = rows.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max), ("v", F.var_samp), ("m", F.avg))]).first()
        n = stats["n"]
        shift = np.array([stats[f"m{i}"] or 0.0 for i in range(d)])
        patterns = missing_patterns(rows, columns) if full else []
        tied = set(tied or ())
        if strategy != "given":
            free = [m for m in mixtures if m.mean is None]
            if strategy == "grid":
                starts = grid([stats[f"lo{i}"] for i in range(d)], [stats[f"hi{i}"] for i in range(d)], len(free)) if free else []
                for m, p in zip(free, starts, strict=True):
                    m.mean = np.array(p)
            elif free:
                start = rows.withColumn("_id", F.lit(0))
                if any(len(p) < d for p in missing_patterns(rows, columns)):
                    inner = em(df, columns, mixtures, priors, tol=tol, minimum_variance=minimum_variance, minimum_covariance=minimum_covariance, strategy="grid", max_iter=10, tied_variances=tied_variances)
                    start = fill(start, columns, inner, of_fit=True)
                km = KMeansClusterer(n_classes=k, cache=False).fit(start, columns)
                for m, p in zip(mixtures, km.par["representatives"], strict=True):
                    if m.mean is None:
                        m.mean = np.array(p)
            variances = np.array([stats[f"v{i}"] or 0.0 for i in range(d)])
            for i, m in enumerate(mixtures):
                if m.var is None:
                    m.var = kind.start(variances, k, minimum_variance, minimum_covariance)
                    if kind is DiagonalGaussian and tied_variances:
                        tied.add(i)
        before, step = -np.inf, 0
        while True:
            step += 1
            used = (priors, copy.deepcopy(mixtures))
            p, ll = posteriors(x, priors, mixtures, patterns)
            scored = rows.select(*columns, p.alias("_p"), ll.alias("_ll"))
            aggs = [F.sum("_ll").alias("ll")]
            for j in range(k):
                w = F.get("_p", F.lit(j))
                aggs.append(F.sum(w).alias(f"p{j}"))
                for i, c in enumerate(columns):
                    y = F.col(c) - float(shift[i])
                    aggs += [F.sum(F.when(F.col(c).isNotNull(), w)).alias(f"w{j}_{i}"), F.sum(w * y).alias(f"x{j}_{i}"), F.sum(w * y * y).alias(f"q{j}_{i}")]
                if full:
                    for a, b in combinations_with_replacement(range(d), 2):
                        ya, yb = F.col(columns[a]) - float(shift[a]), F.col(columns[b]) - float(shift[b])
                        both = ya.isNotNull() & yb.isNotNull()
                        aggs += [F.sum(F.when(both, w)).alias(f"pw{j}_{a}_{b}"), F.sum(F.when(both, w * ya)).alias(f"pa{j}_{a}_{b}"), F.sum(F.when(both, w * yb)).alias(f"pb{j}_{a}_{b}"), F.sum(w * ya * yb).alias(f"pq{j}_{a}_{b}")]
            got = scored.agg(*aggs).first().asDict()
            ll = got["ll"] or 0.0
            mass = [got[f"p{j}"] or 0.0 for j in range(k)]
            priors = [m / sum(mass) for m in mass] if sum(mass) else priors
            sums = [_Sums(got, j, d, shift, full) for j in range(k)]
            for m, s in zip(mixtures, sums, strict=True):
                for i in range(d):
                    if s.w[i] > 1:  # a mean moves only if more than one row's weight stands behind it
                        m.mean[i] = s.mean(i)
                m.var = kind.update(s, m.mean, minimum_variance, minimum_covariance)
            for i in tied:
                mixtures[i].var = mixtures[max(tied)].var
            if ll - before <= tol * abs(ll) or step >= max_iter:
                npars = kind.npar(k, d) + k - 1
                return Fit(priors, mixtures, ll, bic(ll, npars, n), aic(ll, npars), step, tied, used)
            before = ll
    finally:
        rows.unpersist()


def membership(df: DataFrame, columns: Sequence[str], fit: Fit, out: str = "prediction", of_fit: bool = False) -> DataFrame:
    priors, mixtures = fit.before if of_fit and fit.before else (fit.priors, fit.mixtures)
    x = [F.col(c).cast("double") for c in columns]
    patterns = missing_patterns(df, list(columns)) if isinstance(mixtures[0], FullGaussian) else []
    return df.withColumn(out, posteriors(x, priors, mixtures, patterns)[0])


def fill(df: DataFrame, columns: Sequence[str], fit: Fit, of_fit: bool = False) -> DataFrame:
    """Missing cells as the mixtures' means weighted by responsibility."""
    tagged = membership(df, columns, fit, "_p", of_fit)
    value = lambda i: F.aggregate(F.zip_with(F.col("_p"), F.array(*[F.lit(float(m.mean[i])) for m in fit.mixtures]), lambda p, m: p * m), F.lit(0.0), lambda a, b: a + b)
    return tagged.withColumns({c: F.coalesce(F.col(c).cast("double"), value(i)) for i, c in enumerate(columns)}).drop("_p")


@dataclass
class GMMHyper:
    n_classes: int = 3
    mixtures: Any = DiagonalGaussian
    initial_probmixtures: list[float] | None = None
    tol: float = 1e-6
    minimum_variance: float = 0.05
    minimum_covariance: float = 0.0
    initialisation_strategy: str = "kmeans"
    maximum_iterations: int = 5000
    tied_variances: bool = True
    tunemethod: Any = None


class _GMM(Model):
    """A new fit starts from the mixtures of the last one."""

    Hyper = GMMHyper
    online = True

    def __init__(self, **kwargs: Any):
        if isinstance(kwargs.get("mixtures"), (list, tuple)):
            kwargs.setdefault("n_classes", len(kwargs["mixtures"]))
            if kwargs["n_classes"] != len(kwargs["mixtures"]):
                raise ValueError("n_classes differs from the number of mixtures")
        super().__init__(**kwargs)

    def _em(self, df: DataFrame, columns: Sequence[str]) -> Fit:
        h = self.hpar
        old: Fit | None = self.par["fit"] if self.par else None
        mixtures = old.mixtures if old else list(h.mixtures) if isinstance(h.mixtures, (list, tuple)) else [h.mixtures() for _ in range(h.n_classes)]
        fit = em(
            df, columns, mixtures, old.priors if old else h.initial_probmixtures, tol=h.tol, minimum_variance=h.minimum_variance, minimum_covariance=h.minimum_covariance,
            strategy="given" if old else h.initialisation_strategy, max_iter=h.maximum_iterations, tied_variances=h.tied_variances, tied=old.tied if old else None,
        )
        done = self._info.get("fitted_records", 0)
        self._info = {"fitted_records": done + df.count(), "xndims": len(columns), "lL": fit.log_likelihood, "BIC": fit.bic, "AIC": fit.aic, "iterations": fit.iterations}
        return fit


class GaussianMixtureClusterer(_GMM):
    """Soft clusters: an array of responsibilities a row."""

    def _fit(self, df: DataFrame, columns: Sequence[str]) -> None:
        self.par = {"fit": self._em(df, columns), "columns": list(columns)}

    def _transform(self, df: DataFrame) -> DataFrame:
        return membership(df, self.par["columns"], self.par["fit"])

    def _of_fit(self, df: DataFrame) -> DataFrame:
        return membership(df, self.par["columns"], self.par["fit"], of_fit=True)


class GaussianMixtureRegressor2(_GMM):
    """Mixtures of the features; each has a weighted mean of the targets."""

    supervised = True

    def _fit(self, df: DataFrame, columns: Sequence[str], targets: Sequence[str]) -> None:
        fit = self._em(df, columns)
        tagged = membership(df, columns, fit, "_p", of_fit=True)
        k = len(fit.mixtures)
        got = tagged.agg(*[F.sum(F.get("_p", F.lit(j)) * F.col(t)).alias(f"s{j}_{i}") for j in range(k) for i, t in enumerate(targets)], *[F.sum(F.get("_p", F.lit(j))).alias(f"w{j}") for j in range(k)]).first()
        means = [[got[f"s{j}_{i}"] / got[f"w{j}"] if got[f"w{j}"] else 0.0 for i in range(len(targets))] for j in range(k)]
        self.par = {"fit": fit, "columns": list(columns), "means": means}

    def _transform(self, df: DataFrame) -> DataFrame:
        tagged = membership(df, self.par["columns"], self.par["fit"], "_p")
        return _expected(tagged, self.par["means"])


class GaussianMixtureRegressor(_GMM):
    """Mixtures of features and targets together; targets are predicted as missing."""

    supervised = True

    def _fit(self, df: DataFrame, columns: Sequence[str], targets: Sequence[str]) -> None:
        self.par = {"fit": self._em(df, [*columns, *targets]), "columns": list(columns), "targets": list(targets)}

    def _transform(self, df: DataFrame) -> DataFrame:
        columns, targets, fit = self.par["columns"], self.par["targets"], self.par["fit"]
        hidden = df.withColumns({f"_t{i}": F.lit(None).cast("double") for i in range(len(targets))})
        tagged = membership(hidden, [*columns, *[f"_t{i}" for i in range(len(targets))]], fit, "_p").drop(*[f"_t{i}" for i in range(len(targets))])
        return _expected(tagged, [m.mean[len(columns) :].tolist() for m in fit.mixtures])


def _expected(tagged: DataFrame, means: list[list[float]]) -> DataFrame:
    dims = [sum((F.get("_p", F.lit(j)) * F.lit(float(m[i])) for j, m in enumerate(means[1:], 1)), F.get("_p", F.lit(0)) * F.lit(float(means[0][i]))) for i in range(len(means[0]))]
    return tagged.withColumn("prediction", dims[0] if len(dims) == 1 else F.array(*dims)).drop("_p")
