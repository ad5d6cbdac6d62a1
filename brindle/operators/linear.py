"""Perceptron, kernel perceptron and Pegasos classifiers.

Their updates depend on the order of rows, so training is sequential: rows go in
order of the id to one task, which holds the numeric arrays of at most
``max_rows`` rows. Beyond it set ``parallel`` (rows are dealt into that many parts,
each trains in order, and the hyperplanes are averaged by rows): one job a fit,
no data at the driver. Scoring is a projection.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.activations import softmax
from brindle.functions.arrays import dot, literal, vector
from brindle.functions.distances import radial_kernel
from brindle.operators.base import Model

_EPS = float(np.finfo(float).eps)


@dataclass
class Hyperplane:
    w: np.ndarray
    b: float
    mean_w: np.ndarray
    mean_b: float
    errors: int
    iterations: int


def perceptron_binary(x: np.ndarray, y: np.ndarray, w=None, b: float = 0.0, *, epochs: int = 1000, shuffle: bool = False, force_origin: bool = False, seed: int = 123) -> Hyperplane:
    """Mistake-driven passes until one has no error; the mean is over rows times the given epochs."""
    n, d = x.shape
    w = np.zeros(d) if w is None else np.asarray(w, float)
    b = 0.0 if force_origin else float(b)
    sw, sb, rng, errors = w.copy(), b, np.random.default_rng(seed), 0
    for t in range(1, epochs + 1):
        if shuffle:
            o = rng.permutation(n)
            x, y = x[o], y[o]
        errors, i = 0, 0
        while i < n:
            wrong = np.flatnonzero(y[i : i + 4096] * (x[i : i + 4096] @ w + b) <= _EPS)
            if not len(wrong):
                i += 4096
                continue
            i += int(wrong[0])
            w = w + y[i] * x[i]
            b = 0.0 if force_origin else b + y[i]
            sw, sb, errors, i = sw + w, sb + b, errors + 1, i + 1
        if not errors:
            break
    return Hyperplane(w, float(b), sw / (n * epochs), float(sb / (n * epochs)), errors, t)


def pegasos_binary(x: np.ndarray, y: np.ndarray, w=None, b: float = 0.0, *, multiplicative: float = 0.5, rate: Callable[[int], float] = lambda t: 1 / np.sqrt(t), epochs: int = 1000, shuffle: bool = False, force_origin: bool = False, seed: int = 123) -> Hyperplane:
    n, d = x.shape
    w = np.zeros(d) if w is None else np.asarray(w, float)
    b = 0.0 if force_origin else float(b)
    sw, sb, rng, errors = w.copy(), b, np.random.default_rng(seed), 0
    for t in range(1, epochs + 1):
        if shuffle:
            o = rng.permutation(n)
            x, y = x[o], y[o]
        errors, eta = 0, rate(t)
        keep = 1 - eta * multiplicative
        for i in range(n):
            if y[i] * (w @ x[i] + b) <= _EPS:
                w = keep * w + eta * y[i] * x[i]
                b = 0.0 if force_origin else b + eta * y[i]
                sw, sb, errors = sw + w, sb + b, errors + 1
            else:
                w = keep * w
        if not errors:
            break
    return Hyperplane(w, float(b), sw / (n * epochs), float(sb / (n * epochs)), errors, t)


def radial(x: np.ndarray, z: np.ndarray, gamma: float = 0.5) -> np.ndarray:
    return np.exp(-gamma * np.maximum(0, (x * x).sum(1)[:, None] + (z * z).sum(1)[None] - 2 * x @ z.T))


def polynomial(x: np.ndarray, z: np.ndarray, constant: float = 0.0, degree: float = 2.0) -> np.ndarray:
    return (x @ z.T + constant) ** degree


def kernel_perceptron_binary(x: np.ndarray, y: np.ndarray, alpha=None, *, kernel: Callable = radial, epochs: int = 100, shuffle: bool = False, seed: int = 123) -> tuple[np.ndarray, int, int]:
    """Error counts a row, errors of the last pass, passes; kernel rows are computed once a pass and block."""
    n = len(y)
    a = np.zeros(n, np.int64) if alpha is None else np.asarray(alpha, np.int64).copy()
    rng, order, errors = np.random.default_rng(seed), np.arange(n), 0
    score = np.zeros(n)
    for j in np.flatnonzero(a):
        score += a[j] * y[j] * kernel(x[j : j + 1], x)[0]
    for t in range(1, epochs + 1):
        if shuffle:
            order = rng.permutation(n)
        errors = 0
        for i in order:
            if y[i] * score[i] <= _EPS:
                a[i] += 1
                errors += 1
                score += y[i] * kernel(x[i : i + 1], x)[0]  # one row of the Gram matrix, never all of it
        if not errors:
            break
    return a, errors, t


@dataclass
class PerceptronHyper:
    initial_parameters: list | None = None
    epochs: int = 1000
    shuffle: bool = True
    force_origin: bool = False
    return_mean_hyperplane: bool = False
    parallel: int = 1
    max_rows: int = 2_000_000
    tunemethod: Any = None


@dataclass
class PegasosHyper(PerceptronHyper):
    learning_rate: Callable[[int], float] = lambda t: 1 / np.sqrt(t)
    learning_rate_multiplicative: float = 0.5


class _Linear(Model):
    supervised = True

    def _train(self, hyper, seed: int) -> Callable:
        raise NotImplementedError

    def _fit(self, df: DataFrame, columns: Sequence[str], label: str, id_col: str = "_id") -> None:
        columns, h = list(columns), self.hpar
        classes = [r[0] for r in df.groupBy(label).agg(F.min(id_col).alias("i")).orderBy("i").select(label).collect()]
        n = df.count()
        if n > h.max_rows and h.parallel < 2:
            raise ValueError(f"{n} rows are too many to train in order; set parallel, or raise max_rows")
        train, old = self._train(h, self.opt.seed), self.par
        code = F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1
        rows = df.select(F.col(id_col).alias("_id"), vector(columns).alias("x"), code.cast("int").alias("c"))
        rows = rows.repartition(h.parallel, "_id") if h.parallel > 1 else rows.coalesce(1)
        start = old["planes"] if old and old["classes"] == classes else h.initial_parameters
        mean = h.return_mean_hyperplane

        def run(batches):
            pdf = pd.concat(list(batches))
            if not len(pdf):
                return
            pdf = pdf.sort_values("_id", kind="stable")
            x, c, out = np.stack(pdf["x"].to_numpy()).astype(float), pdf["c"].to_numpy(), []
            for k in range(len(classes)):
                if k == 1 and len(classes) == 2:
                    out.append((-out[0][0], -out[0][1]))
                    break
                w, b = start[k] if start else (None, 0.0)
                p = train(x, np.where(c == k, 1, -1), w, b)
                out.append((p.mean_w, p.mean_b) if mean else (p.w, p.b))
            yield pd.DataFrame({"n": [len(pdf)], "planes": [pickle.dumps(out)]})

        got = [(r["n"], pickle.loads(bytes(r["planes"]))) for r in rows.mapInPandas(run, "n long, planes binary").collect()]
        whole = sum(m for m, _ in got)
        planes = [(sum(m * p[k][0] for m, p in got) / whole, sum(m * p[k][1] for m, p in got) / whole) for k in range(len(classes))]
        self.par = {"columns": columns, "classes": classes, "planes": planes}
        self._info = {"fitted_records": n, "xndims": len(columns), "n_classes": len(classes)}

    def _transform(self, df: DataFrame) -> DataFrame:
        x, classes = vector(self.par["columns"]), self.par["classes"]
        return df.withColumn("prediction", linear_pmf(x, self.par["planes"], classes))


def linear_pmf(x: Column, planes: Sequence[tuple[Sequence[float], float]], classes: Sequence[Any]) -> Column:
    """Softmax over the scores as a map; two classes use s and -s."""
    scores = [dot(x, literal(w)) + F.lit(float(b)) for w, b in planes]
    if len(classes) == 2:
        scores[1] = -scores[0]
    return F.map_from_arrays(F.array(*map(F.lit, classes)), softmax(F.array(*scores)))


def sign_predict(x: Column, w: Sequence[float], b: float = 0.0) -> Column:
    return F.when(dot(x, literal(w)) + b > _EPS, 1).otherwise(-1)


class PerceptronClassifier(_Linear):
    Hyper = PerceptronHyper

    def _train(self, h, seed):
        return lambda x, y, w, b: perceptron_binary(x, y, w, b, epochs=h.epochs, shuffle=h.shuffle, force_origin=h.force_origin, seed=seed)


class PegasosClassifier(_Linear):
    Hyper = PegasosHyper

    def _train(self, h, seed):
        return lambda x, y, w, b: pegasos_binary(x, y, w, b, multiplicative=h.learning_rate_multiplicative, rate=h.learning_rate, epochs=h.epochs, shuffle=h.shuffle, force_origin=h.force_origin, seed=seed)


@dataclass
class KernelHyper:
    kernel: Callable = radial
    initial_errors: list | None = None
    epochs: int = 100
    shuffle: bool = True
    max_rows: int = 50_000
    tunemethod: Any = None


class KernelPerceptronClassifier(Model):
    """One model a pair of classes, trained side by side; the winners of the pairs vote."""

    Hyper = KernelHyper
    supervised = True

    def _fit(self, df: DataFrame, columns: Sequence[str], label: str, id_col: str = "_id") -> None:
        columns, h, seed = list(columns), self.hpar, self.opt.seed
        sizes = {r[0]: r[2] for r in df.groupBy(label).agg(F.min(id_col).alias("i"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()}
        classes = list(sizes)
        pairs = [(i, j) for i in range(len(classes)) for j in range(i + 1, len(classes))]
        if any(sizes[classes[i]] + sizes[classes[j]] > h.max_rows for i, j in pairs):
            raise ValueError(f"a pair of classes has more than {h.max_rows} rows to train in order")
        if self.hpar.initial_errors is not None and len(self.hpar.initial_errors) != len(pairs):
            raise ValueError("initial_errors needs one list for each pair of classes")
        code = F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1
        mine = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.lit(j).alias("j")) for m, (i, j) in enumerate(pairs)]) if pairs else None
        models: list = [None] * len(pairs)
        if pairs:
            rows = df.select(F.col(id_col).alias("_id"), vector(columns).alias("x"), code.cast("int").alias("c"))
            rows = rows.select("*", F.explode(F.filter(mine, lambda p: (p["i"] == F.col("c")) | (p["j"] == F.col("c")))).alias("p")).select("_id", "x", F.col("p.m").alias("m"), F.when(F.col("p.i") == F.col("c"), 1).otherwise(-1).alias("y"))
            kernel, epochs, shuffle, given = h.kernel, h.epochs, h.shuffle, h.initial_errors

            def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values("_id", kind="stable")
                x, y = np.stack(pdf["x"].to_numpy()).astype(float), pdf["y"].to_numpy()
                a, errors, t = kernel_perceptron_binary(x, y, None if given is None else given[key[0]], kernel=kernel, epochs=epochs, shuffle=shuffle, seed=seed)
                held = a > 0
                return pd.DataFrame({"m": [key[0]], "model": [pickle.dumps((x[held], y[held] * a[held], errors, t))]})

            for r in rows.groupBy("m").applyInPandas(run, "m int, model binary").collect():
                models[r["m"]] = pickle.loads(bytes(r["model"]))
        self.par = {"columns": columns, "classes": classes, "pairs": pairs, "models": models}
        self._info = {"fitted_records": sum(sizes.values()), "xndims": len(columns), "n_classes": len(classes)}

    def _transform(self, df: DataFrame) -> DataFrame:
        par, kernel, k = self.par, self.hpar.kernel, len(self.par["classes"])
        if k == 1:
            return df.withColumn("prediction", F.create_map(F.lit(par["classes"][0]), F.lit(100.0)))
        held = df.sparkSession.sparkContext.broadcast(par["models"])  # support rows only; the model's size

        def wins(x: pd.Series) -> pd.Series:
            rows, out = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, 1)), np.zeros((len(x), k))
            for (i, j), (sx, sy, *_) in zip(par["pairs"], held.value, strict=True):
                s = kernel(rows, sx) @ sy if len(sx) else np.zeros(len(rows))
                out[np.arange(len(rows)), np.where(s > _EPS, i, j)] += 1
            return pd.Series(list(out))

        udf = F.pandas_udf(wins, "array<double>")
        return df.withColumn("_v", udf(vector(par["columns"]))).withColumn("prediction", F.map_from_arrays(F.array(*map(F.lit, par["classes"])), softmax("_v"))).drop("_v")


def kernel_score(x: Column, support: Sequence[tuple[Sequence[float], float]], kernel: Callable[[Column, Column], Column] = radial_kernel) -> Column:
    """Sum of weighted kernels to literal support rows, in Catalyst."""
    return F.aggregate(F.array(*[F.struct(literal(v).alias("v"), F.lit(float(a)).alias("a")) for v, a in support]), F.lit(0.0), lambda s, p: s + p["a"] * kernel(p["v"], x))
