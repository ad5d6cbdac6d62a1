"""Activation functions, their derivatives, and helpers for layers, as Columns.

Each scalar function takes a column (or its name) and gives a column; vector
functions take array<double>. ``KNOWN_DERIVATIVES`` pairs them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.arrays import argmax, bind, col, lse, mean


def identity(x) -> Column:
    return col(x)


def didentity(x) -> Column:
    return F.when(col(x).isNotNull(), F.lit(1.0))


def relu(x) -> Column:
    return F.greatest(F.lit(0.0), col(x))


def drelu(x) -> Column:
    return F.when(col(x) <= 0, 0.0).otherwise(1.0)


def elu(x, alpha: float = 1.0) -> Column:
    return F.when(col(x) > 0, col(x)).otherwise(alpha * F.expm1(col(x)))


def delu(x, alpha: float = 1.0) -> Column:
    return F.when(col(x) > 0, 1.0).otherwise(elu(x, alpha) + alpha)


def celu(x, alpha: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), col(x)) + F.least(F.lit(0.0), alpha * F.expm1(col(x) / alpha))


def dcelu(x, alpha: float = 1.0) -> Column:
    return F.when(col(x) >= 0, 1.0).otherwise(F.exp(col(x) / alpha))


def plu(x, alpha: float = 0.1, c: float = 1.0) -> Column:
    return F.greatest(alpha * (col(x) + c) - c, F.least(alpha * (col(x) - c) + c, col(x)))


def dplu(x, alpha: float = 0.1, c: float = 1.0) -> Column:
    inside = (col(x) >= alpha * (col(x) + c) - c) & (col(x) <= alpha * (col(x) + c) + c)
    return F.when(inside, 1.0).otherwise(alpha)


def tanh(x) -> Column:
    return F.tanh(col(x))


def dtanh(x) -> Column:
    return 1.0 / F.pow(F.cosh(col(x)), F.lit(2.0))


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def dsigmoid(x) -> Column:
    return F.exp(-col(x)) * F.pow(sigmoid(x), F.lit(2.0))


def softplus(x) -> Column:
    """log(1 + e^x), written so that large x does not overflow."""
    return F.greatest(col(x), F.lit(0.0)) + F.log1p(F.exp(-F.abs(col(x))))


def dsoftplus(x) -> Column:
    return sigmoid(x)


def mish(x) -> Column:
    return col(x) * F.tanh(softplus(x))


def dmish(x) -> Column:
    v = col(x)
    omega = F.exp(3 * v) + 4 * F.exp(2 * v) + (6 + 4 * v) * F.exp(v) + 4 * (1 + v)
    delta = 1 + F.pow(F.exp(v) + 1, F.lit(2.0))
    return F.exp(v) * omega / F.pow(delta, F.lit(2.0))


def softmax(x, beta: float = 1.0) -> Column:
    return bind(F.transform(col(x), lambda v: beta * v), lambda z: bind(lse(z), lambda s: F.transform(z, lambda v: F.exp(v - s))))


def dsoftmax(x, beta: float = 1.0) -> Column:
    """The Jacobian as an array of rows."""
    return bind(softmax(x, beta), lambda p: F.transform(p, lambda a, i: F.transform(p, lambda b, j: beta * (F.when(i == j, a).otherwise(0.0) - a * b))))


def dmaximum(x) -> Column:
    """1 at the first maximum, else 0."""
    return bind(argmax(x), lambda at: F.transform(col(x), lambda v, i: F.when(i + 1 == at, 1.0).otherwise(0.0)))


def dmean(x) -> Column:
    return F.transform(col(x), lambda v: 1.0 / F.size(col(x)))


def pool1d(x, poolsize: int = 3, f: Callable[[Column], Column] = mean) -> Column:
    """``f`` of each window of ``poolsize`` neighbours; shorter arrays give none."""
    n = F.size(col(x)) - poolsize
    return F.when(n < 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(1), n + 1), lambda i: f(F.slice(col(x), i, poolsize))))


KNOWN_DERIVATIVES: dict[Callable, Callable] = {
    identity: didentity, relu: drelu, elu: delu, celu: dcelu, plu: dplu, tanh: dtanh, sigmoid: dsigmoid, softmax: dsoftmax, softplus: dsoftplus, mish: dmish, mean: dmean, F.array_max: dmaximum,
}


def match_known_derivatives(f: Callable) -> Callable | None:
    return KNOWN_DERIVATIVES.get(f)


def jacobian(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray, step: float = 1e-6) -> np.ndarray:
    """Central differences of a numpy function, a row for each output: for functions without a closed derivative."""
    x = np.asarray(x, float)
    columns = []
    for i in range(x.size):
        e = np.zeros_like(x)
        e.flat[i] = step * max(1.0, abs(x.flat[i]))
        columns.append((np.atleast_1d(f(x + e)) - np.atleast_1d(f(x - e))) / (2 * e.flat[i]))
    return np.stack(columns, axis=-1)


def xavier_init(n_before: int, n_here: int, size: tuple[int, ...] | None = None, seed: int = 123) -> np.ndarray:
    """Uniform weights within the square root of 6 over both widths."""
    bound = np.sqrt(6.0) / np.sqrt(n_before + n_here)
    return np.random.default_rng(seed).uniform(-bound, bound, size or (n_here, n_before))


def parallel_seeds(seed: int, n: int, reseed: bool = False) -> list[int]:
    """Seeds of n parallel pieces of work: equal, or derived from the piece's number only."""
    return [seed + 10 * i if reseed else seed for i in range(1, n + 1)]
