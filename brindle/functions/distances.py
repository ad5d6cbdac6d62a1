"""Distances, kernels and row-wise losses over array<double> columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.arrays import bind, col, dot, ratio, total

Distance = Callable[[Column, Column], Column]


def l1_distance(x, y) -> Column:
    return total(F.zip_with(col(x), col(y), lambda a, b: F.abs(a - b)))


def l2squared_distance(x, y) -> Column:
    return total(F.zip_with(col(x), col(y), lambda a, b: (a - b) * (a - b)))


def l2_distance(x, y) -> Column:
    return F.sqrt(l2squared_distance(x, y))


def by_column(distance: Distance, xs: Sequence[Column], ys: Sequence[Column]) -> Column | None:
    """A symmetric distance of vectors that are given number by number, which Spark compiles; None of other distances."""
    terms = {l1_distance: lambda a, b: F.abs(a - b), l2squared_distance: lambda a, b: (a - b) * (a - b)}
    term = terms.get(l2squared_distance if distance is l2_distance else distance)
    if term is None or not xs:
        return None
    s = sum((term(a, b) for a, b in zip(xs, ys, strict=True)), F.lit(0.0))
    return F.sqrt(s) if distance is l2_distance else s


def cosine_distance(x, y) -> Column:
    return 1.0 - ratio(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def radial_kernel(x, y, gamma: float = 0.5) -> Column:
    return F.exp(-gamma * l2squared_distance(x, y))


def polynomial_kernel(x, y, constant: float = 0.0, degree: float = 2.0) -> Column:
    return F.pow(dot(x, y) + constant, F.lit(float(degree)))


def linear_kernel(x, y) -> Column:
    return dot(x, y)


def crossentropy(y, y_hat, weight: Column | None = None) -> Column:
    terms = F.zip_with(col(y), col(y_hat), lambda a, b: -a * F.log(b + 1e-15))
    return total(terms if weight is None else F.zip_with(terms, weight, lambda t, w: t * w))


def dcrossentropy(y, y_hat, weight: Column | None = None) -> Column:
    terms = F.zip_with(col(y), col(y_hat), lambda a, b: -a / (b + 1e-15))
    return terms if weight is None else F.zip_with(terms, weight, lambda t, w: t * w)


def kl_divergence(p, q, base2: bool = True) -> Column:
    log = F.log2 if base2 else F.log
    return total(F.zip_with(col(p), col(q), lambda a, b: a * log((a + 1e-15) / (b + 1e-15))))


def squared_cost(y, y_hat) -> Column:
    return 0.5 * l2squared_distance(y, y_hat)


def dsquared_cost(y, y_hat) -> Column:
    return F.zip_with(col(y), col(y_hat), lambda a, b: b - a)


def huber_loss(x, delta: float = 0.01) -> Column:
    return F.when(F.abs(col(x)) < delta, col(x) * col(x) / 2).otherwise(delta * (F.abs(col(x)) - delta / 2))


def pinball(x, alpha: float) -> Column:
    return F.when(col(x) >= 0, alpha * col(x)).otherwise(-(1 - alpha) * col(x))


def nearest(x: Column, points: list[list[float]], distance: Distance = l2_distance) -> Column:
    """1-based number of the nearest point, ties to the lowest, 0 if every distance is NaN."""
    d = F.array(*[F.coalesce(distance(x, F.array(*map(F.lit, p))), F.lit(float("nan"))) for p in points])
    return bind(d, lambda v: bind(F.filter(v, lambda e: ~F.isnan(e)), lambda good: F.when(F.size(good) == 0, F.lit(0)).otherwise(F.array_position(v, F.array_min(good)).cast("int"))))


def nearest_of(xs: Sequence[Column], points: list[list[float]], distance: Distance = l2_distance) -> Column:
    """``nearest`` of a vector given number by number; the distances of ``by_column`` are compiled."""
    each = [by_column(distance, xs, list(map(F.lit, p))) for p in points]
    if not each or each[0] is None:
        return nearest(F.array(*xs), points, distance)
    d = [F.coalesce(e, F.lit(float("nan"))) for e in each]
    least = F.least(*d) if len(d) > 1 else d[0]  # NaN is the greatest number
    out = F.when(F.isnan(least), F.lit(0))
    for k, e in enumerate(d, 1):
        out = out.when(e == least, F.lit(k))
    return out
