"""Arithmetic on array<double> columns; everything stays a Catalyst expression."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vector(names: Sequence[str]) -> Column:
    """Columns as one array<double>."""
    return F.array(*[F.col(n).cast("double") for n in names])


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Column | str) -> Column:
    return F.aggregate(col(x), F.lit(0.0), lambda a, v: a + v)


def dot(x: Column | str, y: Column | str) -> Column:
    return total(F.zip_with(col(x), col(y), lambda a, b: a * b))


def mean(x: Column | str) -> Column:
    return total(x) / F.size(col(x))


def argmax(x: Column | str) -> Column:
    """1-based place of the first maximum."""
    return F.array_position(col(x), F.array_max(col(x)))


def argmin(x: Column | str) -> Column:
    return F.array_position(col(x), F.array_min(col(x)))


def ratio(a: Column, b: Column, when_zero: float | None = float("nan")) -> Column:
    """a / b without the error that ANSI mode raises for b = 0."""
    return F.when(b == 0, F.lit(when_zero).cast("double")).otherwise(a / b)


def lse(x: Column | str) -> Column:
    """log(sum(exp(x))), shifted by the maximum."""
    return bind(col(x), lambda v: bind(F.array_max(v), lambda m: m + F.log(F.aggregate(v, F.lit(0.0), lambda a, e: a + F.exp(e - m)))))
