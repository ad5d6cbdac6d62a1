"""Probability mass functions as map<label, double> columns, and modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.arrays import argmax, col


def mode_of_map(pmf: Column | str) -> Column:
    """The key of the greatest value; ties go to the lowest key."""
    ordered = F.array_sort(F.transform(F.map_entries(col(pmf)), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return F.get(ordered, F.lit(0))["k"]


def mode_of_array(x: Column | str) -> Column:
    """1-based place of the greatest element; ties go to the first."""
    return argmax(x)


def mode_of_labels(df: DataFrame, label: str) -> DataFrame:
    """The most frequent label; ties go to the lowest."""
    return df.groupBy(label).count().orderBy(F.desc("count"), label).limit(1).select(F.col(label).alias("mode"))


def mean_of_maps(df: DataFrame, pmf: str, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """(Weighted) mean map over rows, over the union of keys; a key that a row lacks counts 0 there."""
    by, w = by or [], F.lit(1.0) if weight is None else weight
    rows = df.select(*by, F.col(pmf).alias("_pmf"), w.alias("_w"))
    sizes = rows.groupBy(*by).agg(F.sum("_w").alias("_total"))
    keys = rows.select(*by, "_w", F.explode("_pmf")).groupBy(*by, "key").agg(F.sum(F.col("value") * F.col("_w")).alias("_s"))
    joined = keys.join(sizes, by) if by else keys.join(F.broadcast(sizes))  # one row of totals
    return joined.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", (F.col("_s") / F.col("_total")).alias("value"))))).alias("pmf"))


def from_arrays(labels: list, p: Column) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, labels)), p)


def top_labels(pmf: Column | str, n: int) -> Column:
    """The n labels of greatest probability."""
    ordered = F.array_sort(F.transform(F.map_entries(col(pmf)), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return F.transform(F.slice(ordered, 1, n), lambda e: e["k"])


def accuracy_of_map(label: Column | str, pmf: Column | str, tol: int = 1) -> Column:
    """1 if the label is among the ``tol`` most probable ones, else 0; 0 for an absent key."""
    return F.coalesce(F.array_contains(top_labels(pmf, tol), col(label)), F.lit(False)).cast("double")


def accuracy_of_array(position: Column | str, p: Column | str, tol: int = 1) -> Column:
    """The same for a 1-based class number and an array of probabilities."""
    ordered = F.array_sort(F.transform(col(p), lambda v, i: F.struct((-v).alias("v"), (i + 1).alias("i"))))
    return F.coalesce(F.array_contains(F.transform(F.slice(ordered, 1, tol), lambda e: e["i"]), col(position).cast("int")), F.lit(False)).cast("double")
