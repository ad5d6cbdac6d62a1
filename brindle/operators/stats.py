"""M-estimation, quantiles and tests of fit. Statistics are aggregates; the
distribution functions are plain mathematics on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.arrays import ratio
from brindle.functions.distances import pinball


def welch_satterthwaite(sx: float, sy: float, n: int, m: int) -> int:
    """Degrees of freedom of two samples with variances sx and sy."""
    return math.floor((sx / n + sy / m) ** 2 / (sx**2 / (n**2 * (n - 1)) + sy**2 / (m**2 * (m - 1))))


def m_estimation(df: DataFrame, column: str, candidates: Sequence[float], loss: Callable[[Column], Column] = F.abs) -> tuple[float, float]:
    """The candidate of least mean loss (the first of equals) and that loss; one pass for all candidates."""
    each = [F.avg(loss(F.col(column) - F.lit(float(c)))).alias(f"c{i}") for i, c in enumerate(candidates)]
    got = list(df.agg(*each).first())
    at = min(range(len(got)), key=lambda i: (got[i], i))
    return float(candidates[at]), got[at]


def find_quantile(df: DataFrame, column: str, alpha: float, precision: float = 0.001, points: int = 64) -> float:
    """The grid point of least pinball loss. The mean loss is convex, so each pass narrows the grid."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return float("nan")
    low, high = float(low), float(high)
    while True:
        grid = np.linspace(low, high, points).tolist()
        best, _ = m_estimation(df, column, grid, lambda x: pinball(x, alpha))
        step = (high - low) / (points - 1)
        if step <= precision:
            return best
        low, high = max(low, best - step), min(high, best + step)


# ---------------------------------------------------------------- distribution functions


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return min(1.0, total * front)
    b, c = x + 1 - a, 1e308
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-308)
        c = b + an / c or 1e-308
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return max(0.0, 1 - front * h)


def chi2_cdf(x: float, k: float) -> float:
    return gamma_p(k / 2, x / 2)


def chi2_quantile(p: float, k: float) -> float:
    low, high = 0.0, max(1.0, k)
    while chi2_cdf(high, k) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return (low + high) / 2


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def kolmogorov_cdf(x: float) -> float:
    """Limit distribution of the scaled KS statistic."""
    if x <= 0:
        return 0.0
    if x < 1.18:
        return math.sqrt(2 * math.pi) / x * sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 40))
    return 1 - 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 100))


def ks_exact_cdf(d: float, n: int) -> float:
    """Exact distribution of the one-sample KS statistic, by powers of a banded matrix."""
    if d <= 0:
        return 0.0
    if d >= 1:
        return 1.0
    k = math.ceil(n * d)
    m, h = 2 * k - 1, k - n * d
    a = np.zeros((m, m))
    for i in range(m):
        for j in range(m):
            if i - j + 1 >= 0:
                a[i, j] = 1.0
    for i in range(m):
        a[i, 0] -= h ** (i + 1)
        a[m - 1, i] -= h ** (m - i)
    a[m - 1, 0] += (2 * h - 1) ** m if 2 * h - 1 > 0 else 0
    for i in range(m):
        for j in range(m):
            if i - j + 1 > 0:
                a[i, j] /= math.factorial(i - j + 1)
    out = np.linalg.matrix_power(a, n)[k - 1, k - 1]
    for i in range(1, n + 1):
        out *= i / n
    return float(min(1.0, max(0.0, out)))


# ---------------------------------------------------------------- tests


def _verdict(value: float, threshold: float, p: float) -> dict:
    return {"testValue": value, "threshold": threshold, "rejectedH0": value > threshold, "p_value": p}


def goodness_of_fit(counts: Sequence[float], p0: Sequence[float] | None = None, alpha: float = 0.05, estimated: int = 0) -> dict:
    """Chi-square test of counts against probabilities; ``estimated`` parameters lower the degrees of freedom."""
    k, n = len(counts), sum(counts)
    p0 = p0 or [1 / k] * k
    value = sum((c - n * p) ** 2 / (n * p) for c, p in zip(counts, p0, strict=True))
    dof = k - 1 - estimated
    return _verdict(value, chi2_quantile(1 - alpha, dof), 1 - chi2_cdf(value, dof))


def compute_density(df: DataFrame, column: str, support: DataFrame) -> DataFrame:
    """How often each value of the support occurs."""
    counts = df.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    name = support.columns[0]
    return support.join(counts, support[name] == F.col("_v"), "left").select(*[support[c] for c in support.columns], F.coalesce("_n", F.lit(0)).cast("long").alias("count"))


def chi2_statistic(df: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    """The chi-square statistic of a column against a table (value, p)."""
    n = F.sum("count").over(Window.partitionBy())
    joined = compute_density(df, column, expected).withColumn("_e", F.col("p") * n)
    return joined.agg(F.sum(ratio(F.pow(F.col("count") - F.col("_e"), F.lit(2.0)), F.col("_e"))).alias("chi2"))


def goodness_of_fit_support(df: DataFrame, column: str, pmf: dict, alpha: float = 0.05, estimated: int = 0) -> dict:
    """The test of raw values against a probability function on its support."""
    got = {r[0]: r[1] for r in df.groupBy(column).count().where(F.col(column).isin(*pmf)).collect()}
    return goodness_of_fit([got.get(v, 0) for v in pmf], list(pmf.values()), alpha, estimated)


def ks_distance(df: DataFrame, column: str, cdf: Callable[[Column], Column]) -> DataFrame:
    """n and the greatest distance of the empirical from the given distribution function.

    Ranks come from counts of distinct values summed up in order; only the sorted distinct values share a window."""
    from brindle.operators.prep import numbered

    rows = numbered(df.select(F.col(column).cast("double").alias("v")).where("v is not null"), F.col("v"))
    total = rows.count()
    f, i = cdf(F.col("v")), F.col("_n") + 1
    gap = F.greatest(F.abs((i - 1) / F.lit(float(max(total, 1))) - f), F.abs(i / F.lit(float(max(total, 1))) - f))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max(gap).alias("distance"))


def ks_test(df: DataFrame, column: str, cdf: Callable[[Column], Column], alpha: float = 0.05, asymptotic_threshold: int = 100) -> dict:
    """One-sample Kolmogorov-Smirnov test, exact up to the threshold of rows."""
    n, d = ks_distance(df, column, cdf).first()
    value = math.sqrt(n) * d
    if n > asymptotic_threshold:
        low, high = 0.0, 10.0
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if kolmogorov_cdf(mid) < 1 - alpha else (low, mid)
        return _verdict(value, low, 1 - kolmogorov_cdf(value))
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if ks_exact_cdf(mid, n) < 1 - alpha else (low, mid)
    return _verdict(value, low * math.sqrt(n), 1 - ks_exact_cdf(d, n))


def ks_table_value(spark, quantile: Callable[[Column], Column], cdf: Callable[[Column], Column], n: int, alpha: float, repetitions: int = 1000, seed: int = 123) -> float:
    """The critical value by simulation: repetitions are groups of rows, n values each."""
    rows = spark.range(repetitions).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k"))
    u = (F.pmod(F.xxhash64("r", "k", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    drawn = rows.select("r", quantile(u).alias("v"))
    i = F.row_number().over(Window.partitionBy("r").orderBy("v"))
    f = cdf(F.col("v"))
    gaps = drawn.select("r", F.greatest(F.abs((i - 1) / F.lit(float(n)) - f), F.abs(i / F.lit(float(n)) - f)).alias("g"))
    return gaps.groupBy("r").agg((F.max("g") * math.sqrt(n)).alias("t")).agg(F.percentile("t", 1 - alpha)).first()[0]


def sterling(n: int, k: int) -> int:
    """Stirling number of the second kind."""
    return sum((-1) ** j * math.comb(k, j) * (k - j) ** n for j in range(k + 1)) // math.factorial(k)
