"""Encoders, scalers, principal components, and dividing rows: fitting is an
aggregate, applying is a projection."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.arrays import argmax, vector
from brindle.operators.base import FIXED_SEED, Model, shuffled_key

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_CONTINUOUS = (T.FloatType, T.DoubleType)

# ---------------------------------------------------------------- shapes and types


def as_features(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Columns gathered in one array<double>: matrices, row and column vectors are this or a plain column."""
    return df.withColumn(out, vector(columns))


def as_column(df: DataFrame, array: str, out: str = "x") -> DataFrame:
    """An array as rows, with the 1-based place: a column vector."""
    return df.select("*", F.posexplode(array).alias("_at", out)).withColumn("_at", F.col("_at") + 1)


def flatten(x: Column | str) -> Column:
    return F.flatten(F.col(x) if isinstance(x, str) else x)


def is_sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(is_sortable(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return is_sortable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType)) if hasattr(T, "VariantType") else not isinstance(kind, T.MapType)


def row_vector(spark: SparkSession, values: Sequence[float], out: str = "features") -> DataFrame:
    """One row with the values as array<double>."""
    return spark.createDataFrame([([float(v) for v in values],)], f"`{out}` array<double>")


def column_types(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema}


def allow_missing(df: DataFrame) -> DataFrame:
    """The same rows under a schema in which every column may be null."""
    return df.select(*[F.when(F.col(f"`{f.name}`").isNotNull(), F.col(f"`{f.name}`")).alias(f.name) if not f.nullable else F.col(f"`{f.name}`") for f in df.schema])


def disallow_missing(df: DataFrame) -> DataFrame:
    """The same rows; a null anywhere is an error when they are read."""
    return df.select(*[F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} has a missing value"))).otherwise(F.col(c)).alias(c) for c in df.columns])


def single_unique(df: DataFrame, column: str, id_col: str = "_id") -> DataFrame:
    """Distinct values (of arrays: of their elements) in order of first appearance."""
    rows = df.select(F.col(id_col).alias("_i"), F.lit(0).alias("_j"), F.col(column).alias("value"))
    kind = df.schema[column].dataType
    while isinstance(kind, T.ArrayType):
        rows = rows.select("_i", F.posexplode("value").alias("_j2", "value2")).select("_i", F.col("_j2").alias("_j"), F.col("value2").alias("value"))
        kind = kind.elementType
    return rows.groupBy("value").agg(F.min(F.struct("_i", "_j")).alias("_at")).orderBy("_at").select("value")


def columns_with_missing(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    columns = list(columns or df.columns)
    got = df.agg(*[F.coalesce(F.bool_or(F.col(c).isNull()), F.lit(False)).alias(c) for c in columns]).first()
    return [c for c in columns if got[c]]


def is_integer_valued(x: Column | str) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return c == F.floor(c)


def permutations(values: Sequence[Any], keep_structure: bool = False) -> list[list[Any]]:
    """All orders of the values; with ``keep_structure`` all renamings of the distinct ones, the pattern kept."""
    if not keep_structure:
        return [list(p) for p in itertools.permutations(values)]
    classes = list(dict.fromkeys(values))
    return [[dict(zip(classes, p, strict=True))[v] for v in values] for p in itertools.permutations(classes)]


# ---------------------------------------------------------------- dividing rows


def numbered(df: DataFrame, *order: Column, out: str = "_n") -> DataFrame:
    """Rows numbered from 0 in an order, without one task for all rows.

    Literal bounds of the first order column cut the rows into ranges; each is numbered apart and adds the sizes of
    those before it (a number a range). Equal rows give equal ranges each time they are computed."""
    first, parts = order[0], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = df.select(first.alias("k")).schema["k"].dataType
    if isinstance(kind, (*_INTEGERS, *_CONTINUOUS, T.DateType, T.TimestampType)):
        cuts = df.agg(F.percentile_approx(first, [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    else:
        # at most some thousands of values, chosen by hash
        n = max(1, df.count() // 5000)
        some = [x[0] for x in df.select(first.alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(n)) == 0).where("k is not null").orderBy("k").limit(20_000).collect()]
        cuts = [some[len(some) * i // parts] for i in range(1, parts)] if some else []
    cuts = list(dict.fromkeys(cuts))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("_first"))) if cuts else F.lit(0)
    names = [f"_order{i}" for i in range(len(order))]
    rows = df.withColumns({**dict(zip(names, order, strict=True)), "_first": first}).withColumn("_part", F.when(F.col("_first").isNull(), 0).otherwise(part)).drop("_first")
    before, run = {}, 0
    for k, n in sorted((x[0], x[1]) for x in rows.groupBy("_part").count().collect()):
        before[k] = run
        run += n
    offset = F.element_at(F.create_map(*[x for k, v in before.items() for x in (F.lit(k), F.lit(v))]), F.col("_part")) if before else F.lit(0)
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*names)) - 1
    return rows.withColumn(out, (local + offset).cast("long")).drop(*names, "_part")


def _order(shuffle: bool, seed: int, id_col: str) -> tuple[Column, ...]:
    return (shuffled_key(seed, id_col), F.col(id_col)) if shuffle else (F.col(id_col),)


def shares_to_bounds(shares: Sequence[float], n: int) -> list[int]:
    """Row numbers at which the parts end; halves are rounded to even."""
    if abs(sum(shares) - 1.0) > 1e-9:
        raise ValueError("the shares must sum to 1")
    done, out = 0.0, []
    for s in shares:
        done += s
        out.append(round(done * n))
    return [*out[:-1], n]


def partition(df: DataFrame, shares: Sequence[float], *, shuffle: bool = True, seed: int = FIXED_SEED, id_col: str = "_id") -> list[DataFrame]:
    """Exact shares of the rows; what stands in one row stays together, so aligned arrays are one DataFrame."""
    n = df.count()
    bounds = shares_to_bounds(shares, n)
    rows = numbered(df, *_order(shuffle, seed, id_col))
    lows = [0, *bounds[:-1]]
    return [rows.where((F.col("_n") >= a) & (F.col("_n") < b)).drop("_n") for a, b in zip(lows, bounds, strict=True)]


def partition_columns(columns: Sequence[str], shares: Sequence[float], *, shuffle: bool = True, seed: int = FIXED_SEED) -> list[list[str]]:
    names = list(columns)
    if shuffle:
        names = [names[i] for i in np.random.default_rng(seed).permutation(len(names))]
    bounds = shares_to_bounds(shares, len(names))
    return [names[a:b] for a, b in zip([0, *bounds[:-1]], bounds, strict=True)]


def consistent_shuffle(df: DataFrame, seed: int = FIXED_SEED, id_col: str = "_id") -> DataFrame:
    return df.orderBy(shuffled_key(seed, id_col), id_col)


def batches(df: DataFrame, size: int, *, sequential: bool = False, seed: int = FIXED_SEED, id_col: str = "_id") -> DataFrame:
    """Rows with the number of their mini-batch; what does not fill a batch is left out, unless there is only one."""
    n = df.count()
    rows = numbered(df, *_order(not sequential, seed, id_col))
    full = 1 if size > n else n // size
    return rows.withColumn("batch", F.floor(F.col("_n") / size)).where(F.col("batch") < full).drop("_n")


class DataSampler:
    """Base of user-defined samplers: ``split(df)`` yields (train, validation) pairs."""

    def split(self, df: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
        raise NotImplementedError


@dataclass
class KFold(DataSampler):
    nsplits: int = 5
    nrepeats: int = 1
    shuffle: bool = True
    seed: int = FIXED_SEED
    id_col: str = "_id"

    def folds(self, df: DataFrame, repeat: int = 0) -> DataFrame:
        """The rows with their fold, 0 and up."""
        n = df.count()
        bounds = shares_to_bounds([1 / self.nsplits] * self.nsplits, n)
        fold = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("_n")))
        return numbered(df, *_order(self.shuffle, self.seed + repeat, self.id_col)).withColumn("fold", fold).drop("_n")

    def split(self, df: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
        for repeat in range(self.nrepeats):
            rows = self.folds(df, repeat).persist()  # the numbering is a sort
            try:
                for k in range(self.nsplits):
                    yield rows.where(F.col("fold") != k).drop("fold"), rows.where(F.col("fold") == k).drop("fold")
            finally:
                rows.unpersist()


# ---------------------------------------------------------------- encoders


@dataclass
class EncoderHyper:
    categories: list | None = None
    handle_unknown: str = "error"  # error, missing, infrequent
    other_categories_name: Any = None


class _Encoder(Model):
    Hyper = EncoderHyper

    def _fit(self, df: DataFrame, column: str, id_col: str = "_id") -> None:
        kind = df.schema[column].dataType
        self.par = {"column": column, "categories": None}
        if self.hpar.categories is not None:
            cats = list(self.hpar.categories)
        elif isinstance(kind, _CONTINUOUS) and not df.agg(F.bool_and(is_integer_valued(column))).first()[0]:
            self._info = {"n_categories": 0}
            return  # continuous values are left as they are
        elif isinstance(kind, (*_INTEGERS, *_CONTINUOUS)):
            low, high = df.agg(F.min(column), F.max(column)).first()
            cats = [] if low is None else list(range(int(low), int(high) + 1))
        else:
            cats = [r.value for r in single_unique(df.where(F.col(column).isNotNull()), column, id_col).collect()]
        if self.hpar.handle_unknown == "infrequent":
            cats.append(self.hpar.other_categories_name)
        self.par["categories"] = cats
        self._info = {"n_categories": len(cats)}

    def _position(self, x: Column) -> Column:
        cats = self.par["categories"]
        known = cats[:-1] if self.hpar.handle_unknown == "infrequent" else cats
        at = F.array_position(F.array(*map(F.lit, known)), x)
        if self.hpar.handle_unknown == "infrequent":
            at = F.when(at == 0, len(cats)).otherwise(at)
        elif self.hpar.handle_unknown == "missing":
            at = F.when(at == 0, None).otherwise(at)
        else:
            at = F.when(at == 0, F.raise_error(F.concat(F.lit("unknown category "), x.cast("string"))).cast("long")).otherwise(at)
        return F.when(x.isNull(), None).otherwise(at).cast("int")

    def _value(self, at: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.par["categories"])), at - 1)


class OrdinalEncoder(_Encoder):
    """The 1-based number of the category."""

    def _transform(self, df: DataFrame) -> DataFrame:
        x = F.col(self.par["column"])
        return df.withColumn("encoded", x if self.par["categories"] is None else self._position(x))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        at = F.col("encoded")
        return df.withColumn("decoded", at if self.par["categories"] is None else self._value(at))


class OneHotEncoder(_Encoder):
    """An array of booleans; a missing value gives an array of nulls."""

    def _transform(self, df: DataFrame) -> DataFrame:
        x, cats = F.col(self.par["column"]), self.par["categories"]
        if cats is None:
            return df.withColumn("encoded", x)
        at = self._position(x)
        return df.withColumn("encoded", F.transform(F.sequence(F.lit(1), F.lit(len(cats))), lambda k: k == at))

    def transform_pmf(self, df: DataFrame, pmf: str) -> DataFrame:
        """Maps of probabilities as arrays in the order of the categories."""
        return df.withColumn("encoded", F.array(*[F.coalesce(F.try_element_at(F.col(pmf), F.lit(c)), F.lit(0.0)) for c in self.par["categories"]]))

    def inverse_transform(self, df: DataFrame, probabilities: bool = False) -> DataFrame:
        e = F.col("encoded")
        if self.par["categories"] is None:
            return df.withColumn("decoded", e)
        at = argmax(e) if probabilities else F.array_position(e, F.lit(True))
        return df.withColumn("decoded", F.when(F.exists(e, lambda v: v.isNull()), None).otherwise(self._value(at.cast("int"))))


# ---------------------------------------------------------------- scalers


@dataclass
class MinMax:
    input_range: tuple[Callable[[Column], Column], Callable[[Column], Column]] = (F.min, F.max)
    output_range: tuple[float, float] = (0.0, 1.0)

    def aggregates(self, c: Column) -> tuple[Column, Column]:
        return self.input_range[0](c), self.input_range[1](c)

    def affine(self, low: float | None, high: float | None) -> tuple[float, float]:
        a, b = self.output_range
        if low is None or high is None or high == low:
            return float("nan"), float("nan")
        slope = (b - a) / (high - low)
        return slope, a - low * slope


@dataclass
class Standard:
    scale: bool = True
    center: bool = True

    def aggregates(self, c: Column) -> tuple[Column, Column]:
        return F.avg(c), F.stddev_pop(c)

    def affine(self, mean: float | None, sd: float | None) -> tuple[float, float]:
        if mean is None:
            return float("nan"), float("nan")
        slope = 1.0 if not self.scale else float("nan") if not sd else 1.0 / sd
        return slope, -mean * slope if self.center else 0.0


@dataclass
class ScalerHyper:
    method: Any = field(default_factory=Standard)
    skip: tuple[str, ...] = ()


class Scaler(Model):
    """x -> slope * x + shift per column; missing values stay missing, constant columns become NaN."""

    Hyper = ScalerHyper

    def _fit(self, df: DataFrame, columns: Sequence[str]) -> None:
        used = [c for c in columns if c not in self.hpar.skip]
        aggs = [a for c in used for a in self.hpar.method.aggregates(F.col(c).cast("double"))]
        got = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first() if aggs else []
        self.par = {c: self.hpar.method.affine(got[2 * i], got[2 * i + 1]) for i, c in enumerate(used)}
        self._info = {"columns": list(columns), "scaled": used}

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(a) + F.lit(b) for c, (a, b) in self.par.items()})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(b)) / F.lit(a) if a else F.lit(None).cast("double") for c, (a, b) in self.par.items()})


# ---------------------------------------------------------------- principal components


@dataclass
class PCAHyper:
    encoded_size: int | None = None
    max_unexplained_var: float = 0.05


class PCAEncoder(Model):
    """Projection on the main eigenvectors of the population covariance; rows are not centred before it."""

    Hyper = PCAHyper

    def _fit(self, df: DataFrame, columns: Sequence[str]) -> None:
        columns = list(columns)
        if columns_with_missing(df, columns):
            raise ValueError("missing values are not supported")
        pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
        got = df.agg(*[F.covar_pop(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")).alias(f"c{i}_{j}") for i, j in pairs]).first()
        cov = np.zeros((len(columns),) * 2)
        for (i, j), v in zip(pairs, got, strict=True):
            cov[i, j] = cov[j, i] = v
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1], vectors[:, ::-1]
        share = np.cumsum(values) / values.sum()
        k = self.hpar.encoded_size or int(np.argmax(share >= 1 - self.hpar.max_unexplained_var)) + 1
        self.par = {"columns": columns, "loadings": vectors[:, :k]}
        self._info = {"explained_var_by_dim": share.tolist(), "prop_explained_var": float(share[k - 1]), "retained_dims": k}

    def _transform(self, df: DataFrame) -> DataFrame:
        parts = [sum((F.col(c).cast("double") * F.lit(float(w)) for c, w in zip(self.par["columns"][1:], loading[1:], strict=True)), F.col(self.par["columns"][0]).cast("double") * F.lit(float(loading[0]))) for loading in self.par["loadings"].T]
        return df.withColumn("encoded", F.array(*parts))


def covariance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population covariances as rows i, j, covariance, in one pass."""
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias("covariance")) for a, b in pairs]).alias("x"))
    return row.select(F.inline("x"))


