"""Imputers of missing values."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.base import Model
from brindle.operators.gmm import _GMM, fill


@dataclass
class SimpleHyper:
    statistic: Callable[[Column], Column] = F.avg
    norm: float | None = None


class SimpleImputer(Model):
    """A statistic of the column; with ``norm`` p it is scaled by the row's p-norm over the sum of norms."""

    Hyper = SimpleHyper

    def _norms(self, columns: Sequence[str]) -> Column:
        p = float(self.hpar.norm)
        cells = [F.col(c).cast("double") for c in columns]
        total = sum((F.coalesce(F.pow(F.abs(c), F.lit(p)), F.lit(0.0)) for c in cells[1:]), F.coalesce(F.pow(F.abs(cells[0]), F.lit(p)), F.lit(0.0)))
        n = sum((c.isNotNull().cast("int") for c in cells[1:]), cells[0].isNotNull().cast("int"))
        return F.when(n > 0, F.pow(total, F.lit(1 / p)) / n)

    def _fit(self, df: DataFrame, columns: Sequence[str]) -> None:
        columns = list(columns)
        aggs = [self.hpar.statistic(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)]
        got = df.agg(*aggs, *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)]).first()
        stats = list(got[: len(columns)])
        known = [s for s in stats if s is not None]
        stats = [s if s is not None else sum(known) / len(known) if known else None for s in stats]
        self.par = {"columns": columns, "statistics": stats}
        self._info = {"n_imputed_values": sum(got[len(columns) :])}

    def _transform(self, df: DataFrame) -> DataFrame:
        columns = self.par["columns"]
        if self.hpar.norm is None:
            return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(s)) for c, s in zip(columns, self.par["statistics"], strict=True)})
        # norms of the rows at hand; a row without values has their mean
        tagged = df.withColumn("_norm", self._norms(columns))
        total, mean, n = tagged.agg(F.sum("_norm"), F.avg("_norm"), F.count(F.lit(1))).first()
        norm = F.coalesce(F.col("_norm"), F.lit(mean))
        whole = (mean or 0.0) * n
        return tagged.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(s) * norm / F.lit(whole)) for c, s in zip(columns, self.par["statistics"], strict=True)}).drop("_norm")


class GaussianMixtureImputer(_GMM):
    """Missing cells from the mixtures, weighted by responsibility."""

    def _fit(self, df: DataFrame, columns: Sequence[str]) -> None:
        self.par = {"fit": self._em(df, columns), "columns": list(columns)}
        holes = df.agg(*[F.count_if(F.col(c).isNull()) for c in columns]).first()
        self._info["n_imputed_values"] = sum(holes)

    def _transform(self, df: DataFrame) -> DataFrame:
        return fill(df, self.par["columns"], self.par["fit"])

    def _of_fit(self, df: DataFrame) -> DataFrame:
        return fill(df, self.par["columns"], self.par["fit"], of_fit=True)


def _by_missing(df: DataFrame, columns: Sequence[str]) -> list[str]:
    got = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return [columns[i] for i in sorted(range(len(columns)), key=lambda i: (-got[i], -i))]


@dataclass
class GeneralHyper:
    cols_to_impute: Any = "auto"  # auto: those with missing values; all; or names
    estimator: Any = None  # a model, or a dictionary by column; a forest by default
    missing_supported: Any = False
    fit_function: Callable | None = None  # fit(estimator, df, features, target)
    predict_function: Callable | None = None  # predict(estimator, df) with a column prediction
    recursive_passages: int = 1
    multiple_imputations: int = 1


class GeneralImputer(Model):
    """Each column is predicted from the others by an estimator; later passages use what earlier ones filled in."""

    Hyper = GeneralHyper

    def _estimator(self, df: DataFrame, column: str, seed: int) -> Any:
        from brindle.operators.trees import RandomForestEstimator

        chosen = self.hpar.estimator
        chosen = chosen.get(column) if isinstance(chosen, dict) else chosen
        if chosen is None:
            return RandomForestEstimator(seed=seed, cache=False)
        twin = chosen.copy() if isinstance(chosen, Model) else chosen
        if isinstance(twin, Model):
            twin.opt.cache, twin.opt.seed = False, seed
        return twin

    def _supported(self, column: str) -> bool:
        s = self.hpar.missing_supported
        return s[column] if isinstance(s, dict) else bool(s)

    def _chosen(self, df: DataFrame, columns: list[str]) -> list[str]:
        ordered = _by_missing(df, columns)
        if self.hpar.cols_to_impute == "all":
            return ordered
        if self.hpar.cols_to_impute == "auto":
            got = df.agg(*[F.bool_or(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(ordered)]).first()
            return [c for c, x in zip(ordered, got, strict=True) if x]
        return [c for c in ordered if c in self.hpar.cols_to_impute]

    def _fit(self, df: DataFrame, columns: Sequence[str], id_col: str = "_id") -> None:
        columns = list(columns)
        targets = self._chosen(df, columns)
        kinds = {c: df.schema[c].dataType for c in columns}
        holes = df.agg(*[F.count_if(F.col(c).isNull()) for c in columns]).first()
        runs = []
        for m in range(self.hpar.multiple_imputations):
            now, models = df, {}
            for passage in range(self.hpar.recursive_passages):
                filled = now
                for k, target in enumerate(targets):
                    others = [c for c in columns if c != target]
                    rows = now.where(F.col(target).isNotNull()) if passage == 0 else df.where(F.col(target).isNotNull()).select(id_col, target).join(now.drop(target), id_col)
                    use = others
                    if not self._supported(target) and passage == 0:
                        # features that are missing in a row to fill are left out, then complete rows are used
                        gaps = now.where(F.col(target).isNull()).agg(*[F.coalesce(F.bool_or(F.col(c).isNull()), F.lit(False)).alias(f"g{i}") for i, c in enumerate(others)]).first()
                        use = [c for c, g in zip(others, gaps, strict=True) if not g]
                        rows = rows.dropna(subset=use) if use else rows
                    if not use:
                        continue
                    est = self._estimator(df, target, self.opt.seed + 1000 * m + 100 * passage + k)
                    est = (self.hpar.fit_function or (lambda e, d, x, y: e.fit(d, x, y)))(est, rows, use, target) or est
                    models[target] = (est, use)
                for target, (est, use) in models.items():
                    filled = self._put(filled, df, target, est, kinds[target], id_col)
                now = filled
            runs.append(models)
        self.par = {"columns": columns, "models": runs, "kinds": kinds, "id_col": id_col}
        self._info = {"n_imputed_values": sum(holes), "cols_imputed": targets}

    def _value(self, kind: T.DataType) -> Column:
        p = F.col("prediction")
        if isinstance(kind, T.StringType):
            from brindle.functions.pmf import mode_of_map

            return mode_of_map(p)
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return F.bround(p).cast(kind)
        return p.cast(kind)

    def _put(self, rows: DataFrame, original: DataFrame, target: str, est: Any, kind: T.DataType, id_col: str) -> DataFrame:
        was = original.select(F.col(id_col), F.col(target).alias("_was")) if rows is not original else None
        tagged = (self.hpar.predict_function or (lambda e, d: e.transform(d)))(est, rows)
        value = self._value(kind)
        if was is None:
            return tagged.withColumn(target, F.coalesce(F.col(target), value)).drop("prediction")
        return tagged.join(was, id_col).withColumn(target, F.coalesce(F.col("_was"), value)).drop("prediction", "_was")

    def imputations(self, df: DataFrame) -> list[DataFrame]:
        """One DataFrame for each of the multiple imputations."""
        out = []
        for models in self.par["models"]:
            rows = df
            for target, (est, _) in models.items():
                rows = self._put(rows, df, target, est, self.par["kinds"][target], self.par["id_col"])
            out.append(rows)
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.imputations(df)[0]


@dataclass
class ForestImputerHyper(GeneralHyper):
    missing_supported: Any = True
    forced_categorical_cols: list[str] = field(default_factory=list)
    n_trees: int = 30
    max_depth: int | None = None
    min_gain: float = 0.0
    min_records: int = 2
    max_features: int | None = None
    splitting_criterion: Any = None
    oob: bool = False


class RandomForestImputer(GeneralImputer):
    """A forest a column, columns by decreasing number of missing values; integers are rounded, labels by majority."""

    Hyper = ForestImputerHyper

    def _estimator(self, df: DataFrame, column: str, seed: int) -> Any:
        from brindle.operators.trees import RandomForestEstimator

        h = self.hpar
        kind = df.schema[column].dataType
        return RandomForestEstimator(n_trees=h.n_trees, max_depth=h.max_depth, min_gain=h.min_gain, min_records=h.min_records, max_features=h.max_features, splitting_criterion=h.splitting_criterion, oob=h.oob, force_classification=column in h.forced_categorical_cols or isinstance(kind, T.StringType), seed=seed, cache=False)

    def _value(self, kind: T.DataType) -> Column:
        return super()._value(kind)
