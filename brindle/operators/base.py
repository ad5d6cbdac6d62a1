"""What all models share: options, verbosity, the fit / transform / inverse
interface, reports, reset and persistence."""

from __future__ import annotations

import dataclasses
import enum
import logging
import pickle
import uuid
import warnings
from dataclasses import dataclass
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIXED_SEED = 123
log = logging.getLogger("brindle")


class Verbosity(enum.IntEnum):
    NONE = 0
    LOW = 10
    STD = 20
    HIGH = 30
    FULL = 40

    @classmethod
    def from_integer(cls, i: int) -> Verbosity:
        """The step at or below a number: 0 none, 1-10 low, 11-20 std, 21-30 high, above full."""
        for step in cls:
            if i <= step:
                return step
        return cls.FULL

    @classmethod
    def from_steps(cls, i: int) -> Verbosity:
        """Steps 0, 1, 2, 3 and more of host frameworks."""
        return [cls.NONE, cls.LOW, cls.STD, cls.HIGH][i] if 0 <= i <= 3 else cls.FULL


@dataclass
class Options:
    cache: bool = True
    descr: str = ""
    autotune: bool = False
    verbosity: Verbosity = Verbosity.STD
    seed: int = FIXED_SEED


class NotFitted(ValueError):
    pass


def shuffled_key(seed: int, id_col: str = "_id"):
    """An order key that depends on the row's id and the seed only, never on partitions."""
    return F.xxhash64(F.col(id_col), F.lit(seed))


class Model:
    """Base of all models.

    Subclasses set ``Hyper`` (a dataclass) and write ``_fit(df, ...)`` and
    ``_transform(df)``. Keywords of the constructor go to the hyper-parameters or
    the options, whichever has a field of that name.
    """

    @dataclass
    class Hyper:
        pass

    OptionsType = Options
    supervised = False
    online = False

    def __init__(self, **kwargs: Any):
        hyper = {f.name for f in dataclasses.fields(self.Hyper)}
        opts = {f.name for f in dataclasses.fields(self.OptionsType)}
        if unknown := set(kwargs) - hyper - opts:
            raise TypeError(f"{type(self).__name__} has no {', '.join(sorted(unknown))}")
        self.hpar = self.Hyper(**{k: v for k, v in kwargs.items() if k in hyper})
        self.opt = self.OptionsType(**{k: v for k, v in kwargs.items() if k in opts})
        self.par: Any = None
        self.fitted = False
        self._info: dict[str, Any] = {}
        self._cached: DataFrame | None = None

    # ------------------------------------------------------------ verbs

    def fit(self, df: DataFrame, *args: Any, **kwargs: Any) -> Model:
        if self.fitted and not self.online:
            warnings.warn(f"{type(self).__name__} does not train incrementally: it is fitted anew", stacklevel=2)
        if self.opt.autotune and not self.fitted:
            from brindle.operators.tune import autotune

            autotune(self, df, *args, **kwargs)
        self._fit(df, *args, **kwargs)
        self.fitted = True
        self._cached = self._of_fit(df) if self.opt.cache and hasattr(self, "_transform") else None
        return self

    fit_ex = fit

    def _of_fit(self, df: DataFrame) -> DataFrame:
        """What predict() without rows gives after a fit."""
        return self.transform(df)

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise NotFitted(f"{type(self).__name__} is not fitted")
        return self._transform(df)

    def predict(self, df: DataFrame | None = None) -> DataFrame | None:
        """Of new rows; without rows, the (lazy) result for those of the last fit."""
        if df is not None:
            return self.transform(df)
        if not self.fitted:
            warnings.warn("the model is not fitted", stacklevel=2)
            return None
        return self._cached

    def inverse_transform(self, df: DataFrame) -> DataFrame | None:
        return None

    inverse_predict = inverse_transform

    def info(self) -> dict[str, Any]:
        return dict(self._info)

    def parameters(self) -> Any:
        return self.par

    def hyperparameters(self) -> Any:
        return self.hpar

    def options(self) -> Options:
        return self.opt

    def set_hyperparameters(self, values: dict[str, Any]) -> Model:
        self.hpar = dataclasses.replace(self.hpar, **values)
        return self

    def reset(self) -> Model:
        if self._cached is not None:
            self._cached.unpersist()
        self.par, self.fitted, self._info, self._cached = None, False, {}, None
        return self

    reset_ex = reset

    def copy(self) -> Model:
        twin = type(self)(**{f.name: getattr(self.hpar, f.name) for f in dataclasses.fields(self.hpar)})
        twin.opt = dataclasses.replace(self.opt)
        return twin

    def __repr__(self) -> str:
        return f"{type(self).__name__}({'fitted' if self.fitted else 'not fitted'})"

    def describe(self) -> str:
        lines = [f"{type(self).__name__}: {self.opt.descr}".rstrip(": "), f"  hyper-parameters: {self.hpar}", f"  options: {self.opt}"]
        if self.fitted:
            lines += ["  report:", *(f"    {k}: {v}" for k, v in self._info.items())]
        return "\n".join(lines)

    def _say(self, level: Verbosity, text: str) -> None:
        if self.opt.verbosity >= level:
            log.info(text)

    # what is stored; DataFrames stay out
    def __getstate__(self):
        return {**self.__dict__, "_cached": None}


class AutoTuneMethod:
    """Base of user-defined tuning methods: ``tune(model, df, *args, **kwargs)``."""

    def tune(self, model: Model, df: DataFrame, *args: Any, **kwargs: Any) -> None:
        raise NotImplementedError


# ---------------------------------------------------------------- persistence


def model_save(spark: SparkSession, path: str, overwrite: bool = False, **models: Any) -> None:
    """Store models under their names in one Parquet table; others of that table
    stay unless ``overwrite``, one of the same name is replaced."""
    new = {k: bytearray(cloudpickle.dumps(v)) for k, v in models.items()}
    if not overwrite:
        try:
            old = {r.name: r.model for r in spark.read.parquet(path).collect()}
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = {}
        new = old | new
    # written beside and renamed: a failure on the way leaves the old table or the new one, whole
    beside, behind = f"{path.rstrip('/')}.{uuid.uuid4().hex}.new", f"{path.rstrip('/')}.{uuid.uuid4().hex}.old"
    spark.createDataFrame(sorted(new.items()), "name string, model binary").coalesce(1).write.parquet(beside)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().hadoopConfiguration()
    at, new_, old_ = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, beside, behind))
    fs = at.getFileSystem(conf)
    there = fs.exists(at)
    if there and not fs.rename(at, old_):
        raise OSError(f"{path} can't be replaced")
    if not fs.rename(new_, at):
        raise OSError(f"{path} can't be written; the old table is {behind}" if there else f"{path} can't be written")
    if there:
        fs.delete(old_, True)


def model_load(spark: SparkSession, path: str, *names: str) -> Any:
    """One model, several (a tuple), or all (a dictionary by name). Load only files you wrote: they hold Python objects."""
    df = spark.read.parquet(path)
    if names:
        df = df.where(F.col("name").isin(*names))
    got = {r.name: pickle.loads(bytes(r.model)) for r in df.collect()}
    if not names:
        return got
    if missing := [n for n in names if n not in got]:
        raise KeyError(f"no model {', '.join(missing)} in {path}")
    return got[names[0]] if len(names) == 1 else tuple(got[n] for n in names)
