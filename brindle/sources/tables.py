"""Readers that give rows an ``_id``, and the sinks of tables and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.base import model_load, model_save

__all__ = ["in_memory", "model_load", "model_save", "read_delimited", "read_table", "with_id", "write_table"]


def with_id(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """``_id`` in the given order (0 and up); without an order one that only grows with partition and place."""
    if order is None:
        return df.withColumn("_id", F.monotonically_increasing_id())
    from brindle.operators.prep import numbered

    return numbered(df, *[F.col(c) for c in order], out="_id")


def read_table(spark: SparkSession, path: str, id_col: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table; a column serves as the id, else rows get one."""
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*dict.fromkeys([*columns, *([id_col] if id_col else [])]))
    return df.withColumn("_id", F.col(id_col).cast("long")) if id_col else with_id(df)


def read_delimited(spark: SparkSession, path: str, names: Sequence[str], *, sep: str = ",", header: bool = False, missing: str = "?", kinds: Sequence[str] | None = None, repeated_blanks: bool = False) -> DataFrame:
    """Separated text with ids in file order. ``missing`` stands for a null; fields that are not of their kind become null."""
    if repeated_blanks:
        lines = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id())
        parts = F.split(F.btrim("value"), r"\s+", len(names))
        df = lines.where(F.btrim("value") != "").select("_id", *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])
    else:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        df = spark.read.schema(schema).csv(path, sep=sep, header=header, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).withColumn("_id", F.monotonically_increasing_id())
    kinds = kinds or ["double"] * len(names)
    return df.select("_id", *[(F.when(F.col(n) == missing, None).otherwise(F.col(n)) if k == "string" else F.col(n).try_cast(k)).alias(n) for n, k in zip(names, kinds, strict=True)])


def in_memory(spark: SparkSession, rows: Sequence[Sequence], names: Sequence[str], kinds: Sequence[str] | None = None) -> DataFrame:
    """Rows of a program as a DataFrame with ids in their order."""
    spec = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds or ["double"] * len(names), strict=True))
    turn = lambda v, k: float(v) if k == "double" and v is not None else v
    kinds = kinds or ["double"] * len(names)
    return spark.createDataFrame([(i, *[turn(v, k) for v, k in zip(r, kinds, strict=True)]) for i, r in enumerate(rows)], f"_id long, {spec}")


def write_table(df: DataFrame, path: str, *, mode: str = "error", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
