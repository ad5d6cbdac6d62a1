"""Incremental fits as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.operators.base import Model, model_save


def fit_stream(model: Model, stream: DataFrame, *args: Any, checkpoint: str, save_to: str | None = None, name: str = "model", trigger: dict | None = None, **kwargs: Any) -> StreamingQuery:
    """Each micro-batch is a further fit of the model (K-means, mixtures, networks, confusion matrices);
    with ``save_to`` the parameters after each batch are stored under a versioned name."""
    if not model.online:
        raise ValueError(f"{type(model).__name__} does not train incrementally")

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        model.fit(batch, *args, **kwargs)
        if save_to:
            model_save(batch.sparkSession, save_to, **{f"{name}_{number}": model})

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_mean(stream: DataFrame, column: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """The exact mean so far, by group; the state is a sum and a count a group."""
    c = F.col(column) if isinstance(column, str) else column
    return stream.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"))


def windowed(stream: DataFrame, time: str, length: str, aggregates: Sequence[Column], *, late: str = "10 minutes", slide: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Aggregates over event-time windows; what comes later than ``late`` is left out, so state is bounded."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length, slide) if slide else F.window(time, length), *by).agg(*aggregates)


def confusion_stream(stream: DataFrame, y: str, y_hat: str) -> DataFrame:
    """Counts of actual by predicted labels so far, in complete mode."""
    return stream.groupBy(y, y_hat).agg(F.count(F.lit(1)).alias("count"))


def for_each(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
