"""K-means and K-medoids: each iteration is one aggregate over a projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.arrays import bind, vector
from brindle.functions.distances import Distance, by_column, l2_distance, nearest, nearest_of
from brindle.operators.base import Model, shuffled_key
from brindle.operators.measures import Vectors, blocks_for, line_sums, paired, silhouette_of_rows


def grid(lows: Sequence[float], highs: Sequence[float], k: int) -> list[list[float]]:
    """k points on the diagonal of the box, half a step from its ends."""
    return [[lo + (hi - lo) / (2 * k) + i * (hi - lo) / k for lo, hi in zip(lows, highs, strict=True)] for i in range(k)]


def init_representatives(df: DataFrame, columns: Sequence[str], k: int, strategy: str = "grid", given: list | None = None, seed: int = 123, id_col: str = "_id") -> list[list[float]]:
    if strategy == "given":
        if given is None:
            raise ValueError("strategy 'given' needs initial_representatives")
        return [list(map(float, p)) for p in given]
    if strategy == "shuffle":
        return [[float(v) for v in r] for r in df.orderBy(shuffled_key(seed, id_col), id_col).limit(k).select(*columns).collect()]
    got = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i, c in enumerate(columns)]).first()
    lows, highs = list(got[: len(columns)]), list(got[len(columns) :])
    if strategy == "random":
        return np.random.default_rng(seed).uniform(lows, highs, (k, len(columns))).tolist()
    if strategy != "grid":
        raise ValueError(f"no strategy {strategy!r}")
    return grid(lows, highs, k)


def assign(df: DataFrame, x: Column, points: list[list[float]], distance: Distance = l2_distance, out: str = "cluster") -> DataFrame:
    return df.withColumn(out, nearest(x, points, distance))


def kmeans_update(df: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Mean and size of each cluster; partial sums before the shuffle."""
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in columns])


def kmedoids_update(df: DataFrame, id_col: str, features: str, cluster: str = "cluster", distance: Distance = l2_distance, blocks: int | None = None) -> DataFrame:
    """The member of each cluster with the least sum of distances to the others, the first of equals.

    On a line the sums come from prefix sums. Otherwise pairs within a cluster are this operator's definition; blocks
    of members keep any one cluster from being one task, and grow with the rows unless given. Sums are exact on a line
    and have 12 digits elsewhere, so that equal ones tie in any order of addition."""
    rows = df.select(F.col(id_col).alias("i"), F.col(cluster).alias("k"), F.col(features).alias("x")).where("k is not null and i is not null")
    seen = Vectors.of(rows, "x")
    if seen.on_a_line(distance):
        at = rows.withColumn("v", seen.whole(F.get("x", F.lit(0)).cast("double")))
        per = at.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("i"), F.min_by("x", "i").alias("x"))
        costs = line_sums(per, "k").withColumnRenamed("_s", "order").withColumn("cost", seen.back(F.col("order")))
    else:
        # all ordered pairs: the distance of a row to the others is the caller's, in its direction
        met = paired(rows, [], distance, blocks or blocks_for(seen.n, 8), seen.width, ["k"], both=True)
        s = F.sum("distance")
        unit = F.pow(F.lit(10.0), F.lit(11) - F.floor(F.log10(F.when(s > 0, s))))
        costs = met.groupBy("k", "i").agg(F.coalesce(F.rint(s * unit) / unit, s).alias("cost")).withColumn("order", F.col("cost")).join(rows, ["k", "i"])
    best = costs.groupBy("k").agg(F.min_by(F.struct("i", "x", "cost"), F.struct("order", "i")).alias("m"))
    return best.select(F.col("k").alias(cluster), F.col("m.i").alias(id_col), F.col("m.x").alias(features), F.col("m.cost").alias("cost"))


@dataclass
class KMeansHyper:
    n_classes: int = 3
    dist: Distance = l2_distance
    initialisation_strategy: str = "grid"
    initial_representatives: list | None = None
    max_iter: int = 1000


@dataclass
class KMedoidsHyper(KMeansHyper):
    initialisation_strategy: str = "shuffle"


class _Clusterer(Model):
    """A new fit starts from the representatives of the last one."""

    online = True

    def _x(self) -> Column:
        return vector(self.par["columns"])

    def _start(self, df: DataFrame, columns: Sequence[str], id_col: str) -> list[list[float]]:
        if self.par:
            return [list(p) for p in self.par["representatives"]]
        return init_representatives(df, columns, self.hpar.n_classes, self.hpar.initialisation_strategy, self.hpar.initial_representatives, self.opt.seed, id_col)

    def _update(self, rows: DataFrame, columns: list[str], id_col: str, points: list) -> list:
        raise NotImplementedError

    def _step(self, rows: DataFrame, columns: list[str], id_col: str, points: list, changed: Column | None) -> list | None:
        """The next representatives, or None if no row changed its cluster."""
        if changed is not None and not rows.agg(F.count_if(changed)).first()[0]:
            return None
        return self._update(rows, columns, id_col, points)

    def _fit(self, df: DataFrame, columns: Sequence[str], id_col: str = "_id") -> None:
        columns = list(columns)
        points = self._start(df, columns, id_col)
        rows = df.select(id_col, *columns).persist()
        try:
            xs, before = [F.col(c).cast("double") for c in columns], None
            for step in range(self.hpar.max_iter):
                tagged = rows.withColumn("cluster", nearest_of(xs, points, self.hpar.dist))
                changed = None if before is None else F.col("cluster") != nearest_of(xs, before, self.hpar.dist)
                got = self._step(tagged, columns, id_col, points, changed)
                if got is None:
                    break
                before, points = points, got
            own = [F.get(F.array(*[F.lit(p[i]) for p in points]), F.col("cluster") - 1) for i in range(len(columns))]
            gap = by_column(self.hpar.dist, xs, own)
            n, far = tagged.agg(F.count(F.lit(1)), F.avg(self.hpar.dist(F.array(*xs), F.array(*own)) if gap is None else gap)).first()
        finally:
            rows.unpersist()
        done = self._info.get("fitted_records", 0)
        self.par = {"columns": columns, "representatives": points}
        self._info = {"fitted_records": done + n, "av_distance_last_fit": far, "xndims": len(columns), "iterations": step}

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", nearest_of([F.col(c).cast("double") for c in self.par["columns"]], self.par["representatives"], self.hpar.dist))

    def distances(self, df: DataFrame) -> DataFrame:
        """The distance of each row to every representative."""
        return df.withColumn("distances", bind(self._x(), lambda x: F.array(*[self.hpar.dist(x, F.array(*map(F.lit, p))) for p in self.par["representatives"]])))


class KMeansClusterer(_Clusterer):
    Hyper = KMeansHyper

    def _step(self, rows: DataFrame, columns: list[str], id_col: str, points: list, changed: Column | None) -> list | None:
        """Changed rows are counted in the pass that takes the means."""
        got = {r["cluster"]: r for r in rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lit(False) if changed is None else changed).alias("changed"), *[F.avg(c).alias(c) for c in columns]).collect()}  # a row a cluster
        if changed is not None and not sum(r["changed"] for r in got.values()):
            return None
        n = sum(r["n"] for r in got.values())
        centre = [sum(r["n"] * r[c] for r in got.values()) / n for c in columns] if n else []
        out = []
        for k, p in enumerate(points, 1):
            if k in got:
                out.append([got[k][c] for c in columns])
            else:  # an empty cluster moves a little towards the mean of all
                out.append([a + 0.01 * (m - a) for a, m in zip(p, centre, strict=True)])
        return out


class KMedoidsClusterer(_Clusterer):
    Hyper = KMedoidsHyper

    def _update(self, rows: DataFrame, columns: list[str], id_col: str, points: list) -> list:
        got = {r["cluster"]: list(r["features"]) for r in kmedoids_update(rows.withColumn("features", vector(columns)), id_col, "features", "cluster", self.hpar.dist).collect()}
        return [got.get(k, p) for k, p in enumerate(points, 1)]


def silhouette_of(df: DataFrame, columns: Sequence[str], cluster: str, id_col: str = "_id", distance: Distance = l2_distance) -> DataFrame:
    return silhouette_of_rows(df.select(F.col(id_col).alias("i"), vector(columns).alias("x"), F.col(cluster).alias("label")), distance)


