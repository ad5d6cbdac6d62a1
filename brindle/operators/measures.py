"""Counts, impurities, losses, distances between rows, and the confusion matrix."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.arrays import ratio
from brindle.functions.distances import Distance, by_column, kl_divergence, l1_distance, l2_distance
from brindle.operators.base import Model

# ---------------------------------------------------------------- counts and impurity


def class_counts(df: DataFrame, columns: str | Sequence[str], classes: Sequence[Any] | None = None) -> DataFrame:
    """Rows of each distinct item (or combination); given classes are all there, in their order, with 0 if absent."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))
    if classes is None:
        return counts
    rows = [(i, *(c if isinstance(c, (tuple, list)) else (c,))) for i, c in enumerate(classes)]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    wanted = df.sparkSession.createDataFrame(rows, f"_order int, {kinds}")  # the caller's list
    joined = wanted.join(counts, columns, "left")
    return joined.orderBy("_order").select(*columns, F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def gini(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    return _moments(df, column, by, lambda n, a: F.sum(F.pow(n / a, F.lit(2.0))), lambda s: 1.0 - s, "gini")


def entropy(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    return _moments(df, column, by, lambda n, a: F.sum(n / a * F.log2(n / a)), lambda s: -s, "entropy")


def _moments(df: DataFrame, column: str, by: Sequence[str], inner, outer, name: str) -> DataFrame:
    by = list(by)
    counts = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    joined = counts.join(totals, by) if by else counts.join(F.broadcast(totals))  # one row
    return joined.groupBy(*by).agg(outer(inner(F.col("_n"), F.col("_all"))).alias(name))


def variance(column: Column | str) -> Column:
    """Population variance, as an aggregate."""
    return F.var_pop(column)


def bic(log_likelihood: float, k: float, n: float) -> float:
    return k * math.log(n) - 2 * log_likelihood


def aic(log_likelihood: float, k: float) -> float:
    return 2 * k - 2 * log_likelihood


def online_mean(new: float, mean: float = 0.0, n: int = 0) -> float:
    return (mean * n + new) / (n + 1)


# ---------------------------------------------------------------- pairs


#: Rows of a block, so that a task meets its square in pairs at most; as many are buffered in memory by a merge join.
BLOCK_ROWS = 2048


def blocks_for(n: int, least: int) -> int:
    """How many blocks n rows are dealt into: they grow with the rows, so a pair of blocks does not."""
    return max(least, -(-n // BLOCK_ROWS))


def paired(rows: DataFrame, carried: Sequence[str], distance: Distance, blocks: int, width: int | None = None, within: Sequence[str] = (), both: bool = False) -> DataFrame:
    """Pairs of rows (i, x, carried): i, j, the carried columns of both (``_`` before those of j), x and the distance.

    Rows are dealt into blocks and each pair of blocks (and of the columns ``within``) is one key of an equi-join. The
    number of its parts is given: Spark would otherwise join them by the bytes read, which are few, into a single task.
    A symmetric distance of vectors of a known width is compiled over all pairs; other distances see i >= j only
    unless ``both``; those marked by ``_half`` have to be mirrored by the caller."""
    xs = [F.get("x", F.lit(k)) for k in range(width or 0)]
    names, others = [f"_x{k}" for k in range(len(xs))], [f"_y{k}" for k in range(len(xs))]
    quick = by_column(distance, [F.col(c) for c in names], [F.col(c) for c in others])
    block = F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int")
    rows = rows.where("i is not null").withColumn("b", block)
    spread = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    mine = [x.alias(n) for x, n in zip(xs, names, strict=True)] if quick is not None else [F.col("x")]
    yours = [x.alias(n) for x, n in zip(xs, others, strict=True)] if quick is not None else [F.col("x").alias("y")]
    left = rows.select("i", *within, *carried, *mine, "b", spread.alias("c"))
    right = rows.select(F.col("i").alias("j"), *within, *[F.col(c).alias(f"_{c}") for c in carried], *yours, F.col("b").alias("c"), spread.alias("b"))
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, min(blocks * blocks // 4, 20_000))
    met = left.repartition(parts, *within, "b", "c").join(right.repartition(parts, *within, "b", "c"), [*within, "b", "c"])
    if quick is not None:
        return met.withColumns({"distance": quick, "_half": F.lit(False)})
    return (met if both else met.where("i >= j")).withColumns({"distance": distance(F.col("x"), F.col("y")), "_half": F.col("i") != F.col("j")})


@dataclass
class Vectors:
    """What a pass over an array column tells: rows, their common width if there is one, and the greatest absolute number
    if all are there and finite."""

    n: int
    width: int | None
    top: float | None

    @classmethod
    def of(cls, df: DataFrame, x: str) -> Vectors:
        size = F.coalesce(F.size(x), F.lit(-1))
        n, low, high = df.agg(F.count(F.lit(1)), F.min(size), F.max(size)).first()
        if low != high or low < 1 or low > 16:
            return cls(n, None, None)
        first = F.get(x, F.lit(0)).cast("double")
        top, bad = df.agg(F.max(F.abs(first)), F.count_if(first.isNull() | F.isnan(first))).first() if low == 1 else (None, 1)
        return cls(n, low, None if bad or top is None or math.isinf(top) else top)

    def on_a_line(self, distance: Distance) -> bool:
        return self.width == 1 and self.top is not None and distance in (l1_distance, l2_distance)

    def digits(self) -> int:
        """Decimals that leave 15 digits to the greatest number."""
        return max(-290, min(290, 14 - math.floor(math.log10(self.top)))) if self.top else 0

    def whole(self, x: Column) -> Column:
        """A number as a whole one of 10 ** -digits, so that sums are exact, and equal ones are equal, in any order."""
        return F.round(x * F.lit(float(10.0 ** self.digits()))).cast("decimal(18,0)")

    def back(self, x: Column) -> Column:
        return x.cast("double") / F.lit(float(10.0 ** self.digits()))


def line_sums(per: DataFrame, by: str) -> DataFrame:
    """_s, the sum of distances on a line from each value v to all members of its group, from their numbers n by value, and _n, their number.

    With N members up to v whose sum is P, of all T with sum S, that is v (2 N - T) - 2 P + S: a sort and two windows
    instead of all pairs."""
    up, all_ = Window.partitionBy(by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(by)
    n, w = F.col("n").cast("decimal(12,0)"), (F.col("v") * F.col("n").cast("decimal(12,0)")).cast("decimal(28,0)")
    sums = per.withColumns({"_n": F.sum("n").over(all_), "_up": F.sum(n).over(up), "_p": F.sum(w).over(up), "_all": F.sum(w).over(all_)})
    gap = (2 * F.col("_up") - F.col("_n")).cast("decimal(12,0)")
    value = (F.col("v") * gap).cast("decimal(34,0)") - (2 * F.col("_p")).cast("decimal(34,0)") + F.col("_all").cast("decimal(34,0)")
    return sums.withColumn("_s", value).drop("_up", "_p", "_all")


def pairwise(df: DataFrame, id_col: str, features: str, distance: Distance = l2_distance, blocks: int | None = None) -> DataFrame:
    """i, j, distance of all pairs, both ways: the result itself is quadratic.

    Blocks of rows meet pair by pair, so no task meets all rows; unless given, blocks are counted from the rows.
    Distances that are not known to be symmetric are computed for i >= j and mirrored."""
    rows = df.select(F.col(id_col).alias("i"), F.col(features).alias("x"))
    seen = Vectors.of(rows, "x")
    met = paired(rows, [], distance, blocks or blocks_for(seen.n, 16), seen.width)
    if "_x0" in met.columns:
        return met.select("i", "j", "distance")
    both = F.when(F.col("_half"), F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).otherwise(F.array(F.struct("i", "j")))
    return met.select(F.explode(both).alias("p"), "distance").select("p.i", "p.j", "distance")


def _silhouette_of(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """The silhouette from sums _s of distances to the _n members of each class _other, of rows of class _own."""
    a = F.max(F.when(F.col("_own") == F.col("_other"), ratio(F.col("_s"), F.col("_n") - 1)))
    b = F.min(F.when(F.col("_own") != F.col("_other"), F.col("_s") / F.col("_n")))
    got = sums.groupBy(*by).agg(a.alias("a"), b.alias("b"))
    value = F.when(F.isnan("a") | F.col("b").isNull(), 0.0).when(F.col("a") == F.col("b"), 0.0).when(F.col("a") < F.col("b"), 1 - ratio(F.col("a"), F.col("b"))).otherwise(ratio(F.col("b"), F.col("a")) - 1)
    return got.select(*by, value.alias("silhouette"))


def silhouette(distances: DataFrame, classes: DataFrame, id_col: str = "i", label: str = "label") -> DataFrame:
    """i, silhouette from pair distances (i, j, distance) and a class a row; a lone member has 0."""
    own = classes.select(F.col(id_col).alias("i"), F.col(label).alias("_own"))
    other = classes.select(F.col(id_col).alias("j"), F.col(label).alias("_other"))
    sizes = classes.groupBy(F.col(label).alias("_other")).agg(F.count(F.lit(1)).alias("_n"))
    sums = distances.join(other, "j").groupBy("i", "_other").agg(F.sum("distance").alias("_s")).join(sizes, "_other").join(own, "i")
    return _silhouette_of(sums, ["i"])


def silhouette_of_rows(rows: DataFrame, distance: Distance = l2_distance) -> DataFrame:
    """i, silhouette from rows i, x, label, without a table of pairs.

    On a line sums to all classes come from prefix sums; else pairs are added up where they meet."""
    seen = Vectors.of(rows, "x")
    if seen.on_a_line(distance) and not rows.where("label is null or i is null").limit(1).count():
        at = rows.select("i", seen.whole(F.get("x", F.lit(0)).cast("double")).alias("v"), F.col("label").alias("_own"))
        per = at.groupBy("_own", "v").agg(F.count(F.lit(1)).alias("n"))
        places = per.select("v").distinct().crossJoin(per.select(F.col("_own").alias("_other")).distinct()).withColumn("n", F.lit(0).cast("long"))
        cells = places.unionByName(per.withColumnRenamed("_own", "_other")).groupBy("_other", "v").agg(F.sum("n").alias("n"))
        sums = line_sums(cells, "_other").select("v", "_other", "_n", seen.back(F.col("_s")).alias("_s"))
        return at.join(_silhouette_of(per.select("v", "_own").join(sums, "v"), ["v", "_own"]), ["v", "_own"]).select("i", "silhouette")
    met = paired(rows.select("i", "x", "label"), ["label"], distance, blocks_for(seen.n, 16), seen.width)
    pick = F.array(F.struct(F.col("i").alias("i"), F.col("label").alias("own"), F.col("_label").alias("other")))
    if "_x0" not in met.columns:
        back = F.array(F.struct(F.col("j").alias("i"), F.col("_label").alias("own"), F.col("label").alias("other")))
        met = met.select(F.explode(F.when(F.col("_half"), F.concat(pick, back)).otherwise(pick)).alias("p"), "distance").select("p.*", "distance")
    else:
        met = met.select("i", F.col("label").alias("own"), F.col("_label").alias("other"), "distance")
    sizes = rows.groupBy(F.col("label").alias("_other")).agg(F.count(F.lit(1)).alias("_n"))
    sums = met.groupBy("i", F.col("own").alias("_own"), F.col("other").alias("_other")).agg(F.sum("distance").alias("_s")).join(sizes, "_other")
    return _silhouette_of(sums, ["i"])


# ---------------------------------------------------------------- losses


def mse(df: DataFrame, y: str, y_hat: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(y) - F.col(y_hat), F.lit(2.0))).alias("mse"))


def squared_cost(df: DataFrame, y: str, y_hat: str) -> DataFrame:
    return df.agg((F.sum(F.pow(F.col(y) - F.col(y_hat), F.lit(2.0))) / 2).alias("squared_cost"))


def accuracy(df: DataFrame, y: str, y_hat: str, ignore_labels: bool = False) -> float:
    """Share of equal labels; with ``ignore_labels`` under the best one-to-one renaming.

    Renamings are tried on the class-by-class counts, of which there are at most K x K."""
    if not ignore_labels:
        return df.agg(F.avg((F.col(y) == F.col(y_hat)).cast("double"))).first()[0]
    counts = {(r[0], r[1]): r[2] for r in df.groupBy(y, y_hat).count().collect()}
    names = list(dict.fromkeys([k for pair in counts for k in pair]))
    n = sum(counts.values())
    return max(sum(counts.get((a, b), 0) for a, b in zip(names, p, strict=True)) for p in itertools.permutations(names)) / n if n else float("nan")


def error(df: DataFrame, y: str, y_hat: str, ignore_labels: bool = False) -> float:
    return 1.0 - accuracy(df, y, y_hat, ignore_labels)


def relative_mean_error(df: DataFrame, y: Sequence[str], y_hat: Sequence[str], *, normdim: bool = False, normrec: bool = False, p: float = 1) -> float:
    """p-norm error over the norm of y: of all cells, averaged by column (normdim), by row (normrec), or both.

    The variants by row or column use the inner exponent 1/p, as published results do."""
    cells = list(zip(y, y_hat, strict=True))
    e = lambda a, b, q: F.pow(F.abs(F.col(a) - F.col(b)), F.lit(float(q)))
    m = lambda a, q: F.pow(F.abs(F.col(a)), F.lit(float(q)))
    add = lambda xs: sum(xs[1:], xs[0])
    if not normrec and not normdim:
        s, t = df.agg(F.sum(add([e(a, b, p) for a, b in cells])), F.sum(add([m(a, p) for a, _ in cells]))).first()
        return (s / t) ** (1 / p)
    if normdim and normrec:
        each = [F.avg(ratio(F.abs(F.col(a) - F.col(b)), F.abs(F.col(a)))) for a, b in cells]
        got = df.agg(*[x.alias(f"a{i}") for i, x in enumerate(each)]).first()
        return sum(got) / len(got)
    if normrec:
        row = ratio(F.pow(add([e(a, b, 1 / p) for a, b in cells]), F.lit(1.0 / p)), F.pow(add([m(a, 1 / p) for a, _ in cells]), F.lit(1.0 / p)))
        return df.agg(F.avg(row)).first()[0]
    got = df.agg(*[x for i, (a, b) in enumerate(cells) for x in (F.sum(e(a, b, 1 / p)).alias(f"e{i}"), F.sum(m(a, 1 / p)).alias(f"m{i}"))]).first()
    return sum((got[2 * i] / got[2 * i + 1]) ** (1 / p) for i in range(len(cells))) / len(cells)


def mase(df: DataFrame, y: str, y_hat: str, order: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute scaled error; with an order the scale is that of lag-1 forecasts, else of the mean."""
    by = list(by)
    if order:
        w = Window.partitionBy(*by).orderBy(order)
        naive = F.abs(F.col(y) - F.lag(y).over(w))
        rows = df.select(*by, F.abs(F.col(y) - F.col(y_hat)).alias("_e"), naive.alias("_n"))
    else:
        means = df.groupBy(*by).agg(F.avg(y).alias("_m"))
        joined = df.join(means, by) if by else df.join(F.broadcast(means))  # one row
        rows = joined.select(*by, F.abs(F.col(y) - F.col(y_hat)).alias("_e"), F.abs(F.col(y) - F.col("_m")).alias("_n"))
    return rows.groupBy(*by).agg(ratio(F.avg("_e"), F.avg("_n")).alias("mase"))


def sobol_index(df: DataFrame, y_hat: str, y_hat_without: str, is_pmf: bool = False) -> float:
    """Total Sobol index from predictions with and without a variable; PMFs are arrays and differ by KL divergence."""
    a, b = F.col(y_hat), F.col(y_hat_without)
    if not is_pmf:
        s, v, n = df.agg(F.sum(F.pow(a - b, F.lit(2.0))), F.var_pop(a), F.count(a)).first()
        return s / (v * n) if v else float("nan")
    k = df.select(F.max(F.size(a))).first()[0]
    means = list(df.agg(*[F.avg(F.get(a, F.lit(i))).alias(f"m{i}") for i in range(k)]).first())
    centre = F.array(*map(F.lit, means))
    s, t = df.agg(F.sum(F.pow(kl_divergence(a, b), F.lit(2.0))), F.sum(F.pow(kl_divergence(a, centre), F.lit(2.0)))).first()
    return s / t if t else float("nan")


# ---------------------------------------------------------------- confusion matrix


@dataclass
class ConfusionHyper:
    categories: list | None = None
    handle_unknown: str = "error"  # error, infrequent
    handle_missing: str = "error"  # error, drop
    other_categories_name: Any = "Other"
    categories_names: dict | None = None
    normalise_scores: bool = True


class ConfusionMatrix(Model):
    """Counts of actual by predicted class, which later fits add to, and what follows from them."""

    Hyper = ConfusionHyper
    online = True

    def _fit(self, df: DataFrame, y: str = "y", y_hat: str = "y_hat") -> None:
        rows = df.select(F.col(y).alias("y"), F.col(y_hat).alias("h"))
        if self.hpar.handle_missing == "drop":
            rows = rows.where("y is not null and h is not null")
        got = rows.groupBy("y", "h").count().collect()  # at most K x K rows
        if self.hpar.handle_missing == "error" and any(r.y is None or r.h is None for r in got):
            raise ValueError("missing labels; set handle_missing='drop'")
        if self.par is None:
            names = self.hpar.categories or sorted({v for r in got for v in (r.y, r.h)}, key=lambda v: (str(type(v)), v))
            names = list(names) + ([self.hpar.other_categories_name] if self.hpar.handle_unknown == "infrequent" else [])
            self.par = {"labels": names, "scores": [[0] * len(names) for _ in names]}
        place = {v: i for i, v in enumerate(self.par["labels"])}
        for r in got:
            at = []
            for v in (r.y, r.h):
                if v not in place:
                    if self.hpar.handle_unknown == "error":
                        raise ValueError(f"unknown category {v!r}")
                    v = self.hpar.other_categories_name
                at.append(place[v])
            self.par["scores"][at[0]][at[1]] += r["count"]
        self._report()

    def _report(self) -> None:
        s, k = self.par["scores"], len(self.par["labels"])
        n = sum(map(sum, s))
        tp = [s[i][i] for i in range(k)]
        actual, predicted = [sum(s[i]) for i in range(k)], [sum(s[j][i] for j in range(k)) for i in range(k)]
        fp, fn = [predicted[i] - tp[i] for i in range(k)], [actual[i] - tp[i] for i in range(k)]
        tn = [n - tp[i] - fp[i] - fn[i] for i in range(k)]
        div = lambda a, b: a / b if b else float("nan")
        each = {
            "precision": [div(tp[i], tp[i] + fp[i]) for i in range(k)], "recall": [div(tp[i], tp[i] + fn[i]) for i in range(k)],
            "specificity": [div(tn[i], tn[i] + fp[i]) for i in range(k)], "f1score": [div(2 * tp[i], 2 * tp[i] + fp[i] + fn[i]) for i in range(k)],
        }
        self._info = {"accuracy": div(sum(tp), n), "misclassification": div(n - sum(tp), n), "actual_count": actual, "predicted_count": predicted, "scores": s, "tp": tp, "tn": tn, "fp": fp, "fn": fn, "normalised_scores": [[div(x, actual[i]) for x in s[i]] for i in range(k)], **each}
        for name, values in each.items():
            self._info[f"mean_{name}"] = (sum(values) / k if k else float("nan"), div(sum(v * a for v, a in zip(values, actual, strict=True) if a), n))
        self._info["fitted_records"], self._info["n_categories"] = n, k

    def predict(self, df: DataFrame | None = None):
        if not self.fitted:
            return super().predict()
        return self._info["normalised_scores"] if self.hpar.normalise_scores else self.par["scores"]

    def scores(self, spark) -> DataFrame:
        rows = [(str(a), str(b), self.par["scores"][i][j]) for i, a in enumerate(self.par["labels"]) for j, b in enumerate(self.par["labels"])]
        return spark.createDataFrame(rows, "y string, y_hat string, count long")

    def report(self) -> str:
        names = [str((self.hpar.categories_names or {}).get(v, v)) for v in self.par["labels"]]
        wide = max(map(len, names), default=4) + 2
        lines = ["Confusion matrix (rows: actual, columns: predicted)", " " * wide + "".join(f"{v:>{wide}}" for v in names)]
        lines += [f"{v:>{wide}}" + "".join(f"{x:>{wide}}" for x in row) for v, row in zip(names, self.par["scores"], strict=True)]
        lines += [f"accuracy {self._info['accuracy']:.4f}"]
        lines += [f"{v:>{wide}} precision {p:.4f} recall {r:.4f} specificity {c:.4f} f1 {f:.4f}" for v, p, r, c, f in zip(names, *(self._info[x] for x in ("precision", "recall", "specificity", "f1score")), strict=True)]
        return "\n".join(lines)


def confusion_counts(df: DataFrame, y: str, y_hat: str) -> DataFrame:
    return df.groupBy(y, y_hat).agg(F.count(F.lit(1)).alias("count"))
