"""Soft-membership mixing of domains to target weights, in Spark functions only.

A softmax regression is fitted on the labelled table: its domains are clean
(quality 1, not toxic), poor (quality 0, not toxic) and toxic; its evidence are
binned statistics of the text and words that poor or toxic texts have more often
than all texts (those of clean text tell languages, not domains). It gives each
document posteriors p over the domains and its number of words n.

Rates r >= 0 solve least squares: the expected totals S_d = sum r n p_d shall
equal T_d = weight_d * volume * sum n. A gradient step preconditioned by n depends
on a document only through p, so documents are pre-aggregated to cells of equal
posteriors rounded to ``GRID`` (at most 5,151 cells of three domains, whatever
the data), with exact sums of n and n p_d. Each step is one aggregate over the
cells; the rate is a fold over the residuals so far (accelerated projected
gradient), and only the totals come to the driver.

The classifier is fitted on at most ``max_labelled`` labelled documents, chosen
by hash of the id: Spark counts words and patterns of evidence, the driver solves
for the weights. Everything else covers all rows.

Defined results: null and empty texts have no words, n = 0 and the posteriors of
an empty text; labels null in either column are ignored, of several labels of an
id the most toxic and least quality count; without labels posteriors are even;
a domain that no cell reaches can't meet its target: the fit stays finite, comes as
near as least squares does, and warns; an empty table gives no rows; repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import stage, unstage, unused
from brindle.llm.native import let, text_of

DOMAINS = ("clean", "poor", "toxic")
#: Production targets: the shares of expected tokens, and their sum against the tokens there are.
WEIGHTS = {"clean": 0.96, "poor": 0.03, "toxic": 0.01}
VOLUME = 1.5
GRID = 100
MAX_LABELLED = 12_000
MAX_WORDS = 96
MIN_ERRORS = 5.0
RIDGE = 1.0
STEPS = 60
TOLERANCE = 1e-3
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _evidence(words: Column, text: Column, vocabulary: list[str]) -> Column:
    """Chosen words that occur, and the bins of three statistics."""
    n = F.size(words)
    many = F.when(n < 5, "n0").when(n < 20, "n1").when(n < 100, "n2").when(n < 1000, "n3").otherwise("n4")
    threes = F.when(n < 4, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))
    distinct = let(threes, lambda t: F.size(F.array_distinct(t)) / F.size(t).cast("double"))
    fresh = let(distinct, lambda x: F.when(x < 0.5, "d0").when(x < 0.75, "d1").when(x < 0.9, "d2").otherwise("d3"))
    shouted = F.size(F.filter(words, lambda w: (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w)))
    loud = F.when(shouted / F.greatest(n, F.lit(1)).cast("double") > 0.3, "u1").otherwise("u0")
    density = (F.size(F.split(text, "[#*$%&|<>]", -1)) - 1) / F.greatest(n, F.lit(1)).cast("double")
    marks = let(density, lambda x: F.when(x < 0.02, "s0").when(x < 0.3, "s1").when(x < 0.8, "s2").otherwise("s3"))
    stats = F.array(*[F.concat(F.lit("\x00"), x) for x in (many, fresh, loud, marks)])
    if not vocabulary:
        return stats
    return F.concat(stats, F.array_intersect(F.array(*map(F.lit, vocabulary)), words))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPLIT, -1), lambda w: w != "")


def _read(vocabulary: list[str]) -> Column:
    """n_tokens and evidence of the column text."""
    text = text_of()
    return let(_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_tokens"), _evidence(w, text, vocabulary).alias("evidence")))


def _domains(labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t"))
    known = known.where("doc_id is not null and q is not null and t is not null").groupBy("doc_id").agg(F.min("q").alias("q"), F.max("t").alias("t"))
    return known.select("doc_id", F.when(F.col("t") == 1, 2).when(F.col("q") == 0, 1).otherwise(0).alias("domain"))


class Classifier:
    """Softmax regression: a bias a domain, and a weight a domain for each piece of evidence."""

    def __init__(self, vocabulary: list[str], biases: list[float], table: dict[str, list[float]]):
        self.vocabulary, self.biases, self.table = vocabulary, biases, table

    def posteriors(self, evidence: Column) -> Column:
        start = F.array(*map(F.lit, self.biases))
        if self.table:
            known = F.create_map(*[x for k, v in sorted(self.table.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))])
            none = F.array(*[F.lit(0.0)] * len(DOMAINS))
            start = F.aggregate(evidence, start, lambda acc, e: F.zip_with(acc, F.coalesce(F.try_element_at(known, e), none), lambda a, b: a + b))

        def softmax(z: Column) -> Column:
            return let(F.transform(z, lambda x: F.exp(x - F.array_max(z))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))

        return let(start, softmax)


def fit_classifier(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, max_words: int = MAX_WORDS) -> Classifier:
    spark, k = docs.sparkSession, len(DOMAINS)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most max_labelled ids: a proven bound for the broadcast
    chosen = stage(spark, _domains(labels).orderBy(F.xxhash64("doc_id", F.lit("mixing")), "doc_id").limit(max_labelled), "chosen")
    sample = docs.join(F.broadcast(chosen.withColumnRenamed("doc_id", "chosen_id")), F.col("doc_id") == F.col("chosen_id")).select("doc_id", "text", "domain")
    sample = stage(spark, sample.repartition(spark.sparkContext.defaultParallelism), "labelled")
    sizes = {r[0]: r[1] for r in sample.groupBy("domain").count().collect()}
    total = sum(sizes.values())
    if not total:
        return Classifier([], [math.log(1 / k)] * k, {})
    share = [(sizes.get(d, 0) + 0.5) / (total + 0.5 * k) for d in range(k)]
    counts = [F.count_if(F.col("domain") == d).alias(f"c{d}") for d in range(k)]
    words = sample.select("domain", F.explode(F.array_distinct(_words(text_of()))).alias("word")).groupBy("word").agg(*counts)
    # words whose share in a domain but the first exceeds that in all by MIN_ERRORS standard errors or more
    every = sum((F.col(f"c{d}") for d in range(1, k)), F.col("c0")) / F.lit(float(total))
    excess = lambda d: F.greatest(F.col(f"c{d}") / F.lit(float(max(sizes.get(d, 0), 1))) - every, F.lit(0.0))
    gain = F.greatest(*[F.pow(excess(d), F.lit(2)) / (every + F.lit(0.5 / total)) * F.lit(float(sizes.get(d, 0))) for d in range(1, k)])
    top = words.where(" + ".join(f"c{d}" for d in range(k)) + " >= 3").select("word", gain.alias("gain")).where(F.col("gain") >= MIN_ERRORS**2).orderBy(F.desc("gain"), "word").limit(max_words)
    vocabulary = sorted(r[0] for r in top.collect())
    # at most max_labelled rows
    seen = sorted((list(r[0]), list(r[1:])) for r in sample.select("domain", _read(vocabulary)["evidence"].alias("evidence")).groupBy("evidence").agg(*counts).collect())
    unstage(chosen, sample)
    names = sorted({e for evidence, _ in seen for e in evidence})
    place = {e: i for i, e in enumerate(names)}
    x = np.zeros((len(seen), len(names)))
    for row, (evidence, _) in zip(x, seen, strict=True):
        row[[place[e] for e in evidence]] = 1.0
    weights, biases = softmax_regression(x, np.array([c for _, c in seen], float), np.log(share))
    return Classifier(vocabulary, biases.tolist(), {e: w.tolist() for e, w in zip(names, weights, strict=True)})


def softmax_regression(x: np.ndarray, counts: np.ndarray, start: np.ndarray, ridge: float = RIDGE, steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Weights (columns of x by classes) and biases from rows that stand for ``counts`` of each class, by Newton's
    method; the ridge draws weights to 0 and biases to ``start``, so one class alone has an answer as well."""
    a = np.hstack([x, np.ones((len(x), 1))])
    m, k = a.shape[1], counts.shape[1] - 1  # the first class is the reference
    n, centre = counts.sum(1), np.zeros((m, k))
    centre[-1] = start[1:] - start[0]
    theta = centre.copy()

    def loss(theta):
        z = np.hstack([np.zeros((len(a), 1)), a @ theta])
        top = z.max(1, keepdims=True)
        log_p = z - top - np.log(np.exp(z - top).sum(1, keepdims=True))
        return -(counts * log_p).sum() + ridge / 2 * ((theta - centre) ** 2).sum(), np.exp(log_p[:, 1:])

    now, p = loss(theta)
    for _ in range(steps):
        slope = a.T @ (n[:, None] * p - counts[:, 1:]) + ridge * (theta - centre)
        bend = np.block([[(a * (n * p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ a for j in range(k)] for i in range(k)]) + ridge * np.eye(m * k)
        step = np.linalg.solve(bend, slope.T.ravel()).reshape(k, m).T
        size = 1.0
        while (after := loss(theta - size * step))[0] > now and size > 1e-6:
            size /= 2
        theta = theta - size * step
        now, p = after
        if np.abs(size * step).max() < 1e-6:
            break
    whole = np.hstack([np.zeros((m, 1)), theta])
    return whole[:-1], whole[-1] + start[0]


def memberships(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, n_tokens and the posteriors as array p."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _read(classifier.vocabulary).alias("got"))
    return rows.select("doc_id", "got.n_tokens", classifier.posteriors(F.col("got.evidence")).alias("p"))


def _cell(p: Column) -> Column:
    """A number for the posteriors rounded to the grid; the last one follows from the others."""
    out = F.lit(0)
    for d in range(len(DOMAINS) - 1):
        out = out * (GRID + 1) + F.round(F.get(p, F.lit(d)) * GRID).cast("int")
    return out


def _walk(q: Column, steps: list[list[float]], eta: float) -> Column:
    """r and b, the rate after the given steps and the one before; each step is its momentum and the residuals of the domains."""
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("b"))

    def step(s: Column, x: Column) -> Column:
        point = s["r"] + F.get(x, F.lit(0)) * (s["r"] - s["b"])
        slope = sum((F.get(q, F.lit(d)) * F.get(x, F.lit(d + 1)) for d in range(1, len(DOMAINS))), F.get(q, F.lit(0)) * F.get(x, F.lit(1)))
        return F.struct(F.greatest(F.lit(0.0), point - F.lit(eta) * slope).alias("r"), s["r"].alias("b"))

    # one literal however many steps there are, so plans stay small
    return F.aggregate(F.from_json(F.lit(json.dumps(steps)), "array<array<double>>"), start, step)


@dataclass
class Fit:
    """The rates by cell, the steps it took, and how far the expected token shares are from their goals (largest, over the volume)."""

    rates: DataFrame
    steps: int
    miss: float

    @property
    def converged(self) -> bool:
        return self.miss <= TOLERANCE


def fit_rates(members: DataFrame, weights: dict[str, float] | None = None, volume: float = VOLUME, steps: int = STEPS) -> Fit:
    """What each cell of posteriors is taken. Where the goals can't be met the fit ends after ``steps`` and warns how far it is."""
    weights, spark, k = weights or WEIGHTS, members.sparkSession, len(DOMAINS)
    sums = [F.sum(F.col("n_tokens") * F.get("p", F.lit(d))).alias(f"s{d}") for d in range(k)]
    cells = members.groupBy(_cell(F.col("p")).alias("cell")).agg(F.sum("n_tokens").alias("n"), *[F.avg(F.get("p", F.lit(d))).alias(f"a{d}") for d in range(k)], *sums)
    cells = stage(spark, cells.withColumn("q", F.array(*[F.round(f"a{d}", 3) for d in range(k)])).coalesce(1), "cells")  # at most 5,151 rows
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return Fit(cells.select("cell", F.lit(1.0).alias("rate")), 0, 0.0)
    goal = [weights[d] * volume for d in DOMAINS]
    done: list[list[float]] = []
    eta, t = 1.0, 1.0
    while True:
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        momentum = (t - 1) / t_next
        at = cells.withColumn("w", _walk(F.col("q"), done, eta))
        # a number of its own in each step would be compiled anew; an array is passed to the same code
        point = F.get(F.transform(F.from_json(F.lit(json.dumps([momentum])), "array<double>"), lambda m: F.col("w.r") + m * (F.col("w.r") - F.col("w.b"))), F.lit(0))
        got = at.select(*[F.sum(F.col(f"s{d}") * x).alias(f"{n}{d}") for n, x in (("t", point), ("u", F.col("w.r"))) for d in range(k)]).first()
        miss = max(abs(got[k + d] / total - goal[d]) for d in range(k)) / volume
        if miss <= TOLERANCE or len(done) == steps:
            break
        done.append([momentum, *[got[d] / total - goal[d] for d in range(k)]])
        t = t_next
    if miss > TOLERANCE:
        warnings.warn(f"after {steps} steps the token shares are up to {miss:.4f} from their goals", stacklevel=2)
    return Fit(stage(spark, cells.select("cell", _walk(F.col("q"), done, eta)["r"].alias("rate")), "rates"), len(done), miss)


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, volume: float = VOLUME) -> DataFrame:
    """doc_id, n_tokens, the posteriors and the rate of every document."""
    members = stage(docs.sparkSession, memberships(docs, fit_classifier(docs, labels)), "members")
    rates = fit_rates(members, weights, volume).rates
    # one row a cell, at most 5,151: a proven bound
    got = members.withColumn("cell", _cell(F.col("p"))).join(F.broadcast(rates), "cell", "left")
    return got.select("doc_id", "n_tokens", *[F.round(F.get("p", F.lit(d)), 6).alias(f"p_{x}") for d, x in enumerate(DOMAINS)], F.round("rate", 6).alias("rate"))


def thin(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, volume: float = VOLUME) -> DataFrame:
    """The documents, all columns, as often as their rate takes them: the rate's whole part in copies, and one more
    with the probability of its fraction, drawn by a hash of id and text, so the expected tokens of each domain are
    those that its rate gives. Texts are read once: rows are written with their posteriors beside them."""
    classifier = fit_classifier(docs, labels)
    own = unused(docs, "mixing")
    read = docs.withColumn(own, _read(classifier.vocabulary))
    read = read.withColumn(own, F.struct(F.col(own)["n_tokens"].alias("n_tokens"), classifier.posteriors(F.col(own)["evidence"]).alias("p")))
    rows = stage(docs.sparkSession, read, "rows")
    rates = fit_rates(rows.select(f"{own}.n_tokens", f"{own}.p"), weights, volume).rates
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("mixing")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    cell, rate = f"{own}_cell", f"{own}_rate"
    rated = rows.withColumn(cell, _cell(F.col(own)["p"])).join(F.broadcast(rates.select(F.col("cell").alias(cell), F.col("rate").alias(rate))), cell, "left")
    taken = F.coalesce(rate, F.lit(1.0))
    copies = (F.floor(taken) + (taken - F.floor(taken) > draw).cast("long")).cast("int")
    return rated.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(0), copies)).alias(own)).drop(own)
