"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, documents drawn by a hash of their
id are the unlabelled ones. Linear classifiers over word presence minimise, by
Adam in numpy, the class-prior-corrected risk

    prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])

with logistic loss; when the bracket turns negative its gradient is ascended
(non-negative correction). ``ensemble`` classifiers see different resamples and
their probabilities are averaged.

Labels are read only from rows outside the held-out fold. The fit uses at most
``max_positive`` positives and ``max_unlabelled`` unlabelled documents, both chosen by
the smallest hash of the id. The unlabelled ones are drawn from all documents outside
the held-out fold, positives included, as the risk takes them for the population; a
document may so stand for both. Their mean loss is an estimate of an expectation whose
error falls with their number (at 9,000 a share is within 0.011), not with the
corpus, so their bound is a matter of accuracy; the prior is counted over all labelled rows (give
``prior`` where these are no fair draw), and every document is scored over its whole text. Only the text enters a score.

Defined results: null and empty texts get the score of a document without
words; without positives (or without labels) every score is the prior (0
without labels); several labels of one id count as toxic if any is; null labels
are ignored; repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import FOLD, as_bytes, held_out, per_batch, stage, unstage

MAX_POSITIVE = 3000
MAX_UNLABELLED = 9000
MAX_FEATURES = 1000
MIN_DF = 2
#: A word is evidence if its shares among positives and unlabelled differ by so many standard errors.
MIN_ERRORS = 4.0
#: The penalty is this over the number of positives.
PENALTY = 0.03
THRESHOLD = 0.5


@dataclass
class Model:
    """Words, and a column of weights (the last row is the bias) for each classifier."""

    prior: float
    words: list[bytes] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None

    def __post_init__(self):
        self.place = {w: i for i, w in enumerate(self.words)}
        self.known = frozenset(self.words)

    def score(self, text: bytes | None) -> float:
        if self.weights is None:
            return self.prior
        seen = self.known.intersection((text or b"").translate(FOLD).split())
        z = self.bias + (self.weights[[self.place[w] for w in seen]].sum(0) if seen else 0.0)
        return float(np.mean(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))))


def nnpu(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, n_features: int, prior: float, *, unlabelled: np.ndarray | None = None, steps=300, rate=0.05, l2=3e-4, beta=0.0, gamma=1.0, seed=0) -> tuple[np.ndarray, float]:
    """Weights and bias; (rows, cols) are the set cells of a binary matrix. A row may be positive and unlabelled; without ``unlabelled`` those are all others."""
    rng = np.random.default_rng(seed)
    n = len(positive)
    # a resample: each row gets a weight, so the matrix stays as it is
    draw = rng.exponential(size=n)
    wp = np.where(positive, draw, 0.0)
    wu = np.where(~positive if unlabelled is None else unlabelled, draw, 0.0)
    wp, wu = wp / max(wp.sum(), 1e-12), wu / max(wu.sum(), 1e-12)
    w, b = np.zeros(n_features), -1.0
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=w[cols], minlength=n) + b
        s = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
        negative_loss = np.logaddexp(0.0, z)
        inner = (wu * negative_loss).sum() - prior * (wp * negative_loss).sum()
        slope = wu * s - prior * wp * s  # of the bracket
        if inner >= -beta:
            slope = slope + prior * wp * (s - 1.0)
        else:
            slope = -gamma * slope
        g = np.bincount(cols, weights=slope[rows], minlength=n_features) + 2 * l2 * w
        gb = slope.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w = w - rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b = b - rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def _known_labels(labels: DataFrame) -> DataFrame:
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )


def fit(docs: DataFrame, labels: DataFrame, *, max_positive=MAX_POSITIVE, max_unlabelled=MAX_UNLABELLED, max_features=MAX_FEATURES, prior: float | None = None, ensemble: int = 3, steps: int = 400) -> Model:
    spark = docs.sparkSession
    known = _known_labels(labels)
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.lit(0))).first()
    prior = min(max(toxic / n, 0.0), 0.95) if prior is None and n else prior or 0.0
    if not toxic:
        return Model(prior)
    draw = F.xxhash64("doc_id", F.lit("toxicity"))
    toxic_ids = {r[0] for r in known.where("toxic = 1").orderBy(draw, "doc_id").limit(max_positive).collect()}
    free = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & ~held_out())
    free_ids = {r[0] for r in free.orderBy(draw, "doc_id").limit(max_unlabelled).collect()}
    # at most max_positive + max_unlabelled ids: a proven bound for the broadcast
    kinds = "doc_id long, positive boolean, unlabelled boolean"
    chosen = spark.createDataFrame([(i, i in toxic_ids, i in free_ids) for i in sorted(toxic_ids | free_ids)], kinds)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "positive", "unlabelled", "text")
    head = ["doc_id", "positive", "unlabelled"]

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted(set((t or b"").translate(FOLD).split())) for t in as_bytes(batch.column(3))]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.binary()))], [*head, "words"])

    bags = stage(spark, sample.mapInArrow(per_batch(lambda: words), f"{kinds}, words array<binary>").repartition(spark.sparkContext.defaultParallelism), "bags")
    n_p, n_u = bags.agg(F.count_if("positive"), F.count_if("unlabelled")).first()
    if not n_p or not n_u:
        return Model(prior)
    share_p, share_u = F.col("p") / F.lit(float(n_p)), F.col("u") / F.lit(float(n_u))
    top = (
        bags.select("positive", "unlabelled", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.count_if("positive").alias("p"), F.count_if("unlabelled").alias("u"))
        .where(F.col("p") + F.col("u") >= MIN_DF)
        .select("word", (F.pow(share_p - share_u, F.lit(2)) / (share_p * prior + share_u + F.lit(0.5 / n_u))).alias("gain"))
        .where(F.col("gain") * n_p >= MIN_ERRORS**2)
        .orderBy(F.desc("gain"), "word")
        .limit(max_features)
        .collect()
    )
    names = sorted(bytes(r[0]) for r in top)
    if not names:
        return Model(prior)
    held = spark.sparkContext.broadcast({w: i for i, w in enumerate(names)})

    def cells(batch: pa.RecordBatch) -> pa.RecordBatch:
        place = held.value
        found = [[place[w] for w in x if w in place] for x in batch.column(3).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int32()))], [*head, "cells"])

    got = sorted((*r[:3], sorted(r[3])) for r in bags.mapInArrow(per_batch(lambda: cells), f"{kinds}, cells array<int>").collect())
    unstage(bags)
    positive, unlabelled = (np.array([r[k] for r in got]) for k in (1, 2))
    rows = np.repeat(np.arange(len(got)), [len(r[3]) for r in got])
    cols = np.array([c for r in got for c in r[3]], dtype=np.int64)
    fits = [nnpu(rows, cols, positive, len(names), prior, unlabelled=unlabelled, steps=steps, l2=PENALTY / n_p, seed=k) for k in range(ensemble)]
    return Model(prior, names, np.stack([w for w, _ in fits], 1), np.array([b for _, b in fits]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    held = docs.sparkSession.sparkContext.broadcast((model.prior, model.words, model.weights, model.bias))

    def make():
        m = Model(*held.value)
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m.score(t) for t in as_bytes(batch.column(2))], pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(per_batch(make), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that score below the threshold."""
    held = docs.sparkSession.sparkContext.broadcast((model.prior, model.words, model.weights, model.bias))
    place = docs.columns.index("text")

    def make():
        m = Model(*held.value)
        return lambda batch: batch.filter(pa.array([m.score(t) < threshold for t in as_bytes(batch.column(place))], pa.bool_()))

    return docs.mapInArrow(per_batch(make), docs.schema)
