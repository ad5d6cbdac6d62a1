"""Quality rules: statistics of texts and a learned decision list, in Spark functions only.

Statistics are array expressions over the words and lines of one row, so they
need no shuffle and hold no more than one text. Windows of eight words are
compared by 64-bit hashes within their text.

The decision list is learned by sequential covering on labelled statistics: a
rule grows condition by condition (``feature >= cut`` or ``feature < cut``) on
two thirds of the rows by information gain, is pruned on the last third, and is
kept if it is precise enough there; the rows it covers go, and the next one
grows. At most ``max_labelled`` labelled documents are used, chosen by hash of the
id; their rows stay in Spark: each step is one grouped count over binned features,
whose result has at most features x bins x 2 rows. The list becomes one ordered
Spark conditional expression; what no rule covers is kept. Statistics of the corpus
are computed where they are returned, in one pass without a shuffle.

Defined results: null, empty and wordless texts have zeros and fail the base;
null labels and labels without a document are ignored, of several labels of an
id the least counts; without labels of both kinds the list is empty and only the
base decides; equal gains go to the earlier feature, the lower cut, and ``>=``;
repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import stage
from brindle.llm.native import let, text_of, white_words

WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
FEATURES = ("word_length", "symbols_per_word", "dup_line_share", "repeat_share", "words")
BINS = 24
MAX_RULES = 8
MAX_CONDITIONS = 3
MIN_PRECISION = 0.8
MIN_COVER = 8
MAX_LABELLED = 40_000


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """How many words stand in a window of ``size`` words that occurs twice or more."""

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))

    def covered(h: Column) -> Column:
        def count(s: Column) -> Column:
            same = lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False))
            at = F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))
            return let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size)))), F.lit(0), lambda a, b: a + b))

        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, count))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= size, F.lit(0)).otherwise(let(let(hashes, windows), covered)).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    per_words = let(white_words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    per_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long")
    got = rows.select("doc_id", per_words.alias("w"), per_lines.alias("l"), symbols.alias("n_symbols"))
    return got.select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "word_length": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_share": F.col("n_repeat_words") / words,
        "words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature >= cut, or feature < cut
    cut: float
    bin: int

    def column(self) -> Column:
        x = features()[self.feature]
        return x >= self.cut if self.above else x < self.cut

    def on_bins(self) -> Column:
        x = F.col(f"b_{self.feature}")
        return x >= self.bin if self.above else x < self.bin


@dataclass(frozen=True)
class Rules:
    """Ordered conjunctions; a text that meets one is dropped, any other is kept."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def kept(self) -> Column:
        """The list as one conditional expression over the statistics."""
        out = None
        for rule in self.rules:
            met = F.lit(True)
            for c in rule:
                met = met & c.column()
            out = F.when(met, F.lit(False)) if out is None else out.when(met, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        said = [" and ".join(f"{c.feature} {'>=' if c.above else '<'} {c.cut:.6g}" for c in r) for r in self.rules]
        return "".join(f"drop if {x}; " for x in said) + "else keep"


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _bin_of(feature: str, cuts: list[float]) -> Column:
    """How many cuts the value reaches."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(feature))) if cuts else F.lit(0)


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.on_bins()
    return out


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Rules:
    """A decision list for label quality = 0 among the texts that pass the base."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # at most max_labelled ids: a proven bound for the broadcasts
    chosen = stage(spark, known.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(max_labelled), "chosen")
    ids = chosen.select(F.col("doc_id").alias("chosen_id"))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), F.col("doc_id") == F.col("chosen_id")).select("doc_id", "text")
    # written first: else the filter below would be moved before the join, to all documents
    sample = stage(spark, sample.repartition(spark.sparkContext.defaultParallelism), "sample")
    rows = statistics(sample).join(F.broadcast(chosen), "doc_id").where(~base_failed())
    rows = rows.select("doc_id", (F.col("quality") == 0).alias("bad"), *[c.alias(k) for k, c in features().items()])
    rows = stage(spark, rows, "labelled", narrow=True)
    shares = [k / BINS for k in range(BINS + 1)]
    quantiles = rows.agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in FEATURES]).first()
    if quantiles[0] is None:
        return Rules()
    # cuts lie midway between a quantile and the next different one
    values = {f: sorted({float(q) for q in quantiles[f]}) for f in FEATURES}
    cuts = {f: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for f, v in values.items()}
    binned = rows.select(
        "bad", (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).alias("prune"),
        *[_bin_of(f, cuts[f]).alias(f"b_{f}") for f in FEATURES],
    )
    binned = stage(spark, binned, "binned")

    def counts(where: Column) -> dict[str, list[list[int]]]:
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b")) for f in FEATURES])).alias("x")
        got = binned.where(where).select("bad", pairs).groupBy("x.f", "x.b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
        out = {f: [[0, 0] for _ in range(len(cuts[f]) + 1)] for f in FEATURES}
        for f, b, p, n in got:
            out[f][b] = [p, n]
        return out

    found: list[tuple[Condition, ...]] = []
    left = F.lit(True)
    while len(found) < MAX_RULES:
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS:
            table = counts(left & ~F.col("prune") & _all(rule))
            p0, n0 = (sum(x[k] for x in table[FEATURES[0]]) for k in (0, 1))
            if p0 < MIN_COVER or not n0:
                break
            best, choice = 1e-9, None
            for f in FEATURES:
                p = n = 0
                for b in range(1, len(cuts[f]) + 1):
                    p, n = p + table[f][b - 1][0], n + table[f][b - 1][1]
                    for above, (x, y) in ((True, (p0 - p, n0 - n)), (False, (p, n))):
                        gain = _gain(x, y, p0, n0)
                        if x >= MIN_COVER and gain > best:
                            best, choice = gain, Condition(f, above, cuts[f][b - 1], b)
            if choice is None:
                break
            rule.append(choice)
        if not rule:
            break
        # prune: the shortest prefix of best worth on the rows kept apart
        ask = [F.count_if(_all(rule[:k]) & (F.col("bad") if bad else ~F.col("bad"))) for k in range(1, len(rule) + 1) for bad in (True, False)]
        got = list(binned.where(left & F.col("prune")).agg(*[c.alias(f"c{i}") for i, c in enumerate(ask)]).first())
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in zip(got[::2], got[1::2], strict=True)]
        k = max(range(len(rule)), key=lambda i: (worth[i], -i))
        p, n = got[2 * k], got[2 * k + 1]
        if not p or p / (p + n) < MIN_PRECISION:
            break
        rule = rule[: k + 1]
        found.append(tuple(rule))
        left = left & ~_all(rule)
    return Rules(tuple(found))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics, base_failed and kept of every document."""
    rules = learn(docs, labels)
    return statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.kept())
