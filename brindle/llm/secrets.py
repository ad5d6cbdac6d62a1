r"""Secret scan over a trigram inverted index, in Spark functions only.

From each rule's regular expression a Boolean query over lower-cased trigrams is
derived (``trigram_query``): literals and small classes give strings, a
concatenation joins them, alternatives are OR-ed, and what has no mandatory
trigram gives TRUE. The index holds postings (trigram, doc_id) for the trigrams
that any query names. Postings are intersected per conjunction by counting, and
the candidates of a rule are verified with its regular expression. Rules whose
query is TRUE (the hex rule) scan every text. A query is never narrower than its
rule, so nothing is lost; texts are read whole.

Positions are code points. They come from splitting the text at the matches: the
lengths of the parts between and of the matches themselves add up.

Defined results: a null text is empty; an empty table gives no rows; rows that
share an id share candidates but are verified each on its own text; a null
doc_id is a key like any other; matches that fail a rule's length are dropped
after matching, so what they covered is not searched again; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import stage
from brindle.llm.native import text_of

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # the names before Python 3.11
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: least code points of ``group``; shorter matches are dropped
    least: int = 1
    group: int = 0


#: The first three are the base kinds, in the order that breaks ties.
#: ``[0-9a-f]{24,}`` finds the same as runs of ``[0-9a-f]+`` with 24 characters or more: both start where the run starts.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")
MAX_STRINGS = 64

# ----------------------------------------------------------------- queries
# A query is a set of conjunctions (frozensets of trigrams): any of them must hold. TRUE is the set of the empty one.

TRUE = frozenset({frozenset()})


def _and(a, b):
    return frozenset(x | y for x in a for y in b)


def _or(a, b):
    both = a | b
    return frozenset(x for x in both if not any(y < x for y in both))


def _of_strings(strings: set[str]):
    out = frozenset()
    for s in strings:
        out = _or(out, frozenset({frozenset(s[i : i + 3] for i in range(len(s) - 2))}))
    return out


def _class(items) -> set[str] | None:
    found: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            found.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < 8:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def _analyse(parsed) -> tuple[set[str] | None, frozenset]:
    """The strings that the pattern matches, if few, and else a query."""
    now: set[str] = {""}
    query = TRUE
    exact = True
    for op, arg in parsed:
        strings, part = None, TRUE
        if op is sre.LITERAL:
            strings = {chr(arg).lower()}
        elif op is sre.IN:
            strings = _class(arg)
        elif op is sre.SUBPATTERN:
            strings, part = _analyse(arg[3])
        elif op is sre.BRANCH:
            each = [_analyse(p) for p in arg[1]]
            if all(s is not None for s, _ in each):
                strings = set().union(*(s for s, _ in each))
            else:
                part = frozenset()
                for s, q in each:
                    part = _or(part, q if s is None else _of_strings(s))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            s, q = _analyse(inner)
            if s is not None and high <= 2 and len(s) ** high <= MAX_STRINGS:
                strings, grown = set() if low else {""}, {""}
                for k in range(1, high + 1):
                    grown = {a + b for a in grown for b in s}
                    if k >= low:
                        strings |= grown
            elif low:
                part = q if s is None else _of_strings(s)
        elif op is sre.AT:
            strings = {""}
        if strings is not None and len(strings) * len(now) <= MAX_STRINGS:
            now = {a + b for a in now for b in strings}
            continue
        query, exact, now = _and(query, _of_strings(now)), False, {""}
        query = _and(query, part if strings is None else _of_strings(strings))
    if exact:
        return now, TRUE
    return None, _and(query, _of_strings(now))


def trigram_query(pattern: str) -> frozenset:
    """Conjunctions of lower-cased trigrams, one of which every match contains; TRUE if there is none."""
    strings, query = _analyse(sre_parse.parse(pattern))
    return query if strings is None else _of_strings(strings)


# ----------------------------------------------------------------- index


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (trigram, doc_id) of the trigrams that the rules' queries name."""
    named = sorted({t for r in rules for c in trigram_query(r.pattern) for t in c})
    if not named:
        return docs.sparkSession.createDataFrame([], "trigram string, doc_id long")
    rows = _keyed(docs).select("doc_id", F.lower("text").alias("low"))
    there = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in named])
    return rows.select("doc_id", F.explode(F.array_compact(there)).alias("trigram")).select("trigram", "doc_id").distinct()


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and a bit for each rule whose query holds; rules with query TRUE have none here."""
    rows = []
    for n, r in enumerate(rules):
        query = trigram_query(r.pattern)
        if query != TRUE:
            rows += [(t, f"{n}.{k}", n, len(c)) for k, c in enumerate(sorted(map(sorted, query))) for t in c]
    if not rows:
        return index.sparkSession.createDataFrame([], "doc_id long, rules long")
    # a few rows for each rule of the caller: a bound that no table moves
    wanted = index.sparkSession.createDataFrame(rows, "trigram string, clause string, rule int, size int")
    met = index.join(F.broadcast(wanted), "trigram").groupBy("doc_id", "clause", "rule", "size").agg(F.count(F.lit(1)).alias("n")).where("n = size")
    return met.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


# ----------------------------------------------------------------- matches


#: Rows that a fold appends one by one before they are set down as one block.
FOLD_ROWS = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _running(rows: Column, after: Callable, emit: Callable, kind: str) -> Column:
    """emit(place, row) for each row, where the place starts at 0 and moves by after(place, row).

    Appending copies what is there, so rows are appended to blocks and blocks to the result:
    a text of n matches costs n * FOLD_ROWS + (n / FOLD_ROWS) ** 2 moves at most."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc, x):
        return F.struct(after(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(emit(acc["at"], x))).alias("out"))

    def block(acc, part):
        done = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return _let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    def walk(xs):
        firsts = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(FOLD_ROWS))
        parts = F.transform(firsts, lambda i: F.slice(xs, i, FOLD_ROWS))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.aggregate(parts, start, block, lambda acc: F.flatten(acc["out"]))

    return _let(rows, walk)


def spans_of(text: Column, rule: Rule) -> Column:
    """start, end, kind of each match, leftmost first, those that are too short dropped."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)
    cut = F.filter(F.arrays_zip(gaps.alias("g"), found.alias("m"), value.alias("v")), lambda x: x["m"].isNotNull())
    sized = F.transform(cut, lambda x: F.struct(F.length(x["g"]).alias("g"), F.length(x["m"]).alias("m"), (F.length(x["v"]) >= rule.least).alias("ok")))
    walked = _running(
        sized, lambda at, x: at + x["g"] + x["m"],
        lambda at, x: F.struct((at + x["g"]).alias("start"), (at + x["g"] + x["m"]).alias("end"), F.lit(rule.kind).alias("kind"), x["ok"].alias("ok")),
        "struct<start:int,end:int,kind:string,ok:boolean>",
    )
    return F.transform(F.filter(walked, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))


def _ordered(found: Column, rules: tuple[Rule, ...]) -> Column:
    """By start, then by the kinds' order, then by end."""
    rank = F.create_map(*[x for n, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(n))])
    keyed = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.element_at(rank, x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.transform(F.sort_array(keyed), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, index: DataFrame | None = None) -> DataFrame:
    """doc_id, text and found: array of start, end, kind in order, for every document."""
    if len(rules) > 62:
        raise ValueError("at most 62 rules in one scan")
    index = build_index(docs, rules) if index is None else index
    hits = stage(docs.sparkSession, candidates(index, rules), "candidates", narrow=True)
    rows = _keyed(docs).join(hits.withColumnRenamed("doc_id", "candidate_id"), F.col("doc_id").eqNullSafe(F.col("candidate_id")), "left")
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    parts = []
    for n, r in enumerate(rules):
        scans = trigram_query(r.pattern) == TRUE
        may = F.col("text").rlike(r.pattern) if scans else (F.coalesce("rules", F.lit(0)).bitwiseAND(F.lit(1 << n)) != 0) & F.col("text").rlike(r.pattern)
        parts.append(F.when(may, spans_of(F.col("text"), r)).otherwise(empty))
    return rows.select("doc_id", "text", F.concat(*parts).alias("found")).select("doc_id", "text", F.when(F.size("found") > 0, _ordered(F.col("found"), rules)).otherwise(F.col("found")).alias("found"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The counts, the hash of the base spans and all spans as text."""
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame, mask: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and the text with every span replaced; overlapping spans become one mask."""
    scanned = scan(docs, rules)
    # the place is the greatest end so far; a span that begins before it adds no gap
    gaps = F.filter(
        _running(
            F.col("found"), lambda at, x: F.greatest(at, x["end"]),
            lambda at, x: F.struct(at.alias("start"), F.when(x["end"] <= at, at - 1).otherwise(x["start"]).alias("end")), "struct<start:int,end:int>",
        ),
        lambda x: x["end"] >= x["start"],
    )
    last = F.struct(F.array_max(F.transform("found", lambda x: x["end"])).alias("start"), F.length("text").alias("end"))

    # four bytes a character: a gap is found by its place, not by walking there; the first
    # character keeps a gap's own from being read as a byte order mark
    def cut(wide):
        part = lambda x: F.concat(F.encode(F.lit("x"), "UTF-32"), F.substring(wide, 4 * x["start"] + 1, 4 * (x["end"] - x["start"])))
        return F.array_join(F.transform(F.concat(gaps, F.array(last)), lambda x: F.substr(F.decode(part(x), "UTF-32"), F.lit(2))), mask)

    done = _let(F.encode("text", "UTF-32"), cut)
    return scanned.select("doc_id", F.when(F.size("found") > 0, done).otherwise(F.col("text")).alias("text"))
