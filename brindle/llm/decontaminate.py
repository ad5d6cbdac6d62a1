"""Benchmark decontamination with one Aho-Corasick automaton.

Item texts are folded (A-Z lowered, words of digits, letters and non-ASCII
characters, one space between). What counts as an occurrence is a window of 13
words (an item of fewer words is one window). Every window holds one of the item's
words 0-6, 7-13, ... whole, so the automaton has these anchors only, and whole
short items; its letters are numbers of words. It has at most a node a word of the
benchmark. Each document is folded in the same way and scanned once. A match of an
anchor is extended to the left and right while document and item agree; if that
reaches 13 words, all of them are hit. Hits map to word numbers and, for the spans,
to code points of the original text.

The automaton is broadcast, so its source is measured first. Beyond
``max_block_bytes`` of item text the items are dealt into blocks by hash. Then rows
get numbers of their own, the blocks' automata scan the documents one after another,
each pass writes the hits it finds, and hits are gathered by row: no worker or
driver holds more than a block, and the results are the same.

Defined results: a null or wordless text has no words, no hits and is kept; an
item that is null or wordless has no window; equal windows of several items
count for each of them; a repeated document row gives a repeated result row, and
each row is judged on its own text, whatever other rows have its id; a
null item_id is written as ``null``; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import FOLD, as_bytes, keep, per_batch, stage, unused

WINDOW = 13
MAX_BLOCK_BYTES = 8 << 20
#: A word of the original text; after lower-casing A-Z it is a word of the contract.
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_HITS = "array<struct<first:int,words:int,item_id:string>>"
SCHEMA = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "items array<string>, spans array<struct<start:int,end:int>>"
)


class Matcher:
    """The automaton over anchors of items, and the items."""

    def __init__(self, items: list[tuple[str, bytes | None]], size: int = WINDOW):
        import ahocorasick

        self.size, self.number, self.items = size, {}, []
        owners: dict[bytes, list[str]] = {}
        for item_id, text in items:
            if words := (text or b"").translate(FOLD).split():
                owners.setdefault(b" ".join(words), []).append(item_id)
        anchors: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        step = (size + 1) // 2
        for line, ids in owners.items():
            words = [self.number.setdefault(w, len(self.number) + 1) for w in line.split()]
            n = len(words)
            cuts = [(0, n)] if n < size else [(a, a + step) for a in range(0, n - step + 1, step)]
            for a, b in cuts:
                anchors.setdefault(tuple(words[a:b]), []).append((len(self.items), a))
            self.items.append((sorted(set(ids)), array("I", words)))
        self.automaton = None
        if anchors:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for anchor, places in anchors.items():
                self.automaton.add_word(anchor, (len(anchor), places))
            self.automaton.make_automaton()

    def find(self, text: bytes | None) -> tuple[int, list[tuple[int, int, str]]]:
        """Number of words, and (first word, words, item) of each run that is made of windows of the item."""
        words = (text or b"").translate(FOLD).split()
        hits: list[tuple[int, int, str]] = []
        if not words or self.automaton is None:
            return len(words), hits
        known = self.number.get
        line = tuple([known(w, 0) for w in words])
        done: dict[tuple[int, int], int] = {}  # how far an item has been followed, by its place against the text's
        for end, (n, places) in self.automaton.iter(line):
            start = end - n + 1
            for item, at in places:
                ids, body = self.items[item]
                if len(body) < self.size:
                    hits += [(start, n, i) for i in ids]
                    continue
                if done.get((item, start - at), -1) > end:
                    continue
                a, b = start, end + 1
                while a > 0 and a - start + at > 0 and line[a - 1] == body[a - 1 - start + at]:
                    a -= 1
                while b < len(line) and b - start + at < len(body) and line[b] == body[b - start + at]:
                    b += 1
                done[item, start - at] = b
                if b - a >= self.size:
                    hits += [(a, b - a, i) for i in ids]
        return len(words), hits


def runs(hits) -> list[tuple[int, int]]:
    """Maximal runs of hit words, end exclusive."""
    out: list[list[int]] = []
    for a, n in sorted({(a, n) for a, n, _ in hits}):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [(a, b) for a, b in out]


def _summary(doc_id, text: bytes | None, n_words: int, hits) -> tuple:
    covered = runs(hits)
    n_hit = sum(b - a for a, b in covered)
    items = sorted({i for _, _, i in hits})
    spans = []
    if covered:
        places = [m.span() for m in WORD.finditer(text.decode("utf-8"))]
        spans = [{"start": places[a][0], "end": places[b - 1][1]} for a, b in covered]
    digest = hashlib.sha256(",".join(items).encode()).hexdigest()
    return doc_id, n_words, n_hit, len(items), digest, _contaminated(n_words, n_hit), items, spans


def _contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def _blocks(benchmark: DataFrame, max_block_bytes: int) -> Iterator[tuple[int, list]]:
    """How many blocks there are, and each block's items, of which the driver holds one block at a time."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("binary").alias("text")
    )
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / max_block_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield n, [(r[0], None if r[1] is None else bytes(r[1])) for r in part.collect()]


def _scanner(docs: DataFrame, items: list, window: int):
    """A broadcast of the items, and what gives a worker's matcher for them."""
    held = docs.sparkSession.sparkContext.broadcast(items)
    key = f"matcher {held._jbroadcast.id()} {window}"
    return held, lambda: keep(key, lambda: Matcher(held.value, window))


def _gathered(docs: DataFrame, benchmark: DataFrame, window: int, max_block_bytes: int) -> tuple[DataFrame, DataFrame, str]:
    """The rows with a number of their own (the column named last), and (row, hits) of those with hits, by one pass a block."""
    spark, row = docs.sparkSession, unused(docs, "row")
    held = stage(spark, docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("item_id", pa.string())]))
    found = None
    for _, items in _blocks(benchmark, max_block_bytes):
        shared, matcher = _scanner(docs, items, window)

        def make(matcher=matcher):
            m = matcher()

            def one(batch: pa.RecordBatch) -> pa.RecordBatch:
                got = [(r, [{"first": a, "words": n, "item_id": i} for a, n, i in h]) for r, h in zip(batch.column(0).to_pylist(), (m.find(t)[1] for t in as_bytes(batch.column(1))), strict=True) if h]
                return pa.RecordBatch.from_arrays([pa.array([r for r, _ in got], pa.int64()), pa.array([h for _, h in got], kind)], ["row", "hits"])

            return one

        texts = held.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text"))
        hits = stage(spark, texts.mapInArrow(per_batch(make, keeps=True), f"row long, hits {_HITS}"), "hits", narrow=True)
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    return held, found.groupBy("row").agg(F.flatten(F.collect_list("hits")).alias("hits")), row


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """One row a document: word counts, hit words, matched items and the original spans."""
    n, items = next(_blocks(benchmark, max_block_bytes))
    rows = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if n == 1:
        _, matcher = _scanner(docs, items, window)

        def make():
            m = matcher()
            return lambda batch: _table([_summary(i, t, *m.find(t)) for i, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True)])

        return docs.select(*rows).mapInArrow(per_batch(make, keeps=True), SCHEMA)
    held, found, row = _gathered(docs, benchmark, window, max_block_bytes)
    joined = held.select(*rows, F.col(row).alias("row")).join(found, "row", "left").select("doc_id", "text", "hits")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        hits = [[(h["first"], h["words"], h["item_id"]) for h in x or ()] for x in batch.column(2).to_pylist()]
        return _table([_summary(i, t, len((t or b"").translate(FOLD).split()), h) for i, t, h in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), hits, strict=True)])

    return joined.mapInArrow(per_batch(lambda: one), SCHEMA)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
    names = [x.split()[0] for x in SCHEMA.split(", ")[:7]] + ["spans"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """The documents, all columns, whose text is not contaminated; each row is judged on its own text."""
    n, items = next(_blocks(benchmark, max_block_bytes))
    if n == 1:
        _, matcher = _scanner(docs, items, window)
        place = docs.columns.index("text")

        def make():
            m = matcher()

            def clean(text: bytes | None) -> bool:
                words, hits = m.find(text)
                return not _contaminated(words, sum(b - a for a, b in runs(hits)))

            return lambda batch: batch.filter(pa.array([clean(t) for t in as_bytes(batch.column(place))], pa.bool_()))

        return docs.mapInArrow(per_batch(make, keeps=True), docs.schema)
    held, found, row = _gathered(docs, benchmark, window, max_block_bytes)
    texts = held.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text")).join(found, "row")

    def flagged(batch: pa.RecordBatch) -> pa.RecordBatch:
        hits = [runs([(h["first"], h["words"], "") for h in x]) for x in batch.column(2).to_pylist()]
        bad = [_contaminated(len((t or b"").translate(FOLD).split()), sum(b - a for a, b in h)) for t, h in zip(as_bytes(batch.column(1)), hits, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(bad, pa.bool_()))], ["row"])

    gone = texts.mapInArrow(per_batch(lambda: flagged), "row long").withColumnRenamed("row", row)
    return held.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
