"""Removal of repeated passages of words, with a count-min prefilter.

Pass 1 lays the texts down in blocks (``blocks``) and counts, for each block, the
windows of 35 words in a count-min sketch: two hashes of a window are its cells in
the sketch's two rows. Blocks' sketches are sparse, cells with "once" or "more", and
are merged cell by cell where a range of cells lives. The lesser cell of a window is
at least its count, so windows are never underestimated. The sketch is not sent
anywhere: its owner answers each block with those of its cells that count two or
more, so no task holds more than a range of cells, and the sketch grows with the
text (about eight cells a window) and never fills up.

Pass 2 opens each block again and takes only windows whose cells were both answered
into the exact grouping: by 128-bit BLAKE2b of their words, so equal windows meet
and different ones do not, whatever their words are made of. Windows of a block are
combined before, so a passage has one entry a block at most, however hot. Nothing is
lost, and what the sketch let through in error is found to be single.

Defined results: null, empty and wordless texts have no words; texts of fewer
than 35 words lose nothing; rows that share a doc_id are different rows; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F

from brindle.llm.blocks import BLOCK_BYTES, block_rows, groups, lay, load
from brindle.llm.common import fresh_path, give_back, let_go, release, shared_fs, stage
from brindle.llm.repeats import Prefix, _runs, covered, finish
from brindle.llm.substrings import byte_units

LENGTH = 35
ROWS_OF_CELLS = 2
MIN_CELLS = 1 << 20
#: Cells of a range that one task owns at a time.
CHUNK = 1 << 22
_LOW = 15
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_BASE, _MIX = np.uint64(0x5851F42D4C957F2D), np.uint64(0xA0761D6478BD642F)
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[32, 9, 10, 11, 12, 13]] = True
#: Of the first pass and the answers: a block's cells in a range of the sketch; a range below 0 only tells that there is the block.
CELLS = "block long, part long, cells binary"
#: A window (without last), or a run of windows that are known to be repeated (known = 2; 1: a window that its block has several times).
FOUND = "high long, low long, block long, doc int, first long, last long, known int"


def word_units(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and where it starts; different words may share one, which lets more through the sketch and no more."""
    white = _IS_WHITE[np.frombuffer(text, np.uint8)]
    edge = np.diff(np.concatenate([[True], white, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    size = ends - starts
    return finish(Prefix(byte_units(text), _BASE).of(starts, size) * _MIX + size.astype(np.uint64)), starts


def window_hashes(texts: list[bytes], length: int, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first word and hash of each window; short texts are hashed together."""
    docs, firsts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    k = 0
    while k < len(texts):
        begin, size = k, 0
        while k < len(texts) and (k == begin or size + len(texts[k]) < at_once):
            size, k = size + len(texts[k]) + 1, k + 1
        some = texts[begin:k]
        units, places = word_units(b"\n".join(some))
        sizes = np.array([len(t) + 1 for t in some])
        ends = np.searchsorted(places, np.cumsum(sizes))  # in words
        counts = np.diff(ends, prepend=0)
        text = np.repeat(np.arange(len(some)), counts)
        word = np.arange(len(units))
        starts = word[word + length <= ends[text]]
        if len(starts):
            docs.append(begin + text[starts])
            firsts.append(starts - (ends - counts)[text[starts]])
            hashes.append(Prefix(units, _BASE).of(starts, length))
    return np.concatenate(docs), np.concatenate(firsts), finish(np.concatenate(hashes))


def cells_of(hashes: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each window in each row of the sketch."""
    return [(finish(hashes * s) & np.uint64(width - 1)).astype(np.int64) for s in _SEEDS[:ROWS_OF_CELLS]]


def width_for(docs: DataFrame) -> int:
    """Cells a row: a power of two of about eight a window, a word having some eight bytes."""
    size = block_rows(docs).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(MIN_CELLS, 1 << int(size - 1).bit_length() if size else 0)


def _cells(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "part", "cells"])


def pack(offset: np.ndarray, more: np.ndarray) -> bytes:
    """Sorted cells of a range, as places in it, and a mark each: many as counts of parts of the range and 16 bits each."""
    if len(offset) < CHUNK >> _LOW:
        return b"\0" + (offset << 1 | more).astype("<u4").tobytes()
    counts = np.bincount(offset >> _LOW, minlength=CHUNK >> _LOW).astype("<u2")
    return b"\1" + counts.tobytes() + ((offset & (1 << _LOW) - 1) << 1 | more).astype("<u2").tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    if blob[0] == 0:
        got = np.frombuffer(blob, "<u4", offset=1).astype(np.int64)
        return got >> 1, (got & 1).astype(bool)
    got = np.frombuffer(blob, "<u2", offset=1)
    parts = CHUNK >> _LOW
    low = got[parts:].astype(np.int64)
    return np.repeat(np.arange(parts) << _LOW, got[:parts]) + (low >> 1), (low & 1).astype(bool)


def sketch(docs: DataFrame, out: str, width: int, length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Lays the blocks down; their sparse sketches."""

    def partial(batches):
        let_go()
        for block, texts in lay(batches, out, block_bytes):
            rows = [(block, -1 - block % 1024, b"")]
            for r, cells in enumerate(cells_of(window_hashes(texts, length)[2], width)):
                cell, n = np.unique(cells, return_counts=True)
                at = np.flatnonzero(np.diff(cell // CHUNK, prepend=-1))
                for a, b in zip(at.tolist(), [*at[1:].tolist(), len(cell)][: len(at)], strict=True):
                    rows.append((block, int(cell[a]) // CHUNK * ROWS_OF_CELLS + r, pack(cell[a:b] % CHUNK, n[a:b] > 1)))
            yield _cells(rows)
            del texts
            give_back()

    return block_rows(docs).mapInArrow(partial, CELLS)


def answers(sketched: DataFrame) -> DataFrame:
    """A row that tells of each block (part -1), and of its cells those that count two or more in the merged sketch."""

    def merge(batches):
        for part, table in groups(batches):
            blocks = table.column(1).to_pylist()
            if part < 0:
                yield _cells([(b, -1, b"") for b in blocks])
                continue
            once, more = np.zeros(CHUNK, bool), np.zeros(CHUNK, bool)
            got = [unpack(x) for x in table.column(2).to_pylist()]
            for cell, several in got:
                more[cell] |= once[cell] | several
                once[cell] = True
            rows = [(b, part, pack(c, np.ones(len(c), bool))) for b, c in zip(blocks, (cell[more[cell]] for cell, _ in got), strict=True) if len(c)]
            if rows:
                yield _cells(rows)

    ranged = sketched.select("part", "block", "cells")
    return ranged.repartition("part").sortWithinPartitions("part").mapInArrow(merge, CELLS)


def _estimated(table: pa.Table, hashes: np.ndarray, width: int) -> np.ndarray:
    """The windows of a block whose lesser cell was answered to be two or more."""
    parts, blobs = table.column(1).to_pylist(), table.column(2).to_pylist()
    good = np.ones(len(hashes), bool)
    for r, cells in enumerate(cells_of(hashes, width)):
        mine = sorted((p // ROWS_OF_CELLS, b) for p, b in zip(parts, blobs, strict=True) if p >= 0 and p % ROWS_OF_CELLS == r)
        if not mine:
            return np.zeros(len(hashes), bool)
        known = np.concatenate([unpack(b)[0] + c * CHUNK for c, b in mine])
        at = np.searchsorted(known, cells)
        good &= known[np.minimum(at, len(known) - 1)] == cells
    return good


def _digests(texts: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """128 bits of the words of each window, as two numbers."""
    out: list[bytes] = []
    for k in np.unique(docs).tolist():
        words = texts[k].split()
        line = b" ".join(words)
        begins = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
        mine = starts[np.searchsorted(docs, k) : np.searchsorted(docs, k, "right")]
        out += [hashlib.blake2b(line[a:b], digest_size=16).digest() for a, b in zip(begins[mine].tolist(), (begins[mine + length] - 1).tolist(), strict=True)]
    return np.frombuffer(b"".join(out), "<i8").reshape(-1, 2)


def probe(told: DataFrame, out: str, width: int, length: int) -> DataFrame:
    """Of each block, its windows that are estimated as repeated: one of each kind, and runs of those that it has several times."""

    def run(batches):
        for block, table in groups(batches):
            texts = load(out, block)[1]
            docs, starts, hashes = window_hashes(texts, length)
            good = _estimated(table, hashes, width)
            docs, starts = docs[good], starts[good]
            if not len(docs):
                continue
            digest = _digests(texts, docs, starts, length)
            order = np.lexsort((digest[:, 1], digest[:, 0]))  # stable: the first of equals leads
            d = digest[order]
            new = np.concatenate([[True], (d[1:] != d[:-1]).any(1)])
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(order)))
            head, again = order[at], order[np.repeat(size > 1, size)]
            zero = np.zeros(len(again), np.int64)
            runs = _runs(docs[again], zero, starts[again], starts[again]) if len(again) else (zero, zero, zero, zero)
            cols = [
                np.concatenate([digest[head, 0], runs[2]]), np.concatenate([digest[head, 1], runs[0]]), np.full(len(head) + len(runs[0]), block),
                np.concatenate([docs[head], runs[0]]).astype(np.int32), np.concatenate([starts[head], runs[2]]),
                pa.array(np.concatenate([starts[head], runs[3]]), mask=np.arange(len(head) + len(runs[0])) < len(head)),
                np.concatenate([(size > 1).astype(np.int32), np.full(len(runs[0]), 2, np.int32)]),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], [x.split()[0] for x in FOUND.split(", ")])
            give_back()

    return told.mapInArrow(run, FOUND)


def repeated_runs(found: DataFrame) -> DataFrame:
    """block, doc, first, last of the runs of repeated windows. One shuffle; a window has as many rows as blocks at most."""
    same = SparkWindow.partitionBy("high", "low")
    window = F.col("known") < 2
    counted = found.withColumn("n", F.count_if(window).over(same)).withColumn("many", F.max(F.when(window, F.col("known"))).over(same))
    return counted.where("known = 2 or known = 0 and (n > 1 or many = 1)").select("block", "doc", "first", F.coalesce("last", "first").alias("last"))


def dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, the removed runs of words and, if asked for, what is left."""
    spark = docs.sparkSession
    out, width = fresh_path(spark, "blocks"), width_for(docs)
    fs, folder = shared_fs(out)
    fs.create_dir(folder, recursive=True)
    told = stage(spark, answers(sketch(docs, out, width, length, block_bytes)), "answers")
    release(spark)
    known = told.where("part < 0")
    n = max(known.count(), 1)  # so that a task opens about one block
    found = probe(told.repartition(n, "block").sortWithinPartitions("block", "part"), out, width, length)
    none = F.lit(None).cast("long")
    runs = known.select("block", F.lit(-1).alias("doc"), none.alias("first"), none.alias("last")).unionByName(repeated_runs(found))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def one(batches):
        for block, table in groups(batches):
            ids, texts = load(out, block)
            gone_of: list[list[tuple[int, int]]] = [[] for _ in texts]
            doc, first, last = (c.to_numpy() for c in table.filter(pc.greater_equal(table.column(1), 0)).columns[1:])
            if len(doc):
                doc, _, first, last = _runs(doc, np.zeros(len(doc), np.int64), first, last)
                for k, a, b in zip(doc.tolist(), first.tolist(), last.tolist(), strict=True):
                    gone_of[k].append((a, b))
            rows = []
            for doc_id, text, starts in zip(ids, texts, gone_of, strict=True):
                words = text.split()
                gone = covered(starts, length, len(words))
                kept, at = ([], 0) if gone else (words, 0)
                for a, b in gone:
                    kept += words[at:a]
                    at = b
                kept = kept + words[at:] if gone else kept
                line = b" ".join(kept)
                rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(line).hexdigest(), [{"start": a, "end": b} for a, b in gone], line.decode() if with_text else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.string()]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            give_back()

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,end:long>>, kept string"
    got = runs.repartition(n, "block").sortWithinPartitions("block").mapInArrow(one, schema)
    return got if with_text else got.drop("kept")
