"""Removal of repeated byte strings, by prefix-free parsing.

Rolling-hash triggers cut each text into phrases (``repeats``): the dictionary
is the set of different phrases, the parse the sequence of their places. Phrases
overlap by 99 bytes, so a string of 100 bytes lies wholly in the phrase it starts
in and no suffix of the dictionary has to be compared on into the parse.

The parse is sorted first: places of one phrase follow each other in corpus
order, and all but the first are repeated as a whole. The dictionary's suffixes
are sorted next (``suffix_ranks``, as far as 100 bytes), in the groups of one
trigger that equal strings can't leave; those of equal rank, put in the corpus
order of their phrases' first places, are repeated but for the first. A group of
over ``repeats.SMALL`` phrases would be one task's; its suffixes travel by hashes
of their 100 bytes instead and meet in many. Highly repetitive text collapses, as
each different phrase is looked into once.

Defined results: null and empty texts have no bytes; texts under 100 bytes lose
nothing; rows that share a doc_id come in order of their text; null ids come
first; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brindle.llm.common import as_bytes, per_batch
from brindle.llm.repeats import Coder, Setting, covered, decided_runs, prepare

SETTING = Setting(length=100, k=32, keep_first=True)
_TABLE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def byte_units(text: bytes) -> np.ndarray:
    return _TABLE[np.frombuffer(text, np.uint8)]


def suffix_ranks(dictionary: bytes, depth: int) -> np.ndarray:
    """For each byte of the dictionary the rank of its suffix, in byte order, as far as ``depth`` bytes: those equal so
    far share one. Prefix doubling from eight bytes at once; suffixes that run into the next phrase are not used."""
    raw = np.frombuffer(dictionary, np.uint8).astype(np.uint64)
    padded = np.concatenate([raw, np.zeros(depth, np.uint64)])
    done, key = min(8, depth), np.zeros(len(raw), np.uint64)
    for k in range(done):
        key = key << np.uint64(8) | padded[k : k + len(raw)]
    while True:
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        if done == depth:
            return rank
        step = min(done, depth - done)
        ahead = np.zeros(len(rank), np.int64)
        ahead[: max(0, len(rank) - step)] = rank[step:]
        key, done = rank * (len(rank) + 1) + ahead, done + step


CODER = Coder(byte_units, lambda text, units, a, b: text[a:b], byte_units, suffix_ranks)


def dedup(docs: DataFrame, setting: Setting = SETTING, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, the removed spans (bytes) and, if asked for, what is left.

    What is left may cut a character in two, so it is binary."""
    rows = prepare(docs)
    runs = decided_runs(rows, CODER, setting)
    joined = rows.join(runs, ["doc", "copy"], "left").select("doc_id", "text", "runs")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc_id, text, runs_ in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            gone = covered([(r["x"], r["y"]) for r in runs_ or ()], setting.length, len(text))
            kept = text
            if gone:
                parts, at = [], 0
                for a, b in gone:
                    parts.append(text[at:a])
                    at = b
                kept = b"".join([*parts, text[at:]])
            out.append((doc_id, len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in gone], kept if with_text else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    got = joined.mapInArrow(per_batch(lambda: one), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>, kept binary")
    return got if with_text else got.drop("kept")
