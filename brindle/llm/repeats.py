r"""Exact search for repeated windows of ``length`` units (bytes or words), for two removal rules.

Shared by the byte operator (prefix-free parsing) and the word operator
(count-min prefilter). Each start position s of a window looks at the hashes of
the k-unit strings inside its window; the smallest (leftmost of equals) is its
*trigger*. The trigger depends on the window's content only, so equal windows
have equal triggers at equal offsets. Neighbouring starts mostly share a
trigger; a maximal run of starts with one trigger is a *phrase*: all its windows
lie in the units from its first start to its last start + length - 1.

So a window can be repeated only if its trigger string is, and

1. phrases with a trigger string that occurs once in the corpus are done;
2. phrases equal to another one (the dictionary holds one of them, with its
   count and first place) are decided as a whole, all their windows at once;
3. only different phrases around an equal trigger string are opened: their
   windows, the dictionary's suffixes, are compared one by one.

Nothing is all-pairs. Map tasks combine equal entries before the shuffle, ``COMBINE``
at a time (some 20 MB of text), so a phrase or window has at most one entry in so
many, however hot it is. A trigger with ``HOT`` different phrases among them is hot:
its phrases are known to be opened, so they are spread over all tasks at once and
only a mark goes to the trigger's own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import as_bytes, give_back, release, stage


#: A row of the shuffles. tag: kind + 4 * many + 8 * copy. An ENTRY of a phrase has in ``place`` the trigger's
#: place << 16 | first start's distance before it << 8 | last start's; an ENTRY of a window has its start there.
#: A DECIDED run of starts has its first in ``phrase`` and its last in ``place``. SPREAD is an entry of a hot trigger,
#: which it has in ``phrase``, MARK tells of one. Where windows meet, WINDOW is added to the kind of their rows.
ENTRY, DECIDED, SPREAD, MARK = 0, 1, 2, 3
WINDOW = 2
ROWS = "trigger long, phrase long, doc long, place long, tag int"
_POSITION_BITS = 28
LEAST_ID = -(1 << 63)
#: Entries of a trigger that may be decided in one task.
SMALL = 4096
#: Entries that a map task combines at once, and different phrases of a trigger among them that make it hot.
COMBINE = 1 << 19
HOT = 64


@dataclass(frozen=True)
class Setting:
    length: int  # units of a window
    k: int  # units of a trigger string
    keep_first: bool  # the first of equal windows stays (else all go)
    block: int = 1 << 19  # units that are hashed at once

    @property
    def reach(self) -> int:
        return self.length - self.k + 1


@dataclass(frozen=True)
class Coder:
    """How texts become units, how a piece of one travels, and how the strings of its units are told apart where
    phrases meet: by ``ranks`` (of the string of so many units at each unit of pieces laid end to end), else by hashes."""

    units: Callable[[bytes], np.ndarray]
    pack: Callable[[bytes, np.ndarray, int, int], bytes]
    unpack: Callable[[bytes], np.ndarray]
    ranks: Callable[[bytes, int], np.ndarray] | None = None


def _mixer(seed: int) -> tuple[np.uint64, np.uint64]:
    rng = np.random.default_rng(seed)
    return np.uint64(int(rng.integers(1, 1 << 62)) * 2 + 1), np.uint64(int(rng.integers(1, 1 << 62)) * 2 + 1)


_BASE1, _MIX1 = _mixer(11)
_BASE2, _MIX2 = _mixer(12)


def finish(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Prefix:
    """Polynomial hashes mod 2^64 of any substring of unit values, from prefix sums.

    H(a, n) = sum of u[a + i] * B^(n - 1 - i), as P[a + n] - P[a] * B^n. P needs a
    sequential scan; it is built by doubling over blocks of the text instead."""

    def __init__(self, units: np.ndarray, base: np.uint64):
        self.base = base
        n = len(units)
        # P[i + 1] = P[i] * B + u[i]  =>  P[i] = B^i * sum(u[j] * B^-(j + 1)), with the inverse of an odd B mod 2^64
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.powers = _powers(base, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(units * _powers(inverse, n + 1)[1:], out=self.sums[1:])

    def of(self, a: np.ndarray, n) -> np.ndarray:
        return (self.sums[a + n] - self.sums[a]) * self.powers[a + n]


_power_cache: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    held = _power_cache.get(int(base))
    if held is None or len(held) < n:
        out = np.ones(max(n, 1 << 16), np.uint64)
        out[1:] = base
        np.multiply.accumulate(out, out=out)
        _power_cache[int(base)] = held = out
    return held[:n]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done, out = 1, x
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def phrases(units: np.ndarray, lengths: np.ndarray, setting: Setting):
    """For texts laid end to end: text number, trigger hash, phrase hash, trigger place in its text, and how far
    the first and last start are before it; and Prefix for the windows."""
    none = np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    n = len(units)
    if n < setting.length:
        return none, none, none, none, none, none, None
    one = Prefix(units, _BASE1)
    starts_k = np.arange(n - setting.k + 1)
    h = finish(one.of(starts_k, setting.k) * _MIX1)
    keyed = (h >> np.uint64(_POSITION_BITS) << np.uint64(_POSITION_BITS)) | starts_k.astype(np.uint64)
    best = (_sliding_min(keyed, setting.reach) & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
    # starts whose window stays in its text
    text = np.repeat(np.arange(len(lengths)), lengths)[: len(best)]
    valid = np.arange(len(best)) + setting.length <= ends[text]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return none, none, none, none, none, none, None
    at = best[starts]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    place, lo, hi = at[first], starts[first], starts[last]
    two = Prefix(units, _BASE2)
    size = hi - lo + setting.length
    phrase = finish(two.of(lo, size) * _MIX2 + (place - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64))
    who = text[lo]
    return who, h[place].view(np.int64), phrase.view(np.int64), place - begins[who], place - lo, place - hi, (one, two, begins)


def _batch(trigger, phrase, doc, place, tag) -> pa.RecordBatch:
    cols = [np.ascontiguousarray(x, np.int64) for x in (trigger, phrase, doc, place)] + [np.ascontiguousarray(tag, np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["trigger", "phrase", "doc", "place", "tag"])


def _decided(doc, copy, first, last) -> pa.RecordBatch:
    return _batch(_spread_key(doc, first), first, doc, last, DECIDED + 8 * copy)


def _spread_key(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A key of its own for each row that has nothing to meet."""
    return finish(doc.view(np.uint64) * np.uint64(31) + place.astype(np.uint64)).view(np.int64)


def _combine(key1, key2, doc, copy, place, first, last, keep_first: bool, hot: int | None = None) -> list[pa.RecordBatch]:
    """The entries at hand, equal ones combined: what is decided here, and one entry of each pair of keys;
    with ``hot`` those whose first key has so many second ones are spread."""
    order = np.lexsort((place, copy, doc, key2, key1))
    new = np.ones(len(order), bool)
    new[1:] = (key1[order][1:] != key1[order][:-1]) | (key2[order][1:] != key2[order][:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.concatenate([at, [len(order)]]))
    head, many = order[at], size > 1
    rest = np.sort(order[~new] if keep_first else order[np.repeat(many, size)])
    out = []
    if hot:
        begin = np.flatnonzero(np.concatenate([[True], key1[head][1:] != key1[head][:-1]]))
        wide = np.diff(np.concatenate([begin, [len(head)]]))
        if (wide >= hot).any():
            found = key1[head[begin[wide >= hot]]]
            none = np.zeros(len(found), np.int64)
            out.append(_batch(found, none, none, none, none + MARK))
            spread = np.repeat(wide >= hot, wide)
            h = head[spread]
            out.append(_batch(_spread_key(doc[h], place[h]), key1[h], doc[h], place[h], SPREAD + 8 * copy[h]))
            head, many = head[~spread], many[~spread]
    out.append(_batch(key1[head], key2[head], doc[head], place[head], ENTRY + 4 * many + 8 * copy[head]))
    if len(rest):
        out.append(_decided(*_runs(doc[rest], copy[rest], first[rest], last[rest])))
    return out


def _runs(doc, copy, first, last):
    """Joins runs of starts that touch."""
    order = np.lexsort((first, copy, doc))
    doc, copy, first, last = doc[order], copy[order], first[order], last[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (first[1:] > last[:-1] + 1)
    at = np.flatnonzero(new)
    return doc[at], copy[at], first[at], np.maximum.reduceat(last, at)


# ----------------------------------------------------------------- the rows of texts


#: Rows of one id are numbered in this many groups by a hash of the text.
NUMBER_GROUPS = 4096


def prepare(docs: DataFrame) -> DataFrame:
    """doc_id, doc (the id, the least long for null), copy (numbers rows of one id), text.

    Ids are counted first; only where some repeat are their rows numbered: within (id, group
    of texts) by a window, after the rows of the id's groups before it, which narrow counts tell.
    So the rows of a frequent id, as null may be, are not one task's."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if not rows.groupBy("doc").count().where("count > 1").limit(1).count():
        return rows.select("doc_id", "doc", F.lit(0).alias("copy"), "text")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(NUMBER_GROUPS)))
    earlier = Window.partitionBy("doc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("doc", "part").agg(F.count(F.lit(1)).alias("n"))
    firsts = sizes.select("doc", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("doc", "part").orderBy("text")) - 1
    numbered = rows.withColumn("within", within).join(firsts, ["doc", "part"])
    return numbered.select("doc_id", "doc", (F.col("first") + F.col("within")).cast("int").alias("copy"), "text")


def in_blocks(texts, units_of, setting: Setting):
    """Gathers (doc, copy, text) into blocks: doc, copy, offset and length of each piece, and all units.

    A text beyond a block is cut into pieces that share length - 1 units, so each window is in one piece."""
    docs, copies, offsets, parts, held = [], [], [], [], 0
    for doc, copy, text in texts:
        units = units_of(text)
        for a in range(0, max(1, len(units) - setting.length + 1), setting.block):
            part = units[a : a + setting.block + setting.length - 1]
            if len(part) < setting.length:
                continue
            docs.append(doc)
            copies.append(copy)
            offsets.append(a)
            parts.append(part)
            held += len(part)
            if held >= setting.block:
                yield np.array(docs, np.int64), np.array(copies, np.int64), np.array(offsets, np.int64), np.array([len(x) for x in parts]), np.concatenate(parts)
                docs, copies, offsets, parts, held = [], [], [], [], 0
    if docs:
        yield np.array(docs, np.int64), np.array(copies, np.int64), np.array(offsets, np.int64), np.array([len(x) for x in parts]), np.concatenate(parts)


def _texts(batches):
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True)


def entries(rows: DataFrame, units_of, setting: Setting, wanted=None) -> DataFrame:
    """The dictionary's entries of all texts; ``wanted`` tells of trigger hashes which may be repeated."""

    def run(batches):
        held: list[tuple] = []
        size = 0
        for docs, copies, offsets, lengths, units in in_blocks(_texts(batches), units_of, setting):
            who, trigger, phrase, at, lo, hi, _ = phrases(units, lengths, setting)
            if wanted is not None and len(who):
                keep = wanted(trigger)
                who, trigger, phrase, at, lo, hi = (x[keep] for x in (who, trigger, phrase, at, lo, hi))
            if len(who):
                at = at + offsets[who]
                held.append((trigger, phrase, docs[who], copies[who], at << 16 | lo << 8 | hi, at - lo, at - hi))
                size += len(who)
            if size >= COMBINE:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)
        held = []
        give_back()

    def flush(held):
        return _combine(*(np.concatenate(x) for x in zip(*held, strict=True)), setting.keep_first, HOT)

    return rows.select("doc", "copy", "text").mapInArrow(run, ROWS)


def resolve(rows: DataFrame, setting: Setting) -> DataFrame:
    """Of all blocks together: decided runs (kind DECIDED: doc, copy, first x, last y) and phrases to open (kind ENTRY: doc, copy, trigger, place y; x tells a large group)."""
    kind, copy = F.col("tag").bitwiseAND(F.lit(3)), F.shiftright("tag", 3)
    entry = kind == ENTRY
    by_trigger = Window.partitionBy("trigger")
    by_phrase = Window.partitionBy("trigger", "phrase")
    ranked = by_phrase.orderBy("doc", copy, "place")
    only = F.when(entry, F.col("phrase"))
    got = rows.withColumn("marked", F.max(kind == MARK).over(by_trigger)).withColumn("several", F.col("marked") | F.coalesce(F.min(only).over(by_trigger) != F.max(only).over(by_trigger), F.lit(False)))
    got = got.withColumn("n", F.when(entry, F.row_number().over(ranked))).withColumn("large", F.col("marked") | (F.count(F.lit(1)).over(by_trigger) > SMALL))
    if setting.keep_first:
        decided, open_ = entry & (F.col("n") > 1), entry & (F.col("n") == 1) & F.col("several")
    else:
        many = F.max(F.col("tag").bitwiseAND(F.lit(4))).over(by_phrase)
        got = got.withColumn("more", (F.count(F.lit(1)).over(by_phrase) > 1) | (many > 0))
        decided, open_ = entry & F.col("more"), entry & (F.col("n") == 1) & F.col("several")
    at, lo, hi = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(255)), F.col("place").bitwiseAND(F.lit(255))
    run = F.when(kind == DECIDED, F.struct(F.lit(DECIDED).alias("kind"), F.lit(0).cast("long").alias("trigger"), F.col("phrase").alias("x"), F.col("place").alias("y"))).when(
        decided, F.struct(F.lit(DECIDED).alias("kind"), F.lit(0).cast("long").alias("trigger"), (at - lo).alias("x"), (at - hi).alias("y"))
    )
    opened = F.when(open_, F.struct(F.lit(ENTRY).alias("kind"), F.col("trigger"), F.col("large").cast("long").alias("x"), F.col("place").alias("y"))).when(
        kind == SPREAD, F.struct(F.lit(ENTRY).alias("kind"), F.col("phrase").alias("trigger"), F.lit(1).cast("long").alias("x"), F.col("place").alias("y"))
    )
    return got.select("doc", copy.alias("copy"), F.inline(F.array_compact(F.array(run, opened))))


def windows(rows: DataFrame, opened: DataFrame, coder: Coder, setting: Setting) -> DataFrame:
    """Decided runs of starts among the windows of opened phrases: doc, copy, x, y.

    Phrases of a trigger with at most SMALL entries travel as they are, and their windows meet in one task; those of
    a larger one travel window by window, equal ones of a block combined, so their windows meet wherever their hash says."""
    lists = opened.groupBy("doc", "copy").agg(F.collect_list(F.struct("trigger", "x", "y")).alias("open"))
    joined = rows.join(lists, ["doc", "copy"]).select("doc", "copy", "text", "open")

    def spread(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            out: list[tuple] = []
            for doc, copy, text, open_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3), strict=True):
                units = coder.units(text)
                trigger, large, place = (open_.values.field(k).to_numpy() for k in ("trigger", "x", "y"))
                small = np.flatnonzero(large == 0)
                for t, p in zip(trigger[small].tolist(), place[small].tolist(), strict=True):
                    first, last = (p >> 16) - (p >> 8 & 255), (p >> 16) - (p & 255)
                    out.append((t, t, 0, doc, p, 8 * copy + ENTRY, coder.pack(text, units, first, last + setting.length)))
                rest = np.flatnonzero(large)
                if not len(rest):
                    continue
                hashes = Prefix(units, _BASE1)
                for a in range(0, len(rest), 1 << 14):
                    t, p = trigger[rest[a : a + (1 << 14)]], place[rest[a : a + (1 << 14)]]
                    which, start, h = _opened(p, hashes, (p >> 16) - (p >> 8 & 255), setting)
                    held.append((t[which], h, np.full(len(which), doc), np.full(len(which), copy), start))
                    size += len(which)
                    if size >= COMBINE:
                        yield from flush(held)
                        held, size = [], 0
            for a in range(0, len(out), 1 << 14):
                yield _spread_batch(*zip(*out[a : a + (1 << 14)], strict=True))
        if held:
            yield from flush(held)

    def flush(held):
        t, h, doc, copy, start = (np.concatenate(x) for x in zip(*held, strict=True))
        for batch in _combine(t, h, doc, copy, start, start, start, setting.keep_first):
            t, h, doc, place, tag = (c.to_numpy() for c in batch.columns)  # of kinds ENTRY and DECIDED
            key = finish(t.view(np.uint64) * _MIX1 + h.view(np.uint64)).view(np.int64)
            yield _spread_batch(key, t, h, doc, place, tag + WINDOW, [None] * len(t))

    def meet(batches):
        carried = None
        for batch in batches:
            batch = batch if carried is None else pa.concat_batches([carried, batch])
            key = batch.column(0).to_numpy()
            new = np.flatnonzero(key[1:] != key[:-1])
            cut = int(new[-1]) + 1 if len(new) else 0  # the last key may go on in the next batch
            carried = batch.slice(cut)
            if cut:
                yield from _meet(batch.slice(0, cut), coder, setting)
        if carried is not None and carried.num_rows:
            yield from _meet(carried, coder, setting)

    sent = joined.mapInArrow(spread, "key long, trigger long, phrase long, doc long, place long, tag int, content binary")
    return sent.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "doc long, copy int, x long, y long")


def _starts(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrase number, number within the phrase and start in the text of each window of phrases."""
    at, lo, hi = place >> 16, place >> 8 & 255, place & 255
    count = lo - hi + 1
    which = np.repeat(np.arange(len(place)), count)
    step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return which, step, (at - lo)[which] + step


def _opened(place: np.ndarray, hashes: Prefix, first: np.ndarray, setting: Setting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrase number, start in the text and hash of each window of phrases; ``first``: where their first starts lie in the units."""
    which, step, start = _starts(place)
    # within a trigger, offset and hash of the window decide
    offset = (place >> 8 & 255)[which] - step
    h = finish(hashes.of(first[which] + step, setting.length) * _MIX2 + offset.astype(np.uint64)).view(np.int64)
    return which, start, h


def _spread_batch(key, trigger, phrase, doc, place, tag, content) -> pa.RecordBatch:
    cols = [pa.array(np.asarray(x, np.int64)) for x in (key, trigger, phrase, doc, place)] + [pa.array(np.asarray(tag, np.int32)), pa.array(content, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["key", "trigger", "phrase", "doc", "place", "tag", "content"])


def _meet(batch: pa.RecordBatch, coder: Coder, setting: Setting):
    """Decides the windows of whole keys."""
    _, trigger, phrase, doc, place, tag = (c.to_numpy() for c in batch.columns[:6])
    kind, copy = tag & 3, tag >> 3
    done = kind == DECIDED + WINDOW
    runs = [(doc[done], copy[done], phrase[done], place[done])]
    window = kind == ENTRY + WINDOW
    parts = [(trigger[window], phrase[window], doc[window], copy[window], place[window], (tag[window] & 4) > 0)]
    small = np.flatnonzero(kind == ENTRY)
    if len(small):
        contents = batch.column(6).take(pa.array(small)).to_pylist()
        pieces = contents if coder.ranks else [coder.unpack(x) for x in contents]
        lengths = np.array([len(c) for c in pieces])
        begins = np.cumsum(lengths) - lengths
        if coder.ranks:  # equal strings have equal triggers, so ranks among the pieces of several triggers do
            which, step, start = _starts(place[small])
            h = coder.ranks(b"".join(pieces), setting.length)[begins[which] + step]
        else:
            which, start, h = _opened(place[small], Prefix(np.concatenate(pieces), _BASE1), begins, setting)
        parts.append((trigger[small][which], h, doc[small][which], copy[small][which], start, np.zeros(len(which), bool)))
    t, h, d, c, s, many = (np.concatenate(x) for x in zip(*parts, strict=True))
    if len(t):
        order = np.lexsort((s, c, d, h, t))
        new = np.ones(len(order), bool)
        new[1:] = (t[order][1:] != t[order][:-1]) | (h[order][1:] != h[order][:-1])
        if setting.keep_first:
            rest = order[~new]
        else:
            at = np.flatnonzero(new)
            size = np.diff(np.concatenate([at, [len(order)]]))
            rest = order[np.repeat((size > 1) | np.logical_or.reduceat(many[order], at), size)]
        runs.append((d[rest], c[rest], s[rest], s[rest]))
    d, c, first, last = (np.concatenate(x) for x in zip(*runs, strict=True))
    if len(d):
        d, c, first, last = _runs(d, c, first, last)
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(c.astype(np.int32)), pa.array(first), pa.array(last)], ["doc", "copy", "x", "y"])


def decided_runs(rows: DataFrame, coder: Coder, setting: Setting, wanted=None) -> DataFrame:
    """doc, copy and runs (array of first, last start) of the texts with windows to remove."""
    spark = rows.sparkSession
    both = stage(spark, resolve(entries(rows, coder.units, setting, wanted), setting), "phrases")
    release(spark)
    met = stage(spark, windows(rows, both.where(F.col("kind") == ENTRY), coder, setting), "windows")
    release(spark)
    every = both.where(F.col("kind") == DECIDED).select("doc", "copy", "x", "y").unionByName(met)
    return every.groupBy("doc", "copy").agg(F.collect_list(F.struct("x", "y")).alias("runs"))


def covered(starts: list[tuple[int, int]], length: int, total: int) -> list[tuple[int, int]]:
    """Maximal runs of units covered by windows at the starts first..last, end exclusive."""
    out: list[list[int]] = []
    for first, last in sorted(starts):
        a, b = first, min(total, last + length)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
