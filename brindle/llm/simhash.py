"""SimHash near-dedup over a byte-position inverted index.

Texts are lower-cased (A-Z) and cut into words; each run of three words is a
shingle, repeats included. A fingerprint bit is the majority of that bit over
the shingles' XXH64. Two documents link if their fingerprints differ in at most
``max_bits`` = 2 bits.

Count filtering: two differing bits touch at most two of the eight bytes, so
linked fingerprints share at least six positional bytes (``LEAST_SHARED``). A posting
of one byte would hold 1/256 of all fingerprints, so the index is compounded: eight
bytes are four blocks of two, of which two blocks at least are whole in any linked
pair, and a posting is keyed by the positions and values of two blocks (six
choices). For each pair that meets in a posting the shared positional bytes are
tallied, pairs with fewer than six are dropped, and the others verified by popcount.
A posting with over ``PAIRED`` fingerprints (near copies by the thousand) is not
paired: it is split by two of its other four bytes (six choices), where every pair
has a tally of six at least and a posting holds 65,536 fingerprints at most. Members
there within one bit of a common value are within two bits of each other, so each
such star is tied to its least member.

Classes are connected components of the distinct fingerprints, found by
alternating large-star and small-star rounds, each written to the shared folder.

Defined results: null, empty and wordless texts have fingerprint zero, linked
like any other; one or two words are one shingle; a null doc_id keeps its
fingerprint and gets the class of the others with it, or null alone; repeated
rows repeat; extra columns are ignored. ``keep_one`` keeps one row of a class: of
the least id (null ids last), and of several rows with it the one read first.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from brindle.llm.common import LOWER, as_bytes, per_batch, stage_apart, unstage, unused

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: A differing bit touches one byte.
LEAST_SHARED = 8 - MAX_BITS
#: Fingerprints of a posting whose pairs are tallied one by one.
PAIRED = 64
#: Rows into which a component's row is copied where all its members look it up.
SALT = 16
_WHITE = bytes(32 if b in (32, 9, 10, 11, 12, 13) else b for b in LOWER)
#: Positions of each two of the four blocks of two bytes.
_FOURS = [(2 * a, 2 * a + 1, 2 * b, 2 * b + 1) for a, b in combinations(range(4), 2)]
_ONE_BIT = np.array([0, *(1 << k for k in range(16))], np.uint32)


def fingerprint(text: bytes | None) -> int:
    import xxhash

    line = b" ".join((text or b"").translate(_WHITE).split())
    if not line:
        return 0
    hash64 = xxhash.xxh64_intdigest
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    if len(spaces) < SHINGLE - 1:
        return hash64(line, SEED)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(line)][SHINGLE - 1 :]
    n, ones = len(ends), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([hash64(line[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=False)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _adder(docs: DataFrame, name: str) -> tuple[Callable[[pa.RecordBatch], pa.RecordBatch], StructType]:
    """What adds the fingerprint (64 bits as a signed long) to a batch of docs, and the schema then."""
    at = docs.columns.index("text")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.array([fingerprint(t) for t in as_bytes(batch.column(at))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits)], [*batch.schema.names, name])

    return one, StructType([*docs.schema.fields, StructField(name, LongType())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a signed long), staged."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one, schema = _adder(rows, "bits")
    kept = ["doc_id", "bits"]
    return stage_apart(docs.sparkSession, rows, "fingerprints", each=lambda batch: one(batch).select(kept), schema=StructType([f for f in schema.fields if f.name in kept]))


def _byte(k: int) -> Column:
    return F.shiftrightunsigned("bits", 8 * k).bitwiseAND(F.lit(255))


def _joined(positions) -> Column:
    out = F.lit(0).cast("long")
    for n, k in enumerate(positions):
        out = out.bitwiseOR(F.shiftleft(_byte(k), 8 * n))
    return out


def _postings(bits: DataFrame) -> DataFrame:
    """(key, bits) for each choice of two blocks: the key has the choice and the four bytes."""
    return bits.select("bits", F.inline(F.array(*[F.struct(_joined(c).bitwiseOR(F.lit(n << 32)).alias("key")) for n, c in enumerate(_FOURS)])))


def _refined(large: DataFrame) -> DataFrame:
    """(key, more, rest) of members of large postings: ``more`` has the choice of two other positions and their bytes, ``rest`` the two last bytes."""
    out = None
    for n, four in enumerate(_FOURS):
        other = [k for k in range(8) if k not in four]
        rows = F.array(*[
            F.struct(_joined(two).bitwiseOR(F.lit(m << 16)).cast("int").alias("more"), _joined([k for k in other if k not in two]).cast("int").alias("rest"))
            for m, two in enumerate(combinations(other, 2))
        ])
        out = F.when(F.shiftright("key", 32) == n, rows) if out is None else out.when(F.shiftright("key", 32) == n, rows)
    return large.select("key", F.inline(out))


def pairs(bits: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within postings that are laid end to end."""
    begins = np.repeat(np.cumsum(sizes) - sizes, sizes)
    before = np.arange(len(bits)) - begins
    second = np.repeat(np.arange(len(bits)), before)
    first = begins[second] + np.arange(len(second)) - np.repeat(np.cumsum(before) - before, before)
    return bits[first], bits[second]


def verified(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs whose tally of shared positional bytes reaches the least, and whose bits do as well."""
    differ = a ^ b
    tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    good = np.flatnonzero(tally >= LEAST_SHARED)
    good = good[np.bitwise_count(differ[good]) <= MAX_BITS]
    return a[good], b[good]


def stars(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least, member) that link 16-bit values within two bits as all their pairs would."""
    near = (rest[:, None].astype(np.uint32) ^ _ONE_BIT[None, :]).ravel()
    who = np.repeat(rest.astype(np.uint32), len(_ONE_BIT))
    order = np.lexsort((who, near))
    near, who = near[order], who[order]
    new = np.concatenate([[True], near[1:] != near[:-1]])
    least = who[np.maximum.accumulate(np.where(new, np.arange(len(near)), 0))]
    edge = np.unique(least[~new].astype(np.uint64) << 16 | who[~new])
    return (edge >> np.uint64(16)).astype(np.uint32), (edge & np.uint64(0xFFFF)).astype(np.uint32)


def links(bits: DataFrame) -> DataFrame:
    """Edges a, b between distinct fingerprints, enough to connect all that link."""
    postings = _postings(bits)
    sizes = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stage_apart(bits.sparkSession, postings.join(sizes, "key"), "postings", narrow=True)
    small = met.where(F.col("n") <= PAIRED).groupBy("key").agg(F.collect_list("bits").alias("bits")).select("bits")
    large = _refined(met.where(F.col("n") > PAIRED)).groupBy("key", "more").agg(F.collect_set("rest").alias("rest")).where(F.size("rest") > 1)
    edges = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def tally(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = verified(*pairs(batch.column(0).flatten().to_numpy().view(np.uint64), np.diff(batch.column(0).offsets.to_numpy())))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=edges)

    def tie(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(np.zeros(0, np.uint64),) * 2]
        for key, more, rest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            four = _FOURS[key >> 32]
            other = [k for k in range(8) if k not in four]
            two = list(combinations(other, 2))[more >> 16]
            base = sum((key >> 8 * n & 255) << 8 * k for n, k in enumerate(four)) | sum((more >> 8 * n & 255) << 8 * k for n, k in enumerate(two))
            low, high = (k for k in other if k not in two)
            ends = stars(rest.values.to_numpy())
            out.append(verified(*(np.uint64(base) | (x.astype(np.uint64) & np.uint64(255)) << np.uint64(8 * low) | (x.astype(np.uint64) >> np.uint64(8)) << np.uint64(8 * high) for x in ends)))
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=edges)

    return small.mapInArrow(per_batch(lambda: tally), "a long, b long").unionByName(large.mapInArrow(per_batch(lambda: tie), "a long, b long")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for each node of the edges (a, b): the least node of its component.

    Large-star and small-star rounds; every round's edges are written to the
    shared folder, and only two sums come to the driver."""
    spark = edges.sparkSession
    now = stage_apart(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges-0", narrow=True)
    before = None
    for k in range(1, max_rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above u go to the least of u's neighbourhood
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below u, and u, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, stage_apart(spark, small, f"edges-{k}", narrow=True)
        unstage(last)
        state = tuple(now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))), F.lit(0))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _shared(prints: DataFrame, row: Column) -> DataFrame:
    """bits and ``first`` (the least doc_id of the class and the row it is from) of fingerprints that several rows have or that link."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), row.alias("row"))
    nodes = stage_apart(prints.sparkSession, prints.groupBy("bits").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")), "nodes", narrow=True)
    root = components(links(nodes.select("bits")))
    tied = nodes.join(root.withColumnRenamed("node", "bits"), "bits").select("bits", "root", "first")
    # the root stands for its component; its own first row counts as well
    least = tied.select("root", "first").unionByName(nodes.join(root.select("root").distinct(), nodes.bits == F.col("root"), "left_semi").select(F.col("bits").alias("root"), "first"))
    least = least.groupBy("root").agg(F.min("first").alias("class"))
    # a large component's members look up one row: it is copied, and they are spread
    copies = least.withColumn("salt", F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALT)])))
    member = tied.select("bits", "root", F.pmod(F.xxhash64("bits"), F.lit(SALT)).alias("salt")).join(copies, ["root", "salt"]).select("bits", "class")
    member = member.unionByName(least.select(F.col("root").alias("bits"), "class"))
    # only fingerprints of several rows or of a larger component need a join; the others are their own class
    shared = nodes.join(member, "bits", "left").where("n > 1 or class is not null").select("bits", F.coalesce("class", "first").alias("first"))
    return stage_apart(prints.sparkSession, shared, "shared", narrow=True)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id."""
    prints = fingerprints(docs)
    shared = _shared(prints, F.lit(0).cast("long")).select("bits", F.col("first.doc_id").alias("component_id"))
    text = F.lpad(F.lower(F.hex("bits")), 16, "0")
    return prints.join(shared, "bits", "left").select("doc_id", text.alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, all columns, of each class the first row (see above). Rows are told apart by a number of their own, not by doc_id."""
    spark = docs.sparkSession
    bits, row = unused(docs, "bits"), unused(docs, "row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    one, schema = _adder(numbered, bits)
    held = stage_apart(spark, numbered, "rows", each=one, schema=schema)
    prints = held.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(bits).alias("bits"), F.col(row).alias("row"))
    shared = _shared(prints, F.col("row"))
    dropped = prints.join(shared, "bits").where(F.col("row") != F.col("first.row")).select(F.col("row").alias(row))
    dropped = stage_apart(spark, dropped, "dropped", narrow=True)
    return held.join(dropped, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
