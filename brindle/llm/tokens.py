"""Token ids in files of directly addressable codes.

Each id is split into chunks of ``CHUNK`` bits. Level 0 holds the lowest chunk of
every id, level k the k-th chunk of those ids that have one; a bitmap beside each
level tells which of its entries go on to the next, and a rank directory (set
bits before each block of 512) finds an entry's place there. So any token is
read from a few places, and no block is decoded. A file holds the documents of a
range of ids in ascending order, with their ids and offsets.

Text is dealt out by ranges of doc_id. Each task encodes its documents in order
and writes files of at most ``file_tokens`` ids (a longer document has a file of
its own), each under a temporary name that is then renamed. The manifest of
files comes to the driver (a row a file); start positions are its running sums.

Encoding equals the tokenizer's on the whole text. For a plain byte-level BPE,
pieces are found as by its own split pattern, and each different one of a slice of
texts is encoded once, short ones by merges in all of them at a time; texts with any character whose class the pattern library
could see otherwise, or with a special token's string, and all texts of other
kinds of tokenizers are encoded whole. ``tests/llm`` compares both.

Defined results: a null text is empty (only the end id); rows of one doc_id stay
adjacent, ordered by text; null ids come first; an empty table writes nothing
and gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import fresh_path, give_back, keep, shared_fs, write_whole

CHUNK = 8
BLOCK = 512
MAGIC = b"BDAC\x01"
FILE_TOKENS = 4 << 20
END_ID = 0
#: What remembered pieces may take, beside those of one slice, with ENTRY_BYTES beside the bytes and ids of each; and the characters encoded at once.
CACHE_BYTES = 24 << 20
ENTRY_BYTES = 64
SLICE = 4 << 20
#: Bytes of the longest pieces that are merged many at once; longer ones are left to the tokenizer.
LONGEST = 32
FILES = "file string, first_doc long, n_docs long, n_tokens long, part int, seq int"
ROWS = "doc_id long, local_start long, n_tokens long, ids_crc32 long, file string"

# ----------------------------------------------------------------- the codes


def pack_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, rank directory) of each level."""
    rest, out = np.asarray(ids, np.uint32), []
    while True:
        more = rest >= (1 << CHUNK)
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32) if len(more) else np.zeros(0, np.uint32)
        out.append(((rest & 0xFF).astype(np.uint8), bits, ranks))
        if not more.any():
            return out
        rest = rest[more] >> CHUNK


class Codes:
    """Reads one file's bytes; nothing is decoded before it is asked for."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        at = len(MAGIC)
        n_docs, self.n, n_levels = struct.unpack_from("<QQI", data, at)
        at += 20
        self.null = np.frombuffer(data, np.uint8, n_docs, at).astype(bool)
        at += n_docs
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        at += 8 * n_docs
        self.starts = np.frombuffer(data, "<u8", n_docs + 1, at).astype(np.int64)
        at += 8 * (n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            parts = []
            for kind, size in (("u1", n), ("u1", (n + 7) // 8), ("<u4", -(-n // BLOCK))):
                parts.append(np.frombuffer(data, kind, size, at))
                at += size * int(kind[-1])
            self.levels.append(tuple(parts))

    def token(self, i: int) -> int:
        """The i-th id of the file: one chunk, one bit and one rank a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(bits, ranks, i)
        return value

    @staticmethod
    def _rank(bits, ranks, i: int) -> int:
        block = i // BLOCK
        head = np.unpackbits(bits[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
        return int(ranks[block]) + int(head.sum())

    def slice(self, a: int, b: int) -> np.ndarray:
        """The ids from a to b, end exclusive, by the same places a level at a time."""
        out = np.zeros(max(0, b - a), np.uint32)
        at = np.arange(len(out))
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            if not len(at):
                break
            out[at] |= chunks[a:b].astype(np.uint32) << np.uint32(CHUNK * k)
            more = np.unpackbits(bits[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + (b - a)].astype(bool)
            if not more.any():
                break
            a = self._rank(bits, ranks, a)
            b = a + int(more.sum())
            at = at[more]
        return out


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> list[bytes]:
    levels = pack_levels(ids)
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    out = [
        MAGIC, struct.pack("<QQI", len(doc_ids), len(ids), len(levels)),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), starts.tobytes(),
    ]
    for chunks, bits, ranks in levels:
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()]
    return out


# ----------------------------------------------------------------- encoding

#: The split of byte-level BPE for texts whose letters and digits both libraries see alike.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: A single space between other characters is always a border of pieces. These make a text odd;
#: white space of other kinds does too, as it is not among the plain characters.
_ODD = ("  ", " \n", "\n ", "\n\n")
_BORDER = "\n\n"


#: Characters outside those whose class is the same for Python's patterns and the tokenizer's.
_NOT_PLAIN = re.compile("[^\n -~\u00a1\u00ab\u00bb\u00bf-\u00d6\u00d8-\u00f6\u00f8-\u017f\u2013-\u201e\u2026\u20ac]")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _is_byte_level(said: dict) -> bool:
    """Whether a tokenizer's description is that of a BPE over bytes which are split by ``PIECES`` and not changed before."""
    before, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    rare = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    return bool(said.get("normalizer") is None and not said.get("truncation") and not said.get("padding") and plain and model.get("type") == "BPE" and not any(model.get(k) for k in rare))


def _kinds() -> np.ndarray:
    """What each byte of plain texts belongs to: 1 letters, 2 digits, 3 a line end, 4 a space, 0 other characters. All
    plain characters that begin with one byte over 127 are of one kind; the bytes after it take it from there."""
    out = np.zeros(256, np.uint8)
    for c in filter(lambda c: not _NOT_PLAIN.match(c), map(chr, range(0x2100))):
        out[c.encode()[0]] = {"\n": 3, " ": 4}.get(c) or (1 if re.match(r"[^\W\d_]", c) else 2 if re.match(r"\d", c) else 0)
    return out


_KINDS = _kinds()


def cut_pieces(data: pa.Buffer) -> pa.LargeBinaryArray:
    """The pieces by ``PIECES`` of plain characters in UTF-8, where white space is single spaces before words, single line
    ends within them and ``_BORDER`` after them: a new piece begins where the kind of characters changes."""
    chars = np.frombuffer(data, np.uint8)
    kind = _KINDS[chars]
    after = np.flatnonzero((chars & 0xC0) == 0x80)
    for _ in range(2):  # plain characters have three bytes at most
        kind[after] = kind[after - 1]
    begins = np.ones(len(chars), bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins[np.flatnonzero(kind == 4) + 1] = False
    # 's 't 'm 'd 're 've 'll where a piece begins
    at = np.flatnonzero(begins & (chars == ord("'")))
    one, two = chars[at + 1], chars[at + 1].astype(np.uint16) << 8 | chars[at + 2]
    more = np.where(np.isin(one, list(b"stmd")), 1, 2 * np.isin(two, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")]))
    at, more = at[more > 0], more[more > 0]
    begins[at + 1] = False
    begins[at + 1 + more] = True
    offsets = np.append(np.flatnonzero(begins), len(chars)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), data])


def _spread(values: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``size`` values from each place on, end to end."""
    at = np.repeat(place - (np.cumsum(size) - size), size)
    at += np.arange(len(at))
    return values[at]


class Merges:
    """The merges of a BPE over bytes, applied to many pieces of one length at once: each round does in every piece what the
    tokenizer would do next there, the merge of the lowest rank (of equal ones the leftmost)."""

    #: Rank of pairs that are not merged; a rank and a column (under 64) fit 31 bits.
    NONE = (1 << 25) - 1

    def __init__(self, vocab: dict[str, int], merges: list, letters: dict[int, str]):
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        ranks = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ranks[vocab[a] << 32 | vocab[b]] = rank, vocab[a + b]
        self.made = np.zeros(len(merges) + 1, np.int32)
        keys, rank = np.array([*ranks, -1], np.int64)[:-1], np.array([r for r, _ in ranks.values()], np.int32)
        self.made[rank] = [m for _, m in ranks.values()]
        # open addressing: a pair is in the first free place from its own on
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.NONE, np.int32)
        place, left = self._place(keys), np.arange(len(keys))
        while len(left):
            taken = self.keys[place] >= 0
            mine, who = np.unique(np.where(taken, -1, place), return_index=True)
            mine, who = mine[mine >= 0], who[mine >= 0]
            self.keys[mine], self.ranks[mine] = keys[left[who]], rank[left[who]]
            wait = np.ones(len(left), bool)
            wait[who] = False
            left, place = left[wait], np.where(taken[wait], place[wait] + 1 & self.last, place[wait])
        self.byte_pairs = self.rank(np.repeat(self.first, 256), np.tile(self.first, 256)).reshape(256, 256)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        place = self._place(keys)
        there = self.keys[place]
        out = np.where(there == keys, self.ranks[place], self.NONE)
        left = np.flatnonzero((there != keys) & (there >= 0))
        place = place[left]
        while len(left):
            place = place + 1 & self.last
            there, hit = self.keys[place], self.keys[place] == keys[left]
            out[left[hit]] = self.ranks[place[hit]]
            go = ~hit & (there >= 0)
            left, place = left[go], place[go]
        return out

    def apply(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of pieces, end to end, and how many each has; the bytes of a piece are a column."""
        n, many = chars.shape
        out, size, rows = np.zeros((many, n), np.uint32), np.zeros(many, np.int64), np.arange(many)
        ids, ranks = self.first[chars], self.byte_pairs[chars[:-1], chars[1:]]
        while len(rows):
            best = (ranks << 6 | np.arange(n - 1, dtype=np.int32)[:, None]).min(axis=0) if n > 1 else np.full(len(rows), self.NONE << 6)
            go = best < self.NONE << 6
            if not go.all():
                size[rows[~go]], out[rows[~go], :n] = n, ids[:, ~go].T
                rows, ids, ranks, best = rows[go], ids[:, go], ranks[:, go], best[go]
                if not len(rows):
                    break
            n -= 1
            at, new, columns = best & 63, self.made[best >> 6], np.arange(len(rows))
            ids[at, columns] = new
            ids = np.where(np.arange(n)[:, None] <= at, ids[:-1], ids[1:])
            ranks = np.where(np.arange(n - 1)[:, None] < at, ranks[:-1], ranks[1:])
            some = np.flatnonzero(at > 0)
            ranks[at[some] - 1, some] = self.rank(ids[at[some] - 1, some], new[some])
            some = np.flatnonzero(at < n - 1)
            ranks[at[some], some] = self.rank(new[some], ids[at[some] + 1, some])
        return out[np.arange(chars.shape[0]) < size[:, None]], size


class Encoder:
    """ids of whole texts. A slice of texts is cut at its spaces, equal words are encoded once for the slice, and
    their pieces are remembered from slice to slice until they take ``CACHE_BYTES``.

    Only a plain byte-level BPE is taken apart so; texts of any other tokenizer are encoded whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        said, self.letters = json.loads(self.whole.to_str()), _byte_letters()
        self.apart = _is_byte_level(said)
        complete = self.apart and all(x in said["model"]["vocab"] for x in self.letters.values())
        self.merges = Merges(said["model"]["vocab"], said["model"]["merges"], self.letters) if complete else None
        self._forget()

    def _direct(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _odd(self, text: str) -> bool:
        return text[:1] in ("", " ", "\n") or text[-1] in " \n" or any(s in text for s in _ODD) or any(s in text for s in self.special)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and how many each has."""
        odd = np.array([not self.apart or self._odd(t) for t in texts], bool)
        plain = [t for t, o in zip(texts, odd.tolist(), strict=True) if not o]
        flat, lengths, bad = self._plain(plain)
        if not odd.any() and not bad.any():
            return flat, lengths
        odd[np.flatnonzero(~odd)[bad]] = True
        known = iter(np.split(flat, np.cumsum(lengths)[:-1]) if len(lengths) else ())
        out = []
        for text, o in zip(texts, odd.tolist(), strict=True):
            out.append(self._direct(text) if o else next(known))
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids and lengths of the texts without odd white space; and which of them (left out of both) have other odd characters."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool)
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        begins = cut.offsets.to_numpy()[:-1]
        coded = pc.dictionary_encode(cut.flatten())
        words, at = coded.dictionary, coded.indices.to_numpy().copy()
        del cut, coded
        # a text's first word has no space before it
        firsts, which = np.unique(at[begins], return_inverse=True)
        at[begins] = len(words) + which
        bad = np.zeros(len(texts), bool)
        odd = pc.match_substring_regex(words, _NOT_PLAIN.pattern)
        if pc.any(odd).as_py():
            is_odd = odd.to_numpy(zero_copy_only=False)
            bad = np.logical_or.reduceat(np.concatenate([is_odd, is_odd[firsts]])[at], begins)
            words = pc.if_else(odd, pa.scalar("x", pa.large_string()), words)
        # two line ends between words: never inside one of these texts, and a piece of their own before a space
        space, border, nothing = (pa.scalar(x, pa.large_string()) for x in (" ", _BORDER, ""))
        spaced = pc.binary_join_element_wise(space, words, border, nothing)
        joined = pa.concat_arrays([spaced, pc.binary_join_element_wise(words.take(pa.array(firsts)), border, nothing)])
        which = self._numbers(cut_pieces(joined.buffers()[2]))
        size = self.size[which]
        ids = _spread(self.ids, self.place[which], size)
        ends = np.cumsum(size)[which == 0]
        size = np.diff(ends, prepend=0)  # of words
        place = ends - size
        lengths = np.add.reduceat(size[at], begins)
        if bad.any():
            at, lengths = at[np.repeat(~bad, np.diff(np.append(begins, len(at))))], lengths[~bad]
        return _spread(ids, place[at], size[at]), lengths, bad

    def _forget(self) -> None:
        self.number = pa.array([_BORDER.encode()], pa.large_binary())
        self.ids, self.size, self.place = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.held = 0

    def _numbers(self, pieces: pa.LargeBinaryArray) -> np.ndarray:
        """The number of each piece among those that are remembered; new ones are encoded."""
        if self.held > CACHE_BYTES:
            self._forget()
        coded = pc.dictionary_encode(pieces)
        found = pc.index_in(coded.dictionary, value_set=self.number)
        number = pc.fill_null(found, -1).to_numpy().copy()
        if found.null_count:
            new = coded.dictionary.filter(pc.is_null(found))
            number[number < 0] = np.arange(len(self.number), len(self.number) + len(new))
            ids, place, size = self._encode_pieces(new)
            self.place = np.concatenate([self.place, place + len(self.ids)])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, ids])
            self.number = pa.concat_arrays([self.number, new])
            self.held += ENTRY_BYTES * len(new) + new.nbytes + 4 * len(ids)
        return number[coded.indices.to_numpy()]

    def _encode_pieces(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of different pieces, and at which of them each piece begins and how many it has."""
        starts = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        data, n_bytes = np.frombuffer(pieces.buffers()[2], np.uint8), np.diff(starts)
        place, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        parts, held = [], 0
        order = np.argsort(n_bytes, kind="stable")
        edges = np.searchsorted(n_bytes[order], np.arange(1, LONGEST + 2)) if self.merges else np.zeros(LONGEST + 1, np.int64)
        for n in range(1, LONGEST + 1):  # all pieces of n bytes at once
            some = order[edges[n - 1] : edges[n]]
            if not len(some):
                continue
            ids, sizes = self.merges.apply(data[starts[some] + np.arange(n)[:, None]])
            size[some], place[some] = sizes, held + np.cumsum(sizes) - sizes
            parts.append(ids)
            held += len(ids)
        for i in order[edges[-1] :].tolist():
            got = self.whole.model.tokenize(data[starts[i] : starts[i + 1]].tobytes().decode("latin-1").translate(self.letters))
            size[i], place[i] = len(got), held
            parts.append(np.array([t.id for t in got], np.uint32))
            held += len(got)
        return np.concatenate(parts), place, size


def encoder(path: str) -> Encoder:
    return keep(f"encoder {path}", lambda: Encoder(path))


# ----------------------------------------------------------------- files


def _slices(batches):
    """ids and texts of some ``SLICE`` characters of documents at once."""
    ids: list[int | None] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc_id)
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= SLICE:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def write(docs: DataFrame, out: str, tokenizer: str, *, parts: int | None = None, file_tokens: int = FILE_TOKENS) -> list[tuple]:
    """Write the files below ``out``; returns their manifest in order: (file, n_docs, n_tokens, start)."""
    spark = docs.sparkSession
    fs, path = shared_fs(out)
    fs.create_dir(path, recursive=True)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        fs, path = shared_fs(out)
        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []

        def roll():
            nonlocal seq, ids, doc_ids, lengths
            name = f"part-{part:06d}-{seq:05d}.dac"
            whole = np.concatenate(ids)
            write_whole(fs, f"{path}/{name}", file_bytes(doc_ids, lengths, whole))
            row = [name, doc_ids[0], len(doc_ids), len(whole), part, seq]
            seq, ids, doc_ids, lengths = seq + 1, [], [], []
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["file", "first_doc", "n_docs", "n_tokens", "part", "seq"])

        held = 0
        for some_ids, texts in _slices(batches):
            flat, sizes = enc.encode_all(texts)
            flat, at = np.insert(flat, np.cumsum(sizes), END_ID), 0
            for doc_id, n in zip(some_ids, (sizes + 1).tolist(), strict=True):
                if held and held + n > file_tokens:
                    yield roll()
                    held = 0
                ids.append(flat[at : at + n])
                doc_ids.append(doc_id)
                lengths.append(n)
                held, at = held + n, at + n
        if doc_ids:
            yield roll()
        give_back()

    files = sorted(dealt.mapInArrow(run, FILES).collect(), key=lambda r: (r.part, r.seq))
    out_rows, start = [], 0
    for r in files:
        out_rows.append((r.file, r.n_docs, r.n_tokens, start))
        start += r.n_tokens
    write_whole(fs, f"{path}/MANIFEST", ["".join("\t".join(map(str, r)) + "\n" for r in out_rows).encode()])
    return out_rows


def read(spark, out: str, manifest: list[tuple]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the files."""
    if not manifest:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string")

    def run(batches):
        fs, path = shared_fs(out)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{path}/{name}") as f:
                    codes = Codes(f.read())
                starts = codes.starts.tolist()
                crc = [zlib.crc32(codes.slice(a, b).tobytes()) for a, b in zip(starts, starts[1:], strict=False)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([
                    pa.array(codes.doc_ids, pa.int64(), mask=codes.null), pa.array(codes.starts[:-1] + base, pa.int64()),
                    pa.array(np.diff(codes.starts), pa.int64()), pa.array(crc, pa.int64()), pa.array([name] * n, pa.string()),
                ], ["doc_id", "start", "n_tokens", "ids_crc32", "file"])

    files = spark.createDataFrame([(r[0], r[3]) for r in manifest], "file string, base long")
    n = min(len(manifest), 4 * spark.sparkContext.defaultParallelism if len(manifest) < 10_000 else len(manifest) // 8)
    return files.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def encode_to_files(docs: DataFrame, tokenizer: str, out: str | None = None, **options) -> DataFrame:
    """Write and read back."""
    spark = docs.sparkSession
    out = out or fresh_path(spark, "tokens")
    return read(spark, out, write(docs, out, tokenizer, **options))
