"""Deterministic sharded WARC writer and reader.

Rows are sorted by ranges of page_id. Equal payloads (SHA-1 of the UTF-8 html)
are found on narrow rows only: per digest the smallest page_id is the response,
every other row becomes a revisit. That decision joins the pages inside the one
range exchange (both kinds of rows are sorted to the same place), so html moves
once. Each task writes records as gzip members, rolls to a new file once the
compressed size reaches ``roll_bytes``, and commits each file by renaming a
temporary name. Headers, record ids, dates and digests are regenerated from the
row alone, so a repeated task writes equal bytes. A manifest per run lists the
files; readers take files from it only.

Defined results: null html is an empty payload; rows of one page_id with equal
payloads are one response and revisits of the same id; a null page_id sorts
first and is never referred to unless all rows of the payload have null ids;
payloads below ``min_revisit_bytes`` are all responses; an empty table gives an
empty manifest and no rows; control characters in a url are percent-encoded;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import fresh_path, shared_fs, stage, unstage, write_whole

ROLL_BYTES = 64 << 20
#: Payloads with more than one in this many rows are joined where the rows stand.
HOT_SHARE = 1000
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "file string, n_records long, n_bytes long, part int, seq int"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string, file string, offset long"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, copy: int) -> str:
    raw = bytearray(hashlib.sha256(f"{page_id}:{digest}:{copy}".encode()).digest()[:16])
    raw[6], raw[8] = raw[6] & 0x0F | 0x50, raw[8] & 0x3F | 0x80
    h = raw.hex()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def clean_url(url: str | None) -> str:
    return "".join(quote(c) if ord(c) < 33 or ord(c) == 127 else c for c in url or "urn:none")


def record_bytes(page_id, url, payload: bytes, digest: str, copy: int, refers_to, revisit: bool) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest, copy)), ("WARC-Date", DATE),
        ("WARC-Target-URI", clean_url(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
    ]
    if page_id is not None:
        fields.append(("WARC-Page-Id", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_to, digest, 0))]
        if refers_to is not None:
            fields.append(("WARC-Refers-To-Page-Id", str(refers_to)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def records(data: bytes, step: int = 1 << 16):
    """(offset of the member, headers, block) of each record of a .warc.gz file; the
    file is decompressed in steps, so the rest of it isn't copied for each record."""
    at = 0
    while at < len(data):
        reader, parts, here = zlib.decompressobj(31), [], at
        while not reader.eof:
            if here >= len(data):
                raise ValueError(f"the record at {at} is cut off")
            parts.append(reader.decompress(data[here : here + step]))
            here += step
        raw, end = b"".join(parts), min(here, len(data)) - len(reader.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        block = rest[: int(headers["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
            raise ValueError(f"damaged record at {at}")
        yield at, headers, block
        at = end


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def _again(pages: DataFrame, min_revisit_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of ``revisits``, and the staged tables that they are read from."""
    spark = pages.sparkSession
    narrow = stage(spark, _pages(pages).where(F.octet_length("html") >= min_revisit_bytes).select("page_id", F.sha1("html").alias("digest")).distinct(), "payloads", narrow=True)
    counted = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = stage(spark, counted, "firsts", narrow=True)
    is_hot = F.col("n") * HOT_SHARE > narrow.count()
    # fewer than HOT_SHARE payloads can have more than that share of the rows: small at any size
    hot = F.broadcast(firsts.where(is_hot).drop("n"))
    cold = narrow.join(hot.select("digest"), "digest", "left_anti").join(firsts.where(~is_hot).drop("n"), "digest")
    met = narrow.join(hot, "digest").unionByName(cold)
    return met.where("page_id is null or page_id > refers_to").select("page_id", "digest", "refers_to"), [narrow, firsts]


def revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, digest and refers_to of the payloads that occur under several ids; narrow
    rows, combined before the shuffle. A frequent payload's rows stay where they are."""
    return _again(pages, min_revisit_bytes)[0]


def write(pages: DataFrame, out: str, *, parts: int | None = None, roll_bytes: int = ROLL_BYTES, min_revisit_bytes: int = 0) -> list[tuple]:
    """Write the archives below ``out``; returns (file, records, bytes) in order."""
    spark = pages.sparkSession
    fs, path = shared_fs(out)
    fs.create_dir(path, recursive=True)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    full = _pages(pages).select("page_id", F.sha1("html").alias("digest"), F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to"))
    later, staged = _again(pages, min_revisit_bytes)
    other = later.select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "refers_to")
    dealt = full.unionByName(other).repartitionByRange(parts, "page_id", "digest").sortWithinPartitions("page_id", "digest", "kind", "url")

    def run(batches):
        fs, path = shared_fs(out)
        part, seq, size, members = TaskContext.get().partitionId(), 0, 0, []
        last, copy, target, is_revisit = None, 0, None, False

        def roll():
            nonlocal seq, size, members
            name = f"part-{part:06d}-{seq:05d}.warc.gz"
            write_whole(fs, f"{path}/{name}", members)
            row = [name, len(members), size, part, seq]
            seq, size, members = seq + 1, 0, []
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["file", "n_records", "n_bytes", "part", "seq"])

        for batch in batches:
            for page_id, digest, kind, url, html, refers_to in zip(*(c for c in batch.columns), strict=True):
                page_id, digest = page_id.as_py(), digest.as_py()
                if kind.as_py() == 0:
                    last, copy, target, is_revisit = (page_id, digest), 0, refers_to.as_py(), True
                    continue
                if last != (page_id, digest):
                    last, copy, target, is_revisit = (page_id, digest), 0, None, False
                payload = html.as_py().encode("utf-8")
                again = is_revisit or copy > 0 and len(payload) >= min_revisit_bytes
                raw = record_bytes(page_id, url.as_py(), payload, sha1_base32(payload), copy, target if is_revisit else page_id, again)
                press = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = press.compress(raw) + press.flush()
                copy += 1
                members.append(member)
                size += len(member)
                if size >= roll_bytes:
                    yield roll()
        if members:
            yield roll()

    files = sorted(dealt.mapInArrow(run, FILES).collect(), key=lambda r: (r.part, r.seq))
    unstage(*staged)
    manifest = [(r.file, r.n_records, r.n_bytes) for r in files]
    write_whole(fs, f"{path}/MANIFEST", ["".join("\t".join(map(str, r)) + "\n" for r in manifest).encode()])
    return manifest


def read(spark, out: str, manifest: list[tuple] | None = None, *, with_html: bool = True) -> DataFrame:
    """The records of the files in the manifest, digests recomputed where there is a payload."""
    if manifest is None:
        fs, path = shared_fs(out)
        with fs.open_input_file(f"{path}/MANIFEST") as f:
            manifest = [line.split("\t") for line in f.read().decode().splitlines()]
    if not manifest:
        return spark.createDataFrame([], RECORDS)

    def run(batches):
        fs, path = shared_fs(out)
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{path}/{name}") as f:
                    data = f.read()
                rows: list[tuple] = []
                for at, headers, block in records(data):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    n = int(head.rpartition(b"Content-Length: ")[2])
                    response = headers["WARC-Type"] == "response"
                    if response and (len(payload) != n or sha1_base32(payload) != digest):
                        raise ValueError(f"{name}: payload at {at} does not match its digest")
                    page, to = headers.get("WARC-Page-Id"), headers.get("WARC-Refers-To-Page-Id")
                    rows.append((int(page) if page else None, headers["WARC-Target-URI"], n, digest, headers["WARC-Type"], int(to) if to else None, payload.decode("utf-8") if response and with_html else None, name, at))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.createDataFrame([(r[0],) for r in manifest], "file string")
    n = min(len(manifest), 4 * spark.sparkContext.defaultParallelism if len(manifest) < 10_000 else len(manifest) // 8)
    return files.repartition(n).mapInArrow(run, RECORDS)


def archive(pages: DataFrame, out: str | None = None, **options) -> DataFrame:
    """Write and read back, without the html."""
    out = out or fresh_path(pages.sparkSession, "warc")
    return read(pages.sparkSession, out, write(pages, out, **options), with_html=False)
