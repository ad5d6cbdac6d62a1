"""Shared pieces of the training-data operators.

Files that several machines must see (staged tables, written archives) go to
the folder of ``spark.checkpoint.dir``; only where that is unset in local mode, as
in tests, a folder of our own is made and registered.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space of the word contracts, as a class for Java and Python patterns.
WHITE = r"\x20\x09-\x0D"

#: Lower-cases A-Z, keeps a-z, 0-9 and all bytes of non-ASCII characters, makes the rest a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Lower-cases A-Z and nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-"))
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/brindle-{uuid.uuid4().hex[:12]}/{name}"


def stage(spark: SparkSession, df: DataFrame, name: str, *, narrow: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage
    and survives lost executors. The schema is given, so an empty table works.

    A ``narrow`` table (a few numbers a row, cheap to make) has no more files than twice
    the cluster's cores, however many partitions the shuffle before it has."""
    path = fresh_path(spark, name)
    (df.coalesce(2 * spark.sparkContext.defaultParallelism) if narrow else df).write.parquet(path)
    return _read(spark, df.schema, path)


#: Types that Arrow's Parquet writer and Spark's hold alike.
_PLAIN = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.BinaryType, T.DateType)
#: Bytes of batches that are written as one row group.
_GROUP_BYTES = 8 << 20


def _plain(kind: T.DataType) -> bool:
    return all(_plain(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else type(kind) in _PLAIN


def stage_apart(spark: SparkSession, df: DataFrame, name: str, *, narrow: bool = False, each: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """``stage``, with files that Python workers write, after ``each`` (whose result has ``schema``) on every batch.

    Hadoop's local file system forks the JVM for each file and folder that it makes, to run
    chmod; until the child does so it shows all memory of its executor (or driver) once more.
    Tables of other types than ``_PLAIN``, and shared folders that aren't local, go Spark's way."""
    path, schema = fresh_path(spark, name), schema or df.schema
    if not _plain(schema) or "://" in path and not path.startswith("file:"):
        return stage(spark, df.mapInArrow(per_batch(lambda: each), schema) if each else df, name, narrow=narrow)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        fs, folder = shared_fs(path)
        at = TaskContext.get()
        temporary, writer, held, size = f"{folder}/_{at.partitionId()}-{uuid.uuid4().hex}", None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(each(batch) if each else batch)
            size += held[-1].nbytes
            if size >= _GROUP_BYTES:
                writer = writer or pq.ParquetWriter(temporary, held[0].schema, filesystem=fs)
                writer.write_table(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            writer = writer or pq.ParquetWriter(temporary, held[0].schema, filesystem=fs)
            writer.write_table(pa.Table.from_batches(held))
        if writer:  # whole files only; a repeated task replaces its file
            writer.close()
            fs.move(temporary, f"{folder}/part-{at.partitionId():05d}.parquet")
        held, writer, batch = [], None, None
        give_back()
        yield pa.RecordBatch.from_pydict({"done": [True]})

    fs, folder = shared_fs(path)
    fs.create_dir(folder)
    (df.coalesce(2 * spark.sparkContext.defaultParallelism) if narrow else df).mapInArrow(write, "done boolean").collect()
    return _read(spark, schema, path)


def _read(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    out = spark.read.schema(schema).parquet(path)
    out.brindle_path = path
    _staged.append(path)
    return out


#: Staged tables of this driver that may still be read.
_staged: list[str] = []


def delete(spark: SparkSession, path: str) -> None:
    """Delete what is at a path of the shared folder, and the folder of its own that ``fresh_path`` gave it."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
    top = jvm.org.apache.hadoop.fs.Path(path).getParent()
    top.getFileSystem(sc.hadoopConfiguration()).delete(top, True)


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for t in tables:
        path = t.brindle_path
        if path in _staged:
            _staged.remove(path)
            delete(t.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Delete all staged tables: for a driver that has written every result it wants from them."""
    while _staged:
        delete(spark, _staged.pop())


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    out = f"brindle_{name}"
    while out in taken:
        out += "_"
    return out


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of queries whose results are staged: its
    cleaner waits for the driver's garbage collection, which a quiet driver seldom runs."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def shared_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or an absolute local path, usable on any worker."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:") and not uri.startswith("file:///"):
            uri = "file://" + uri[len("file:") :]
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def write_whole(fs: pafs.FileSystem, path: str, chunks: list[bytes]) -> None:
    """Write under a name of this attempt, then rename: readers see whole files
    only, and a repeated task replaces a file by an equal one."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary) as out:
        for chunk in chunks:
            out.write(chunk)
    fs.move(temporary, path)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def give_back() -> None:
    """Return freed memory to the machine: workers are used again, and what a task freed would stay with them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


_kept: dict[str, object] = {}


def keep(key: str, build: Callable[[], object]) -> object:
    """What a worker keeps from task to task (an automaton, an encoder): one at a time, as workers serve one operator after another."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def let_go() -> None:
    """A function of the module, so that it is the worker's own memory that is cleared, not a copy sent with a task."""
    _kept.clear()


def per_batch(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], *, keeps: bool = False) -> Callable:
    """A mapInArrow function; ``make`` runs once a task and returns what maps a batch. Unless it uses ``keep``, what the worker kept goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            let_go()
        one, batch = make(), None
        for batch in batches:
            if batch.num_rows:
                yield one(batch)
        del batch
        give_back()

    return run


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True for the rows whose crc32(id as text) mod folds is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % F.lit(folds) == 0, F.lit(False))
