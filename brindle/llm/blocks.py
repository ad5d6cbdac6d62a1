"""Texts laid down once in files of some megabytes, which later steps read where they need them.

The first pass over a table writes its rows, as they come, to block files in the shared folder: Arrow, compressed,
under a temporary name that is renamed. A row is then addressed by its block and its number there, whatever its
doc_id, and only addresses and findings are shuffled, never a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import as_bytes, shared_fs, write_whole

#: Bytes of text that close a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
_SEQ_BITS = 24
_OPTIONS = pa.ipc.IpcWriteOptions(compression="zstd")


def block_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _path(folder: str, block: int) -> str:
    return f"{folder}/block-{block >> _SEQ_BITS:07d}-{block & (1 << _SEQ_BITS) - 1:06d}.arrow"


def lay(batches: Iterator[pa.RecordBatch], out: str, block_bytes: int) -> Iterator[tuple[int, list[bytes]]]:
    """Write the blocks of a task's rows (doc_id, text); yields each block's number and texts. A repeated task writes the same."""
    fs, folder = shared_fs(out)
    part, seq = TaskContext.get().partitionId(), 0
    ids: list[int | None] = []
    texts: list[bytes] = []
    size = 0

    def close() -> tuple[int, list[bytes]]:
        nonlocal seq, ids, texts, size
        block = part << _SEQ_BITS | seq
        table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_binary())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, table.schema, options=_OPTIONS) as f:
            f.write_table(table)
        write_whole(fs, _path(folder, block), [sink.getvalue()])
        done, seq, ids, texts, size = (block, texts), seq + 1, [], [], 0
        return done

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            if texts and size + len(text) > block_bytes:
                yield close()
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
    if texts:
        yield close()


def load(out: str, block: int) -> tuple[list[int | None], list[bytes]]:
    """doc_ids and texts of a block."""
    fs, folder = shared_fs(out)
    with fs.open_input_file(_path(folder, block)) as f:
        table = pa.ipc.open_file(f).read_all()
    return table.column(0).to_pylist(), table.column(1).to_pylist()


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each value of the first column, by which the batches are sorted."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = batch.column(0).to_numpy()
        a = 0
        while a < len(keys):
            if now is not None and keys[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(keys[a])
            b = a + int((keys[a:] == now).sum())
            held.append(batch.slice(a, b - a))
            a = b
    if held:
        yield now, pa.Table.from_batches(held)
