"""Blocks of rows, and questions that blocks put to shards of a key space.

Corpus-wide lookups per word or window would ship one row per word.  Here rows are
packed into blocks of a few megabytes, kept once as a table in the shared folder.
A block asks every shard about its distinct keys in one compact array; a shard sees
the arrays of all blocks, decides, and answers in the order asked.  A key that
occurs in a third of all rows costs one entry per block, a block or a shard has a
bounded size, and a lost executor costs the tasks it ran, nothing more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.plans.session import materialize

BLOCK_BYTES = 4 << 20
SHARD_BYTES = 12 << 20
MAX_ROWS = 1 << 20
BATCH_BYTES = 4 << 20  # of the rows that Python gets at once; wide rows would else come by the thousands
ROW_GROUP = 8 << 20  # bytes of blocks that a task reads at once
BLOCK_SCHEMA = "block long, n int, rows binary"


def pack(df: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows of ``df`` as compressed blocks of about ``block_bytes`` of text; a longer text is a block of its own.

    Block ids are fixed by writing the table; the key of a row is ``block * 2**20 + position``.
    """
    def flush(block: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table.combine_chunks())
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([table.num_rows], pa.int32()),
             pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "n", "rows"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq, parts, held, rows = TaskContext.get().partitionId() << 20, 0, [], 0, 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
            start = 0
            for i, size in enumerate(sizes):
                if rows and (held + size > block_bytes or rows >= MAX_ROWS):
                    if i > start:
                        parts.append(batch.slice(start, i - start))
                    yield flush(base + seq, parts)
                    seq, parts, held, rows, start = seq + 1, [], 0, 0, i
                held, rows = held + size, rows + 1
            if start < len(sizes):
                parts.append(batch.slice(start))
        if parts:
            yield flush(base + seq, parts)

    # Rows of megabytes, compressed already: sizes are looked at after each, not after the usual hundred.
    options = {"compression": "none", "parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": 1,
               "parquet.block.size.row.check.min": 1}
    return materialize(df.mapInArrow(cut, BLOCK_SCHEMA), "blocks", batch_bytes=BATCH_BYTES, **options)


def unpack(value) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(value.as_py() if hasattr(value, "as_py") else value)).read_all()


def each_block(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    for batch in batches:
        for block, rows in zip(batch.column("block"), batch.column("rows")):
            yield block.as_py(), unpack(rows)
            pa.default_memory_pool().release_unused()  # workers live on; blocks need not add up


def shard_count(blocks: DataFrame, bytes_per_block: int) -> int:
    """Shards of about SHARD_BYTES for entries that take so many bytes a block."""
    return max(1, -(-blocks.count() * bytes_per_block // SHARD_BYTES))


def to_bytes(*columns: np.ndarray) -> bytes:
    """Columns of one length, one after the other."""
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def from_bytes(raw: bytes, *dtypes) -> list[np.ndarray]:
    n = len(raw) // sum(np.dtype(d).itemsize for d in dtypes)
    out, at = [], 0
    for d in dtypes:
        out.append(np.frombuffer(raw, d, n, at))
        at += n * np.dtype(d).itemsize
    return out


def by_shard(shards: int, keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Split equally long columns by ``keys % shards``; the order of entries is kept."""
    shard = keys % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    counts = np.bincount(shard.astype(np.int64), minlength=0)
    ends = np.cumsum(counts)
    for s in np.flatnonzero(counts).tolist():
        part = order[ends[s] - counts[s]:ends[s]]
        yield s, [c[part] for c in columns]


def restore(shards: int, keys: np.ndarray, answers: dict[int, np.ndarray], dtype) -> np.ndarray:
    """Answers of all shards in the order of ``keys`` (the inverse of `by_shard`)."""
    shard = keys % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    parts = [answers[s] for s in np.unique(shard).tolist()]
    out = np.zeros(len(keys), dtype)
    if parts:
        out[order] = np.concatenate(parts)
    return out


def ask(blocks: DataFrame, question: Callable[[int, pa.Table], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """``question(block, rows)`` gives (shard, entries) for every block."""
    def run(batches):
        for block, table in each_block(batches):
            asked = list(question(block, table))
            yield _entries([s for s, _ in asked], [block] * len(asked), [e for _, e in asked])

    return blocks.mapInArrow(run, "shard int, block long, entries binary")


def _entries(shard, block, entries) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(block, pa.int64()),
                                       pa.array(entries, pa.binary())], names=["shard", "block", "entries"])


def answer(asked: DataFrame, decide: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """``decide`` gets the entries of all blocks at one shard and answers each block in its order."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        return pa.Table.from_batches([_entries(table["shard"].to_pylist(), table["block"].to_pylist(),
                                               decide(table["entries"].to_pylist()))])

    return asked.groupBy("shard").applyInArrow(run, "shard int, block long, entries binary")


def tell(blocks: DataFrame, answers: DataFrame, use: Callable[[int, pa.Table, list[dict]], pa.Table],
         schema: str) -> DataFrame:
    """Bring answers back: ``use(block, rows, answers)`` runs once per block, with none as an empty list."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        told = right.drop_columns(["block"]).to_pylist()
        outs = [use(block, rows, told) for block, rows in each_block(left.to_batches())]
        return pa.concat_tables(outs) if outs else use(-1, None, [])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def count_entries(df: DataFrame) -> int:
    return df.agg(F.count("*")).first()[0]
