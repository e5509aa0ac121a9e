"""Steps that several operators share: tables written to the shared folder and hash tables of fixed size."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from concord.sources.tables import fresh_path

#: Parts a hash table is cut into while it is summed.
PIECES = 64
#: Tables of one piece are first summed in so many heaps, so that no task meets the tables of all others.
HEAPS = 32


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of a number array, byte planes apart: sorted and small numbers shrink well."""
    flat = np.ascontiguousarray(values)
    planes = flat.view(np.uint8).reshape(len(flat), flat.dtype.itemsize).T if len(flat) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(body: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1)


def give_back() -> None:
    """Hand freed memory back to the system: Python workers live on between tasks and keep what they once needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries do without
        ctypes.CDLL(None).malloc_trim(0)


def shards(spark: SparkSession) -> int:
    """Shards into which keys are dealt: some for each shuffle partition, so that a task's shards even out."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later steps read it instead of computing it again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def summed(tables: DataFrame, size: int) -> np.ndarray:
    """Sum of hash tables, given as rows of :func:`table_rows`. Only ``size`` numbers reach the driver."""
    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(size // PIECES, np.uint64)
        for body in group.column("body"):
            total += unpack(body.as_py(), np.uint64)
        return pa.table({
            "piece": pa.array([group.column("piece")[0].as_py()], pa.int32()), "heap": pa.array([0], pa.int32()),
            "body": pa.array([pack(total)], pa.binary()),
        })

    kind = "piece int, heap int, body binary"
    halves = tables.groupBy("piece", "heap").applyInArrow(add, kind)
    whole = np.zeros(size, np.uint64)
    step = size // PIECES
    for row in halves.groupBy("piece").applyInArrow(add, kind).collect():
        whole[row.piece * step : (row.piece + 1) * step] = unpack(bytes(row.body), np.uint64)
    return whole


def table_rows(table: np.ndarray, heap: int) -> pa.RecordBatch:
    """Rows (piece, heap, body) of one task's hash table."""
    cut = table.astype(np.uint64).reshape(PIECES, -1)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(range(PIECES), pa.int32()), pa.array([heap % HEAPS] * PIECES, pa.int32()),
            pa.array([pack(x) for x in cut], pa.binary()),
        ],
        names=["piece", "heap", "body"],
    )


def hash_counts(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], size: int) -> np.ndarray:
    """How often each slot of a table of ``size`` is hit by the hashes of all rows of ``df``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = np.zeros(size, np.int64)
        for batch in batches:
            for some in hashes(batch):
                table += np.bincount(some & np.uint64(size - 1), minlength=size)
        yield table_rows(table, TaskContext.get().partitionId())
        give_back()

    return summed(df.mapInArrow(count, "piece int, heap int, body binary"), size)


def presence(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit table of ``bits`` bits (a power of two) with the bit of every 64-bit value of the one column set.

    Its size is fixed, so it may be sent to all executors; with too many values it lets more rows pass that have to be
    sorted out later, never fewer.
    """
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(bits - 1)
            np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield table_rows(table.view(np.uint64), TaskContext.get().partitionId())

    kind = "piece int, heap int, body binary"
    whole = np.zeros(bits // 64, np.uint64)
    step = len(whole) // PIECES

    def join(group: pa.Table) -> pa.Table:
        total = np.zeros(step, np.uint64)
        for body in group.column("body"):
            total |= unpack(body.as_py(), np.uint64)
        return pa.table({
            "piece": pa.array([group.column("piece")[0].as_py()], pa.int32()), "heap": pa.array([0], pa.int32()),
            "body": pa.array([pack(total)], pa.binary()),
        })

    halves = hashes.mapInArrow(fill, kind).groupBy("piece", "heap").applyInArrow(join, kind)
    for row in halves.groupBy("piece").applyInArrow(join, kind).collect():
        whole[row.piece * step : (row.piece + 1) * step] = unpack(bytes(row.body), np.uint64)
    return whole.view(np.uint8)


def present(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set in a table of :func:`presence`."""
    at = hashes & np.uint64(len(table) * 8 - 1)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
