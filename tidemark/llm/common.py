"""Shared pieces: table access, size-checked broadcast joins, and words of Arrow text batches as arrays."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir

#: White space throughout: space and the five control characters from tab to carriage return.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
SPACE_CHARACTERS = " \t\n\x0b\x0c\r"

#: Bytes of text handled at once by array code, so that its temporaries stay in the processor's caches.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


#: Rows that travel to a Python worker at once; texts are long, so fewer than Spark's own 10,000.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows, so that a batch of long texts fits in a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def give_back() -> None:
    """Return this worker's freed memory to the system: Spark keeps workers for later stages, which need it."""
    _POWERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def giving_back(run):
    """``run``, over batches of a partition, that gives its memory back at the end."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (they are counted), else as it is.

    ``df`` should be cheap to count: a checkpoint or a table.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd ``base`` modulo 2^64 and of its inverse."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, CHUNK_BYTES + 64)

        def run(value):
            out = np.full(size, np.uint64(value))
            out[0] = 1
            return np.multiply.accumulate(out)

        held = run(base), run(pow(base, -1, 1 << 64))
        if size <= 4 * CHUNK_BYTES:
            _POWERS[base] = held
    return held


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the n + 1 offsets of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with about ``size`` bytes each; a longer row is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of each row's first word (n + 1 numbers)."""
    inside = ~_SPACE[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    power, inverse = powers(_BASE, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def run_hashes(items: np.ndarray, length: int, base: int) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` items; entry i is the run that starts at i."""
    n = len(items) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = powers(base, len(items) + 1)
    total = np.zeros(len(items) + 1, np.uint64)
    np.cumsum(items * power[: len(items)], out=total[1:])
    return mix((total[length:] - total[:n]) * inverse[:n])


def batch(columns: dict[str, object], types: Sequence[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[name], pa.Array) else pa.array(c, kind) for name, kind in types], names=[name for name, _ in types])


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again: compressed, and safe when executors go."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4()}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
