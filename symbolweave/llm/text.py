"""Helpers shared by the operators on texts: columns, bounded chunks, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that one step of a Python task looks at.  Temporary arrays are a small
# multiple of it, so a worker's memory does not depend on the size of its partition.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text being empty."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def partitions(df: DataFrame) -> int:
    """How many tasks read ``df``: it follows the size of the input, and so do counts derived from it."""
    return max(1, df.rdd.getNumPartitions())


def release() -> None:
    """Give freed memory back to the system: a worker outlives its tasks and shares its executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no such call, nothing is lost
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Jobs run inside hand Python at most ``size`` bytes of rows at once; with long texts the usual bound is many times this."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    usual = spark.conf.get(setting)
    spark.conf.set(setting, size)
    try:
        yield
    finally:
        spark.conf.set(setting, usual)


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``text`` has about ``size`` bytes, or is one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index("text"))
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in one array, and where each row begins (one more at the end)."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def from_zero(column: pa.Array) -> pa.Array:
    """A string column, null being empty, whose buffers begin with its first row.

    Some Arrow kernels give wrong rows for slices whose offsets begin elsewhere.
    """
    data, offsets = text_bytes(column)
    return pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def blank_separated(column: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every row, A-Z in lower case, and where each row's words begin."""
    column = from_zero(column)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    words, ends = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    ends = ends - ends[0]
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    return words.filter(pa.array(full)), before[ends]


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words; each different word is hashed once."""
    coded = words.dictionary_encode()
    each = np.fromiter(
        map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.large_binary()).to_pylist()),
        np.uint64, len(coded.dictionary),
    )
    return each[np.asarray(coded.indices)] if len(words) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output looks random (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence out of the hash of all but its last word and that word's."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + right)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's ``size``-word shingles, and where each row's set begins.

    A row of fewer words has its whole sequence as its one shingle; a row without words has none.
    """
    words, starts = blank_separated(column)
    hashed = hash_words(words)
    counts = np.diff(starts)
    full = np.maximum(counts - size + 1, 0)
    rows = np.repeat(np.arange(len(counts)), full)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(full) - full, full)
    first = starts[rows] + within
    shingles = hashed[first] if len(rows) else np.zeros(0, np.uint64)
    for k in range(1, size):
        shingles = join_hashes(shingles, hashed[first + k])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i, row in enumerate(short):
            value = hashed[starts[row] : starts[row] + 1]
            for k in range(1, counts[row]):
                value = join_hashes(value, hashed[starts[row] + k : starts[row] + k + 1])
            whole[i] = value[0]
        rows, shingles = np.concatenate([rows, short]), np.concatenate([shingles, mix(whole)])
    order = np.lexsort((shingles, rows))
    rows, shingles = rows[order], shingles[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (shingles[1:] != shingles[:-1])
    rows, shingles = rows[new], shingles[new]
    return shingles, np.searchsorted(rows, np.arange(len(counts) + 1))
