"""Helpers that several operators of this subpackage use: the shared folder, Arrow batches cut by bytes, byte-level words."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from tarnweave.operators.durable import checkpoint_dir

#: Bytes of text that one numpy step handles; its arrays take about 60 times as much.
STEP_BYTES = 2 << 20

#: The folder of this driver's intermediate tables.
RUN = uuid.uuid4().hex
_folders: set[str] = set()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of `[^\x20\x09-\x0D]`.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`: digits, a-z and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for what is deleted when the driver ends."""
    folder = f"{checkpoint_dir(spark)}/tarnweave/{RUN}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_end, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _delete(jvm, path: str) -> None:
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


def _end(folder: str) -> None:
    with suppress(Exception):  # the driver is ending and may have lost its JVM
        _delete(SparkContext._jvm, folder)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and independent of executors. What it shuffled is deleted once the table is written."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        # Small row groups: a writer holds one in memory. A codec that stays on the heap.
        df.write.option("compression", "lz4_raw").option("parquet.block.size", 16 << 20).option("parquet.enable.dictionary", "false").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def free(*tables: DataFrame) -> None:
    """Deletes tables that saved() made and nothing will read again. What a result still reads is deleted when the driver ends."""
    for df in tables:
        _delete(df.sparkSession.sparkContext._jvm, df._saved_at)


def fresh(name: str, *taken: str) -> str:
    """A column name that none of `taken` equals, in any case."""
    while name.lower() in {x.lower() for x in taken}:
        name += "_"
    return name


def by_bytes(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `limit` bytes of text; a longer text is a slice of its own. Nulls become empty."""
    at = batch.schema.get_field_index(column)
    text = batch.column(at).cast(pa.large_binary()).fill_null(b"")
    batch = batch.set_column(at, column, text)
    ends = offsets(text)
    start, n = 0, batch.num_rows
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def offsets(array: pa.Array) -> np.ndarray:
    """Of a large_binary array: where each value begins in its buffer, and the end."""
    return np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8) if len(array) else np.zeros(1, np.int64)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of a large_binary array: all bytes in a row, and the n + 1 places where texts begin in them."""
    at = offsets(array)
    data = array.buffers()[2] if len(array) else None
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return _LOWER[raw]


def words_of(raw: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes for which `inside` holds, none across two texts: starts, ends, and for each text the index of its first word (n + 1 of them)."""
    if not raw.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(at.size, np.int64)
    held = inside[raw]
    first = np.zeros(raw.size + 1, bool)
    first[at] = True
    before = np.empty_like(held)
    before[0] = False
    before[1:] = held[:-1]
    starts = np.flatnonzero(held & (~before | first[:-1]))
    after = np.empty_like(held)
    after[-1] = False
    after[:-1] = held[1:]
    ends = np.flatnonzero(held & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def strings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The given spans as a binary array."""
    size = ends - starts
    to = np.zeros(size.size + 1, np.int64)
    np.cumsum(size, out=to[1:])
    if not to[-1]:
        return pa.array([b""] * size.size, pa.large_binary())
    take = np.repeat(starts - to[:-1], size)
    take += np.arange(to[-1])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), size.size, [None, pa.py_buffer(to), pa.py_buffer(raw[take])])


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64): every bit of the input sways every bit of the result."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between each two neighbours of at."""
    total = np.zeros(values.size + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
