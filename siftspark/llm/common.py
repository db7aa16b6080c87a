"""What the operators share: the shared folder, stored tables and hashed words.

Words are runs of bytes other than 9-13 and 32, so UTF-8 text never needs decoding.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.tables import shared_dir

SEGMENT = 1 << 20
BATCH_BYTES = 4 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []
_STORED: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def store(df: DataFrame, label: str, clean: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lost executors lose nothing.

    With clean, the shuffle files behind the table are deleted with the end of its job, as nothing reads them again: worth it where they are large.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if clean:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if clean:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _STORED.append(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stored tables that no later step reads; without tables, all that this process has stored."""
    paths = [t.stored_at for t in tables] if tables else list(_STORED)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
        _STORED.remove(path)


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow in batches of about BATCH_BYTES (a longer row is a batch of its own), where the session sets no other bound.

    Spark's own bound counts rows, so a batch of long texts would be held whole by the executor and by its worker, on the way in and out.
    The setting is read as a job starts, so it stays in the session.
    """
    if df.sparkSession.conf.get(_BATCH, None) is None:
        df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        both = []
        for base in (_BASE, _INVERSE):
            p = np.full(max(n, 1024), base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        if n > 4 * SEGMENT:
            return both[0], both[1]
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty run."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def segments(data: np.ndarray, at: np.ndarray, size: int = SEGMENT) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive texts of about `size` bytes together: (first, end, bytes, offsets). No text is cut."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): of all words, and per text the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    space = SPACE[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    before[at[at < len(data)]] = True
    after[at[at > 0] - 1] = True
    word = ~space
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, then mixed. Equal words have equal hashes everywhere."""
    out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        power, inverse = _powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * inverse[s]
        i = j
    return mix64(out)


def hashed(column: pa.Array, lower: bool = True, size: int = SEGMENT) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per segment of texts: (first text, end, word hashes, per text its first word)."""
    data, at = utf8(column)
    for lo, hi, part, off in segments(data, at, size):
        if lower:
            part = LOWER[part]
        starts, ends, first = spans(part, off)
        yield lo, hi, word_hashes(part, starts, ends), first
