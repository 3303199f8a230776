"""What the operators share: the shared folder, cutting lineage, and words of Arrow batches as hashes."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.session import scratch_path, small_batches

U64 = np.uint64
#: White space of every contract here: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Odd multiplier of the rolling hash over bytes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are hashed at a time (a longer single document is hashed alone).
CHUNK_BYTES = 1 << 19


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as a table in the shared folder and read it again.

    Cuts the lineage: lost executors don't bring back what stands before, and each reader takes only its columns.
    """
    path = scratch_path(small_batches(df.sparkSession), name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a settled table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (splitmix64)."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def chunks(column: pa.Array, most: int = CHUNK_BYTES):
    """(first row, offsets, bytes) of runs of rows of about `most` bytes; a longer row comes alone, whole."""
    offsets, data = text_bytes(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        i = j


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = []
        for base in (BASE, BASE_INVERSE):
            x = np.full(size, base, U64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=U64))
        if size > 16 * CHUNK_BYTES:  # a very long document: not kept
            return out[0], out[1]
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def words(offsets: np.ndarray, data: np.ndarray, lower: bool = False, between: np.ndarray = SPACE, prefixes: tuple = ()):
    """Start, end, row and 64-bit hash of every word of rows laid end to end.

    A word is a run of bytes that `between` doesn't mark: [^\\x20\\x09-\\x0D]+ unless told otherwise. With prefixes (lengths in bytes)
    only row and hash come back, of the words and of the prefixes of longer ones, which never equal a word's hash.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return (none, np.zeros(0, U64)) if prefixes else (none, none, none, np.zeros(0, U64))
    inside = ~between[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # rows begin here, so words end before
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    up, down = _powers(len(data) + 1)
    seen = LOWER[data] if lower else data
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((seen.astype(U64) + U64(1)) * up[: len(data)], out=total[1:], dtype=U64)
    h = mix((total[end] - total[start]) * down[start] ^ (end - start).astype(U64))
    if not prefixes:
        return start, end, row, h
    rows, hashes = [row], [h]
    for k in prefixes:
        at = np.flatnonzero(end - start > k)
        rows.append(row[at])
        hashes.append(mix((total[start[at] + k] - total[start[at]]) * down[start[at]] ^ U64(k << 32)))
    return np.concatenate(rows), np.concatenate(hashes)


def windows(row: np.ndarray, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every window of `width` words within a row."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(row[width - 1 :] == row[:n])
    out = np.zeros(len(at), U64)
    for k in range(width):
        out = (out + h[at + k]) * U64(0x9FB21C651E98DF25 + 2 * k)
        out ^= out >> U64(29)
    return at, mix(out)


def word_hash(word: str, lower: bool = True) -> int:
    """The hash that words() gives a word."""
    b = np.frombuffer(word.encode(), np.uint8)
    return int(words(np.array([0, len(b)]), b, lower, np.zeros(256, bool))[3][0])


def tidy() -> None:
    """Give freed memory back to the system: Python workers stay alive between tasks and would hold on to it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


def rows_of(batches, size: int):
    """Cut Arrow batches to at most `size` rows."""
    for b in batches:
        for i in range(0, b.num_rows, size):
            yield b.slice(i, size)
