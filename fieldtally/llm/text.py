"""Vectorised text helpers for Arrow batches: words, shingles and exact-content hashes.

A batch of texts is one UTF-8 byte buffer with row offsets.  All work is numpy over slices
of the buffer of bounded size; a text longer than a slice gets a slice of its own, so memory
follows the longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession

SLICE_BYTES = 1 << 21
_U64 = np.uint64


def _odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=_U64) | _U64(1)


_BYTE_VALUES = _odd_constants(256, 11)
_STEP = _odd_constants(1, 13)[0]
_STEP_BACK = _U64(pow(int(_STEP), -1, 2**64))
WINDOW_VALUES = _odd_constants(64, 17)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers = [np.ones(1, _U64), np.ones(1, _U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        for k, step in enumerate((_STEP, _STEP_BACK)):
            table = np.full(n, step, _U64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


class Hasher:
    """Hashes of any byte ranges of one buffer in constant time each."""

    def __init__(self, data: np.ndarray):
        forward, self.back = _power_tables(len(data) + 1)
        self.sums = np.empty(len(data) + 1, _U64)
        self.sums[0] = 0
        np.cumsum(_BYTE_VALUES[data] * forward[: len(data)], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes [start, end) for each pair."""
        value = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(value + (ends - starts).astype(_U64) * _U64(0x9E3779B97F4A7C15))

    def windows(self, width: int) -> np.ndarray:
        """Hash of every window of the width, by start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.empty(0, _U64)
        value = (self.sums[width:] - self.sums[:n]) * self.back[:n]
        return mix(value + _U64(width * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most the limit in bytes, or of one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end
        row = end


class Words:
    """Words (runs of bytes other than space and 0x09-0x0D) of some rows of a buffer.

    ``starts`` and ``ends`` are byte positions in ``data``; ``row`` is each word's row and
    ``first`` the index of each row's first word, with one more entry for the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~IS_SPACE[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        finish = inside.copy()
        finish[:-1] &= ~inside[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        begin[edge] |= inside[edge]
        finish[edge - 1] |= inside[edge - 1]
        self.inside = inside
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def runs(self, values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``width`` consecutive words within a row, and its first word."""
        n = len(values) - width + 1
        if n <= 0:
            return np.empty(0, _U64), np.empty(0, np.int64)
        total = values[:n] * WINDOW_VALUES[0]
        for k in range(1, width):
            total = total + values[k : n + k] * WINDOW_VALUES[k]
        at = np.flatnonzero(self.row[:n] == self.row[width - 1 :])
        return mix(total[at]), at


def count_by_part(batches: Iterator[pa.RecordBatch], cells: int, kind: str) -> Iterator[tuple[int, np.ndarray]]:
    """Occurrences of each cell of each part, from rows (part, cell numbers) sorted by part."""
    current, count = None, np.empty(0, np.int64)
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if part != current:
                if current is not None:
                    yield current, count
                current, count = part, np.zeros(cells, np.int64)
            at, times = np.unique(np.frombuffer(blob.as_buffer(), kind), return_counts=True)
            count[at] += times
    if current is not None:
        yield current, count


def bounded_rows(df: DataFrame) -> Iterator[Row]:
    """Rows of a small table of known bound for the driver: made in parallel, read from one partition."""
    return df.repartition(1).toLocalIterator()


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the bytes of an Arrow batch, so that long texts do not add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def map_arrow(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with bounded batches."""
    prepare(df.sparkSession)
    return df.mapInArrow(step, schema)
