"""Sketches of 64-bit keys: tables of cells of a fixed size, built in parts by tasks.

Every key has two cells; a key occurs at least twice only if both its cells were counted twice.
The sketch never misses such a key, and lets some others pass: a filter before exact work, of a
size that does not grow with the corpus (at most two bitmaps of ``2 ** CELL_BITS`` bits).  A
``Filter`` has one cell a key and remembers which keys there are.

Tables of cells never pass the driver: the tasks that sum a part's cells store it in the shared
folder, and tasks that ask the table read it from there, once a worker.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.text import count_by_part, map_arrow, mix
from fieldtally.session import scratch_path

CELL_BITS = 28
CELL_PARTS = 256
CELLS = "part int, cells binary"


def bits_for(keys: float) -> int:
    """About eight cells a key, within the fixed size."""
    return int(np.clip(np.ceil(np.log2(max(keys, 1.0))) + 3, 16, CELL_BITS))


def _cells(value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits)
    return (mix(value) >> shift).astype(np.int64), (mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> shift).astype(np.int64)


def bit(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def cell_rows(value: np.ndarray, bits: int) -> pa.RecordBatch:
    """The cells of some keys as rows (part, cell numbers inside the part)."""
    return _part_rows(np.sort(np.concatenate(_cells(value, bits))), bits)


def _part_rows(cells: np.ndarray, bits: int) -> pa.RecordBatch:
    per_part = (1 << bits) // CELL_PARTS
    cut = np.searchsorted(cells, np.arange(CELL_PARTS + 1) * per_part)
    own = [p for p in range(CELL_PARTS) if cut[p + 1] > cut[p]]
    blobs = [(cells[cut[p] : cut[p + 1]] - p * per_part).astype("<u4").tobytes() for p in own]
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(blobs, pa.binary())], ["part", "cells"])


def store_parts(rows: DataFrame, label: str) -> str:
    """Writes rows (part, columns of bytes) to the shared folder; returns their folder there."""
    folder = scratch_path(rows.sparkSession, label)
    rows.write.parquet(folder)
    return folder


@functools.lru_cache(maxsize=3)
def load_parts(folder: str, column: str, size: int, parts: int) -> np.ndarray:
    """A stored column, its parts one after another in ``size`` bytes, zero where nothing is stored; kept by the worker."""
    filesystem, root = pafs.FileSystem.from_uri(folder)
    whole, step = np.zeros(size, np.uint8), size // parts
    for found in filesystem.get_file_info(pafs.FileSelector(root)):
        if not found.base_name.endswith(".parquet"):
            continue
        with filesystem.open_input_file(found.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(8, columns=["part", column]):
                for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if blob.as_py():
                        whole[part * step : (part + 1) * step] = np.frombuffer(blob.as_buffer(), np.uint8)
    return whole


@dataclass(frozen=True)
class Sketch:
    """Bitmaps over cells: counted at least twice, and counted more often than a limit."""

    folder: str
    bits: int
    some_hot: bool

    def _set(self, column: str, value: np.ndarray) -> np.ndarray:
        cells = load_parts(self.folder, column, (1 << self.bits) // 8, CELL_PARTS)
        one, two = _cells(value, self.bits)
        return bit(cells, one) & bit(cells, two)

    def again(self, value: np.ndarray) -> np.ndarray:
        return self._set("twice", value)

    def very_often(self, value: np.ndarray) -> np.ndarray:
        return self._set("hot", value) if self.some_hot else np.zeros(len(value), bool)


def _some(flags: np.ndarray) -> bytes:
    """The flags as bits; nothing where none is set."""
    return np.packbits(flags).tobytes() if flags.any() else b""


def _stored_bits(rows: DataFrame, bits: int, least: int, hot: int | None = None) -> str:
    per_part = (1 << bits) // CELL_PARTS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, count in count_by_part(batches, per_part, "<u4"):
            maps = [_some(count >= least), b"" if hot is None else _some(count > hot)]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([m], pa.binary()) for m in maps)], ["part", "twice", "hot"])

    sent = rows.repartition("part").sortWithinPartitions("part")
    return store_parts(map_arrow(sent, add, "part int, twice binary, hot binary"), "sketch")


def gather(rows: DataFrame, bits: int, hot: int | None = None) -> Sketch:
    """Sums the rows of ``cell_rows`` from all tasks; the second bitmap is made only for a limit."""
    folder = _stored_bits(rows, bits, 2, hot)
    hottest = rows.sparkSession.read.schema("part int, hot binary").parquet(folder).where(F.length("hot") > 0)
    return Sketch(folder, bits, hot is not None and not hottest.isEmpty())


@dataclass(frozen=True)
class Filter:
    """Which keys there are: one cell a key, so some others pass."""

    folder: str
    bits: int

    def has(self, value: np.ndarray) -> np.ndarray:
        cells = load_parts(self.folder, "twice", (1 << self.bits) // 8, CELL_PARTS)
        return bit(cells, _place(value, self.bits))


def _place(value: np.ndarray, bits: int) -> np.ndarray:
    return (mix(value.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def key_filter(keys: DataFrame, bits: int) -> Filter:
    """A filter with all keys of a table's only column (long)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _part_rows(np.unique(_place(batch.column(0).to_numpy(), bits)), bits)

    return Filter(_stored_bits(map_arrow(keys, step, CELLS), bits, 1), bits)
