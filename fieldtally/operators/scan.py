"""Ordered folds that never hold a series: steps compose, so chunks of a series become single maps.

A fold over an ordered series keeps a small state and changes it with every row.  Where the changes
compose into changes of the same form, a chunk of the series is one composed map of a few
numbers, whatever its length:

1. keys with more than ``LARGE`` rows are cut into ``PARTS`` chunks at sketched split points of
   their order, all other keys are one chunk;
2. chunks of large keys are reduced to their maps, and the maps of a key, in order, give the
   state at each chunk's start;
3. rows are dealt by key and chunk, read in order and folded from that state.

Tasks read rows as a stream, with one state in memory and linear time; the split points decide
how work spreads, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fieldtally.operators.ordering import match_keys, part_of, split_points
from fieldtally.session import cut_lineage

LARGE = 65_536
PARTS = 256
Numbers = tuple[float, ...]


class Fold(Protocol):
    """States and maps are tuples of numbers; ``identity`` is the map that changes nothing."""

    start: Numbers
    identity: Numbers

    def of(self, x: float | None) -> Numbers: ...

    def compose(self, first: Numbers, then: Numbers) -> Numbers: ...

    def apply(self, state: Numbers, change: Numbers) -> Numbers: ...

    def value(self, state: Numbers) -> float | None: ...

    def column(self, state: Column) -> Column: ...


@dataclass(frozen=True)
class CappedSum:
    """state = min(cap, decay * state + x), from ``initial``; a null changes nothing.

    A map is (cap, factor, addend); decay may not be negative.
    """

    cap: float
    decay: float = 1.0
    initial: float = 0.0

    @property
    def start(self) -> Numbers:
        return (self.initial,)

    @property
    def identity(self) -> Numbers:
        return float("inf"), 1.0, 0.0

    def of(self, x: float | None) -> Numbers:
        return self.identity if x is None else (self.cap, self.decay, x)

    def compose(self, first: Numbers, then: Numbers) -> Numbers:
        (c, m, a), (d, n, b) = first, then
        return min(d, n * c + b) if n else min(d, b), n * m, n * a + b

    def apply(self, state: Numbers, change: Numbers) -> Numbers:
        cap, factor, addend = change
        return (min(cap, factor * state[0] + addend),)

    def value(self, state: Numbers) -> float | None:
        return state[0]

    def column(self, state: Column) -> Column:
        return state[0]


@dataclass(frozen=True)
class DecayedMean:
    """Exponentially weighted mean without adjustment; gaps decay by position.

    At a value the past weighs decay ** (positions since the last value) and the value alpha, and
    their sum is one again; the first value is the mean.  No mean before ``min_n`` values.

    A state is (mean, weight left to the past, values seen).  A map is (rows, values, rows up to and with the first
    value, that value, factor and addend of the mean from there to the last value, rows behind it): the
    mean after the first value depends on the weight that comes in, all later steps are affine.
    """

    span: int = 7
    min_n: int = 3

    @property
    def alpha(self) -> float:
        return 2.0 / (self.span + 1.0)

    start = (0.0, 1.0, 0.0)
    identity = (0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)

    def of(self, x: float | None) -> Numbers:
        return (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0) if x is None else (1.0, 1.0, 1.0, x, 1.0, 0.0, 0.0)

    def _enter(self, mean: float, weight: float, x: float) -> float:
        return (mean * weight + x * self.alpha) / (weight + self.alpha)

    def compose(self, first: Numbers, then: Numbers) -> Numbers:
        rows, n, lead, x, factor, addend, trail = first
        rows2, n2, lead2, x2, factor2, addend2, trail2 = then
        if n2 == 0:
            return rows + rows2, n, lead, x, factor, addend, trail + rows2
        if n == 0:
            return rows + rows2, n2, rows + lead2, x2, factor2, addend2, trail2
        weight = (1.0 - self.alpha) ** (trail + lead2)
        keep, add = weight / (weight + self.alpha), x2 * self.alpha / (weight + self.alpha)
        return rows + rows2, n + n2, lead, x, factor2 * keep * factor, factor2 * (keep * addend + add) + addend2, trail2

    def apply(self, state: Numbers, change: Numbers) -> Numbers:
        mean, weight, seen = state
        rows, n, lead, x, factor, addend, trail = change
        decay = 1.0 - self.alpha
        if n == 0:
            return (mean, weight * decay**rows, seen) if seen else state
        entered = self._enter(mean, weight * decay**lead, x) if seen else x
        return factor * entered + addend, decay**trail, seen + n

    def value(self, state: Numbers) -> float | None:
        return state[0] if state[2] >= max(self.min_n, 1) else None

    def column(self, state: Column) -> Column:
        return F.when(state[2] >= max(self.min_n, 1), state[0])


def repeated(fold: Fold, change: Numbers, times: int) -> Numbers:
    """A map applied so often, by repeated squaring."""
    out = fold.identity
    while times:
        if times & 1:
            out = fold.compose(out, change)
        change = fold.compose(change, change)
        times >>= 1
    return out


def _with_chunks(df: DataFrame, key: list[str], place: str) -> tuple[DataFrame, DataFrame]:
    """``__chunk`` of each row, 0 for the keys that are not large, and the large keys."""
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > LARGE).drop("__n")
    large = cut_lineage(sizes)
    edges = match_keys(df.select(*key, place), large, key).groupBy(*key).agg(split_points(place, PARTS).alias("__edges"))
    chunk = F.when(F.col("__edges").isNull(), F.lit(0).cast("bigint")).otherwise(part_of(place, "__edges"))
    return match_keys(df, edges, key, "left").withColumn("__chunk", chunk).drop("__edges"), large


def _runs(key: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches with the group (key and chunk) of each row."""
    for batch in batches:
        names = batch.schema.names
        yield batch, list(zip(*(batch.column(names.index(c)).to_pylist() for c in [*key, "__chunk"]), strict=True))


def chunk_maps(placed: DataFrame, key: list[str], place: str, value: str, fold: Fold, times: str | None = None) -> DataFrame:
    """``key``, ``__chunk``, ``__map``: one composed map for each chunk."""
    narrow = placed.select(*key, "__chunk", place, F.col(value).cast("double").alias("__x"), *([times] if times else []))
    schema = T.StructType(
        [f for f in narrow.schema.fields if f.name in key or f.name == "__chunk"] + [T.StructField("__map", T.ArrayType(T.DoubleType()))]
    )

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(groups: list, maps: list) -> pa.RecordBatch:
            columns = [pa.array([g[k] for g in groups], kind) for k, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(maps, pa.list_(pa.float64()))], [*key, "__chunk", "__map"])

        current, change, kinds = None, fold.identity, None
        for batch, groups in _runs(key, batches):
            names = batch.schema.names
            kinds = [batch.column(names.index(c)).type for c in [*key, "__chunk"]]
            often = batch.column(names.index(times)).to_pylist() if times else [1] * batch.num_rows
            done, maps = [], []
            for group, x, n in zip(groups, batch.column(names.index("__x")).to_pylist(), often, strict=True):
                if group != current:
                    if current is not None:
                        done.append(current)
                        maps.append(change)
                    current, change = group, fold.identity
                one = fold.of(x)
                change = fold.compose(change, one if n == 1 else repeated(fold, one, n))
            if done:
                yield table(done, maps)
        if current is not None:
            yield table([current], [change])

    return narrow.repartition(*key, "__chunk").sortWithinPartitions(*key, "__chunk", place).mapInArrow(step, schema)


def _entering(maps: DataFrame, key: list[str], fold: Fold) -> DataFrame:
    """``key``, ``__chunk``, ``__state``: state at each chunk's start; a key has at most ``PARTS`` chunks."""
    schema = T.StructType(
        [f for f in maps.schema.fields if f.name != "__map"]
        + [T.StructField("__state", T.ArrayType(T.DoubleType())), T.StructField("__after", T.ArrayType(T.DoubleType()))]
    )

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, fold.start
        for batch, groups in _runs(key, batches):
            before, after = [], []
            for group, change in zip(groups, batch.column(batch.schema.names.index("__map")).to_pylist(), strict=True):
                if group[:-1] != current:
                    current, state = group[:-1], fold.start
                before.append(state)
                state = fold.apply(state, tuple(change))
                after.append(state)
            kept = [batch.column(batch.schema.names.index(c)) for c in [*key, "__chunk"]]
            lists = [pa.array(v, pa.list_(pa.float64())) for v in (before, after)]
            yield pa.RecordBatch.from_arrays([*kept, *lists], [*key, "__chunk", "__state", "__after"])

    return maps.repartition(*key).sortWithinPartitions(*key, "__chunk").mapInArrow(step, schema)


def _numeric(df: DataFrame, order: str) -> Column:
    kind = df.schema[order].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(order)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(order).cast("timestamp"))
    return F.col(order).cast("double")


def running_fold(df: DataFrame, key: list[str], order: str, value: str, name: str, fold: Fold) -> DataFrame:
    """``df`` with the fold's value after each row along ``order`` (distinct within a key; NULLs first)."""
    kept = df.columns
    placed, large = _with_chunks(df.withColumn("__place", _numeric(df, order)), key, "__place")
    states = _entering(chunk_maps(match_keys(placed, large, key, "left_semi"), key, "__place", value, fold), key, fold)
    ready = match_keys(placed, states.drop("__after"), [*key, "__chunk"], "left").withColumn("__x", F.col(value).cast("double"))
    dealt = ready.repartition(*key, "__chunk").sortWithinPartitions(*key, "__chunk", "__place")
    schema = T.StructType([*dealt.schema.fields, T.StructField(name, T.DoubleType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, fold.start
        for batch, groups in _runs(key, batches):
            names, found = batch.schema.names, []
            begin = batch.column(names.index("__state")).to_pylist()
            for group, x, first in zip(groups, batch.column(names.index("__x")).to_pylist(), begin, strict=True):
                if group != current:
                    current, state = group, fold.start if first is None else tuple(first)
                state = fold.apply(state, fold.of(x))
                found.append(fold.value(state))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*names, name])

    return dealt.mapInArrow(step, schema).select(*kept, name)


def final_fold(df: DataFrame, key: list[str], order: str, value: str, name: str, fold: Fold, times: str | None = None) -> DataFrame:
    """``key`` and the fold's value after all rows; a row counts ``times`` times, which costs no more than once."""
    placed, _ = _with_chunks(df.withColumn("__place", _numeric(df, order)), key, "__place")
    states = _entering(chunk_maps(placed, key, "__place", value, fold, times), key, fold)
    last = states.groupBy(*key).agg(F.max_by("__after", "__chunk").alias("__after"))
    return last.select(*key, fold.column(F.col("__after")).alias(name))
