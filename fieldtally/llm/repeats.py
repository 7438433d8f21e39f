"""Removal of repeated 100-byte strings: blockwise suffix sorting with a difference cover.

Every 100-byte window of a text has an anchor, its 32-byte gram of least hash (the first of
equals).  Equal windows have equal anchors at equal places, so only windows whose anchor occurs
again need sorting, and only among the occurrences of one anchor.

1. A sketch of anchor occurrences (two bits a cell, fixed size) drops anchors that occur once.
2. The others go, with the bytes that their windows cover, to the task of their anchor.
3. A task lays contexts out in a matrix aligned at the anchor; a column is one suffix bucket.
   Ranks of 16, 32 and 64 bytes are computed beforehand for the sample columns of a difference
   cover.  Then one bucket at a time is sorted: by the few bytes before its next sample column,
   the ranks from there on, and the few bytes after the last.  Equal neighbours are equal
   windows; all but the first in corpus order are repeats.  Memory holds one block of contexts,
   its ranks and one bucket.
4. An anchor with very many occurrences would make one block; its windows are compared within
   their slice first, and only a slice's first of equal windows meets those of other slices.

Texts equal as a whole are settled by their hash: all but the first document lose every byte.

Defined cases: a null text is empty; texts under 100 bytes lose nothing; rows of equal doc_id are
ordered by their texts' hashes, rows equal in both get the same result and do not repeat each
other; null doc_ids come after all others, as one document; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.llm.sketch import CELLS, Sketch, bits_for, cell_rows, gather, key_filter
from fieldtally.llm.text import Hasher, map_arrow, slices, utf8
from fieldtally.session import cut_lineage, scratch_path

WIDTH = 100
GRAM = 32
SPAN = WIDTH - GRAM  # windows start up to so many bytes before their anchor
ROOM = 2 * SPAN + GRAM  # columns of a context
MODULUS = 16
HOT = 20_000  # occurrences of an anchor beyond which its windows are compared one by one
SALTS = 64  # shares of one window's occurrences among very many
BLOCK_ROWS = 20_000
FILTER_BITS = 26
LAST = (1 << 63) - 1

_HIGH = np.uint64(0xFFFFFFFF00000000)


@functools.cache
def difference_cover(modulus: int = MODULUS) -> tuple[int, ...]:
    """A smallest set whose differences give every residue, with gaps of at most half the modulus."""
    for size in range(1, modulus + 1):
        for chosen in itertools.combinations(range(modulus), size):
            gaps = np.diff([*chosen, chosen[0] + modulus])
            if len({(a - b) % modulus for a in chosen for b in chosen}) == modulus and gaps.max() <= modulus // 2:
                return chosen
    raise ValueError("no cover")


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first and last window start, anchor place, anchor hash."""
    none = np.empty(0, np.int64)
    if len(data) < WIDTH:
        return none, none, none, np.empty(0, np.uint64)
    grams = Hasher(data).windows(GRAM)
    key = (grams & _HIGH) | np.arange(len(grams), dtype=np.uint64)
    least, reach = key, 1
    while 2 * reach <= SPAN + 1:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    extra = SPAN + 1 - reach
    if extra:
        least = np.minimum(least[: len(least) - extra], least[extra:])
    place = (least & ~_HIGH).astype(np.int64)
    starts = np.arange(len(place))
    row_end = np.repeat(offsets[1:], np.diff(offsets))[: len(place)]
    starts = starts[starts + WIDTH <= row_end]
    if not len(starts):
        return none, none, none, np.empty(0, np.uint64)
    at = place[starts]
    change = np.flatnonzero((np.diff(at) != 0) | (np.diff(starts) != 1)) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change, [len(starts)]]) - 1
    return starts[first], starts[last], at[first], grams[at[first]]


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    order = F.coalesce(F.col(key).cast("long"), F.lit(LAST))
    return docs.select(F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8").alias("raw"), order.alias("ord"))


def _tie(raw: bytes) -> int:
    return int.from_bytes(hashlib.sha256(raw).digest()[:8], "big", signed=True)


Sources = list[tuple[DataFrame, Sketch | None]]


def _each(sources: Sources, step: Callable[[Iterator], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """The step over the slices of all sources, each less the texts that its sketch marks as copied."""
    parts = [map_arrow(frame, lambda batches, skip=skip: step(_fresh_slices(batches, skip)), schema) for frame, skip in sources]
    return functools.reduce(DataFrame.unionByName, parts)


def _fresh_slices(batches: Iterator[pa.RecordBatch], skip: Sketch | None):
    """Slices of texts of at least a window: bytes, row offsets, orders and text hashes."""
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        order = batch.column(1).to_numpy()
        for a, b in slices(offsets):
            rows, ties = [], []
            for r in range(a, b):
                if offsets[r + 1] - offsets[r] >= WIDTH:
                    rows.append(r)
                    ties.append(_tie(data[offsets[r] : offsets[r + 1]].tobytes()))
            if rows and skip is not None:
                own = ~skip.again(np.array(ties, np.int64).view(np.uint64))
                rows, ties = np.array(rows)[own].tolist(), np.array(ties)[own].tolist()
            if rows:
                part = data[offsets[a] : offsets[b]]
                if len(rows) < b - a:
                    part = np.concatenate([data[offsets[r] : offsets[r + 1]] for r in rows])
                size = np.array([offsets[r + 1] - offsets[r] for r in rows])
                yield part, np.concatenate([[0], np.cumsum(size)]), order[rows], np.array(ties, np.int64)


def anchor_sketch(sources: Sources, bits: int, hot: int = HOT) -> Sketch:
    """Which anchors occur again, and which more often than ``hot``."""

    def step(parts: Iterator) -> Iterator[pa.RecordBatch]:
        for part, offsets, _, _ in parts:
            _, _, _, value = anchors(part, offsets)
            yield cell_rows(value, bits)

    return gather(_each(sources, step, CELLS), bits, hot)


def _ragged(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary array of byte ranges."""
    size = ends - starts
    edge = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(edge[-1]) + np.repeat(starts - edge[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(data[at])])


def contexts(sources: Sources, sketch: Sketch) -> DataFrame:
    """``anchor, ord, tie, place, before, bytes`` of anchors that may occur again.

    ``bytes`` are those that the anchor's windows cover, ``before`` of them before the anchor,
    which begins at ``place`` of its text.
    """
    def step(parts: Iterator) -> Iterator[pa.RecordBatch]:
        for part, offsets, order, ties in parts:
            first, last, at, value = anchors(part, offsets)
            use = np.flatnonzero(sketch.again(value) & ~sketch.very_often(value))
            first, last, at, value = first[use], last[use], at[use], value[use]
            row = np.searchsorted(offsets, first, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(value.view(np.int64)),
                    pa.array(order[row]),
                    pa.array(ties[row]),
                    pa.array((at - offsets[row]).astype(np.int32)),
                    pa.array((at - first).astype(np.int32)),
                    _ragged(part, first, last + WIDTH),
                ],
                ["anchor", "ord", "tie", "place", "before", "bytes"],
            )

    return _each(sources, step, "anchor long, ord long, tie long, place int, before int, bytes binary")


def _words(matrix: np.ndarray, start: int, end: int) -> np.ndarray:
    """Up to eight columns as one big-endian number."""
    out = np.zeros(len(matrix), np.uint64)
    for c in range(start, end):
        out = (out << np.uint64(8)) | matrix[:, c]
    return out


def _dense(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks of rows under the keys (first key first); equal rows share a rank."""
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), bool)
    for k in keys:
        fresh[1:] |= k[order][1:] != k[order][:-1]
    rank = np.empty(len(order), np.int32)
    rank[order] = np.cumsum(fresh)
    return rank


def cover_ranks(matrix: np.ndarray) -> dict[int, dict[int, np.ndarray]]:
    """Ranks of 16, 32 and 64 bytes from every sample column, each from two of half the length."""
    n, width = matrix.shape
    chosen = difference_cover()
    columns = [c for c in range(width) if c % MODULUS in chosen]
    ranks = {16: {c: _dense([_words(matrix, c, c + 8), _words(matrix, c + 8, c + 16)]) for c in columns if c + 16 <= width}}
    for size in (32, 64):
        half = ranks[size // 2]
        ranks[size] = {
            c: np.unique(half[c].astype(np.int64) * n + half[c + size // 2], return_inverse=True)[1].reshape(-1).astype(np.int32)
            for c in columns
            if c + size <= width
        }
    return ranks


def repeated_windows(matrix: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Flags [row, column]: the window from the column equals one of an earlier row.

    Rows stand in corpus order; a row has windows in the columns low..high.
    """
    n = len(matrix)
    flags = np.zeros((n, SPAN + 1), bool)
    if n < 2:
        return flags
    ranks = cover_ranks(matrix)
    sample = sorted(ranks[64])
    tails = sorted(ranks[32])
    for column in range(SPAN + 1):
        rows = np.flatnonzero((low <= column) & (column <= high))
        if len(rows) < 2:
            continue
        head = next(c for c in sample if c >= column)
        tail = max(c for c in tails if c <= min(head + 64, column + WIDTH - 32))
        part = matrix[rows]
        keys = [
            _words(part, column, head),
            ranks[64][head][rows].astype(np.int64) * n + ranks[32][tail][rows],
            _words(part, tail + 32, column + WIDTH),
        ]
        order = np.lexsort(keys[::-1])  # stable: earlier rows first among equals
        same = np.ones(len(order) - 1, bool)
        for k in keys:
            same &= k[order][1:] == k[order][:-1]
        flags[rows[order[1:][same]], column] = True
    return flags


_SPAN_SCHEMA = "ord long, tie long, start int, end int"


def _block_spans(table: pa.Table) -> pa.RecordBatch:
    """Spans of repeats of one block of whole anchors; rows given twice count once."""
    keys = [table[c].to_numpy() for c in ("place", "tie", "ord", "anchor")]
    order = np.lexsort(keys)
    once = np.ones(len(order), bool)
    once[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    table = table.take(pa.array(order[once])).combine_chunks()
    raw, edge = utf8(table["bytes"])
    before = table["before"].to_numpy().astype(np.int64)
    size = np.diff(edge)
    n = len(before)
    matrix = np.zeros((n, ROOM), np.uint8)
    low = SPAN - before
    at = np.arange(len(raw)) - np.repeat(edge[:-1], size) + np.repeat(np.arange(n) * ROOM + low, size)
    matrix.reshape(-1)[at] = raw
    order = np.lexsort([table[c].to_numpy() for c in ("place", "tie", "ord")])
    flags = repeated_windows(matrix[order], low[order], (low + size - WIDTH)[order])
    wide = np.zeros((n, SPAN + 3), np.int8)
    wide[:, 1:-1] = flags
    step = np.diff(wide, axis=1)
    row, begin = np.nonzero(step == 1)
    _, stop = np.nonzero(step == -1)
    source = order[row]
    origin = table["place"].to_numpy()[source] - SPAN
    return pa.RecordBatch.from_arrays(
        [
            pa.array(table["ord"].to_numpy()[source]),
            pa.array(table["tie"].to_numpy()[source]),
            pa.array((origin + begin).astype(np.int32)),
            pa.array((origin + stop - 1 + WIDTH).astype(np.int32)),
        ],
        ["ord", "tie", "start", "end"],
    )


def anchor_spans(found: DataFrame) -> DataFrame:
    """``ord, tie, start, end``: repeats among the contexts of each anchor, block by block."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK_ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                anchor = table["anchor"].to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1], "left"))  # the last anchor may go on
                if cut:
                    yield _block_spans(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield _block_spans(pa.Table.from_batches(held).combine_chunks())

    return map_arrow(found.repartition("anchor").sortWithinPartitions("anchor"), step, _SPAN_SCHEMA)


def _settled(part: np.ndarray, starts: np.ndarray, rows: np.ndarray, order: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Flags of windows that equal an earlier one of the same slice, byte by byte."""
    value = Hasher(part).ranges(starts, starts + WIDTH)
    by = np.lexsort((starts, ties[rows], order[rows], value))
    near = np.flatnonzero(value[by[1:]] == value[by[:-1]])
    again = np.zeros(len(starts), bool)
    for k in range(0, len(near), 50_000):
        x, y = by[near[k : k + 50_000]], by[near[k : k + 50_000] + 1]
        wide = np.arange(WIDTH)
        again[y] = np.all(part[starts[x][:, None] + wide] == part[starts[y][:, None] + wide], axis=1)
    return again


def hot_spans(sources: Sources, sketch: Sketch) -> DataFrame:
    """Repeats among windows of anchors with very many occurrences, by the first of equal windows.

    A task emits the windows that repeat an earlier one of their slice as spans at once; only a
    slice's first of equal windows goes on, under 128 bits of hash.  Those meet in ``SALTS``
    shares of a window first, whose firsts meet once more, so no window's rows are one task's.
    """
    def step(parts: Iterator) -> Iterator[pa.RecordBatch]:
        for part, offsets, order, ties in parts:
            first, last, _, value = anchors(part, offsets)
            use = np.flatnonzero(sketch.again(value) & sketch.very_often(value))
            if not len(use):
                continue
            count = last[use] - first[use] + 1
            start = np.repeat(first[use], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            row = np.searchsorted(offsets, start, "right") - 1
            again = _settled(part, start, row, order, ties)
            if again.any():
                moved = start[again] + row[again]  # a byte between rows, so that no run crosses them
                begin, end = merge_spans(moved, moved + WIDTH)
                own = np.searchsorted(offsets + np.arange(len(offsets)), begin, "right") - 1
                shift = own + offsets[own]
                yield _hot_rows(pa.nulls(len(own), pa.binary()), order[own], ties[own], begin - shift, end - shift)
            start, row = start[~again], row[~again]
            for k in range(0, len(start), 50_000):
                s, r = start[k : k + 50_000], row[k : k + 50_000]
                raw = [hashlib.blake2b(part[x : x + WIDTH], digest_size=16).digest() for x in s.tolist()]
                at = s - offsets[r]
                yield _hot_rows(pa.array(raw, pa.binary()), order[r], ties[r], at, at + WIDTH)

    found = _each(sources, step, "window binary, ord long, tie long, start int, end int")
    folder = scratch_path(found.sparkSession, "hot-windows")
    found.write.parquet(folder)
    found = found.sparkSession.read.schema(found.schema).parquet(folder)

    def place(*keys: str) -> Column:
        return F.rank().over(Window.partitionBy(*keys).orderBy("ord", "tie", "start"))

    salt = F.pmod(F.xxhash64("ord", "tie", "start"), F.lit(SALTS)).cast("int")
    shares = found.where("window IS NOT NULL").withColumn("salt", salt).withColumn("nth", place("window", "salt"))
    heads = shares.where("nth = 1").withColumn("nth", place("window"))
    columns = ["ord", "tie", "start", "end"]
    parts = [found.where("window IS NULL"), shares.where("nth > 1"), heads.where("nth > 1")]
    return functools.reduce(DataFrame.union, [p.select(*columns) for p in parts])


def _hot_rows(window: pa.Array, order: np.ndarray, ties: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    columns = [window, pa.array(order), pa.array(ties), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["window", "ord", "tie", "start", "end"])


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.append(True, starts[1:] > ends[:-1])
    return starts[fresh], ends[np.append(np.flatnonzero(fresh)[1:] - 1, len(ends) - 1)]


def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of each row.

    ``spans`` are the maximal removed byte ranges (null for a document that repeats an earlier
    one as a whole: it is removed entirely).
    """
    spark = docs.sparkSession
    texts = _texts(docs, key, text)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, size = [], []
            for raw in batch.column(0):
                data = raw.as_buffer()
                sha.append(hashlib.sha256(data).digest())
                size.append(data.size)
            ties = [int.from_bytes(s[:8], "big", signed=True) for s in sha]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(size, pa.int64()), pa.array(sha, pa.binary()), pa.array(ties, pa.int64())],
                ["ord", "n_bytes", "sha", "tie"],
            )

    rows = cut_lineage(map_arrow(texts, hashes, "ord long, n_bytes long, sha binary, tie long"))
    volume = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    sources = _without_copies(texts, rows)
    sketch = anchor_sketch(sources, bits_for(2 * volume / (SPAN + 1)))  # windows have about so many anchors
    spans = anchor_spans(contexts(sources, sketch))
    if sketch.some_hot:
        spans = spans.union(hot_spans(sources, sketch))
    spans = spans.groupBy("ord", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # bounded by a text's length
    spans = cut_lineage(spans)
    firsts = rows.groupBy("sha").agg(F.min("ord").alias("first"))
    marked = rows.join(firsts, "sha").withColumn("copy", (F.col("first") < F.col("ord")) & (F.col("n_bytes") >= WIDTH))
    cleaned = _cleaned(texts, spans)
    nothing = hashlib.sha256(b"").hexdigest()
    part = F.col("n_removed").isNotNull() & ~F.col("copy")

    def pick(copied, partly, whole):
        return F.when(F.col("copy"), copied).when(part, partly).otherwise(whole)

    return marked.join(cleaned, ["ord", "tie"], "left").select(
        F.when(F.col("ord") < LAST, F.col("ord")).alias("doc_id"),
        "n_bytes",
        pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(nothing), F.col("kept"), F.lower(F.hex("sha"))).alias("kept_sha256"),
        pick(F.lit(None), F.col("spans"), F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )


def _without_copies(texts: DataFrame, rows: DataFrame) -> Sources:
    """Texts that occur once as a whole, and the first of each text that may occur again."""
    spark = texts.sparkSession
    bits = bits_for(rows.count())

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield cell_rows(batch.column(0).to_numpy().view(np.uint64), bits)

    skip = gather(map_arrow(rows.select("tie"), cells, CELLS), bits)

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha = [hashlib.sha256(raw.as_buffer()).digest() for raw in batch.column(0)]
            ties = np.array([int.from_bytes(s[:8], "big") for s in sha], np.uint64)
            use = pa.array(skip.again(ties))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(use), batch.column(1).filter(use), pa.array(sha, pa.binary()).filter(use)], ["raw", "ord", "sha"]
            )

    several = map_arrow(texts, copied, "raw binary, ord long, sha binary")
    folder = scratch_path(spark, "copied-texts")
    several.groupBy("sha").agg(F.first("raw").alias("raw"), F.min("ord").alias("ord")).select("raw", "ord").write.parquet(folder)
    return [(texts, skip), (spark.read.parquet(folder), None)]


def _cleaned(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``ord, tie, n_removed, n_spans, kept, spans`` of the texts with spans."""

    wanted = key_filter(spans.select("ord"), FILTER_BITS)  # 8 MB

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(wanted.has(batch.column(1).to_numpy())))
            ties = [_tie(raw.as_buffer()) for raw in kept.column(0)]
            yield pa.RecordBatch.from_arrays([kept.column(1), pa.array(ties, pa.int64()), kept.column(0)], ["ord", "tie", "raw"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, kept, merged = [], [], [], []
            for raw, own in zip(batch.column(2), batch.column(3), strict=True):
                flat = own.values
                starts, ends = merge_spans(flat.field("start").to_numpy(), flat.field("end").to_numpy())
                data, sha, done = raw.as_buffer(), hashlib.sha256(), 0
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    sha.update(data[done:s])
                    done = e
                sha.update(data[done:])
                removed.append(int((ends - starts).sum()))
                runs.append(len(starts))
                kept.append(sha.hexdigest())
                merged.append([{"start": s, "end": e} for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string()), pa.array(merged, kind)],
                ["ord", "tie", "n_removed", "n_spans", "kept", "spans"],
            )

    chosen = map_arrow(texts, some, "ord long, tie long, raw binary").join(spans, ["ord", "tie"]).dropDuplicates(["ord", "tie"])
    schema = "ord long, tie long, n_removed long, n_spans long, kept string, spans array<struct<start: int, end: int>>"
    return map_arrow(chosen.select("ord", "tie", "raw", "spans"), cut, schema)
