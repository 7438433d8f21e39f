"""N-gram Jaccard self-join and its connected groups: size-aware, heavy-light.

A document's set is its distinct 5-word shingles, as 64-bit hashes.  Shingles have one global
order, rare ones first (a sketch of occurrence counts decides, then the hash); shingles whose
lists turn out long are moved to its end, and the lists are made again.  Any order gives the
same result, a good one gives short lists.  A pair with Jaccard >= t shares at least
``ceil(t * size)`` shingles of either set, so among the first ``size - ceil(t * size) + c`` of
each set there are c common ones.

* Small sets (up to a boundary size) enumerate all pairs (c = 2) of that many leading shingles;
  two small sets that link share such a pair.
* Large sets, and small ones that a large one may link with, write their leading shingles
  (c = 1) to inverted lists, which are scanned.

The boundary minimises the estimated cost of keys written plus sets compared, from the sizes of
all sets and the mean number of repeats of a shingle.

Equal sets are one node.  Members of lists are gathered into clusters around pivots (see
``clusters``), so near copies that share many lists are sent and compared once, not once a list.
What a cluster compares first are parity bits, one or two a shingle: two sets' bits differ in no
more places than the sets do, so a set whose bits are too far from all others has no link there
and leaves, and only the other sets are sent.  A cluster is compared block by block, and a task
reports only links that span the groups it found: every pair of different sets that link is
compared, and none of a group's pairs is listed.  Groups are exact.

Defined cases: null or word-less texts have an empty set and link with nothing; shorter texts
count as one shingle; rows with equal doc_id are one document in the groups (its rows' sets are
compared apart); null doc_ids get a null component and link with nothing; an empty table gives
an empty result; further columns are ignored.  Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.llm.sketch import CELLS, Filter, bits_for, cell_rows, gather, key_filter, load_parts, store_parts
from fieldtally.llm.text import LOWER, WINDOW_VALUES, Hasher, Words, bounded_rows, count_by_part, map_arrow, mix, slices, utf8
from fieldtally.session import cut_lineage, store_rows

WIDTH = 5
PERCENT = 80
SKETCH_BITS = 24  # cells of the count sketch: a bounded 16 MB, one byte each
SKETCH_PARTS = 256  # of 2 ** 16 cells each, so a cell inside a part takes two bytes
COMPARE_COST = 20.0  # comparing two sets, in keys written
MAX_SUBSET_SIZE = 64  # sizes tried as boundary
LONG_LIST = 8  # members beyond which a list's shingle goes to the end of the order
LONG_BITS = 26  # bits of the filter that remembers such shingles: 8 MB
REFINEMENTS = 1
BLOCK = 1000  # sets compared at once: two blocks, their overlaps and a panel of shingles are held
PANEL = 2048


def least_common(size: np.ndarray | int, percent: int = PERCENT):
    """ceil(t * size): the fewest shingles that a linked set shares with one of this size."""
    return -(-size * percent // 100)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows one after another, and where each row's begin."""
    w = Words(LOWER[data], offsets)
    value = Hasher(w.data).ranges(w.starts, w.ends)
    run, at = w.runs(value, width)
    row = w.row[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = w.counts[short] > k
            whole[has] += value[w.first[short[has]] + k] * WINDOW_VALUES[k]
        whole = mix(mix(whole) + w.counts[short].astype(np.uint64))
        run, row = np.concatenate([run, whole]), np.concatenate([row, short])
    order = np.lexsort((run, row))
    run, row = run[order], row[order]
    fresh = np.ones(len(run), bool)
    fresh[1:] = (run[1:] != run[:-1]) | (row[1:] != row[:-1])
    run, row = run[fresh], row[fresh]
    return run, np.searchsorted(row, np.arange(len(offsets)))


def set_ids(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit id of each row's set (0 for an empty one)."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    size = np.diff(first).astype(np.uint64)
    return np.where(size > 0, mix(total[first[1:]] - total[first[:-1]] + size) | np.uint64(1), np.uint64(0)).view(np.int64)


def parity_bits(values: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Per row its size, then a word for every 64 cells: whether an odd number of the shingles fall there.

    Cells are the least power of two that is not below the size, 64 at least.
    """
    size = np.diff(first)
    cells = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(cells)])
    own = np.repeat(np.arange(len(size)), size)
    at = begin[own] + (values & (cells[own] - 1).astype(np.uint64)).astype(np.int64)
    words = np.packbits((np.bincount(at, minlength=begin[-1]) & 1).astype(bool)).view(np.uint64)
    return [np.concatenate([[np.uint64(n)], words[a:b]]) for n, a, b in zip(size, begin[:-1] // 64, begin[1:] // 64, strict=True)]


def may_link(bits: list[np.ndarray], sides: np.ndarray | None, percent: int = PERCENT) -> np.ndarray:
    """Which sets have another one (across the sides, if given) that their ``parity_bits`` allow to link with.

    Sets that link differ in size by a quarter at most, so their cells are as many, or twice as many.
    """
    size = np.array([int(b[0]) for b in bits])
    width = np.array([len(b) - 1 for b in bits])
    found = np.zeros(len(bits), bool)
    for w in np.unique(width).tolist():
        same, twice = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        halves = [bits[k][1 : w + 1] ^ bits[k][w + 1 :] for k in twice]
        cells = np.stack([*(bits[k][1:] for k in same), *halves])
        those = np.concatenate([same, twice])
        for place, k in enumerate(same.tolist()):
            other, rest = those[place + 1 :], cells[place + 1 :]
            apart = np.maximum(np.bitwise_count(rest ^ cells[place]).sum(1, dtype=np.int64), np.abs(size[other] - size[k]))
            near = apart * (100 + percent) <= (100 - percent) * (size[other] + size[k])
            if sides is not None:
                near &= sides[other] != sides[k]
            if near.any():
                found[k] = True
                found[other[near]] = True
    return found


def _each_slice(batches: Iterator[pa.RecordBatch], width: int, column: int = 0):
    for batch in batches:
        data, offsets = utf8(batch.column(column))
        for a, b in slices(offsets):
            values, first = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
            yield batch, a, b, values, first, set_ids(values, first)


@dataclass(frozen=True)
class Order:
    """Occurrence levels of sketch cells, rare ones first; shingles known from long lists come last."""

    folder: str
    bits: int
    empty: int  # cells without a shingle
    long_lists: tuple[Filter, ...] = ()

    def keys(self, values: np.ndarray) -> np.ndarray:
        levels = load_parts(self.folder, "levels", 1 << self.bits, SKETCH_PARTS)
        level = levels[(values >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int16)
        if self.long_lists:
            level += 64 * np.any([lists.has(values) for lists in self.long_lists], axis=0).astype(np.int16)
        return level


def document_sets(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, node, bits`` of each row; ``node`` identifies the set (0 for none)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, values, first, node in _each_slice(batches, width, 1):
            bits = pa.array([x.tobytes() for x in parity_bits(values, first)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(np.diff(first).astype(np.int64)), pa.array(node), bits],
                ["doc_id", "n_shingles", "node", "bits"],
            )

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_arrow(narrow, step, "doc_id long, n_shingles long, node long, bits binary")


def _fresh(node: np.ndarray, first: np.ndarray, seen: set[int]) -> np.ndarray:
    """Rows with a set not met before in this task; exact copies are worked on once per task."""
    rows = []
    for k, n in enumerate(node.tolist()):
        if n and n not in seen:
            seen.add(n)
            rows.append(k)
    return np.array(rows, np.int64)


def count_sketch(texts: DataFrame, width: int = WIDTH, bits: int = SKETCH_BITS) -> Order:
    """Occurrences of shingles over all documents, by hash cell, as levels (powers of two).

    Tasks send, for each part of the cells, cell numbers of two bytes.  The result has
    ``2 ** bits`` bytes whatever the corpus' size; it only orders shingles.
    """
    per_part = (1 << bits) // SKETCH_PARTS

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, _, _, values, first, node in _each_slice(batches, width):
            rows = _fresh(node, first, seen)
            if not len(rows):
                continue
            use = np.zeros(len(values) + 1, np.int8)
            np.add.at(use, first[rows], 1)
            np.subtract.at(use, first[rows + 1], 1)
            cells = np.sort((values[np.cumsum(use[:-1], dtype=np.int8) > 0] >> np.uint64(64 - bits)).astype(np.int64))
            cut = np.searchsorted(cells, np.arange(SKETCH_PARTS + 1) * per_part)
            parts, blobs = [], []
            for p in range(SKETCH_PARTS):
                own = cells[cut[p] : cut[p + 1]] - p * per_part
                if len(own):
                    parts.append(p)
                    blobs.append(own.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, count in count_by_part(batches, per_part, "<u2"):
            level = np.ceil(np.log2(count + 1)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p], pa.int32()), pa.array([int((level > 0).sum())], pa.int64()), pa.array([level.tobytes()], pa.binary())],
                ["part", "filled", "levels"],
            )

    sent = map_arrow(texts, step, "part int, cells binary").repartition("part").sortWithinPartitions("part")
    folder = store_parts(map_arrow(sent, add, "part int, filled long, levels binary"), "levels")
    filled = texts.sparkSession.read.schema("filled long").parquet(folder).agg(F.coalesce(F.sum("filled"), F.lit(0))).first()[0]
    return Order(folder, bits, (1 << bits) - filled)


def boundary(sizes: np.ndarray, sets: np.ndarray, repeats: float, percent: int = PERCENT) -> int:
    """Largest size whose sets enumerate subsets, by estimated cost.  Sizes ascend; ``sets`` counts them."""
    leading = sizes - least_common(sizes, percent)
    listed = sets * (leading + 1) * (1 + COMPARE_COST * repeats)
    paired = sets * (leading + 2) * (leading + 1) / 2
    best, at = float(listed.sum()), 0
    for x in range(1, MAX_SUBSET_SIZE + 1):
        small = sizes <= x
        near = small & (100 * sizes >= percent * (x + 1))
        cost = float(paired[small].sum() + listed[near].sum() + listed[~small].sum())
        if cost < best:
            best, at = cost, x
    return at


def _keys(
    values: np.ndarray, first: np.ndarray, rows: np.ndarray, order: Order, small: int, percent: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverted-list and subset keys of some rows: key, row, and place of the (first) shingle in the order."""
    size = np.diff(first)
    values = values[np.lexsort((order.keys(values), np.repeat(np.arange(len(size)), size)))]
    lead = size - least_common(size, percent)
    listed = rows[(size[rows] > small) | (100 * size[rows] >= percent * (small + 1))]
    count = lead[listed] + 1
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    keys, owners, places = [values[np.repeat(first[listed], count) + place]], [np.repeat(listed, count)], [place]
    for s in np.unique(size[rows[size[rows] <= small]]).tolist():
        if least_common(s, percent) < 2:
            continue  # so small that linked sets are equal
        own = rows[size[rows] == s]
        ahead = s - least_common(s, percent) + 2
        one, two = np.triu_indices(ahead, 1)
        table = values[first[own][:, None] + np.arange(ahead)]
        keys.append(mix(table[:, one] * WINDOW_VALUES[0] + table[:, two] * WINDOW_VALUES[1]).ravel())
        owners.append(np.repeat(own, len(one)))
        places.append(np.tile(one, len(own)))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(places)


def candidate_keys(
    texts: DataFrame, order: Order, small: int, expected: float, width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """``key, node, size, place`` of the distinct sets' keys, less keys that surely occur once.

    ``expected`` is the number of keys, about; it sets the size of the sketch that drops them.
    """
    bits = bits_for(expected)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, _, _, values, first, node in _each_slice(batches, width):
            keys, _, _ = _keys(values, first, _fresh(node, first, seen), order, small, percent)
            yield cell_rows(keys, bits)

    sketch = gather(map_arrow(texts, cells, CELLS), bits)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, _, _, values, first, node in _each_slice(batches, width):
            keys, owner, place = _keys(values, first, _fresh(node, first, seen), order, small, percent)
            use = sketch.again(keys)
            keys, owner, place = keys[use], owner[use], place[use]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.view(np.int64)),
                    pa.array(node[owner]),
                    pa.array(np.diff(first)[owner].astype(np.int32)),
                    pa.array(place.astype(np.int32)),
                ],
                ["key", "node", "size", "place"],
            )

    return map_arrow(texts, step, "key long, node long, size int, place int")


def _bits_for(candidates: int) -> int:
    """Bits of the filter on candidate sets: 16 a set, 2 MB to 16 MB."""
    return int(np.clip(np.ceil(np.log2(16 * max(candidates, 1))), 24, 27))


def sets_of(texts: DataFrame, nodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """``node, size, shingles`` (sorted 8-byte hashes) of the given nodes, once each."""
    wanted = key_filter(nodes.select("node"), _bits_for(nodes.count()))  # at most 16 MB

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, _, _, values, first, node in _each_slice(batches, width):
            rows = _fresh(node, first, seen)
            rows = rows[wanted.has(node[rows])]
            blobs = [values[first[r] : first[r + 1]].tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(blobs, pa.binary())], ["node", "shingles"])

    found = map_arrow(texts, step, "node long, shingles binary").join(nodes.select("node"), "node", "left_semi")
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"))


def forest(nodes: np.ndarray, sets: list[np.ndarray], sides: np.ndarray | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that span the groups among some sets; with ``sides``, only pairs across the two sides.

    Overlaps come from the inverted lists of the shingles that several sets have, as products of
    the rows of a membership matrix, a block of rows at a time.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets])
    value, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    often = np.bincount(column, minlength=len(value)) > 1
    use = often[column]
    place = (np.cumsum(often) - 1)[column[use]]
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    overlap = np.zeros((n, n), np.float32)
    for start in range(0, int(often.sum()), PANEL):
        inside = (place >= start) & (place < start + PANEL)
        member = np.zeros((n, PANEL), np.float32)
        member[row[use][inside], place[inside] - start] = 1
        overlap += member @ member.T
    close = 100 * overlap >= percent * (size[:, None] + size[None, :] - overlap)
    if sides is not None:
        close &= sides[:, None] != sides[None, :]
    out = []
    for i, j in zip(*np.nonzero(np.triu(close, 1)), strict=True):
        x, y = root(i), root(j)
        if x != y:
            parent[y] = x
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def clusters(keys: DataFrame) -> DataFrame:
    """``pivot, node``: the sets that share a list, in clusters.

    A list's members of about one size belong to the cluster of their pivot, the member whose
    place in the list is lowest: among near copies the one with fewest changes of its own, so
    many lists name the same pivot and a set is sent once for all of them.  Members stand in
    their size class and the next, so any two that may link meet in one.  The keys are shuffled
    once; lists are windows of that one order.
    """
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1.25))).cast("int")
    dealt = keys.repartition("key").withColumn("band", F.explode(F.array(band, band + 1)))
    whole = Window.partitionBy("key", "band")
    pivot = F.min(F.struct("place", "node")).over(whole)
    listed = dealt.select(
        "node", pivot.alias("p"), F.min("node").over(whole).alias("least"), F.max("node").over(whole).alias("most")
    )
    return listed.where("least <> most").select(F.col("p.node").alias("pivot"), "node").distinct()


def tiles(members: DataFrame, sets: DataFrame, value: str) -> DataFrame:
    """Clusters with a value of each set, tile by tile: ``pivot, i, j, own, node, value``.

    A cluster of more than ``BLOCK`` sets is cut into blocks, and every pair of blocks is a tile of its own.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("count") / BLOCK)).cast("int")
    placed = (
        members.join(members.groupBy("pivot").count(), "pivot")
        .withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node")
    )
    sent = placed.join(sets, "node").select("pivot", "i", "j", "own", "node", value)
    return sent.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")


def _each_tile(batches: Iterator[pa.RecordBatch]):
    """Pivot, nodes, values and (in a tile of two blocks) sides of every tile of two sets or more."""
    tile, held = None, []

    def whole():
        if len(held) > 1:
            own, nodes = (np.array([h[k] for h in held], np.int64) for k in (0, 1))
            yield tile[0], nodes, [h[2] for h in held], own if tile[1] != tile[2] else None

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(5)]
        for pivot, i, j, own, node, blob in zip(*columns, batch.column(5), strict=True):
            if (pivot, i, j) != tile:
                yield from whole()
                tile, held = (pivot, i, j), []
            held.append((own, node, np.frombuffer(blob.as_buffer(), "<u8")))
    yield from whole()


def near_members(members: DataFrame, bits: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The clusters without the sets that their parity bits keep from linking with any other one there."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pivot, nodes, values, sides in _each_tile(batches):
            stay = nodes[may_link(values, sides, percent)]
            if len(stay):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(stay), pivot)), pa.array(stay)], ["pivot", "node"])

    return map_arrow(tiles(members, bits, "bits"), step, "pivot long, node long").distinct()


def linked(members: DataFrame, texts: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Links ``a, b`` that span all groups among sets of a cluster."""
    sets = sets_of(texts, cut_lineage(members.select("node").distinct()), width)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, nodes, values, sides in _each_tile(batches):
            found = forest(nodes, values, sides, percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return map_arrow(tiles(members, sets, "shingles"), step, "a long, b long")


def groups(links: DataFrame) -> DataFrame:
    """``node, comp``: the smallest node reachable over links, for every node with a link.

    Labels go to neighbours, then jump to the label's own label, so rounds grow with the
    logarithm of a chain's length.  A round's state is checkpointed.
    """
    both = cut_lineage(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    )
    state = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")))
    while True:
        heard = both.join(state.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        nearer = state.join(heard.withColumnRenamed("a", "node"), "node").select("node", "comp", F.least("comp", "m").alias("new"))
        target = nearer.select(F.col("node").alias("new"), F.col("new").alias("jump"))
        jumped = cut_lineage(nearer.join(target, "new").select("node", "comp", F.least("new", "jump").alias("next")))
        changed = jumped.where("next <> comp").limit(1).count()
        state = jumped.select("node", F.col("next").alias("comp"))
        if not changed:
            return state


def similar_groups(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, node, component_id`` of each row."""
    texts = docs.select(F.col(text).cast("string").alias("text"))
    rows = store_rows(document_sets(docs, width, key, text))
    histogram = (  # one row per set size
        rows.where("node <> 0").groupBy("node").agg(F.first("n_shingles").alias("size")).groupBy("size").count()
    )
    found = sorted((r["size"], r["count"]) for r in bounded_rows(histogram))
    sizes, counts = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
    order = count_sketch(texts, width)
    total = float((sizes * counts).sum())
    cells = 1 << order.bits
    distinct = max(cells * np.log(cells / max(order.empty, 1)), 1.0)  # linear counting
    small = boundary(sizes, counts, max(total / distinct - 1, 0.0), percent)
    lead = sizes - least_common(sizes, percent)
    expected = float(((lead + 1) * np.where(sizes <= small, lead + 2, 1) * counts).sum())
    keys = candidate_keys(texts, order, small, expected, width, percent)
    for _ in range(REFINEMENTS):
        # what the sketch took for rare but is not; a few shingles more each round, as prefixes refill
        lists = keys.select("key", "node").repartition("key").distinct()
        many = lists.groupBy("key").count().where(F.col("count") > LONG_LIST).select("key")
        order = replace(order, long_lists=(*order.long_lists, key_filter(many, LONG_BITS)))
        keys = candidate_keys(texts, order, small, expected, width, percent)
    bits = rows.where("node <> 0").groupBy("node").agg(F.first("bits").alias("bits"))
    members = cut_lineage(near_members(cut_lineage(clusters(keys)), bits, percent))

    # rows of one doc_id are one document
    twice = rows.where("doc_id IS NOT NULL AND node <> 0").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z"))
    twice = twice.where("a <> z").join(rows.where("node <> 0").select("doc_id", F.col("node").alias("b")), "doc_id")
    links = cut_lineage(twice.where("a <> b").select("a", "b").distinct())

    comp = groups(cut_lineage(links.union(linked(members, texts, width, percent)).distinct()))
    least_doc = rows.where("node <> 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc"))
    grouped = least_doc.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    heads = grouped.groupBy("comp").agg(F.min("doc").alias("component_id"))
    by_node = grouped.join(heads, "comp").select("node", "component_id")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.join(by_node, "node", "left").select("doc_id", "n_shingles", "node", own.alias("component_id"))


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """The documents with one row per group: that of the smallest doc_id.

    Rows without a doc_id or without words all stay.  The rows' own columns are returned.
    """
    found = similar_groups(docs, **options)
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    some = docs.where("doc_id IS NOT NULL").join(stay, F.col("doc_id") == F.col("__id"), "left_semi").dropDuplicates(["doc_id"])
    return some.unionByName(docs.where("doc_id IS NULL"))
