"""Packing documents into sequences: the sum-of-squares rule with a level array.

An open sequence is known only by its fill level, and ``levels[h]`` counts the open sequences
of level h.  A piece of s ids goes to the level h for which the sum of squared counts of partial
levels grows least (a new sequence is level 0, a full one counts no more); ties take the fullest
level.  Documents of at least one whole sequence first give whole sequences.

Spark deals documents to groups of about equal token counts by a hash of their key; a group is
packed by one task with memory for one level array and its open pieces, independent of all other
groups.  At the end of a group the open sequences are closed: the emptiest are cut up to fill
the fullest exactly, so one partial sequence at most is left, and that one is cut by binary
digits, since a sequence whose length is a power of two needs no padding.

Defined cases: a null text counts as empty and still gives its end id; an empty table gives an
empty result; rows with the same key are documents of their own; a null key is dealt like any
other; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.text import map_arrow
from fieldtally.llm.tokens import encoder

LENGTH = 2048
END_ID = 1
GROUP_BYTES = 4 << 20  # bytes of text in a group, about


class LevelPacker:
    """Online packer of sizes 1..length; ``place`` tells sequence and offset of a piece."""

    def __init__(self, length: int):
        self.length = length
        self.levels = np.zeros(length + 1, np.int64)
        self.open: dict[int, list[int]] = defaultdict(list)
        self.made = 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, size: int) -> tuple[int, int]:
        """Cost of moving a sequence from level h to h + size: the change of the sum of squares, halved."""
        if size == self.length:
            return self.new(), 0
        room = self.length - size
        levels = self.levels
        # h = 1..room; full sequences (h == room) leave the sum
        cost = levels[size + 1 :] - levels[1 : room + 1] + 1.0
        cost[-1] = 0.5 - levels[room]
        cost[levels[1 : room + 1] == 0] = np.inf
        best = room - 1 - int(np.argmin(cost[::-1])) if room else 0  # the last of the least: the fullest level
        level = best + 1
        if room == 0 or cost[best] > levels[size] + 0.5:
            at, level = self.new(), 0
        else:
            at = self.open[level].pop()
            levels[level] -= 1
        if level + size < self.length:
            self.open[level + size].append(at)
            levels[level + size] += 1
        return at, level


def pack_group(sizes: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document index, start, size, sequence, offset) of documents of these sizes."""
    packer = LevelPacker(length)
    whole, tails = [], defaultdict(list)
    for doc, size in enumerate(sizes.tolist()):
        start = 0
        while size - start >= length:
            whole.append((doc, start, length, packer.new(), 0))
            start += length
        if size > start:
            at, offset = packer.place(size - start)
            tails[at].append((doc, start, size - start, offset))
    return whole + close(tails, packer, length)


def close(tails: dict[int, list[tuple[int, int, int, int]]], packer: LevelPacker, length: int) -> list[tuple[int, int, int, int, int]]:
    """Final pieces of all sequences, with the open ones merged so that none needs padding."""
    out, queue = [], []
    still_open = {at for level in packer.open.values() for at in level}
    for at, pieces in tails.items():
        if at in still_open:
            queue.append((pieces[-1][3] + pieces[-1][2], at, pieces))
        else:
            out += [(doc, start, size, at, offset) for doc, start, size, offset in pieces]
    queue.sort(key=lambda q: (-q[0], q[1]))  # the fullest first
    low, high = 0, len(queue) - 1
    spare = [(doc, start, size) for doc, start, size, _ in queue[high][2]] if queue else []
    while low < high:
        fill, at, pieces = queue[low]
        out += [(doc, start, size, at, offset) for doc, start, size, offset in pieces]
        low += 1
        while fill < length:
            if not spare:
                if low > high - 1:
                    break
                high -= 1
                spare = [(doc, start, size) for doc, start, size, _ in queue[high][2]]
            doc, start, size = spare.pop()
            used = min(size, length - fill)
            out.append((doc, start, used, at, fill))
            if used < size:
                spare.append((doc, start + used, size - used))
            fill += used
        if fill < length:  # nothing left to fill with: this sequence is the last partial one
            tail = [p for p in out if p[3] == at]
            out = [p for p in out if p[3] != at]
            spare = [(doc, start, size) for doc, start, size, _, _ in tail]
            high = low - 1
            break
    # what is left is less than a sequence: cut by binary digits
    left = sum(size for _, _, size in spare)
    bit = 1 << max(left.bit_length() - 1, 0)
    at, fill = packer.new(), 0
    while spare:
        doc, start, size = spare.pop(0)
        while size:
            while not left & bit:
                bit >>= 1
            used = min(size, bit - fill)
            out.append((doc, start, used, at, fill))
            start, size, fill = start + used, size - used, fill + used
            if fill == bit:
                left, fill = left - bit, 0
                at = packer.new()
    return out


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    length: int = LENGTH,
    end_id: int = END_ID,
    group_bytes: int = GROUP_BYTES,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    With ``ids``, the piece's ids (little-endian 4-byte integers), sequences can be written from
    the result alone.  The number of groups follows the bytes of text, so a group stays small however large the corpus is.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    groups = max(1, -(-(total["b"] + 8 * total["n"]) // group_bytes))
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    group = F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("long")
    dealt = narrow.withColumn("group", group).repartition(groups, "group")
    tail = np.array([end_id], "<u4").tobytes()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer)
        found: dict[int, list[tuple[int | None, bytes]]] = defaultdict(list)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                keys, to = part.column(0).to_pylist(), part.column(2).to_pylist()
                for k, g, ids in zip(keys, to, made.encode(part.column(1).to_pylist()), strict=True):
                    found[g].append((k, ids + tail))
        for g in sorted(found):
            yield from _packed(g, found.pop(g), length, with_ids)

    return map_arrow(dealt, step, PIECES + (", ids binary" if with_ids else ""))


def _packed(group: int, docs: list[tuple[int | None, bytes]], length: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    docs.sort(key=lambda d: (d[0] is None, d[0] or 0, d[1]))  # the same order in every run
    sizes = np.array([len(ids) // 4 for _, ids in docs], np.int64)
    pieces = pack_group(sizes, length)
    for a in range(0, len(pieces), 4096):
        rows = pieces[a : a + 4096]
        ids = [docs[d][1][4 * start : 4 * (start + size)] for d, start, size, _, _ in rows]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([docs[r[0]][0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                pa.array([int(sizes[r[0]]) for r in rows], pa.int64()),
                pa.array([(group << 32) + r[3] for r in rows], pa.int64()),
                pa.array([r[4] for r in rows], pa.int64()),
                *([pa.array(ids, pa.binary())] if with_ids else []),
            ],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])],
        )
