"""Document fingerprints from a locally consistent parse.

A text is parsed into a tree of phrases.  On every level

1. runs of an equal symbol become one symbol,
2. deterministic coin tossing gives each symbol a small label: the lowest bit in which it differs
   from its left neighbour, and that bit's value.  Neighbours keep different labels, and four
   tosses bring 64-bit names down to the labels 0 to 5,
3. a phrase begins at every label that is larger than both its neighbours'; as labels are few,
   a phrase has at most eleven symbols,
4. the phrase's name, a 64-bit hash of its symbols, is a symbol of the next level.

The levels end when one name, the root's, is left.  A boundary depends on five symbols to its left
and one to its right only, so equal substrings are parsed alike inside, wherever they stand.

The fingerprint holds the root's name and, for each level up to ``TOP``, the number of phrases and
the ``KEEP`` smallest of their hashes; a phrase's further occurrences count as further members.
The likeness of two fingerprints compares the phrases of the highest level where both have
``ENOUGH`` (else of the first level): twice the shared part over the sum of the sizes, from the
estimated share of the union; exact where both have at most ``KEEP`` phrases.  Equal roots are 1.

Defined cases: a null text counts as empty; the empty text has the fingerprint ``-``, which is like
itself (1) and like nothing else (0); a text of one symbol, however often, is one phrase, the root;
equal texts have equal fingerprints, whatever their ids.  Memory follows the longest text.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.text import bounded_rows, map_arrow, mix, slices, utf8

TOP = 3
ENOUGH = 12
KEEP = 32
OVERSAMPLE = 8
EMPTY = "-"
LONGEST = 11  # labels rise for at most six symbols and fall for at most six, the peak counted once
_SLICE = 1 << 20
_U64 = np.uint64
_NAME_SHIFT, _ROW_SHIFT = _U64(20), _U64(44)  # a slice has fewer than 2 ** 20 texts; 44 bits of a name remain
_GOLDEN = _U64(0x9E3779B97F4A7C15)

_generator = np.random.Generator(np.random.PCG64(29))
_PLACE = _generator.integers(0, 2**64, LONGEST + 2, dtype=_U64) | _U64(1)
_BYTE_NAMES = mix(_generator.integers(0, 2**64, 256, dtype=_U64))


def _toss(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Labels of a sequence whose neighbours differ; a text's first symbol shows its lowest bit."""
    differ = np.empty_like(values)
    differ[1:] = values[1:] ^ values[:-1]
    differ[begin] = 1
    lowest = differ & (~differ + values.dtype.type(1))
    place = np.bitwise_count(lowest - values.dtype.type(1))
    return (place << np.uint8(1)) | ((values & lowest) != 0)


def labels(symbols: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Labels 0 to 5 of bytes or 64-bit names; neighbours within a text differ before and after."""
    for _ in range(3 if symbols.dtype == np.uint8 else 4):
        symbols = _toss(symbols, begin)
    return symbols


def next_level(symbols: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases over bytes or names, and each text's first phrase.

    ``begin`` are the first places of the texts, none of which is empty.
    """
    # runs of an equal symbol; neighbouring runs differ in their symbol, so the tosses look at that alone
    head = np.ones(len(symbols), bool)
    head[1:] = symbols[1:] != symbols[:-1]
    head[begin] = True
    at = np.flatnonzero(head)
    length = np.diff(np.append(at, len(symbols)))
    symbols = symbols[at]
    begin = np.searchsorted(at, begin)
    names = _BYTE_NAMES[symbols] if symbols.dtype == np.uint8 else symbols.copy()
    runs = np.flatnonzero(length > 1)
    names[runs] = mix(names[runs] ^ mix(length[runs].astype(_U64) * _GOLDEN))
    # a phrase begins at each peak among the labels
    label = labels(symbols, begin)
    peak = np.zeros(len(symbols), bool)
    peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    peak[begin - 1] = False  # neighbours are those of the same text only
    peak[begin] = True
    at = np.flatnonzero(peak)
    size = np.diff(np.append(at, len(symbols)))
    place = np.arange(len(symbols)) - np.repeat(at, size)
    total = np.add.reduceat(names * _PLACE[place], at)
    return mix(total + size.astype(_U64) * _GOLDEN), np.searchsorted(at, begin)


def _sketches(names: np.ndarray, begin: np.ndarray) -> Iterator[str]:
    """For each text of a level: number of phrases and the smallest of their hashes.

    The second, third and so on occurrence of a phrase count as further members, so a text
    that repeats itself is not reduced to a few phrases.
    """
    size = np.diff(np.append(begin, len(names)))
    row = np.repeat(np.arange(len(begin), dtype=_U64) << _ROW_SHIFT, size)
    key = np.sort(row | (names >> _NAME_SHIFT))
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    occurrence = np.arange(len(key)) - np.repeat(at, np.diff(np.append(at, len(key))))
    hashes = mix(key - row + occurrence.astype(_U64) * _GOLDEN)
    key = np.sort(row | (hashes >> _NAME_SHIFT))
    hashes = ((key - row) >> _U64(12)).astype(">u4")
    for first, n in zip(begin.tolist(), size.tolist(), strict=True):
        yield f"{n}:" + hashes[first : first + min(n, KEEP)].tobytes().hex()


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Fingerprint of each row of a UTF-8 buffer."""
    open_rows = np.flatnonzero(np.diff(offsets) > 0)
    out = [EMPTY] * (len(offsets) - 1)
    held: dict[int, list[str]] = {row: [] for row in open_rows.tolist()}
    symbols, begin, level = data, offsets[:-1][open_rows], 0
    while len(open_rows):
        symbols, begin = next_level(symbols, begin)
        level += 1
        if level <= TOP:
            for row, sketch in zip(open_rows.tolist(), _sketches(symbols, begin), strict=True):
                held[row].append(sketch)
        size = np.diff(np.append(begin, len(symbols)))
        done = size == 1
        for row, name in zip(open_rows[done].tolist(), symbols[begin[done]].tolist(), strict=True):
            out[row] = "/".join([f"{name:016x}", *held[row]])
        if done.any():
            symbols, size, open_rows = symbols[np.repeat(~done, size)], size[~done], open_rows[~done]
            begin = np.cumsum(size) - size
    return out


def _levels(fingerprint: str) -> list[tuple[int, list[str]]]:
    found = []
    for part in fingerprint.split("/")[1:]:
        count, hashes = part.split(":")
        found.append((int(count), [hashes[k : k + 8] for k in range(0, len(hashes), 8)]))
    return found


def likeness(a: str, b: str) -> float:
    """0 to 1, from two fingerprints alone."""
    if a.split("/", 1)[0] == b.split("/", 1)[0]:
        return 1.0
    if EMPTY in (a, b):
        return 0.0
    both = list(zip(_levels(a), _levels(b), strict=False))
    enough = [pair for pair in both if min(pair[0][0], pair[1][0]) >= ENOUGH]
    (n, x), (m, y) = (enough or both[:1])[-1]
    x, y = set(x), set(y)
    if max(n, m) <= KEEP:
        return 2 * len(x & y) / (len(x) + len(y))
    smallest = sorted(x | y)[:KEEP]
    shared = sum(h in x and h in y for h in smallest) / len(smallest)
    return 2 * shared / (1 + shared)


def _parsed(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
    """Row ranges of bounded size with their fingerprints."""
    for a, b in slices(offsets, _SLICE):
        yield a, b, fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` of each whole text; no shuffle."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, found in _parsed(*utf8(batch.column(1))):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(found, pa.string())], ["doc_id", "fingerprint"]
                )

    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return map_arrow(narrow, step, "doc_id long, fingerprint string")


def char_starts(text: bytes) -> np.ndarray:
    return np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)


def with_end_replaced(text: bytes, following: bytes, share: int) -> bytes:
    """The last 1/share of the code points gives way to as many (or all) first ones of another text."""
    starts, others = char_starts(text), char_starts(following)
    n = len(starts) // share
    if n == 0:
        return text
    return text[: starts[-n]] + (following if n >= len(others) else following[: others[n]])


def _hex(value: Column) -> Column:
    return F.lpad(F.hex(value), 16, "0")


def _consecutive_parts(docs: DataFrame, key: str, text: str) -> DataFrame | None:
    """``part, is_head, place, doc_id, text``: documents in descending id, cut into parts.

    Ties of the id are ordered by the text's hash, then by position, so no id makes a part that
    cannot be cut.  Cuts are documents of a sample of ``OVERSAMPLE`` a part; they decide how work
    spreads, never the result.  A cut is the first document of its part, so each part ends with
    a copy of the next one's cut (``is_head``), the last part with the first document of all.
    """
    spark = docs.sparkSession
    number = F.col(f"`{key}`").cast("long")
    rows = docs.select(number.alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).select(
        "doc_id",
        "text",
        F.concat(
            F.when(F.col("doc_id").isNull(), "1").otherwise("0"),
            _hex(F.coalesce("doc_id", F.lit(0)).bitwiseXOR(F.lit(2**63 - 1))),  # descending
            _hex(F.xxhash64("text")),
            _hex(F.monotonically_increasing_id()),
        ).alias("place"),
    )
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).first()
    if whole.n == 0:
        return None
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sampled = rows.select("place").sample(fraction=min(1.0, OVERSAMPLE * parts / whole.n), seed=7)
    cuts = sorted(r.place for r in bounded_rows(sampled))[OVERSAMPLE::OVERSAMPLE]

    @F.pandas_udf("int")
    def part_of(place: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(cuts, p) for p in place], dtype="int32")

    heads = spark.createDataFrame([*((c, k) for k, c in enumerate(cuts)), (whole.first, len(cuts))], "place string, part int")
    placed = rows.select(part_of("place").alias("part"), F.lit(False).alias("is_head"), *rows.columns)
    copies = rows.join(F.broadcast(heads), "place").select("part", F.lit(True).alias("is_head"), *rows.columns)
    return placed.union(copies).repartition("part").sortWithinPartitions("part", "is_head", "place")


COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compare_with_next(docs: DataFrame, share: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document beside an edited copy and beside the next document, by their fingerprints.

    Documents follow each other in descending id (nulls last), the first comes after the last, and
    the edited copy is ``with_end_replaced`` by the next document.  Texts are shuffled once;
    a task reads its documents in order and holds one slice and the document before it.
    """
    rows = _consecutive_parts(docs, key, text)
    if rows is None:
        return docs.sparkSession.createDataFrame([], COMPARED)

    def compared(ids: list, texts: list[bytes], prints: list[str]) -> pa.RecordBatch:
        edited = [with_end_replaced(x, y, share) for x, y in zip(texts, texts[1:], strict=False)]
        offsets = np.cumsum([0, *map(len, edited)])
        changed = [p for _, _, found in _parsed(np.frombuffer(b"".join(edited), np.uint8), offsets) for p in found]
        columns = (
            ids,
            [len(char_starts(x)) for x in texts[:-1]],
            [hashlib.sha256(x).hexdigest() for x in edited],
            prints[:-1],
            changed,
            [likeness(p, q) for p, q in zip(prints, changed, strict=False)],
            [likeness(p, q) for p, q in zip(prints, prints[1:], strict=False)],
        )
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = [c.split()[0] for c in COMPARED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, prints = [], [], []  # the document before, if its next one has not come yet
        for batch in batches:
            head = batch.column(1).to_pylist()
            number = batch.column(2).to_pylist()
            data, offsets = utf8(batch.column(3))
            for a, b, found in _parsed(data, offsets):
                for k in range(a, b):
                    ids.append(number[k])
                    texts.append(data[offsets[k] : offsets[k + 1]].tobytes())
                    prints.append(found[k - a])
                    if head[k]:
                        if len(texts) > 1:
                            yield compared(ids[:-1], texts, prints)
                        ids, texts, prints = [], [], []
                if len(texts) > 1:
                    yield compared(ids[:-1], texts, prints)
                    ids, texts, prints = ids[-1:], texts[-1:], prints[-1:]
        if texts:
            raise RuntimeError("the documents changed between two readings of the input")

    return map_arrow(rows.drop("place"), step, COMPARED)
