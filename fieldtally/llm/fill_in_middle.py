"""Fill-in-the-middle: a text's blocks are exchanged in place by rotations, and rotated back.

A text is cut at two places into prefix, middle and suffix, and three sentinels go in before
the blocks, in a ``bytearray``: ``<P>prefix<M>middle<S>suffix``.  Two neighbouring blocks
change places by three reversals (each block, then both as one), which needs no second buffer.
One exchange (middle and suffix) gives the form *psm*, a second one (prefix and suffix) the
form *spm*.  Restoring finds the sentinels, undoes the exchanges in reverse order and takes the
sentinels out, so the text comes back byte for byte.

Cuts lie between units, ``[A-Za-z]+`` or one other code point, and are drawn from the sha256 of
``<seed>:<id>``, so that a rerun, on whatever machine, makes the same ones.

Defined cases: a null text counts as empty; an empty text, one that holds a sentinel and a
document outside the drawn share stay plain (the output is the text, no cuts); both cuts may
fall on one place or on an end, which leaves blocks empty; a null id is drawn as the text
``null``; repeated rows get equal results, one each; an empty table gives an empty result;
columns besides the id and the text are ignored.  A worker's memory follows the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.llm.text import map_arrow, slices, utf8

PREFIX, MIDDLE, SUFFIX = b"<P>", b"<M>", b"<S>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
PLAIN, PSM, SPM = "plain", "psm", "spm"

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[ord("a") : ord("z") + 1] = True


@dataclass(frozen=True)
class Plan:
    """How often to transform: percent of documents, and percent of those in the form *spm*."""

    seed: int = 1
    percent: int = 90
    spm_percent: int = 20

    def draws(self, doc_id: int | None) -> tuple[int, int, int, int]:
        """Four numbers of 32 bits: two for the cuts, one for whether, one for the form."""
        name = "null" if doc_id is None else str(doc_id)
        digest = hashlib.sha256(f"{self.seed}:{name}".encode()).digest()
        return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Byte positions where units begin in UTF-8 text."""
    letter = _LETTER[data]
    begin = (data & 0xC0) != 0x80
    begin[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begin)


def _reverse(view: np.ndarray, start: int, end: int) -> None:
    half = (end - start) // 2
    left = view[start : start + half].copy()
    view[start : start + half] = view[end - half : end][::-1]
    view[end - half : end] = left[::-1]


def exchange(buffer: bytearray, start: int, between: int, end: int) -> int:
    """Blocks [start, between) and [between, end) change places; returns where they meet now."""
    view = np.frombuffer(buffer, np.uint8)
    _reverse(view, start, between)
    _reverse(view, between, end)
    _reverse(view, start, end)
    return start + end - between


def to_form(text: bytes, first: int, second: int, form: str) -> bytearray:
    """A text, cut at two byte positions, in the form *psm* or *spm*."""
    buffer = bytearray(text)
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[0:0] = PREFIX
    middle = first + len(PREFIX)
    suffix = second + len(PREFIX) + len(MIDDLE)
    middle_now = exchange(buffer, middle, suffix, len(buffer))
    if form == SPM:
        exchange(buffer, 0, middle, middle_now)
    return buffer


def restore(output: bytes, form: str) -> bytes:
    """The text behind an output of ``to_form``; a plain output is the text itself."""
    if form == PLAIN:
        return bytes(output)
    buffer = bytearray(output)
    middle_now = buffer.index(MIDDLE)
    if form == SPM:
        middle = exchange(buffer, 0, buffer.index(PREFIX), middle_now)
    else:
        middle = buffer.index(SUFFIX)
    suffix = exchange(buffer, middle, middle_now, len(buffer))
    del buffer[suffix : suffix + len(SUFFIX)]
    del buffer[middle : middle + len(MIDDLE)]
    del buffer[: len(PREFIX)]
    return bytes(buffer)


@dataclass(frozen=True)
class Transformed:
    """One document's result; the lengths count code points and are None where it stays plain."""

    n_units: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def transform(text: bytes, doc_id: int | None, plan: Plan = Plan()) -> Transformed:
    data = np.frombuffer(text, np.uint8)
    starts = unit_starts(data)
    n = len(starts)
    h1, h2, h3, h4 = plan.draws(doc_id)
    if n == 0 or h3 % 100 >= plan.percent or any(s in text for s in SENTINELS):
        return Transformed(n, PLAIN, None, None, text)
    places = np.append(starts, len(data))
    first, second = (int(places[k]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    chars = (data & 0xC0) != 0x80
    form = SPM if h4 % 100 < plan.spm_percent else PSM
    lengths = [int(np.count_nonzero(part)) for part in (chars[:first], chars[first:second])]
    return Transformed(n, form, *lengths, bytes(to_form(text, first, second, form)))


def _strings(values: list[bytes]) -> pa.Array:
    """Text as it came: bytes that are not UTF-8 pass through unchanged."""
    return pa.array(values, pa.binary()).cast(pa.string(), safe=False)


def fill_in_middle(docs: DataFrame, plan: Plan = Plan(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of each row, from its whole text."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                done = [transform(data[offsets[k] : offsets[k + 1]].tobytes(), ids[k], plan) for k in range(a, b)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([t.n_units for t in done], pa.int64()),
                        pa.array([t.form for t in done], pa.string()),
                        pa.array([t.prefix_chars for t in done], pa.int64()),
                        pa.array([t.middle_chars for t in done], pa.int64()),
                        _strings([t.output for t in done]),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return map_arrow(narrow, step, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore_text(transformed: DataFrame) -> DataFrame:
    """The same rows with a further column ``restored``, rebuilt from ``output`` and ``form`` alone."""
    if "restored" in transformed.columns:
        raise ValueError("the table already has a column named restored")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = batch.column(batch.schema.get_field_index("form")).to_pylist()
            data, offsets = utf8(batch.column(batch.schema.get_field_index("output")))
            for a, b in slices(offsets):
                texts = [restore(data[offsets[k] : offsets[k + 1]].tobytes(), forms[k]) for k in range(a, b)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, _strings(texts)],
                    [*batch.schema.names, "restored"],
                )

    schema = T.StructType([*transformed.schema.fields, T.StructField("restored", T.StringType())])
    return map_arrow(transformed, step, schema)
