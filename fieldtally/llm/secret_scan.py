"""Secret scan: patterns find candidates, structure confirms what patterns alone cannot.

Three plain kinds come straight from patterns: ``assign`` (a value assigned to a telling name),
``access`` (access key ids) and ``hex`` (long hexadecimal runs).  Further kinds are reported
only after their bytes parse: base64 or hexadecimal digits are decoded from every place where a key
can begin, over line ends, blanks, joined string literals and the escapes that JSON and source code
write for line ends (``BREAK``), and must hold a private key, that is a DER sequence whose nested lengths close exactly and whose members are those of a
PKCS#1, PKCS#8, encrypted PKCS#8 or EC key (``der``), or the binary OpenSSH container with
consistent lengths (``openssh``); armoured blocks must hold one of these (``pem``, which stands for
a broken run inside it too); signed
tokens must have a JSON header that names an algorithm and a JSON object as claims (``jwt``).

Spans are in code points, end exclusive.  Candidate rows are found on raw bytes by whole-batch
scans; only rows that can hold a secret are decoded and matched.

Defined cases: a null text counts as empty; an empty table gives an empty result; repeated rows
are scanned each for itself; spans that start alike are ordered by kind as listed in ``KINDS``,
then by end; a null doc_id passes through; further columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.llm.text import LOWER, map_arrow, slices, utf8

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "der", "openssh", "pem", "jwt")
REPLACEMENT = "[SECRET]"

# The plain patterns and the least lengths of what they capture.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24

# What may stand between two digits of a key: blanks, escapes (doubled ones too), ends of joined literals.
BREAK = r"""(?:[ \t\r\n\f\v]|\\+[nrt]|\\+(?=[\s/"'])|["'`][ \t\r\n]*[+.,]?[ \t\r\n]*["'`])*"""
DIGIT = {"base64": "[A-Za-z0-9+/_-]", "hex": "[0-9A-Fa-f]"}
PIECE = {form: re.compile(f"({digit}+){BREAK}") for form, digit in DIGIT.items()}
ESCAPE = re.compile(r"\\+[nr]")
LITERAL = re.compile(r"""["'`]\s*[+.,]?\s*["'`]|[\s\\"'`]""")
PADDING = re.compile("={0,2}")
ARMOUR = re.compile(r"""-----BEGIN ([A-Z ]{0,30})PRIVATE KEY-----([A-Za-z0-9+/=\s:,.\\"'`-]*?)-----END \1PRIVATE KEY-----""")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
OPENSSH_MAGIC = b"openssh-key-v1\x00"


def _begins(digits: list[str], more: str, least: int) -> str:
    """Pattern of a first digit that is followed by the others and by at least so many more."""
    return f"{digits[0]}(?={BREAK}{BREAK.join(digits[1:])}(?:{BREAK}{more}){{{least}}})"


STARTS = {
    ("base64", "der"): _begins(["M", "[A-P]"], DIGIT["base64"], 16),
    ("base64", "openssh"): _begins([*base64.b64encode(OPENSSH_MAGIC).decode()], DIGIT["base64"], 16),
    ("hex", "der"): _begins(["3", "0"], DIGIT["hex"], 24),
    ("hex", "openssh"): _begins([f"[{x}{x.upper()}]" for x in OPENSSH_MAGIC.hex()], DIGIT["hex"], 24),
}
START = {place: re.compile(pattern) for place, pattern in STARTS.items()}
ANY_START = re.compile("|".join(STARTS.values()).encode())

_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[*b"0123456789abcdef"]] = True


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value at a place; None unless it closes within ``end``."""
    if at + 2 > end:
        return None
    tag, size = data[at], data[at + 1]
    at += 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        at += n
    return (tag, at, at + size) if at + size <= end else None


def _members(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """All values between two places; None unless they fill the room exactly."""
    found = []
    while at < end:
        one = _tlv(data, at, end)
        if one is None:
            return None
        found.append(one)
        at = one[2]
    return found


def der_key_length(data: bytes) -> int:
    """Bytes of the private key at the start of ``data``, 0 if there is none."""
    outer = _tlv(data, 0, len(data))
    if outer is None or outer[0] != 0x30:
        return 0
    inner = _members(data, outer[1], outer[2])
    if not inner or len(inner) < 2:
        return 0
    tags = [m[0] for m in inner]
    first = data[inner[0][1] : inner[0][2]]

    def algorithm(member: tuple[int, int, int]) -> bool:
        parts = _members(data, member[1], member[2])
        return bool(parts) and parts[0][0] == 0x06 and parts[0][2] > parts[0][1]

    rsa = tags[:9] == [0x02] * 9 and first in (b"\x00", b"\x01")
    dsa = tags == [0x02] * 6 and first == b"\x00"
    pkcs8 = tags[:3] == [0x02, 0x30, 0x04] and first in (b"\x00", b"\x01") and algorithm(inner[1])
    locked = tags == [0x30, 0x04] and algorithm(inner[0]) and inner[1][2] - inner[1][1] >= 16
    ec = tags[:2] == [0x02, 0x04] and first == b"\x01" and inner[1][2] - inner[1][1] >= 20 and set(tags[2:]) <= {0xA0, 0xA1}
    return outer[2] if rsa or dsa or pkcs8 or locked or ec else 0


def openssh_key_length(data: bytes) -> int:
    """Bytes of the OpenSSH container at the start of ``data``, 0 if its lengths do not hold."""
    if not data.startswith(OPENSSH_MAGIC):
        return 0
    at = len(OPENSSH_MAGIC)

    def field() -> bool:
        nonlocal at
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at <= len(data)

    if not (field() and field() and field()) or at + 4 > len(data):
        return 0
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 64 or not all(field() for _ in range(keys + 1)):
        return 0
    return at


def _decoded(text: str) -> bytes:
    """Base64 of either alphabet without regard to padding; empty if it does not decode."""
    text = text.rstrip("=").translate({ord("-"): "+", ord("_"): "/"})
    text = text[: len(text) - (len(text) % 4 == 1)]
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _digits(text: str, at: int, form: str, least: int) -> tuple[str, list[tuple[int, int]]]:
    """Digits from a place on, breaks left out, until there are enough, and (digits before, place) of each piece."""
    pieces, places, n = [], [], 0
    while n < least:
        m = PIECE[form].match(text, at)
        if m is None:
            break
        places.append((n, at))
        pieces.append(m.group(1))
        n, at = n + len(pieces[-1]), m.end()
    return "".join(pieces), places


def _raw(digits: str, form: str) -> bytes:
    return _decoded(digits) if form == "base64" else bytes.fromhex(digits[: len(digits) // 2 * 2])


def _der_head(data: bytes) -> int:
    """Bytes that a key announces, 0 where its first member cannot be a key's."""
    outer = _tlv(data, 0, 1 << 40) if len(data) >= 13 else None
    inner = outer and outer[0] == 0x30 and _tlv(data, outer[1], outer[2])
    if not inner:
        return 0
    version = inner[0] == 0x02 and inner[2] - inner[1] == 1 and data[inner[1]] in (0, 1)
    return outer[2] if version or (inner[0] == 0x30 and data[inner[1]] == 0x06) else 0


def _encoded_keys(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Keys in base64 or hexadecimal digits from every place where one can begin, and whether breaks are inside."""
    for (form, kind), start in START.items():
        done = 0
        size_of = lambda n: -(-n * 4 // 3) if form == "base64" else 2 * n  # noqa: B023, E731
        for m in start.finditer(text):
            at = m.start()
            if at < done:
                continue
            head = _raw(_digits(text, at, form, size_of(21))[0][: size_of(21)], form)
            if kind == "der":
                size = _der_head(head)
                if not size or size_of(size) > len(text) - at:
                    continue
                digits, places = _digits(text, at, form, size_of(size))
                size = der_key_length(_raw(digits[: size_of(size)], form))
            else:
                first = int.from_bytes(head[len(OPENSSH_MAGIC) : len(OPENSSH_MAGIC) + 4], "big")
                if size_of(first) > len(text) - at:
                    continue
                digits, places = _digits(text, at, form, len(text))
                size = openssh_key_length(_raw(digits, form))
            if size:
                n = size_of(size)
                before, place = places[bisect.bisect_left(places, (n, 0)) - 1]
                done = place + n - before
                broken = done - at > n
                if form == "base64":
                    done = PADDING.match(text, done).end()
                yield kind, at, done, broken


def _json_object(part: str) -> dict:
    try:
        found = json.loads(_decoded(part))
    except (ValueError, RecursionError):
        return {}
    return found if isinstance(found, dict) else {}


def find_secrets(text: str, runs: bool = True) -> list[tuple[str, int, int]]:
    """All spans of a text, in order.  ``runs=False`` skips the search for encoded keys."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    keys: list[tuple[str, int, int, bool]] = []
    if runs:
        keys = list(_encoded_keys(text))
    if "-----BEGIN" in text:
        for m in ARMOUR.finditer(text):
            lines = [x for x in ESCAPE.sub("\n", m.group(2)).split("\n") if ":" not in x]  # headers of old armour
            raw = _decoded(LITERAL.sub("", "".join(lines)))
            locked = "ENCRYPTED" in m.group(2) and len(raw) >= 64
            if der_key_length(raw) or openssh_key_length(raw) or locked:
                found.append(("pem", m.start(), m.end()))
                keys = [k for k in keys if not (k[3] and m.start() <= k[1] and k[2] <= m.end())]
    found += [k[:3] for k in keys]
    if "eyJ" in text:
        for m in JWT.finditer(text):
            if isinstance(_json_object(m.group(1)).get("alg"), str) and _decoded(m.group(2))[:1] == b"{" and _json_object(m.group(2)):
                found.append(("jwt", m.start(), m.end()))
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _long_runs(flags: np.ndarray, least: int, offsets: np.ndarray) -> np.ndarray:
    """Starts of runs of at least so many flagged bytes; runs end with their row."""
    begin, finish = flags.copy(), flags.copy()
    begin[1:] &= ~flags[:-1]
    finish[:-1] &= ~flags[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(flags))]
    begin[edge] |= flags[edge]
    finish[edge - 1] |= flags[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts[ends - starts >= least]


def suspects(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that can hold any secret, and those where an encoded key can begin."""
    raw, low = data.tobytes(), LOWER[data].tobytes()
    places = []
    for text, words in ((low, (b"passw", b"secret", b"token", b"api")), (raw, (b"AKIA", b"-----BEGIN", b"eyJ"))):
        for word in words:
            at = text.find(word)
            while at >= 0:
                places.append(at)
                at = text.find(word, at + 1)
    begins = np.array([m.start() for m in ANY_START.finditer(raw)], np.int64)
    rows = len(offsets) - 1
    runs, some = np.zeros(rows, bool), np.zeros(rows, bool)
    runs[np.searchsorted(offsets, begins, "right") - 1] = True
    every = np.concatenate([np.array(places, np.int64), _long_runs(_HEX_BYTE[data], HEX_LENGTH, offsets), begins])
    some[np.searchsorted(offsets, every, "right") - 1] = True
    return some, runs


def _scan(column: pa.Array) -> Iterator[tuple[int, int, dict[int, list[tuple[str, int, int]]], np.ndarray, np.ndarray]]:
    data, offsets = utf8(column)
    for a, b in slices(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        some, runs = suspects(part, at)
        spans = {}
        for row in np.flatnonzero(some).tolist():
            got = find_secrets(part[at[row] : at[row + 1]].tobytes().decode("utf-8", "replace"), bool(runs[row]))
            if got:
                spans[row] = got
        yield a, b, spans, part, at


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``spans``: array of (kind, start, end) of each whole text."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, spans, _, _ in _scan(batch.column(1)):
                lists = [[{"kind": k, "start": s, "end": e} for k, s, e in spans.get(row, ())] for row in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(lists, _SPANS)], ["doc_id", "spans"])

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_arrow(narrow, step, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def spans_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, replacement: str = REPLACEMENT) -> DataFrame:
    """The documents with every secret replaced; overlapping spans go as one.  ``n_chars`` follows."""

    def clean(part: np.ndarray, spans: list[tuple[str, int, int]]) -> str:
        text, out, done = part.tobytes().decode("utf-8", "replace"), [], 0
        for _, start, end in spans:
            if start >= done:
                out += [text[done:start], replacement]
            done = max(done, end)
        return "".join([*out, text[done:]])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, spans, part, at in _scan(batch.column(batch.schema.get_field_index("__text"))):
                rows = batch.slice(a, b - a)
                fixed: list[str | None] = [None] * (b - a)
                for row, got in spans.items():
                    fixed[row] = clean(part[at[row] : at[row + 1]], got)
                columns = [*rows.columns, pa.array(fixed, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "__fixed"])

    tagged = docs.withColumnRenamed("text", "__text")
    schema = T.StructType([*tagged.schema.fields, T.StructField("__fixed", T.StringType())])
    done = map_arrow(tagged, step, schema)
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.coalesce("__fixed", "__text").alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("__fixed").isNotNull(), F.length("__fixed").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return done.select(*out)
