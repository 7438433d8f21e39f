"""Ids of public tokenizers for many texts, each distinct word encoded once per batch.

Both encoders give exactly the ids of ``tokenizers`` for the same file and
``add_special_tokens=False``.  They split a text at places that no rule of the tokenizer can
look across, encode the distinct pieces not yet known in one call, and put the ids of known
pieces together.  A text with anything unusual (special tokens, irregular white space, rare
characters) goes whole through the ``tokenizers`` library.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections.abc import Iterable, Sequence

import numpy as np

CACHE_PIECES = 500_000

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@functools.cache
def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free
    code point from 256 on for bytes that are blank or controls."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)}


class _Encoder:
    """Splits texts into pieces; knows the ids of pieces seen lately (little-endian, 4 bytes each)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        self.vocab = self.spec["model"]["vocab"]
        self.added = [t["content"] for t in self.spec["added_tokens"]]
        self.size = self.plain.get_vocab_size(with_added_tokens=True)
        self.known: dict[str, bytes | None] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def pieces(self, text: str) -> list[str] | None:
        """The pieces of a text, None if it must go whole."""
        raise NotImplementedError

    def learn(self, pieces: Iterable[str]) -> None:
        """Puts the ids of new pieces into ``known``, None for a piece that must not stand alone."""
        raise NotImplementedError

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 4-byte integers; null counts as empty."""
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        get, out, later = self.known.__getitem__, [], []
        for k, text in enumerate(texts):
            pieces = self.pieces(text) if text else []
            try:
                out.append(self.whole(text) if pieces is None else b"".join(map(get, pieces)))
            except TypeError:  # an irregular piece
                out.append(self.whole(text))
            except KeyError:  # a new piece
                out.append(b"")
                later.append((k, pieces))
        if later:
            self.learn(set().union(*(pieces for _, pieces in later)).difference(self.known))
        for k, pieces in later:
            try:
                out[k] = b"".join(map(get, pieces))
            except TypeError:
                out[k] = self.whole(texts[k])
        return out


class ByteEncoder(_Encoder):
    """Byte-level BPE: a single space between two other characters always begins a new word."""

    def __init__(self, path: str):
        super().__init__(path)
        import tiktoken

        back = {s: b for b, s in byte_symbols().items()}
        ranks = {bytes(back[c] for c in t): i for t, i in self.vocab.items() if t not in self.added}
        # Fixed value: the split pattern of this kind of vocabulary.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(max(self.vocab.values()) + 1, bool)
        self.opens[[i for t, i in self.vocab.items() if t.startswith(byte_symbols()[32])]] = True

    def pieces(self, text: str) -> list[str] | None:
        if "\x00" in text or any(a in text for a in self.added):
            return None
        # "\x00" marks the piece that has no space before it
        first, *rest = text.split(" ")
        return ["\x00" + first, *rest]

    def learn(self, pieces: Iterable[str]) -> None:
        joined = []
        for p in pieces:
            if p[:1] == "\x00":
                self.known[p] = (
                    None if len(p) == 1 or p[-1].isspace() else np.array(self.fast.encode_ordinary(p[1:]), "<u4").tobytes()
                )
            elif not p or p[0].isspace() or p[-1].isspace():
                self.known[p] = None
            else:
                joined.append(p)
        ids = np.array(self.fast.encode_ordinary("".join(" " + p for p in joined)), "<u4")
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(joined):  # not expected; then one by one
            for p in joined:
                self.known[p] = np.array(self.fast.encode_ordinary(" " + p), "<u4").tobytes()
            return
        raw, cuts = ids.tobytes(), [*(starts * 4).tolist(), len(ids) * 4]
        for k, p in enumerate(joined):
            self.known[p] = raw[cuts[k] : cuts[k + 1]]


class WordEncoder(_Encoder):
    """BPE with word ends on lower-cased words; white space only separates."""

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer, models, pre_tokenizers

        model = self.spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.bpe = Tokenizer(models.BPE(self.vocab, merges, end_of_word_suffix=model["end_of_word_suffix"]))
        self.bpe.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.closes = np.zeros(max(self.vocab.values()) + 1, bool)
        self.closes[[i for t, i in self.vocab.items() if t.endswith(model["end_of_word_suffix"])]] = True
        plain = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xA1, 0x180))]
        plain = [c for c in plain if len(c.lower()) == 1 and ord(c.lower()) < 0x180 and unicodedata.normalize("NFC", c) == c]
        self.allowed = frozenset(plain)
        lowered = sorted({c.lower() for c in plain})
        letters = re.escape("".join(c for c in lowered if unicodedata.category(c)[0] == "L"))
        numbers = re.escape("".join(c for c in lowered if unicodedata.category(c)[0] == "N"))
        # Fixed value: the split rule of this vocabulary, with its classes spelled out for plain characters.
        self.rule = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+").findall
        self.table = byte_symbols()
        self.words: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str] | None:
        # separators that only one side takes for white space; other rare characters show in the pieces
        if any(c in text for c in "\x1c\x1d\x1e\x1f") or any(a in text for a in self.added):
            return None
        return text.lower().split()

    def learn(self, pieces: Iterable[str]) -> None:
        pieces, strange = list(pieces), set()
        for p in pieces:
            if not (p.isascii() and p.isprintable()) and not self.allowed.issuperset(p):
                strange.add(p)
        self.known.update(dict.fromkeys(strange))  # None: such texts go whole
        pieces = [p for p in pieces if p not in strange] if strange else pieces
        found = [self.rule(p) for p in pieces]
        if len(self.words) > CACHE_PIECES:
            self.words.clear()
        new = list(set().union(*found).difference(self.words))
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            mapped = " ".join(part).encode().decode("latin-1").translate(self.table).replace(self.table[32], " ")
            ids = np.array(self.bpe.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("word ends do not match the words")
            raw, cuts = ids.tobytes(), [0, *(ends * 4).tolist()]
            for i, w in enumerate(part):
                self.words[w] = raw[cuts[i] : cuts[i + 1]]
        get = self.words.__getitem__
        for p, words in zip(pieces, found, strict=True):
            self.known[p] = b"".join(map(get, words))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> _Encoder:
    """The encoder of a file, made once per worker."""
    with open(path, encoding="utf-8") as file:
        suffix = json.load(file)["model"].get("end_of_word_suffix")
    return WordEncoder(path) if suffix else ByteEncoder(path)
