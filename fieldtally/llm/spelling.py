"""Spelling variants: words one edit apart, found by pivotal grams, and the form each belongs to.

1. Words are counted over whole texts; counts are summed in tasks before the shuffle.
2. Bigrams are ranked by how many words hold them, rare first.  A word's *prefix* is every
   occurrence of its three rarest bigrams (all that tie with the third included).  Its two
   *pivots* are the disjoint prefix bigrams of smallest total frequency, by dynamic programming.
3. One edit spoils at most one of two disjoint bigrams.  So of two near words, the one whose
   prefix ends earlier in the ranking has a pivot in the other's prefix.  Pivots are indexed
   against prefixes by an equi-join.  Position limits: the edit lies before or in the first
   pivot, between the two, or behind; what lies beyond a surviving pivot is unchanged, so the key is
   the pivot with all of that, and the length of the changed part, which differs by one at most.
4. Candidates are verified by edit distance, in the join itself.
5. A word's form is its near word of largest count, if that is ``factor`` times its own or more.
   Counts grow along forms, so chains are short, and pointer doubling finds their ends.

The ranking is the only table that every task holds: its alphabet is fixed, so it has at most
90 * 90 bigrams.  Index entries of keys with more than ``LIST`` prefixes are dealt over salted
blocks, so no list is one task's.

Defined cases: a null text has no words; a null id is hashed as the text ``null``; repeated rows
count again; words that tie in count are taken in code-point order; a table without words gives
an empty result; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.text import LOWER, bounded_rows, map_arrow, slices, utf8
from fieldtally.session import cut_lineage

LETTERS = "a-zÀ-ÿ"  # after A-Z are lower-cased
RUN = re.compile(f"[{LETTERS}]+")
LIST = 4096
_HELD = 200_000  # words a task counts before it sends them on


@dataclass(frozen=True)
class Words:
    """Which words take part, and one run in how many loses a letter (0: none)."""

    least_length: int = 6
    least_count: int = 5
    drop_one_in: int = 199

    def __post_init__(self) -> None:
        if self.least_length < 4:
            raise ValueError("words of fewer than four letters have no three bigrams")


def damaged(run: str, doc_id: int | None, every: int) -> str:
    """The run, or the run without one letter where its hash with the id says so."""
    if not every:
        return run
    h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, words: Words = Words(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n`` over all documents."""

    def table(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"]
        )

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                low = LOWER[data[offsets[a] : offsets[b]]].tobytes()
                for k in range(a, b):
                    runs = RUN.findall(low[offsets[k] - offsets[a] : offsets[k + 1] - offsets[a]].decode("utf-8", "replace"))
                    for run, times in Counter(runs).items():
                        if len(run) >= words.least_length:  # losing a letter never makes a run longer
                            word = damaged(run, ids[k], words.drop_one_in)
                            if len(word) >= words.least_length:
                                counts[word] += times
                if len(counts) > _HELD:
                    yield table(counts)
                    counts.clear()
        yield table(counts)

    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    counted = map_arrow(narrow, step, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= words.least_count)


def bigrams(word: str) -> list[str]:
    return [word[k : k + 2] for k in range(len(word) - 1)]


def bigram_frequencies(vocabulary: DataFrame) -> dict[str, int]:
    """Number of words that hold each bigram: at most 90 * 90 entries."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                counts.update(set(bigrams(word)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["gram", "n"]
        )

    grams = map_arrow(vocabulary.select("word"), step, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in bounded_rows(grams)}


def choose_pivots(places: Sequence[int], weights: Sequence[int], count: int = 2, width: int = 2) -> list[int]:
    """Indexes of ``count`` grams that do not overlap and have the smallest total weight.

    ``places`` ascend.  ``best[c]`` holds, for the grams so far, the cheapest choice of c of them; a gram joins the
    best choice among those that end before it.
    """
    history: list[list[tuple[float, tuple[int, ...]]]] = [[(0, ())] + [(float("inf"), ())] * count]
    for k, place in enumerate(places):
        before = next(j for j in range(k, -1, -1) if j == 0 or places[j - 1] + width <= place)
        row = list(history[k])
        for c in range(1, count + 1):
            cost, chosen = history[before][c - 1]
            row[c] = min(row[c], (cost + weights[k], (*chosen, k)))
        history.append(row)
    return list(history[-1][count][1])


@dataclass(frozen=True)
class Signature:
    """Places of the prefix and of the two pivots, and the rank where the prefix ends."""

    prefix: list[int]
    pivots: list[int]
    last: int


class Ranking:
    """Bigrams by frequency, then by letters."""

    def __init__(self, frequencies: dict[str, int]):
        self.frequency = frequencies
        self.rank = {g: k for k, g in enumerate(sorted(frequencies, key=lambda g: (frequencies[g], g)))}

    def signature(self, word: str) -> Signature:
        grams = bigrams(word)
        ranks = [self.rank[g] for g in grams]
        last = sorted(ranks)[2]
        prefix = [k for k, r in enumerate(ranks) if r <= last]
        pivots = choose_pivots(prefix, [self.frequency[grams[k]] for k in prefix])
        return Signature(prefix, [prefix[k] for k in pivots], last)


def pivot_keys(word: str, first: int, second: int) -> list[str]:
    """What one edit leaves unchanged: it lies before or in the first pivot, behind or in the second, or between.

    The changed part's length, which a key begins with, differs by one at most between near words.
    """
    parts = (
        (first + 2, ">" + word[first + 2 :]),
        (len(word) - second, "<" + word[:second]),
        (second - first - 2, "=" + word[: first + 2] + "|" + word[second:]),
    )
    return [f"{size + d}{part}" for size, part in parts for d in (-1, 0, 1) if size + d >= 0]


def prefix_keys(word: str, prefix: Sequence[int]) -> list[str]:
    """The same parts, wherever they hold prefix bigrams in the place of pivots."""
    left = [f"{k}>{word[k:]}" for k in range(prefix[-1] + 1)]
    right = [f"{len(word) - k}<{word[:k]}" for k in range(prefix[0] + 2, len(word) + 1)]
    pairs = [(a, b) for k, a in enumerate(prefix) for b in prefix[k + 1 :] if b >= a + 2]
    return left + right + [f"{b - a - 2}={word[: a + 2]}|{word[b:]}" for a, b in pairs]


def index_entries(vocabulary: DataFrame) -> DataFrame:
    """``key, is_pivot, word, n, last``: the pivots and the prefixes of all words."""
    ranking = Ranking(bigram_frequencies(vocabulary))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = ranking.signature(word)
                rows += [(key, True, word, n, s.last) for key in pivot_keys(word, *s.pivots)]
                rows += [(key, False, word, n, s.last) for key in prefix_keys(word, s.prefix)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "is_pivot", "word", "n", "last"]
            )

    return map_arrow(vocabulary.select("word", "n"), step, "key string, is_pivot boolean, word string, n long, last int")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``word, n, other, other_n`` in both directions, once for each two words of edit distance one."""
    entries = cut_lineage(index_entries(vocabulary))
    lists = entries.groupBy("key").agg(F.count_if("is_pivot").alias("pivots"), F.count_if(~F.col("is_pivot")).alias("prefixes"))
    # only keys that can join; a long list is cut into blocks of LIST, and each pivot goes to every block
    useful = lists.where((F.col("pivots") > 0) & (F.col("prefixes") > 0)).select(
        "key", F.ceil(F.col("prefixes") / LIST).cast("int").alias("blocks")
    )
    found = entries.join(useful, "key")
    pivots = found.where("is_pivot").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "word", "n", "last"
    )
    prefixes = found.where(~F.col("is_pivot")).select(
        "key",
        F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("block"),
        F.col("word").alias("other"),
        F.col("n").alias("other_n"),
        F.col("last").alias("other_last"),
    )
    verified = (
        (F.col("last") <= F.col("other_last"))
        & (F.abs(F.length("word") - F.length("other")) <= 1)
        & (F.levenshtein("word", "other", 1) == 1)
    )
    met = pivots.join(prefixes, ["key", "block"]).where(verified)
    first = F.col("word") < F.col("other")
    once = met.select(
        F.when(first, F.struct("word", "n")).otherwise(F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"))).alias("a"),
        F.when(first, F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"))).otherwise(F.struct("word", "n")).alias("b"),
    ).distinct()
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return once.select(both.alias("p")).select(
        F.col("p.a.word").alias("word"),
        F.col("p.a.n").alias("n"),
        F.col("p.b.word").alias("other"),
        F.col("p.b.n").alias("other_n"),
    )


def last_forms(forms: DataFrame) -> DataFrame:
    """``word, root``: the ends of the chains of ``word, form``, by pointer doubling."""
    steps = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        doubled = cut_lineage(steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"))
        steps = doubled.select("word", "root")
        if doubled.where("further IS NOT NULL").isEmpty():
            return steps


def spelling_forms(
    docs: DataFrame, words: Words = Words(), factor: int = 5, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``word, n, form, form_n, root, n_near`` of every word."""
    vocabulary = cut_lineage(word_counts(docs, words, key, text))
    largest = F.min(F.struct((-F.col("other_n")).alias("minus_n"), F.col("other").alias("word")))
    near = (
        near_words(vocabulary)
        .groupBy("word", "n")
        .agg(F.count(F.lit(1)).alias("n_near"), largest.alias("top"))
        .select("word", "n_near", F.when(-F.col("top.minus_n") >= factor * F.col("n"), F.col("top")).alias("top"))
        .select("word", "n_near", F.col("top.word").alias("form"), (-F.col("top.minus_n")).alias("form_n"))
    )
    near = cut_lineage(near)
    roots = last_forms(near.where("form IS NOT NULL"))
    return (
        vocabulary.join(near, "word", "left")
        .join(roots, "word", "left")
        .select(
            "word",
            "n",
            "form",
            "form_n",
            F.coalesce("root", "word").alias("root"),
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        )
    )
