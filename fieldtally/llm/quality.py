"""Quality rules by weak supervision: rules vote or abstain, EM learns how far to trust each.

Every rule looks at counts of one document and votes good (1), bad (-1) or abstains (0).
The generative model has a hidden class per document and, for each rule and class, a
probability of each of the three outcomes.  Rules are taken as independent given the class.
The corpus enters the fit only through the number of documents of each vote pattern, at most
``3 ** rules`` rows, so every document counts and the driver holds a bounded table.  The
posterior of the class decides, instead of all rules having to pass.  Documents that fail the base conditions
are decided already and take no part in the fit: very short texts would else make up most of
the bad class and hide the other kinds of failure.

Defined cases: a null text counts as empty (no words, all counts 0, ``base_failed``); an empty
table gives an empty result; repeated rows are judged each for itself; ties of the posterior
(exactly the threshold) are kept; a null doc_id passes through; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.text import Hasher, Words, bounded_rows, map_arrow, mix, slices, utf8
from fieldtally.session import cut_lineage

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_alpha",
    "n_distinct_words",
    "n_letters",
    "n_plain_words",
    "n_marks",
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_ALPHA = _UPPER.copy()
_ALPHA[ord("a") : ord("z") + 1] = True
_LETTER = _ALPHA.copy()
_LETTER[0xC0:] = True  # the first byte of any code point beyond ASCII
_MARK = np.zeros(256, bool)
_MARK[[ord("!"), ord("?")]] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _again(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (row, value) pairs in order: which have an equal earlier one, which have any equal one."""
    n = len(value)
    later, several = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        key = mix(value + (row + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        later[order[1:][same]] = True
        several[order[1:][same]] = True
        several[order[:-1][same]] = True
    return later, several


def count_slice(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each row of a UTF-8 buffer."""
    rows = len(offsets) - 1
    w = Words(data, offsets)
    h = Hasher(data)
    value = h.ranges(w.starts, w.ends)
    out = {"n_words": w.counts.astype(np.int64)}
    out["word_chars"] = _per_row(w.inside & ((data & 0xC0) != 0x80), offsets)
    out["n_symbols"] = _per_row(_SYMBOL[data], offsets)
    out["n_upper"] = _per_row(_UPPER[data], offsets)
    out["n_alpha"] = _per_row(_ALPHA[data], offsets)
    out["n_letters"] = _per_row(_LETTER[data], offsets)
    out["n_marks"] = _per_row(_MARK[data], offsets)
    ranges = np.stack([w.starts, w.ends], 1).ravel()
    letters, symbols = (_per_row(t[data], ranges)[::2] for t in (_LETTER, _SYMBOL))
    out["n_plain_words"] = np.bincount(w.row[(letters > 0) & (symbols == 0)], minlength=rows).astype(np.int64)
    # lines: between row edges and line feeds
    feeds = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    end = np.sort(np.concatenate([feeds, offsets[1:]]), kind="stable")
    line_row = np.repeat(np.arange(rows), np.diff(np.searchsorted(feeds, offsets)) + 1)
    words_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(w.inside, out=words_before[1:])
    worded = words_before[end] > words_before[begin]
    begin, end, line_row = begin[worded], end[worded], line_row[worded]
    later, _ = _again(line_row, h.ranges(begin, end))
    out["n_lines"] = np.bincount(line_row, minlength=rows).astype(np.int64)
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=rows).astype(np.int64)
    # words inside windows that are found more than once
    run, at = w.runs(value, WINDOW)
    _, several = _again(w.row[at], run)
    cover = np.zeros(len(value) + 1, np.int64)
    hit = at[several]
    np.add.at(cover, hit, 1)
    np.subtract.at(cover, hit + WINDOW, 1)
    covered = np.cumsum(cover[:-1]) > 0
    out["n_repeat_words"] = np.bincount(w.row[covered], minlength=rows).astype(np.int64)
    later, _ = _again(w.row, value)
    out["n_distinct_words"] = out["n_words"] - np.bincount(w.row[later], minlength=rows)
    return out


def quality_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the counts of each row, from its whole text."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                found = count_slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(pa.array(found[c], pa.int64()) for c in COUNTS)],
                    ["doc_id", *COUNTS],
                )

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_arrow(narrow, step, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Rule:
    """Votes bad when ``bad`` holds, else good when ``good`` holds, else abstains."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.expr(f"CASE WHEN {self.bad} THEN -1 WHEN {self.good} THEN 1 ELSE 0 END")


# Most rules only speak up against a document: failures are of many kinds, so passing one
# rule says little about the others.  Each kind of failure is seen by more than one rule, as
# only agreement between rules tells the model which of them to trust.
NEVER = "false"
RULES = (
    Rule("length", f"n_words < {MIN_WORDS}", "n_words >= 50"),
    Rule("word_length", "word_chars < 2.5 * n_words OR word_chars > 12 * n_words", NEVER),
    Rule("symbols", "10 * n_symbols > n_words", NEVER),
    Rule("letters", "10 * n_letters < 8 * word_chars", NEVER),
    Rule("plain_words", "10 * n_plain_words < 7 * n_words", NEVER),
    Rule("line_copies", "10 * n_dup_lines > 3 * n_lines", NEVER),
    Rule("repeats", "100 * n_repeat_words > 20 * n_words", NEVER),
    Rule("variety", "n_words >= 50 AND n_words < 1000 AND 10 * n_distinct_words < 3 * n_words", NEVER),
    Rule("capitals", "10 * n_upper > 5 * n_alpha", NEVER),
    Rule("marks", "10 * n_marks > 3 * n_words", NEVER),
)


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents and P(outcome | class): ``table[rule, class, vote + 1]``."""

    good_share: float
    table: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log(self.table)
        rule = np.arange(votes.shape[1])
        bad = logs[rule, 0, votes + 1].sum(1) + np.log(1 - self.good_share)
        good = logs[rule, 1, votes + 1].sum(1) + np.log(self.good_share)
        return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def fit_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = 200, smoothing: float = 1.0) -> VoteModel:
    """EM over vote patterns (rows of -1, 0, 1) that ``counts`` documents show each.

    It starts from the patterns' majorities, where a bad vote weighs more than a good one, as
    most documents pass most rules.  Smoothing keeps a rule that never fires from deciding.
    """
    good = 1 / (1 + np.exp(-(votes == 1).sum(1) + 4.0 * (votes == -1).sum(1)))
    rules = votes.shape[1]
    model = VoteModel(0.5, np.full((rules, 2, 3), 1 / 3))
    for _ in range(rounds):
        total = counts.sum()
        share = float(np.clip((good @ counts + smoothing) / (total + 2 * smoothing), 1e-9, 1 - 1e-9))
        table = np.empty((rules, 2, 3))
        for k, weight in enumerate((counts * (1 - good), counts * good)):
            for v in (-1, 0, 1):
                table[:, k, v + 1] = ((votes == v) * weight[:, None]).sum(0) + smoothing
            table[:, k] /= table[:, k].sum(1, keepdims=True)
        model = VoteModel(share, table)
        update = model.posterior(votes)
        done = np.abs(update - good).max(initial=0) < 1e-10
        good = update
        if done:
            break
    return model


def _pattern(rules: Sequence[Rule]) -> Column:
    """The votes in base 3."""
    return sum(((rule.vote() + F.lit(1)) * F.lit(3**k) for k, rule in enumerate(rules)), F.lit(0))


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _posteriors(voted: DataFrame, rules: Sequence[Rule], weight: str | None = None) -> DataFrame:
    """``pattern, quality`` of every pattern that occurs: at most 3 ** rules rows."""
    count = F.col(weight) if weight else F.lit(1)
    patterns = voted.groupBy("pattern").agg(F.sum(F.when(F.col("base_failed"), 0).otherwise(count)).alias("count"))
    sizes = {r["pattern"]: r["count"] for r in bounded_rows(patterns)}
    codes = np.array(sorted(sizes), np.int64)
    votes = (codes[:, None] // 3 ** np.arange(len(rules)) % 3 - 1).reshape(len(codes), len(rules))
    model = fit_votes(votes, np.array([sizes[c] for c in codes.tolist()], float))
    known = [(int(c), float(p)) for c, p in zip(codes, model.posterior(votes), strict=True)]
    return voted.sparkSession.createDataFrame(known, "pattern int, quality double")


def judge_quality(
    docs: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = 0.5, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Counts, ``pattern`` (votes in base 3), ``quality`` (posterior of good) and ``kept`` per row."""
    counted = quality_counts(docs, key, text)
    voted = cut_lineage(counted.withColumn("pattern", _pattern(rules)).withColumn("base_failed", _base_failed()))
    return voted.join(F.broadcast(_posteriors(voted, rules)), "pattern").withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= threshold)
    )


def good_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = 0.5) -> DataFrame:
    """The rows that are kept, in their own columns.

    Two passes over the texts and no shuffle of them: the first learns the model, the second
    counts again beside the rows and drops those that fail.
    """
    counted = quality_counts(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    voted = counted.select(_pattern(rules).alias("pattern"), _base_failed().alias("base_failed"))
    posteriors = _posteriors(cut_lineage(voted.groupBy("pattern", "base_failed").count()), rules, "count")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text").cast("string").alias("__text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                found = count_slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(pa.array(found[c], pa.int64()) for c in COUNTS)], ["__row", *COUNTS]
                )

    schema = packed.select("__row").schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    beside = map_arrow(packed, step, schema).withColumn("pattern", _pattern(rules))
    kept = beside.where(~_base_failed()).join(F.broadcast(posteriors), "pattern").where(F.col("quality") >= threshold)
    return kept.select("__row.*")
