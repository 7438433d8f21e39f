"""Toxic passages as maximal-scoring segments of token log-odds.

Training counts in how many toxic and clean documents each feature occurs: whole words, and
word beginnings of a few bytes, to which words not in the table fall back.  A feature's weight is
its log-odds between the classes under a Dirichlet prior in proportion to its overall share;
only clearly toxic features (by their z-score) enter the table, everything else costs a word
``STEP``.  A linear-time scan yields every maximal segment of a text.

Extreme-value calibration: under the clean model segment scores have an exponential tail with
the rate lambda that solves E[exp(lambda * score)] = 1, and in n words about
K * n * exp(-lambda * S) segments reach S.  Segments with an expected number below
``SIGNIFICANT`` are reported as passages.  A document's evidence is minus the logarithm of that
number, for its best segment and summed over its passages; a logistic curve, fitted on labelled
documents kept apart from the counts, turns evidence into the probability of the label.

The fit uses a bounded sample of about ``TRAIN_DOCS`` labelled documents; every document is
scored over its whole text.

Defined cases: a null or empty text has no evidence and gets the curve's value there; an empty
table gives an empty result; without training rows of both classes every score is the share of
toxic labels (0 without any); repeated rows are scored alike; conflicting labels of a document
count as toxic; null doc_ids are scored and never trained on; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.text import LOWER, Hasher, Words, bounded_rows, map_arrow, mix, slices, utf8
from fieldtally.session import cut_lineage

TRAIN_DOCS = 16_000
TABLE_FEATURES = 20_000
BEGINNINGS = (6, 5, 4)  # bytes; longer ones go first
PRIOR_MASS = 200.0
LEAST_Z = 3.5
LEAST_DOCS = 4
STEP = 0.7
CAP = 6.0
SIGNIFICANT = 0.05

_ALNUM = np.zeros(256, bool)
_ALNUM[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = True
_ALNUM[0x80:] = True


def held_out(key: Column) -> Column:
    """Rows never trained on: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, list[np.ndarray]]:
    """Words of a slice and, per kind of feature, a hash for each word (0 where it has none).

    Words are lower-cased (A-Z) and lose leading and trailing punctuation.
    """
    low = LOWER[data]
    w = Words(low, offsets)
    n = len(low)
    at = np.arange(n + 1)
    alnum = _ALNUM[low]
    following = np.append(np.where(alnum, at[:-1], n), n)
    following = np.minimum.accumulate(following[::-1])[::-1]
    preceding = np.maximum.accumulate(np.append(0, np.where(alnum, at[1:], 0)))
    start = np.minimum(following[w.starts], w.ends)
    end = np.maximum(np.minimum(preceding[w.ends], w.ends), start)
    h = Hasher(low)
    size = end - start
    kinds = [np.where(size > 0, h.ranges(start, end) | np.uint64(1), np.uint64(0))]
    for k in BEGINNINGS:
        stop = np.minimum(start + k, end)
        value = mix(h.ranges(start, stop) + np.uint64(k)) | np.uint64(1)
        kinds.append(np.where(size > k, value, np.uint64(0)))
    return w, kinds


@dataclass
class ToxicityModel:
    """Sorted feature hashes of each kind with their weights, tail (rate, scale) and curve."""

    features: list[np.ndarray] = field(default_factory=lambda: [np.empty(0, np.uint64)] * (1 + len(BEGINNINGS)))
    weights: list[np.ndarray] = field(default_factory=lambda: [np.empty(0)] * (1 + len(BEGINNINGS)))
    rate: float = 1.0
    scale: float = 0.1
    curve: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def word_scores(self, kinds: list[np.ndarray]) -> np.ndarray:
        """Weight of each word by its most specific known feature, 0 where none is known."""
        score = np.zeros(len(kinds[0]))
        for known, weights, value in zip(self.features, self.weights, kinds, strict=True):
            if len(known) and len(value):
                place = np.minimum(np.searchsorted(known, value), len(known) - 1)
                hit = (known[place] == value) & (score == 0)
                score[hit] = weights[place[hit]]
        return score

    def evidence(self, score: float, n_words: int) -> float:
        return self.rate * score - np.log(self.scale * max(n_words, 1))

    def probability(self, best: np.ndarray, total: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * best + c * total, -60, 60)))


def maximal_segments(at: np.ndarray, gain: np.ndarray, step: float = STEP) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, last word, score), left to right.

    ``at`` are the places of words with positive scores ``gain``; every other word scores
    ``-step``.  Each new word either stands alone, or joins earlier segments back to the last
    one whose prefix sum is lower, as long as that gains; every candidate is merged once.
    """
    found: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    total, last = 0.0, -1
    for place, value in zip(at.tolist(), gain.tolist(), strict=True):
        total -= step * (place - last - 1)
        first, before = place, total
        total += value
        last = place
        after = total
        k = len(found) - 1
        while True:
            while k >= 0 and found[k][2] >= before:
                k -= 1
            if k < 0 or found[k][3] >= after:
                found.append((first, place, before, after))
                break
            first, before = found[k][0], found[k][2]
            del found[k:]
            k -= 1
    return [(a, b, after - before) for a, b, before, after in found]


def _documents(column: pa.Array, model: ToxicityModel) -> Iterator[tuple[int, int, Words, list[list[tuple[int, int, float]]]]]:
    data, offsets = utf8(column)
    for a, b in slices(offsets):
        at = offsets[a : b + 1] - offsets[a]
        w, kinds = word_features(data[offsets[a] : offsets[b]], at)
        score = model.word_scores(kinds)
        hits = np.flatnonzero(score > 0)
        cut = np.searchsorted(hits, w.first)
        segments = []
        for row in range(b - a):
            own = hits[cut[row] : cut[row + 1]]
            segments.append(maximal_segments(own - w.first[row], score[own]) if len(own) else [])
        yield a, b, w, segments


def _summary(model: ToxicityModel, w: Words, segments: list[list[tuple[int, int, float]]]) -> tuple[np.ndarray, np.ndarray]:
    best, total = np.zeros(len(segments)), np.zeros(len(segments))
    for row, own in enumerate(segments):
        if own:
            each = [model.evidence(s, int(w.counts[row])) for _, _, s in own]
            best[row] = max(0.0, max(each))
            total[row] = sum(e for e in each if e > -np.log(SIGNIFICANT))
    return best, total


def _features(sample: DataFrame) -> DataFrame:
    """``kind, feature, toxic, clean``: documents of each class with the feature."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            label = np.asarray(batch.column(1).to_numpy(zero_copy_only=False)).astype(bool)
            for a, b in slices(offsets):
                w, kinds = word_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for kind, value in enumerate(kinds):
                    use = value != 0
                    pair = np.unique(np.rec.fromarrays([value[use], w.row[use]], names="f,r"))
                    feature, inverse = np.unique(pair.f, return_inverse=True)
                    toxic = np.bincount(inverse, label[a:b][pair.r], len(feature)).astype(np.int64)
                    every = np.bincount(inverse, minlength=len(feature))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(feature), kind, np.int32)),
                            pa.array(feature.view(np.int64)),
                            pa.array(toxic),
                            pa.array(every - toxic),
                        ],
                        ["kind", "feature", "toxic", "clean"],
                    )

    counted = map_arrow(sample.select("text", "toxic"), step, "kind int, feature long, toxic long, clean long")
    return counted.groupBy("kind", "feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _log_odds(n_toxic: int, n_clean: int) -> tuple[Column, Column]:
    """Log-odds of a feature with a Dirichlet prior in proportion to its overall share, and its z-score."""
    share = (F.col("toxic") + F.col("clean")) / F.lit(float(n_toxic + n_clean))
    prior = F.lit(PRIOR_MASS) * share
    t, c = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(t / F.greatest(F.lit(n_toxic + PRIOR_MASS) - t, F.lit(0.5))) - F.log(
        c / F.greatest(F.lit(n_clean + PRIOR_MASS) - c, F.lit(0.5))
    )
    return odds, odds / F.sqrt(1 / t + 1 / c)


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> ToxicityModel:
    """Model from labelled documents that are not held out.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic (0/1).
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = cut_lineage(usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    every = max(1, -(-known.count() // train_docs))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(every)) == 0)
    # about train_docs rows of two numbers, whatever the size of the corpus
    sample = cut_lineage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    apart = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(3)) == 0
    counting, curve = sample.where(~apart), sample.where(apart)
    sizes = {r["toxic"]: r["count"] for r in bounded_rows(counting.groupBy("toxic").count())}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    model = ToxicityModel()
    if not n_toxic or not n_clean:
        model.curve = (20.0 if n_toxic else -20.0, 0.0, 0.0)
        return model
    odds, z = _log_odds(n_toxic, n_clean)
    table = (
        _features(counting)
        .where(F.col("toxic") >= LEAST_DOCS)
        .withColumn("odds", odds)
        .withColumn("z", z)
        .where((F.col("z") >= LEAST_Z) & (F.col("odds") > 2 * STEP))
        .orderBy(F.desc("z"), "kind", "feature")
        .limit(TABLE_FEATURES)
    )
    rows = [(r["kind"], r["feature"], r["odds"]) for r in bounded_rows(table)]
    for kind in range(1 + len(BEGINNINGS)):
        own = [(f, o) for k, f, o in rows if k == kind]
        value = np.array([f for f, _ in own], np.int64).view(np.uint64)
        order = np.argsort(value)
        model.features[kind] = value[order]
        model.weights[kind] = np.minimum(np.array([o for _, o in own])[order], CAP)
    return _calibrated(model, curve)


def _calibrated(model: ToxicityModel, sample: DataFrame) -> ToxicityModel:
    """Tail and curve from documents apart from the counts: a row of numbers each, bounded."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w, segments in _documents(batch.column(0), model):
                scores = [[s for _, _, s in own] for own in segments]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(a, b - a), pa.array(w.counts), pa.array(scores, pa.list_(pa.float64()))],
                    ["toxic", "n", "scores"],
                )

    rows = list(bounded_rows(map_arrow(sample.select("text", "toxic"), step, "toxic int, n long, scores array<double>")))
    clean = [r for r in rows if not r["toxic"]]
    words = sum(r["n"] for r in clean) + 1
    tops = np.array(sorted(s for r in clean for s in r["scores"]))
    # rate: positive segment scores against the steps between them, one pseudo-segment of the cap added
    gains = np.append(tops, CAP)
    low, high = 1e-6, 20.0
    for _ in range(80):
        middle = (low + high) / 2
        mean = (words * np.exp(-middle * STEP) + np.exp(np.minimum(middle * gains, 500)).sum()) / (words + len(gains))
        low, high = (middle, high) if mean < 1 else (low, middle)
    model.rate = low
    typical = float(np.median(gains))
    reached = float((gains >= typical).sum())
    model.scale = reached / (words * np.exp(-model.rate * typical))
    best, total = np.zeros(len(rows)), np.zeros(len(rows))
    for k, r in enumerate(rows):
        each = [model.evidence(s, r["n"]) for s in r["scores"]]
        best[k] = max([0.0, *each])
        total[k] = sum(e for e in each if e > -np.log(SIGNIFICANT))
    y = np.array([r["toxic"] for r in rows], float)
    model.curve = _logistic(np.stack([np.ones(len(rows)), best, total], 1), y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Newton steps for logistic regression with slopes that are not negative."""
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -60, 60)))
        slope = x.T @ (y - p) - penalty @ beta
        curvature = (x * (p * (1 - p))[:, None]).T @ x + penalty
        move = np.linalg.solve(curvature, slope)
        beta += move * min(1.0, 5 / max(np.abs(move).max(), 1e-12))
        beta[1:] = np.maximum(beta[1:], 0)
        if np.abs(move).max() < 1e-8:
            break
    return tuple(beta.tolist())


def score_toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, passages`` of each row; passages are (start, end, evidence) in bytes of the text."""
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w, segments in _documents(batch.column(1), model):
                best, total = _summary(model, w, segments)
                spans = []
                for row, own in enumerate(segments):
                    first, start = w.first[row], w.offsets[row]
                    each = [(i, j, model.evidence(s, int(w.counts[row]))) for i, j, s in own]
                    spans.append(
                        [
                            {"start": int(w.starts[first + i] - start), "end": int(w.ends[first + j] - start), "evidence": float(e)}
                            for i, j, e in each
                            if e > -np.log(SIGNIFICANT)
                        ]
                    )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(model.probability(best, total)), pa.array(spans, passage)],
                    ["doc_id", "score", "passages"],
                )

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, score double, passages array<struct<start: long, end: long, evidence: double>>"
    return map_arrow(narrow, step, schema)
