"""Composable ordered folds against plain folds."""

import itertools
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldtally.operators import scan
from fieldtally.operators.scan import CappedSum, DecayedMean


def plain_states(fold, xs):
    """The recursion as it is defined, row by row."""
    if isinstance(fold, CappedSum):
        state, out = fold.initial, []
        for x in xs:
            state = state if x is None else min(fold.cap, fold.decay * state + x)
            out.append(state)
        return out
    mean, weight, seen, out = None, 1.0, 0, []
    for x in xs:
        aged = weight * (1 - fold.alpha)
        if x is not None:
            mean = x if mean is None else (mean * aged + x * fold.alpha) / (aged + fold.alpha)
            weight, seen = 1.0, seen + 1
        elif mean is not None:
            weight = aged
        out.append(mean if seen >= fold.min_n else None)
    return out


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))


FOLDS = [CappedSum(40.0, 0.9), CappedSum(5.0, 0.0), CappedSum(100.0, 1.0, 7.0), DecayedMean(7, 3), DecayedMean(3, 1)]


@pytest.mark.parametrize("fold", FOLDS)
def test_chunks_compose_in_every_cut(fold):
    rng = random.Random(3)
    xs = [rng.choice([None, None, rng.uniform(0, 20)]) for _ in range(24)]
    want = plain_states(fold, xs)
    for cuts in itertools.combinations(range(len(xs) + 1), 2):
        state = fold.start
        for a, b in zip((0, *cuts), (*cuts, len(xs)), strict=True):
            change = fold.identity
            for x in xs[a:b]:
                change = fold.compose(change, fold.of(x))
            state = fold.apply(state, change)
            if b:
                assert close(fold.value(state), want[b - 1])
    many = scan.repeated(fold, fold.of(3.0), 1000)
    assert close(fold.value(fold.apply(fold.start, many)), plain_states(fold, [3.0] * 1000)[-1])


@pytest.mark.parametrize("fold", FOLDS)
def test_large_keys_are_cut(spark, monkeypatch, fold):
    monkeypatch.setattr(scan, "LARGE", 50)
    monkeypatch.setattr(scan, "PARTS", 7)
    rng = random.Random(5)
    series = {k: [rng.choice([None, rng.uniform(0, 20)]) for _ in range(n)] for k, n in (("a", 400), ("b", 3), (None, 120), ("c", 50))}
    rows = [(k, t, x) for k, xs in series.items() for t, x in enumerate(xs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t int, x double")
    got = {(r.k, r.t): r.s for r in scan.running_fold(df, ["k"], "t", "x", "s", fold).collect()}
    assert len(got) == len(rows)
    ends = {r.k: r.s for r in scan.final_fold(df, ["k"], "t", "x", "s", fold).collect()}
    for k, xs in series.items():
        want = plain_states(fold, xs)
        assert all(close(got[k, t], w) for t, w in enumerate(want))
        assert close(ends[k], want[-1])


def test_a_million_rows_of_one_key(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 3 != 0, (F.col("id") * 37 % 101).cast("double")).alias("x"))
    got = scan.running_fold(df, ["k"], "t", "x", "s", DecayedMean(7, 3))
    x = pd.Series([float(i * 37 % 101) if i % 3 else None for i in range(n)], dtype=float)
    want = x.ewm(span=7, adjust=False, min_periods=3).mean()
    found = got.select("t", "s").toPandas().set_index("t")["s"].sort_index()
    assert (found - want).abs().max() < 1e-9 and found.isna().equals(want.isna())
    parts = got.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 0.6 * n


def test_repeats_cost_one_row(spark):
    rows = [(u, float(v), c) for u in range(3) for v, c in ((5, 10_000_000), (9, 1), (1, 40))]
    df = spark.createDataFrame(rows, "u int, v double, c long")
    fold = CappedSum(400.0, 0.95)
    got = {r.u: r.s for r in scan.final_fold(df, ["u"], "v", "v", "s", fold, "c").collect()}
    want = plain_states(fold, [1.0] * 40 + [5.0] * 5000 + [9.0])[-1]
    assert len(got) == 3 and all(close(s, want) for s in got.values())
    assert scan.final_fold(df.limit(0), ["u"], "v", "v", "s", fold).count() == 0
