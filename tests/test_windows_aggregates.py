import numpy as np
import pandas as pd
from pyspark.sql import Window, functions as F

from fieldtally.operators import aggregates as ag, sampling, windows as win


def series(spark, groups):
    rows = [(k, i, v) for k, vs in groups.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "k string, t int, x double")


def test_ewm_follows_gaps(spark):
    rng = np.random.default_rng(5)
    groups = {"start": [None, 1.0, 2.0, 4.0, 8.0], "middle": [1.0, 2.0, None, 4.0, 5.0], "double": [3.0, 1.0, None, None, 9.0, 2.0]}
    for i in range(20):
        v = rng.normal(50, 20, 30)
        groups[f"r{i}"] = [None if rng.random() < 0.3 else float(a) for a in v]
    got = win.ewm(series(spark, groups), ["k"], "t", "x", "e").orderBy("k", "t").toPandas()
    for k, vs in groups.items():
        want = pd.Series(vs, dtype=float).ewm(span=7, adjust=False, min_periods=3).mean()
        assert np.allclose(got[got.k == k].e, want, equal_nan=True), k


def test_rolling_mean_needs_enough_values(spark):
    vs = [1.0, None, 3.0, 5.0, None, None, 8.0, 2.0]
    w = Window.partitionBy("k").orderBy("t")
    got = series(spark, {"a": vs}).select("t", win.rolling_mean("x", 7, 3, w).alias("m"), win.ffill("x", w).alias("f")).orderBy("t").toPandas()
    s = pd.Series(vs, dtype=float)
    assert np.allclose(got.m, s.rolling(7, min_periods=3).mean(), equal_nan=True)
    assert np.allclose(got.f, s.ffill(), equal_nan=True)


def test_skew_needs_three_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 2.0), ("b", 9.0)], "k string, v double")
    got = {r.k: r.s for r in df.groupBy("k").agg(ag.skew_adj("v").alias("s")).collect()}
    assert got["a"] is None and np.isclose(got["b"], pd.Series([1, 2, 9.0]).skew())


def test_mode_takes_smallest_of_ties(spark):
    df = spark.createDataFrame([("a", v) for v in (3.0, 1.0, 3.0, 1.0, 2.0)], "k string, v double")
    assert ag.mode_min(df, ["k"], "v").first().mode == 1.0


def test_describe_equals_pandas(spark):
    rng = np.random.default_rng(2)
    values = {"m": rng.lognormal(0, 1, 500).round(2), "d": rng.integers(0, 9, 400).astype(float)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "metric string, value double")
    got = {r.metric: r for r in ag.describe_metrics(df, discrete=("d",)).collect()}
    for k, vs in values.items():
        s, r = pd.Series(vs), got[k]
        q1, q3 = s.quantile([0.25, 0.75])
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        want = [len(s), s.mean(), s.median(), s.var(), s.std(), q1, q3, s.quantile(0.05), s.quantile(0.95), s.skew()]
        have = [r.n, r["mean"], r.median, r.variance, r.std_dev, r.q1, r.q3, r.p05, r.p95, r.skewness]
        assert np.allclose(have, want)
        assert r.tukey_outlier_count == ((s < low) | (s > high)).sum()
    assert got["d"].mode_if_useful == pd.Series(values["d"]).mode().iloc[0] and got["m"].mode_if_useful is None


def test_histogram_right_edge(spark):
    v = np.array([0.0, 1.0, 2.5, 5.0, 9.99, 10.0])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = {r.bin: r.rows for r in ag.hist_n(df, "v", 4).collect()}
    want, _ = np.histogram(v, bins=4)
    assert [got.get(i, 0) for i in range(4)] == list(want)
    step = {r.bucket_lower: r.rows for r in ag.hist_step(spark.createDataFrame([(99.0,), (100.0,), (3.0,)], "v double"), "v", 5, 100).collect()}
    assert step == {95: 1, 100: 1, 0: 1}


def test_latest_value_skips_null_and_rejected(spark):
    df = spark.createDataFrame([(1, 5.0, True), (2, None, True), (3, 9.0, False)], "t int, v double, ok boolean")
    assert df.agg(ag.latest_value("v", "t", F.col("ok")).alias("x")).first().x == 5.0


def test_top_ranked_keeps_ties_and_order(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 9, 9, 1])], "id int, v double")
    got = win.top_ranked(df, [F.desc("v")], ["id"], 3, "r").orderBy("r", "id").collect()
    assert [(r.id, r.r) for r in got] == [(1, 1), (2, 1), (0, 3)]


def test_stratified_sample_tops_up_and_repeats(spark):
    df = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 100), ("b", 101)], "z string, id int")
    one, short = sampling.stratified_sample(df, "z", "id", 5, seed=1)
    two, _ = sampling.stratified_sample(df, "z", "id", 5, seed=1)
    ids = sorted(r.id for r in one.collect())
    assert len(ids) == len(set(ids)) == 10 and ids == sorted(r.id for r in two.collect())
    assert [(r.z, r.available, r.shortfall) for r in short.collect()] == [("b", 2, 3)]
