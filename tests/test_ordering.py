import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from fieldtally.operators import ordering as o


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, with many ties, a long tail and some NULLs."""
    rng = np.random.default_rng(3)
    n = 4000
    key = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    value = np.where(rng.random(n) < 0.3, 5.0, np.exp(rng.normal(0, 3, n)).round(3))
    pdf = pd.DataFrame({"id": range(n), "k": key, "v": value})
    pdf.loc[rng.random(n) < 0.05, "v"] = np.nan
    rows = [(int(i), k, None if np.isnan(v) else float(v)) for i, k, v in pdf.itertuples(index=False)]
    return pdf, spark.createDataFrame(rows, "id bigint, k string, v double").cache()


def test_quantiles_equal_numpy(skewed):
    pdf, df = skewed
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.k: r for r in o.exact_quantiles(df, ["k"], "v", probs, buckets=16).collect()}
    for k, g in pdf.dropna().groupby("k"):
        for name, p in probs.items():
            assert np.isclose(got[k][name], np.quantile(g.v, p)), (k, name)


def test_quantiles_hold_when_every_sketch_differs(spark, skewed, monkeypatch):
    """A sketch merges its parts as they arrive, so evaluated again it gives other split points."""
    pdf, df = skewed
    sketch = o.split_points
    loose = F.udf(lambda edges: sorted(e * random.uniform(0.2, 5) for e in edges), "array<double>").asNondeterministic()
    monkeypatch.setattr(o, "split_points", lambda value, parts: loose(sketch(value, parts)))
    probs = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    got = {r.k: r for r in o.exact_quantiles(df, ["k"], "v", probs, buckets=64).collect()}
    for k, g in pdf.dropna().groupby("k"):
        assert [got[k][name] for name in probs] == pytest.approx(list(np.quantile(g.v, list(probs.values())))), k


def test_quantile_without_key_and_with_one_value(spark, skewed):
    pdf, df = skewed
    assert np.isclose(o.exact_quantiles(df, [], "v", {"m": 0.5}).first().m, pdf.v.median())
    same = spark.createDataFrame([("x", 2.0)] * 7, "k string, v double")
    assert o.exact_quantiles(same, ["k"], "v", {"m": 0.3}).first().m == 2.0


@pytest.mark.parametrize("n", [1, 5, 10, 37, 100])
def test_higher_quantile(spark, n):
    values = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = o.exact_quantiles(df, [], "v", {"a": 0.8, "b": 0.9, "c": 0.95}, how="higher").first()
    for name, q in (("a", 0.8), ("b", 0.9), ("c", 0.95)):
        assert got[name] == np.quantile(values, q, method="higher")


def test_quantiles_of_weighted_values(spark):
    df = spark.createDataFrame([(1.0, 3), (10.0, 1)], "v double, n bigint")
    assert o.exact_quantiles(df, [], "v", {"m": 0.5, "q": 0.9}, weight="n").first().asDict() == {
        "m": 1.0, "q": np.quantile([1, 1, 1, 10], 0.9)
    }


def test_average_rank_equals_pandas(skewed):
    pdf, df = skewed
    got = o.rank_average(df, ["k"], "v", "r", buckets=8).select("id", "r").toPandas().set_index("id").r.sort_index()
    want = pdf.dropna().set_index("id").groupby("k").v.rank().sort_index()
    assert np.allclose(got, want)


def test_split_row_number_equals_window(skewed):
    _, df = skewed
    known = df.where("v IS NOT NULL")
    order = [F.desc("v"), F.col("id")]
    split = o.split_position(known, ["k"], [-F.floor("v")], order, "a")
    both = split.withColumn("b", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    assert both.where("a <> b").count() == 0


def test_chunked_lag_equals_window(skewed):
    _, df = skewed
    got = o.lag_split(df, ["k"], ["id"], ["v", "id"], F.floor(F.col("id") / 100))
    w = Window.partitionBy("k").orderBy("id")
    both = got.withColumn("pv", F.lag("v").over(w)).withColumn("pi", F.lag("id").over(w))
    assert both.where(~F.col("pv").eqNullSafe(F.col("prev_v")) | ~F.col("pi").eqNullSafe(F.col("prev_id"))).count() == 0


def test_chunked_running_sum_equals_window(skewed):
    _, df = skewed
    rows = df.withColumn("v", F.coalesce("v", F.lit(0.0)))
    got = o.running_sum_split(rows, ["k"], "id", "v", "s", chunk_rows=50)
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    both = got.withColumn("t", F.sum("v").over(w))
    assert both.where(F.abs(F.col("s") - F.col("t")) > 1e-6 * F.col("t")).count() == 0


def test_null_keys_match(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, b int")
    assert sorted((r.a, r.b) for r in o.match_keys(a, b, ["k"]).collect()) == [(1, 10), (2, 20)]


def test_total_position_with_mostly_equal_values(spark):
    """Nine rows of ten share the first order column; the ranges are even all the same."""
    n = 20_000
    rng = np.random.default_rng(8)
    value = np.where(rng.random(n) < 0.9, 7.0, rng.uniform(0, 14, n).round(2))
    ids = rng.permutation(n)
    rows = [(int(i), None if i % 97 == 0 else float(v)) for i, v in zip(ids, value)]
    df = spark.createDataFrame(rows, "id bigint, v double").repartition(5)
    order = [F.desc("v"), F.col("id")]
    sizes = [r["count"] for r in o.in_ranges(df, order, 8).groupBy("__part").count().collect()]
    assert sum(sizes) == n and max(sizes) < 2 * n / 8
    got = o.total_position(df, order, "place", 8)
    assert got.columns == ["id", "v", "place"]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [r.id for r in got.orderBy("place").collect()] == [r[0] for r in want]
    assert {r.place for r in got.select("place").collect()} == set(range(1, n + 1))


def test_total_position_of_nothing_and_of_equal_rows(spark):
    df = spark.createDataFrame([(1, 2.0)] * 5, "id bigint, v double")
    order = [F.desc("v"), F.col("id")]
    assert sorted(r.place for r in o.total_position(df, order, "place").collect()) == [1, 2, 3, 4, 5]
    assert o.total_position(df.limit(0), order, "place").count() == 0
