"""Ridge, conformal widths, HAC test, Holm, quality checks against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.plans import forecast as fc, kpi, quality as ql, statistics as st


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(6)
    n = 240
    x = rng.normal(40, 20, (n, 11))
    x[:, 10] = rng.choice([240, 660, 1100], n)
    x[rng.random((n, 11)) < 0.1] = np.nan
    dow = np.eye(7)[rng.integers(0, 7, n)]
    y = np.clip(np.nan_to_num(x[:, 0], nan=40) * 0.5 + dow[:, 5] * 9 + rng.normal(0, 5, n), 0, 100)
    city = np.where(rng.random(n) < 0.8, "hot", "cold")
    rows = [
        (str(city[i]), "final", *[None if np.isnan(v) else float(v) for v in x[i]], *[int(v) for v in dow[i]], float(y[i]))
        for i in range(n)
    ]
    ddl = ", ".join(f"{c} double" for c in fc.FEATURES[:11]) + ", " + ", ".join(f"{c} int" for c in fc.FEATURES[11:])
    df = spark.createDataFrame(rows, f"city_id string, fit string, {ddl}, target_fill_pct double").repartition(5)
    return np.hstack([x, dow]), y, city, df


def test_ridge_equals_the_closed_form(training):
    x, y, city, df = training
    models = fc.fit_ridge(df, ["city_id", "fit"], alpha=10.0)
    for row in models.collect():
        xs, ys = x[city == row.city_id], y[city == row.city_id]
        filled = np.where(np.isnan(xs), np.nanmedian(xs, 0), xs)
        sd = filled.std(0)
        sd[sd == 0] = 1
        z = (filled - filled.mean(0)) / sd
        w = np.linalg.solve(z.T @ z + 10 * np.eye(18), z.T @ (ys - ys.mean()))
        want = np.clip(z @ w + ys.mean(), 0, 100)
        got = df.where(F.col("city_id") == row.city_id).join(models, ["city_id", "fit"]).select(
            "target_fill_pct", fc.ridge_predict().alias("p")
        ).toPandas()
        assert np.allclose(np.sort(got.p), np.sort(want), atol=1e-8)
        assert row.n == len(ys)


def test_model_choice_needs_two_percent(spark):
    rows = [("a", "validation", "known_bins", m, v) for m, v in (("persistence", 10.0), ("moving_average7", 9.0), ("ridge", 8.8))]
    rows += [("b", "validation", "known_bins", m, v) for m, v in (("persistence", 9.0), ("moving_average7", 9.0), ("ridge", 8.9))]
    df = spark.createDataFrame(rows, "city_id string, split string, `group` string, model string, mae_pct_points double")
    got = {r.city_id: (r.best_simple, r.selected_model) for r in fc.select_model(df).collect()}
    assert got == {"a": ("moving_average7", "ridge"), "b": ("persistence", "persistence")}


def hac(x, lags):
    n, c = len(x), x - x.mean()
    lrv = c @ c / n + sum(2 * (1 - i / (lags + 1)) * (c[i:] @ c[:-i]) / n for i in range(1, lags + 1))
    return x.mean(), np.sqrt(lrv / n)


def pairs(spark, **series):
    rows = [(k, i, 0.0, float(v), float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "test_id string, week_start int, weekday_mean double, weekend_mean double, weekend_minus_weekday double")


def test_hac_equals_numpy(spark):
    rng = np.random.default_rng(7)
    x = 3 + np.convolve(rng.normal(size=60), [1, 0.6, 0.3], "valid")[:51]
    for lags in (4, 8):
        r = st.hac_mean_test(pairs(spark, a=x), lags).first()
        mean, se = hac(x, lags)
        assert np.allclose([r.mean_difference, r.hac_standard_error, r.test_statistic_z], [mean, se, mean / se])
        assert np.isclose(r.ci95_upper - r.ci95_lower, 2 * 1.95996398454 * se) and r.positive_weeks == (x > 0).sum()


def test_hac_refuses_short_and_degenerate_series(spark):
    got = {r.test_id: r for r in st.hac_mean_test(pairs(spark, short=range(17), flat=[2.0] * 30), 4).collect()}
    assert (got["short"].status, got["flat"].status) == ("too_few_weeks", "non_positive_variance")
    assert got["short"].test_statistic_z is None and got["flat"].p_value_two_sided is None


def test_holm_is_monotone(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.03), ("c", 0.02), ("d", 0.9)], "test_id string, p_value_two_sided double")
    got = {r.test_id: r for r in st.holm(df).collect()}
    assert np.allclose([got[k].p_value_holm for k in "acbd"], [0.04, 0.06, 0.06, 0.9])
    assert [got[k].reject_h0 for k in "acbd"] == [True, False, False, False]


def test_quality_counts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "id int, k string")
    pk = ql.check_pk(df, ["id"], "t").first()
    assert (pk["rows"], pk.distinct_keys, pk.duplicates, pk.repeated_keys) == (3, 2, 1, 1)
    parent = spark.createDataFrame([("b",)], "k string")
    link = ql.check_links({"p": parent, "c": df}, [("p", "k", "c", "k")]).first()
    assert (link.orphan_keys, link.orphan_rows) == (1, 2)
    prof = {r.field: r for r in ql.profile(df, "t").collect()}
    assert (prof["k"].distinct_values, round(prof["k"].null_pct, 3), prof["id"].max_value) == (1, 33.333, "2")


def test_profile_reads_each_column_once(spark, tmp_path):
    import re

    rows = [(1, 0.5, "b", None), (3, 0.5, None, None), (None, 12.0, "a", None), (12, None, "b", None)]
    spark.createDataFrame(rows, "k int, x double, s string, none date").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    prof = ql.profile(df, "t")
    read = re.findall(r"ReadSchema: struct<([^>]*)>", prof._jdf.queryExecution().executedPlan().treeString())
    assert sorted(",".join(read).split(",")) == ["k:int", "none:date", "s:string", "x:double"]
    got = {r.field: (r.type, r.rows, r.null_pct, r.min_value, r.max_value, r.distinct_values) for r in prof.collect()}
    assert got == {
        "k": ("int", 4, 25.0, "1", "12", 3),
        "x": ("double", 4, 25.0, "0.5", "12.0", 2),
        "s": ("string", 4, 25.0, "a", "b", 2),
        "none": ("date", 4, 100.0, None, None, 0),
    }
    none = ql.profile(df.limit(0), "t").collect()
    assert {(r.field, r.rows, r.null_pct, r.distinct_values) for r in none} == {(c, 0, None, 0) for c in df.columns}


def test_checks_of_a_table_come_from_one_pass(spark):
    rows = [(1, 1, "a"), (1, 1, "b"), (1, 2, "b"), (None, 2, "b"), (None, 2, None)] + [(7, 7, "hot")] * 500
    df = spark.createDataFrame(rows, "x int, y int, k string")
    rules = {"small": F.col("x") < 5, "no_k": F.col("k").isNull()}
    checks = ql.check_table(df, {"pair_copies": ["x", "y"], "k_copies": ["k"]}, rules)
    want = {"pair_copies": 501, "k_copies": 501, "small": 3, "no_k": 1}
    assert {r.check_name: r.violations for r in checks.collect()} == want
    plain = ql.critical_checks([ql.check_table(df, {}, rules)])
    assert {r.check_name: (r.violations, r.is_issue) for r in plain.collect()} == {"small": (3, True), "no_k": (1, True)}
    none = ql.check_table(df.limit(0), {"pair_copies": ["x", "y"]}, rules)
    assert {r.check_name: r.violations for r in none.collect()} == {"pair_copies": 0, "small": 0, "no_k": 0}


def test_critical_checks_scan_the_readings_once(spark):
    """Marts are stored by then; the check of zones reads the readings a second time."""
    from __spark_entry__ import queries

    for name, scans in {"L5": 1, "L5_all": 2, "L7": 0}.items():
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.split("== Initial Plan ==")[0].count("lineitem.parquet") == scans, name


def test_balance_and_step(spark):
    rows = [(1, f"2026-01-31 {h:02d}:00:00", 5.0, 10.0 + 5 * (i + 1), 0.0, 0.0) for i, h in enumerate((20, 22))]
    rows += [(1, "2026-02-01 00:00:00", 5.0, 25.0, 0.0, 0.0), (1, "2026-02-01 04:00:00", 5.0, 24.0, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "bin_id int, ts string, arrivals_l_true double, inventory_l_true double, overflow_l_true double, removed_l_true double")
    df = df.withColumn("timestamp_utc", F.col("ts").cast("timestamp_ntz"))
    r = ql.balance_residual(df, ["bin_id"], ["timestamp_utc"]).first()
    assert (r.compared, r.irregular_steps, r.max_residual_l) == (3, 1, 1.0)


def test_reconciliation_names_failures(spark):
    a = spark.createDataFrame([("x", "m", 1.0), ("x", "n", 2.0)], "city_id string, metric string, value double")
    b = spark.createDataFrame([("x", "m", 1.0), ("x", "n", 2.5)], "city_id string, metric string, value double")
    r = ql.reconciliation_summary(ql.reconcile_kpis(a, b, ["city_id"]), F.concat_ws(":", "city_id", "metric")).first()
    assert (r.checks, r.passed, r.failed, r.failed_names) == (2, 1, 1, "x:n") and np.isclose(r.max_absolute_difference, 0.5)


def test_filters_flow_from_dimensions_to_facts(spark):
    mk = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    tables = {
        "dim_city": mk([("A",), ("B",)], "city_id string"),
        "dim_bin": mk([("A:1", "A"), ("B:1", "B")], "bin_key string, city_id string"),
        "fact_bin_day": mk([("A:1", 1), ("A:1", 2), ("B:1", 1)], "bin_key string, service_date int"),
        "dim_date": mk([(1,), (2,)], "service_date int"),
    }
    got = kpi.apply_filters(tables, {"dim_city": F.col("city_id") == "A", "dim_date": F.col("service_date") == 2})
    assert got["fact_bin_day"].count() == 1 and tables["fact_bin_day"].count() == 3
    assert kpi.apply_filters(tables, {})["fact_bin_day"] is tables["fact_bin_day"]
