"""Descriptive diagnostics and autocorrelation-aware mean tests on day series."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F

from fieldtally.functions.expressions import is_weekend, normal_two_sided_p, week_start
from fieldtally.operators.aggregates import safe_corr, skew_adj
from fieldtally.operators.ordering import rank_average
from fieldtally.session import cut_lineage

# Fixed value: two-sided 95 % normal quantile.
Z95 = 1.95996398454


def autocorr1(df: DataFrame, keys: list[str], ts: str, c: str) -> DataFrame:
    """Lag-1 autocorrelation of each key's day series, over non-null pairs."""
    w = Window.partitionBy(*keys).orderBy(ts)
    return (
        df.select(*keys, F.col(c).alias("__x"), F.lag(c).over(w).alias("__p"))
        .groupBy(*keys)
        .agg(safe_corr("__x", "__p").alias("autocorr1"))
    )


def diagnostics(daily: DataFrame, key: str, ts: str, metrics: list[str]) -> DataFrame:
    """Mean, median, spread, skew and autocorrelation per key and metric (one row per day)."""
    long = daily.select(key, ts, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        [key, ts], metrics, "metric", "value"
    )
    w = Window.partitionBy(key, "metric").orderBy(ts)
    return (
        long.withColumn("__p", F.lag("value").over(w))
        .groupBy(key, "metric")
        .agg(
            F.count("value").alias("n_city_days"),
            F.avg("value").alias("mean"),
            F.median("value").alias("median"),
            F.stddev_samp("value").alias("std"),
            F.percentile("value", F.lit(0.25)).alias("q25"),
            F.percentile("value", F.lit(0.75)).alias("q75"),
            skew_adj("value").alias("skewness"),
            safe_corr("value", "__p").alias("lag1_autocorrelation"),
        )
    )


def corr_matrix(df: DataFrame, id_col: str, columns: list[str], method: str = "spearman") -> DataFrame:
    """Long correlation matrix of one-row-per-id metrics.

    For Spearman the columns are unpivoted and stored, ranked together in one
    bucketed pass per metric, and pivoted back.
    """
    source = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in columns])
    if method == "spearman":
        long = cut_lineage(source.unpivot([id_col], columns, "metric", "value"))
        ranked = rank_average(long, ["metric"], "value", "__rank")
        source = ranked.groupBy(id_col).pivot("metric", columns).agg(F.max("__rank"))
    pairs = list(combinations(columns, 2))
    row = source.agg(*[safe_corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = row.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "correlation")
    parts = F.split("pair", r"\|")
    return long.select(parts[0].alias("left_metric"), parts[1].alias("right_metric"), "correlation")


def complete_weeks(days: DataFrame, date: str, weekdays: int = 5, weekend_days: int = 2) -> DataFrame:
    return (
        days.groupBy(week_start(date).alias("week_start"))
        .agg(
            F.count_if(~is_weekend(date)).alias("weekdays"),
            F.count_if(is_weekend(date)).alias("weekend_days"),
        )
        .where((F.col("weekdays") == weekdays) & (F.col("weekend_days") == weekend_days))
    )


def weekend_pairs(daily: DataFrame, metric: str, date: str = "service_date", test_id: str | None = None) -> DataFrame:
    """Weekend mean minus weekday mean for each complete Monday-to-Sunday week."""
    weekend = is_weekend(date)
    return (
        daily.groupBy(week_start(date).alias("week_start"))
        .agg(
            F.avg(F.when(~weekend, F.col(metric))).alias("weekday_mean"),
            F.avg(F.when(weekend, F.col(metric))).alias("weekend_mean"),
            F.count_if(~weekend).alias("__wd"),
            F.count_if(weekend).alias("__we"),
        )
        .where((F.col("__wd") == 5) & (F.col("__we") == 2))
        .select(
            F.lit(test_id or metric).alias("test_id"),
            "week_start",
            "weekday_mean",
            "weekend_mean",
            (F.col("weekend_mean") - F.col("weekday_mean")).alias("weekend_minus_weekday"),
        )
    )


def hac_mean_test(pairs: DataFrame, lags: int, key: str = "test_id", order: str = "week_start",
                  value: str = "weekend_minus_weekday") -> DataFrame:
    """Newey-West (Bartlett) test that the mean weekly difference is zero.

    Autocovariances use the full-sample mean and divide by n.  Too few weeks or
    a non-positive long-run variance give a status and NULL statistics.
    """
    w = Window.partitionBy(key).orderBy(order)
    whole = Window.partitionBy(key)
    x = F.col(value)
    centred = pairs.where(x.isNotNull()).withColumn("__c", x - F.avg(value).over(whole))
    lagged = centred.select(
        key, F.col(value), "__c", F.lag(value).over(w).alias("__p"),
        *[F.lag("__c", i).over(w).alias(f"__c{i}") for i in range(1, lags + 1)],
    )
    products = [F.sum(F.col("__c") * F.col(f"__c{i}")).alias(f"__g{i}") for i in range(1, lags + 1)]
    stats = lagged.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_weeks"),
        F.avg(value).alias("mean_difference"),
        F.median(value).alias("median_difference"),
        F.stddev_samp(value).alias("sd_weekly_difference"),
        safe_corr(value, "__p").alias("lag1_autocorrelation"),
        F.count_if(x > 0).alias("positive_weeks"),
        F.sum(F.col("__c") * F.col("__c")).alias("__g0"),
        *products,
    )
    n = F.col("n_weeks")
    lrv = F.col("__g0") / n
    for i in range(1, lags + 1):
        lrv = lrv + F.lit(2.0 * (1 - i / (lags + 1))) * F.coalesce(F.col(f"__g{i}"), F.lit(0.0)) / n
    status = F.when(n < 2 * lags + 10, "too_few_weeks").when(F.col("__lrv") <= 0, "non_positive_variance").otherwise("ok")
    se = F.when(F.col("status") == "ok", F.sqrt(F.greatest("__lrv", F.lit(0.0)) / n))
    return (
        stats.withColumn("__lrv", lrv)
        .withColumn("status", status)
        .withColumn("hac_standard_error", se)
        .withColumn("test_statistic_z", F.col("mean_difference") / F.nullif("hac_standard_error", F.lit(0.0)))
        .withColumn("p_value_two_sided", normal_two_sided_p("test_statistic_z"))
        .select(
            key,
            "status",
            "n_weeks",
            "mean_difference",
            "median_difference",
            "sd_weekly_difference",
            (F.col("mean_difference") / F.nullif("sd_weekly_difference", F.lit(0.0))).alias("standardized_effect_dz"),
            F.lit(lags).alias("hac_lags"),
            "hac_standard_error",
            "test_statistic_z",
            "p_value_two_sided",
            (F.col("mean_difference") - Z95 * F.col("hac_standard_error")).alias("ci95_lower"),
            (F.col("mean_difference") + Z95 * F.col("hac_standard_error")).alias("ci95_upper"),
            "lag1_autocorrelation",
            "positive_weeks",
        )
    )


def holm(tests: DataFrame, key: str = "test_id", p: str = "p_value_two_sided", alpha: float = 0.05) -> DataFrame:
    """Holm step-down adjustment over the family of tests (a handful of rows)."""
    family = Window.orderBy(F.col(p).asc_nulls_last(), key)
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    step = F.col(p) * (m - F.row_number().over(family) + 1)
    return (
        tests.withColumn("__s", F.least(step, F.lit(1.0)))
        .withColumn("p_value_holm", F.max("__s").over(family.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("p_value_holm", F.when(F.col(p).isNotNull(), F.col("p_value_holm")))
        .withColumn("reject_h0", F.col("p_value_holm") < alpha)
        .drop("__s")
    )


def test_summary(pairs: DataFrame, lags: int = 4, sensitivity: int = 8, key: str = "test_id") -> DataFrame:
    """Main test, its sensitivity at longer lags, relative difference, Holm adjustment.

    The weekly pairs are few (one row per test and week) and are stored once.
    """
    pairs = cut_lineage(pairs)
    means = pairs.groupBy(key).agg(
        F.avg("weekday_mean").alias("mean_weekday"), F.avg("weekend_mean").alias("mean_weekend")
    )
    longer = hac_mean_test(pairs, sensitivity, key).select(
        key,
        F.col("p_value_two_sided").alias("p_value_hac8_sensitivity"),
        F.col("ci95_lower").alias("ci95_hac8_lower"),
        F.col("ci95_upper").alias("ci95_hac8_upper"),
    )
    full = hac_mean_test(pairs, lags, key).join(means, key).join(longer, key)
    relative = F.lit(100.0) * F.col("mean_difference") / F.nullif("mean_weekday", F.lit(0.0))
    return holm(full.withColumn("relative_difference_pct", relative), key)
