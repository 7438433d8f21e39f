"""Aggregate helpers beyond the built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldtally.functions.expressions import col
from fieldtally.operators.ordering import exact_quantiles, match_keys
from fieldtally.session import cut_lineage


def skew_adj(c) -> Column:
    """Bias-corrected sample skewness; NULL below three values."""
    c = col(c)
    n = F.count(c)
    g = F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, g)


def safe_corr(a, b) -> Column:
    """Pearson correlation over complete pairs; NULL for a constant series.

    The built-in function divides by the spread and raises in ANSI mode when
    there is none, so the quotient is formed here with a guard.
    """
    a, b = col(a), col(b)
    spread = F.sqrt(F.var_pop(F.when(b.isNotNull(), a))) * F.sqrt(F.var_pop(F.when(a.isNotNull(), b)))
    return F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0))


def mode_min(df: DataFrame, keys: list[str], c: str, name: str = "mode") -> DataFrame:
    """Most frequent value per key, the smallest one on ties."""
    counts = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count(F.lit(1)).alias("__n"))
    best = F.min_by(c, F.struct(-F.col("__n"), F.col(c))).alias(name)
    return counts.groupBy(*keys).agg(best)


def tukey(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    """Quartiles, fences at 1.5 IQR and the number of values outside them."""
    quart = exact_quantiles(df, keys, c, {"q1": 0.25, "q3": 0.75})
    fenced = quart.withColumn("iqr", F.col("q3") - F.col("q1"))
    fenced = fenced.withColumn("low", F.col("q1") - 1.5 * F.col("iqr")).withColumn(
        "high", F.col("q3") + 1.5 * F.col("iqr")
    )
    values = df.where(F.col(c).isNotNull()).select(*keys, F.col(c).alias("__v"))
    outside = F.count_if((F.col("__v") < F.col("low")) | (F.col("__v") > F.col("high")))
    return (
        match_keys(values, fenced, keys)
        .groupBy(*keys, "q1", "q3", "iqr", "low", "high")
        .agg(outside.alias("outliers"), F.count(F.lit(1)).alias("n"))
    )


def describe_metrics(long: DataFrame, key: str = "metric", value: str = "value", discrete: tuple = ()) -> DataFrame:
    """Full summary row per metric of a long (metric, value) frame.

    Values first collapse to counts, which are stored once; moments, quantiles,
    mode and fences all read those counts, so no metric's values ever meet in
    one task and the input is computed once.
    """
    counts = cut_lineage(
        long.where(F.col(value).isNotNull())
        .groupBy(key, F.col(value).cast("double").alias(value))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    v, c = F.col(value), F.col("__n")
    means = counts.groupBy(key).agg(F.sum("__n").alias("n"), (F.sum(v * c) / F.sum(c)).alias("mean"))
    n, off = F.col("n"), v - F.col("mean")
    m2, m3 = F.col("__m2"), F.col("__m3")
    moments = (
        counts.join(means, key)
        .groupBy(key, "n", "mean")
        .agg(F.sum(c * off * off).alias("__m2"), F.sum(c * off * off * off).alias("__m3"))
        .select(
            key,
            "n",
            "mean",
            F.when(n > 1, m2 / F.nullif(n - 1, F.lit(0))).alias("variance"),
            F.when(n > 1, F.sqrt(m2 / F.nullif(n - 1, F.lit(0)))).alias("std_dev"),
            F.when(
                (n >= 3) & (m2 > 0),
                (m3 / n) / F.pow(F.nullif(m2, F.lit(0.0)) / n, 1.5)
                * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)),
            ).alias("skewness"),
        )
    )
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p05": 0.05, "p95": 0.95}
    quants = exact_quantiles(counts, [key], value, probs, weight="__n").withColumn(
        "iqr", F.col("q3") - F.col("q1")
    )
    modes = (
        counts.where(F.col(key).isin(*discrete))
        .groupBy(key)
        .agg(F.min_by(value, F.struct(-c, v)).alias("mode_if_useful"))
    )
    low, high = F.col("q1") - 1.5 * F.col("iqr"), F.col("q3") + 1.5 * F.col("iqr")
    outliers = (
        counts.join(quants.select(key, "q1", "q3", "iqr"), key)
        .groupBy(key)
        .agg(F.sum(F.when((v < low) | (v > high), c).otherwise(0)).alias("tukey_outlier_count"))
    )
    return moments.join(quants, key).join(outliers, key).join(modes, key, "left")


def hist_step(df: DataFrame, c: str, step: int, cap: int, name: str = "bucket_lower") -> DataFrame:
    """Fixed-width histogram whose last bucket starts at ``cap``."""
    lower = F.least(F.lit(cap), (F.floor(F.col(c) / step) * step).cast("int"))
    return df.where(F.col(c).isNotNull()).groupBy(lower.alias(name)).agg(F.count(F.lit(1)).alias("rows"))


def hist_n(df: DataFrame, c: str, n: int) -> DataFrame:
    """n equal-width bins between min and max; the right edge belongs to the last bin."""
    known = df.where(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("__v"), F.lit(1).alias("__one"))
    span = known.groupBy("__one").agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / n
    index = F.when(
        width > 0, F.least(F.floor((F.col("__v") - F.col("__lo")) / width), F.lit(n - 1))
    ).otherwise(F.lit(0))
    return (
        known.join(span, "__one")
        .groupBy(index.cast("int").alias("bin"), (F.col("__lo") + width * index).alias("lower"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def hist_unit(df: DataFrame, c: str) -> DataFrame:
    """Unit-wide bins centred on whole numbers."""
    return (
        df.where(F.col(c).isNotNull())
        .groupBy(F.floor(F.col(c) + 0.5).cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def pivot_fixed(df: DataFrame, keys: list[str], c: str, values: list[str], agg: Column) -> DataFrame:
    """Pivot over declared values, so no pass is spent discovering them."""
    return df.groupBy(*keys).pivot(c, values).agg(agg)


def to_long(df: DataFrame, ids: list[str], columns: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    same = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return same.unpivot(ids, columns, name, value)


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("rows"))


def metric_by_month(df: DataFrame, ts: Column, keys: list[str], aggs: list[Column]) -> DataFrame:
    return df.groupBy(F.date_format(ts, "yyyy-MM").alias("target_month"), *keys).agg(*aggs)


def latest_value(value: str, ts: str, cond: Column) -> Column:
    """Value at the latest time among rows that pass and carry a value."""
    ok = cond & F.col(value).isNotNull()
    return F.max_by(F.when(ok, F.col(value)), F.when(ok, F.col(ts)))


def fold_sorted(arr: Column, start: Column, step) -> Column:
    """Ordered fold of an array's elements, smallest first."""
    return F.aggregate(F.array_sort(arr), start, step)


def distinct_of(*columns: str) -> Column:
    return F.count_distinct(*columns) if len(columns) == 1 else F.count_distinct(F.struct(*columns))


def totals(df: DataFrame, aggs: list[Column]) -> DataFrame:
    return df.agg(*aggs)
