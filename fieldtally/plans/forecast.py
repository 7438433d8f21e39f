"""Next-day fill forecast: leakage-safe features, ridge fit, evaluation, intervals.

Every function works for all cities at once; ``city_id`` is a grouping column.
Only observed readings and the bin's capacity enter: no function here takes a
truth table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldtally.functions.expressions import clip, dow_flags, first_of, hours_between, to_local
from fieldtally.operators.aggregates import latest_value
from fieldtally.operators.ordering import exact_quantiles
from fieldtally.operators.windows import ewm, ffill, rolling_mean
from fieldtally.plans.marts import succeeded
from fieldtally.session import cut_lineage

# Model inputs in order, and the baselines with their column.
FEATURES = [
    "current_fill_pct",
    "fill06",
    "fill04",
    "ma7_04",
    "seasonal7_04",
    "ewm7_04",
    "recent_growth_pct",
    "history_growth_pct",
    "hours_since_collection",
    "sensor_age_hours",
    "capacity_l",
] + [f"target_dow_{i}" for i in range(7)]
BASELINES = {
    "persistence": "current_fill_pct",
    "seasonal_naive7": "seasonal7_04",
    "moving_average7": "ma7_04",
    "exponential_smoothing7": "ewm7_04",
}
QUANTILES = {"w80": 0.8, "w90": 0.9, "w95": 0.95}


@dataclass(frozen=True)
class Calendar:
    """Chronological split by target date; dates as ISO text."""

    first_issue: str
    train_end: str
    validation_end: str
    test_end: str
    issue_hour: int = 8
    holdout_mod: int = 5


def feature_frame(obs: DataFrame, dim_bin: DataFrame, cal: Calendar) -> DataFrame:
    """One row per bin and local day, with what was known at the issue hour and the next 04:00 label.

    Readings collapse to bin-days first (one shuffle); all windows then run per
    bin over days.  The warm-up days are cut after the windows.
    """
    hour = F.hour(to_local("timestamp_utc"))
    ok = F.col("sensor_status") == "ok"
    early = hour <= cal.issue_hour
    day = obs.groupBy("bin_id", F.col("service_date_local").cast("date").alias("issue_date")).agg(
        latest_value("fill_level_pct", "timestamp_utc", early & ok).alias("current_fill_pct"),
        F.max(F.when(early & ok & F.col("fill_level_pct").isNotNull(), F.col("timestamp_utc"))).alias("last_sensor_utc"),
        F.max(F.when((hour == 4) & ok, F.col("fill_level_pct"))).alias("fill04"),
        F.max(F.when((hour == 6) & ok, F.col("fill_level_pct"))).alias("fill06"),
        F.max(F.when(early & succeeded(), F.col("timestamp_utc"))).alias("__service"),
    )
    # bin-days are stored once: the fold, its key counts and the windows all read them
    day = ewm(cut_lineage(day), ["bin_id"], "issue_date", "fill04", "ewm7_04")
    w = Window.partitionBy("bin_id").orderBy("issue_date")
    local_midnight = F.col("issue_date").cast("timestamp_ntz") - F.expr("INTERVAL '05:30' HOUR TO MINUTE")
    shifted = day.withColumns(
        {
            "issue_time_utc": local_midnight + F.make_dt_interval(hours=F.lit(cal.issue_hour)),
            "target_time_utc": local_midnight + F.make_dt_interval(hours=F.lit(28)),
            "target_date": F.date_add("issue_date", 1),
            "target_fill_pct": F.lead("fill04").over(w),
            "ma7_04": rolling_mean("fill04", 7, 3, w),
            "seasonal7_04": F.lag("fill04", 6).over(w),
            "__overnight": clip(F.col("fill04") - F.lag("current_fill_pct").over(w), 0.0, 100.0),
            "recent_growth_pct": clip((F.col("current_fill_pct") - F.col("fill06")) / 2, 0.0, 50.0),
            "last_service_utc": ffill("__service", w),
        }
    ).withColumn("history_growth_pct", rolling_mean("__overnight", 7, 3, w))
    full = (
        shifted
        .where(F.col("issue_date") >= F.lit(cal.first_issue).cast("date"))
        .join(dim_bin.select("bin_id", "zone_id", "city_id", "bin_key", "zone_key", "capacity_l"), "bin_id")
    )
    split = (
        F.when(F.col("target_date") <= F.lit(cal.train_end).cast("date"), "train")
        .when(F.col("target_date") <= F.lit(cal.validation_end).cast("date"), "validation")
        .otherwise("test")
    )
    return full.select(
        "city_id",
        "bin_id",
        "bin_key",
        "zone_id",
        "zone_key",
        "issue_date",
        "issue_time_utc",
        "target_date",
        "target_time_utc",
        "last_sensor_utc",
        "last_service_utc",
        "current_fill_pct",
        "fill04",
        "fill06",
        "ma7_04",
        "ewm7_04",
        "seasonal7_04",
        "history_growth_pct",
        "recent_growth_pct",
        hours_between("last_service_utc", "issue_time_utc").alias("hours_since_collection"),
        hours_between("last_sensor_utc", "issue_time_utc").alias("sensor_age_hours"),
        "capacity_l",
        *dow_flags("target_date"),
        (F.col("bin_id") % cal.holdout_mod == 0).alias("bin_holdout"),
        split.alias("split"),
        "target_fill_pct",
    )


def labelled(features: DataFrame, cal: Calendar) -> DataFrame:
    return features.where(
        F.col("target_fill_pct").isNotNull() & (F.col("target_date") <= F.lit(cal.test_end).cast("date"))
    )


def split_group() -> Column:
    return F.when(F.col("bin_holdout"), "unseen_bins").otherwise("known_bins")


def baseline_predict(name: str) -> Column:
    """Baseline value with fallbacks known at issue time."""
    return clip(first_of(BASELINES[name], "ma7_04", "current_fill_pct", F.lit(50.0)), 0.0, 100.0)


# ridge --------------------------------------------------------------------


def _gram_batches(keys: list[str], width: int):
    """Partition function: one partial cross-product matrix per key and partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False):
                z = np.column_stack([np.ones(len(part)), np.stack(part["z"].to_numpy())])
                sums[key] = sums.get(key, np.zeros((width, width))) + z.T @ z
        for key, gram in sums.items():
            yield pd.DataFrame([[*key, gram.ravel().tolist()]], columns=[*keys, "gram"])

    return run


def _solve(keys: list[str], n_features: int, alpha: float):
    """Standardise and solve one small system per key from its summed cross products."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gram = np.zeros((n_features + 2) ** 2)
        gram[pdf["pos"].to_numpy()] = pdf["v"].to_numpy()
        gram = gram.reshape(n_features + 2, n_features + 2)
        n = gram[0, 0]
        mean = gram[0, 1:] / n
        cov = gram[1:, 1:] - n * np.outer(mean, mean)
        sd = np.sqrt(np.clip(np.diag(cov)[:-1] / n, 0, None))
        sd[sd < 1e-12] = 1.0
        xx = cov[:-1, :-1] / np.outer(sd, sd)
        xy = cov[:-1, -1] / sd
        w = np.linalg.solve(xx + alpha * np.eye(n_features), xy) / sd
        row = {k: pdf[k].iloc[0] for k in keys}
        row |= {"n": int(n), "coef": w.tolist(), "offset": float(mean[-1] - mean[:-1] @ w)}
        return pd.DataFrame([row])

    return run


def fit_ridge(train: DataFrame, keys: list[str], alpha: float = 10.0, label: str = "target_fill_pct") -> DataFrame:
    """Median-impute, standardise (population sd), ridge; one model row per key.

    Tasks reduce their rows to cross-product matrices; only those small sums
    are shuffled, so a city with most of the rows is no heavier than another.
    Values are centred on the medians, which keeps the sums well scaled.
    """
    numeric = FEATURES[:11]
    long = train.select(*keys, *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(
        keys, numeric, "feature", "value"
    )
    found = exact_quantiles(long, [*keys, "feature"], "value", {"m": 0.5})
    medians = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("feature", "m"))).alias("__med"))
    centre = [F.coalesce(F.try_element_at("__med", F.lit(c)), F.lit(0.0)) for c in numeric]
    medians = medians.select(*keys, F.array(*centre, *[F.lit(0.0)] * 7).alias("medians"))
    inputs = F.array(*[F.col(c).cast("double") for c in FEATURES])
    z = F.zip_with(inputs, F.col("medians"), lambda x, m: F.coalesce(x - m, F.lit(0.0)))
    rows = train.join(medians, keys).select(*keys, F.concat(z, F.array(F.col(label).cast("double"))).alias("z"))
    width = len(FEATURES) + 2
    types = {f.name: f.dataType.simpleString() for f in train.schema.fields}
    key_ddl = ", ".join(f"{k} {types[k]}" for k in keys)
    partial = rows.mapInPandas(_gram_batches(keys, width), f"{key_ddl}, gram array<double>")
    summed = (
        partial.select(*keys, F.posexplode("gram").alias("pos", "v")).groupBy(*keys, "pos").agg(F.sum("v").alias("v"))
    )
    models = summed.groupBy(*keys).applyInPandas(
        _solve(keys, len(FEATURES), alpha), f"{key_ddl}, n bigint, coef array<double>, offset double"
    )
    return models.join(medians, keys)


def ridge_predict() -> Column:
    """Prediction from the joined model row (coef, offset, medians), clipped to 0..100."""
    inputs = F.array(*[F.col(c).cast("double") for c in FEATURES])
    z = F.zip_with(inputs, F.col("medians"), lambda x, m: F.coalesce(x - m, F.lit(0.0)))
    parts = F.zip_with(z, F.col("coef"), lambda a, b: a * b)
    return clip(F.col("offset") + F.aggregate(parts, F.lit(0.0), lambda a, v: a + v), 0.0, 100.0)


def fit_rows(rows: DataFrame) -> DataFrame:
    """Known bins tagged by fit: ``candidate`` trains before validation, ``final`` also on it."""
    seen = rows.where(~F.col("bin_holdout") & F.col("split").isin("train", "validation"))
    fits = F.when(F.col("split") == "train", F.array(F.lit("candidate"), F.lit("final"))).otherwise(
        F.array(F.lit("final"))
    )
    return seen.withColumn("fit", F.explode(fits))


def predictions(rows: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Long (row, model, prediction) frame over validation (known bins) and test rows."""
    scored = rows.where((F.col("split") == "test") | ((F.col("split") == "validation") & ~F.col("bin_holdout")))
    scored = scored.withColumn("group", split_group())
    entries = [
        F.struct(F.lit(name).alias("model"), baseline_predict(name).alias("prediction_pct")) for name in BASELINES
    ]
    if models is not None:
        fit = F.when(F.col("split") == "validation", "candidate").otherwise("final")
        scored = scored.withColumn("fit", fit).join(
            models.select("city_id", "fit", "coef", "offset", "medians"), ["city_id", "fit"]
        )
        entries.append(F.struct(F.lit("ridge").alias("model"), ridge_predict().alias("prediction_pct")))
    return scored.select(
        "city_id", "bin_id", "target_time_utc", "split", "group", "target_fill_pct", F.explode(F.array(*entries)).alias("p")
    ).select("*", "p.model", "p.prediction_pct").drop("p")


def forecast_metrics(preds: DataFrame, keys: tuple[str, ...] = ("city_id", "split", "group", "model")) -> DataFrame:
    e = F.col("prediction_pct") - F.col("target_fill_pct")
    high = F.col("target_fill_pct") >= 95
    return preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae_pct_points"),
        F.sqrt(F.avg(e * e)).alias("rmse_pct_points"),
        (100 * F.sum(F.abs(e)) / F.nullif(F.sum("target_fill_pct"), F.lit(0.0))).alias("wape_pct"),
        (
            F.count_if(high & (F.col("prediction_pct") >= 95)) / F.greatest(F.count_if(high), F.lit(1))
        ).alias("near_full_recall"),
    )


def select_model(metrics: DataFrame, ratio: float = 0.98) -> DataFrame:
    """Per city: best baseline on validation, and ridge only if its MAE is at most ratio times that."""
    order = F.create_map(*[x for i, m in enumerate(BASELINES) for x in (F.lit(m), F.lit(i))])
    v = metrics.where(F.col("split") == "validation")
    simple = F.col("model") != "ridge"
    rank = F.when(simple, F.struct("mae_pct_points", order[F.col("model")]))
    chosen = v.groupBy("city_id").agg(
        F.min_by(F.when(simple, F.col("model")), rank).alias("best_simple"),
        F.min(F.when(simple, F.col("mae_pct_points"))).alias("best_simple_mae"),
        F.min(F.when(~simple, F.col("mae_pct_points"))).alias("ridge_mae"),
    )
    better = F.coalesce(F.col("ridge_mae") <= ratio * F.col("best_simple_mae"), F.lit(False))
    return chosen.withColumn("selected_model", F.when(better, "ridge").otherwise(F.col("best_simple")))


def interval_widths(preds: DataFrame, selected: DataFrame) -> DataFrame:
    """Empirical half-widths per city from validation residuals of the selected model."""
    chosen = preds.where(F.col("split") == "validation").join(
        selected.select("city_id", F.col("selected_model").alias("model")), ["city_id", "model"]
    )
    residual = F.abs(F.col("prediction_pct") - F.col("target_fill_pct"))
    return exact_quantiles(chosen.withColumn("__r", residual), ["city_id"], "__r", QUANTILES, how="higher")


def test_predictions(preds: DataFrame, selected: DataFrame, widths: DataFrame) -> DataFrame:
    """Test rows of the selected model with the 90 % bounds."""
    return (
        preds.where(F.col("split") == "test")
        .join(selected.select("city_id", F.col("selected_model").alias("model")), ["city_id", "model"])
        .join(widths, "city_id")
        .withColumn("lower90_pct", clip(F.col("prediction_pct") - F.col("w90"), 0.0, 100.0))
        .withColumn("upper90_pct", clip(F.col("prediction_pct") + F.col("w90"), 0.0, 100.0))
    )


def coverage(tested: DataFrame) -> DataFrame:
    inside = F.col("target_fill_pct").between(F.col("lower90_pct"), F.col("upper90_pct"))
    return tested.groupBy("city_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(inside.cast("int")).alias("coverage90")
    )


def monthly_mae(tested: DataFrame) -> DataFrame:
    month = F.date_format(to_local("target_time_utc"), "yyyy-MM")
    return tested.groupBy("city_id", month.alias("target_month"), "group").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(F.col("prediction_pct") - F.col("target_fill_pct"))).alias("mae_pct_points"),
    )


def dispatch_rows(
    features: DataFrame, issue_date: str, selected: DataFrame, widths: DataFrame, models: DataFrame | None = None
) -> DataFrame:
    """Rows of one issue date with prediction and upper bounds; label and split are not carried."""
    rows = features.where(F.col("issue_date") == F.lit(issue_date).cast("date")).drop("target_fill_pct", "split")
    rows = rows.join(selected.select("city_id", F.col("selected_model").alias("model")), "city_id").join(widths, "city_id")
    value = F.lit(None).cast("double")
    if models is not None:
        final = models.where(F.col("fit") == "final").select("city_id", "coef", "offset", "medians")
        rows = rows.join(final, "city_id")
        value = F.when(F.col("model") == "ridge", ridge_predict())
    for name in BASELINES:
        value = F.when(F.col("model") == name, baseline_predict(name)).otherwise(value)
    rows = rows.withColumn("prediction_pct", value)
    for level in (80, 90, 95):
        rows = rows.withColumn(f"upper{level}_pct", clip(F.col("prediction_pct") + F.col(f"w{level}"), 0.0, 100.0))
    return rows.drop("coef", "offset", "medians", "w80", "w90", "w95")


def run(features: DataFrame, cal: Calendar, ridge: bool = True):
    """Fit, evaluate and select.  Returns (models, predictions, metrics, selected, widths).

    Predictions are stored once, as metrics, selection, widths and tests all
    read them.
    """
    rows = labelled(features, cal)
    models = cut_lineage(fit_ridge(fit_rows(rows), ["city_id", "fit"])) if ridge else None
    preds = cut_lineage(predictions(rows, models))
    metrics = forecast_metrics(preds)
    selected = select_model(metrics)
    return models, preds, metrics, selected, interval_widths(preds, selected)
