"""Operational questions over the marts.  Thresholds are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldtally.functions.expressions import (
    choose,
    count_where,
    is_weekend,
    iso_weekday,
    ratio_of_sums,
    safe_div,
    to_local,
)
from fieldtally.operators.ordering import exact_quantiles
from fieldtally.operators.windows import prior_stats, top_ranked, trailing_mean, trailing_sum
from fieldtally.plans.marts import succeeded
from fieldtally.plans.statistics import corr_matrix
from fieldtally.session import cut_lineage
from fieldtally.settings import (
    ANOMALY_HISTORY,
    ANOMALY_Z,
    EARLY_BELOW_PCT,
    KG_PER_LITRE,
    LATE_FROM_PCT,
    LOW_STOPS,
    MIN_ATTEMPTS,
    MIN_DAYS,
)

def n_rows() -> Column:
    return F.count(F.lit(1))


def is_early(limit: float = EARLY_BELOW_PCT) -> Column:
    return succeeded() & (F.col("pre_service_fill_pct") < limit)


def is_late(limit: float = LATE_FROM_PCT) -> Column:
    return (F.col("pre_service_fill_pct") >= limit) | F.col("overflow_at_attempt")


def only_city(df: DataFrame, city_id: str | None) -> DataFrame:
    """All cities, or one: the filter reaches the scan when a city is named."""
    return df if city_id is None else df.where(F.col("city_id") == city_id)


def city_totals_by_day(zone_day: DataFrame) -> DataFrame:
    """Whole-fleet day series; its length is the calendar's."""
    return zone_day.groupBy(F.col("service_date_local").alias("service_date")).agg(
        (F.sum("arrivals_l_simulated") * KG_PER_LITRE).alias("generated_kg_simulated"),
        F.sum("overflow_l_simulated").alias("overflow_l_simulated"),
        F.sum("successful_collections").alias("successful_collections"),
        F.sum("missed_collections").alias("missed_collections"),
        F.sum("scheduled_readings").alias("scheduled_readings"),
    )


def q01(zone_day, min_days=MIN_DAYS, start=None, end=None, k=25):
    span = zone_day
    if start is not None:
        span = span.where(F.col("service_date_local").between(F.lit(start), F.lit(end)))
    per_zone = (
        span.groupBy("zone_id")
        .agg(
            n_rows().alias("observed_days"),
            F.max("bins").alias("bins"),
            (F.sum("arrivals_l_simulated") * KG_PER_LITRE).alias("generated_kg_simulated"),
            ratio_of_sums("arrivals_l_simulated", "bins").alias("litres_per_bin_day"),
            F.sum("overflow_l_simulated").alias("overflow_l_simulated"),
        )
        .where(F.col("observed_days") >= min_days)
    )
    return top_ranked(per_zone, [F.desc("litres_per_bin_day")], ["zone_id"], k, "per_bin_rank")


def q02(bin_day, dim_bin, min_days=MIN_DAYS, k=25):
    """Each bin contributes one row per day, so the percentile state is a calendar long."""
    per_bin = (
        bin_day.groupBy("bin_id", "zone_id")
        .agg(
            n_rows().alias("days"),
            F.sum("arrivals_l_simulated").alias("__total"),
            F.percentile("arrivals_l_simulated", F.lit(0.9)).alias("p90_arrival_l_day"),
            F.avg("mean_observed_fill_pct").alias("mean_observed_fill_pct"),
        )
        .where(F.col("days") >= min_days)
        .join(dim_bin.select("bin_id", "capacity_l"), "bin_id")
        .select(
            "bin_id",
            "zone_id",
            "capacity_l",
            "days",
            (F.col("__total") / F.col("days")).alias("mean_arrival_l_day"),
            (F.lit(100.0) * F.col("__total") / (F.col("days") * F.col("capacity_l"))).alias("gross_capacity_pct_day"),
            "p90_arrival_l_day",
            "mean_observed_fill_pct",
        )
    )
    return top_ranked(per_bin, [F.desc("gross_capacity_pct_day")], ["bin_id"], k, "fill_rate_rank")


def q03(bin_day, k=25):
    risk = (
        bin_day.groupBy("bin_id", "zone_id")
        .agg(
            n_rows().alias("days"),
            count_where(F.col("overflow_l_simulated") > 0).alias("overflow_days"),
            F.sum("overflow_l_simulated").alias("overflow_l_simulated"),
            F.sum("missed_collections").alias("missed_attempts"),
        )
        .where(F.col("overflow_days") > 0)
        .withColumn("overflow_day_pct", F.round(F.lit(100.0) * F.col("overflow_days") / F.col("days"), 2))
    )
    return top_ranked(
        risk, [F.desc("overflow_days"), F.desc("overflow_l_simulated")], ["bin_id"], k, "risk_rank"
    )


def q04(diagnostics, min_attempts=MIN_ATTEMPTS, k=25):
    pct = lambda c: F.round(F.lit(100.0) * F.col(c) / F.col("attempts"), 2)
    return (
        diagnostics.groupBy("zone_id")
        .agg(
            n_rows().alias("attempts"),
            count_where(is_early()).alias("early_successes_lt35_pct"),
            count_where(is_late()).alias("late_risk_attempts_ge95_pct_or_overflow"),
            count_where(F.col("collection_status") == "missed").alias("missed_attempts"),
        )
        .where(F.col("attempts") >= min_attempts)
        .withColumn("early_attempt_pct", pct("early_successes_lt35_pct"))
        .withColumn("late_risk_attempt_pct", pct("late_risk_attempts_ge95_pct_or_overflow"))
        .orderBy(F.desc("late_risk_attempt_pct"), "zone_id")
        .limit(k)
    )


def q05(truth):
    return (
        truth.groupBy(F.hour(to_local("timestamp_utc")).alias("local_hour"))
        .agg(
            n_rows().alias("scheduled_bin_slots"),
            F.avg("arrivals_l_true").alias("mean_arrival_l_per_bin_slot"),
            (F.sum("arrivals_l_true") * KG_PER_LITRE).alias("generated_kg_simulated"),
            count_where(F.col("overflow_l_true") > 0).alias("overflow_slots"),
        )
        .orderBy(F.desc("mean_arrival_l_per_bin_slot"), "local_hour")
    )


def q06(zone_day):
    """The unpartitioned window runs over one row per calendar day."""
    w = Window.orderBy("service_date")
    return (
        city_totals_by_day(zone_day)
        .drop("scheduled_readings")
        .withColumn("prior_day_kg", F.lag("generated_kg_simulated").over(w))
        .withColumn("next_day_kg", F.lead("generated_kg_simulated").over(w))
        .withColumn("trailing_7day_kg", trailing_mean("generated_kg_simulated", 7, w))
    )


def q07(zone_day):
    return (
        city_totals_by_day(zone_day)
        .groupBy(iso_weekday("service_date").alias("iso_weekday"))
        .agg(
            F.max(F.when(is_weekend("service_date"), F.lit("weekend")).otherwise("weekday")).alias("day_type"),
            n_rows().alias("days"),
            F.avg("generated_kg_simulated").alias("mean_generated_kg_day"),
            F.median("generated_kg_simulated").alias("median_generated_kg_day"),
            F.avg("overflow_l_simulated").alias("mean_overflow_l_day"),
        )
    )


def q08(zone_day, min_days=MIN_DAYS, k=25):
    return (
        zone_day.groupBy("zone_id")
        .agg(
            F.max("bins").alias("bins"),
            n_rows().alias("days"),
            F.sum("successful_collections").alias("successful_collections"),
            F.sum("missed_collections").alias("missed_attempts"),
            ratio_of_sums("successful_collections", "bins", 7.0).alias("collections_per_bin_week"),
            ratio_of_sums("overflow_l_simulated", "bins").alias("overflow_l_per_bin_day"),
        )
        .where(F.col("days") >= min_days)
        .orderBy(F.desc("collections_per_bin_week"), "zone_id")
        .limit(k)
    )


def q09(route_day, low=LOW_STOPS, min_days=MIN_DAYS, k=25):
    low_day = choose([(F.col("successful_stops") < low, F.lit("low_stop_proxy"))], F.lit("other"))
    return (
        route_day.where(F.col("distance_origin") == "assumption")
        .withColumn("proxy_flag", low_day)
        .groupBy("vehicle_id")
        .agg(
            n_rows().alias("active_days"),
            count_where(F.col("proxy_flag") == "low_stop_proxy").alias("low_stop_days"),
            F.avg("successful_stops").alias("mean_successful_stops_day"),
            F.avg(safe_div("successful_stops", "distance_km_assumed")).alias("mean_stops_per_assumed_km"),
            F.sum("collected_kg_simulated").alias("collected_kg_simulated"),
            F.sum("distance_km_assumed").alias("distance_km_assumed"),
        )
        .where(F.col("active_days") >= min_days)
        .orderBy(F.desc("low_stop_days"), "vehicle_id")
        .limit(k)
    )


def anomalies(zone_day, part="zone_id", ts="service_date_local", c="arrivals_l_simulated",
              n=ANOMALY_HISTORY, z=ANOMALY_Z, k=50):
    """Zone-days far from their prior n zone-days (rows, so gaps count as adjacent)."""
    mean, sd, seen = prior_stats(c, n, Window.partitionBy(part).orderBy(ts))
    scored = (
        zone_day.select(part, ts, c, mean.alias("prior_28day_mean_l"), sd.alias("__sd"), seen.alias("__seen"))
        .where(F.col("__seen") == n)
        .withColumn("prior_window_z", safe_div(F.col(c) - F.col("prior_28day_mean_l"), "__sd"))
        .where(F.abs("prior_window_z") >= z)
    )
    return (
        scored.orderBy(F.abs("prior_window_z").desc(), part, ts)
        .limit(k)
        .select(part, ts, c, "prior_28day_mean_l", "prior_window_z", F.lit("investigate").alias("review_flag"))
    )


q10 = anomalies


def q11(zone_day):
    return (
        city_totals_by_day(zone_day)
        .groupBy(F.trunc("service_date", "month").alias("service_month"))
        .agg(
            n_rows().alias("days"),
            F.avg("generated_kg_simulated").alias("mean_generated_kg_day"),
            F.avg("overflow_l_simulated").alias("mean_overflow_l_day"),
            F.avg("successful_collections").alias("mean_successful_collections_day"),
        )
    )


def q12(obs, truth, bin_day, zone_day, events):
    """Counts and litres of five grains side by side, one row."""
    parts = [
        obs.agg(n_rows().alias("fact_scheduled_readings")),
        truth.agg(
            n_rows().alias("truth_scheduled_readings"), F.sum("arrivals_l_true").alias("truth_arrivals_l")
        ),
        bin_day.agg(
            F.sum("scheduled_readings").alias("bin_mart_scheduled_readings"),
            F.sum(F.col("successful_collections") + F.col("missed_collections")).alias("bin_mart_attempts"),
            F.sum("arrivals_l_simulated").alias("bin_mart_arrivals_l"),
        ),
        zone_day.agg(
            F.sum("scheduled_readings").alias("zone_mart_scheduled_readings"),
            F.sum("arrivals_l_simulated").alias("zone_mart_arrivals_l"),
        ),
        events.agg(n_rows().alias("collection_attempts")),
    ]
    one = [p.withColumn("__one", F.lit(1)) for p in parts]
    row = one[0]
    for p in one[1:]:
        row = row.join(p, "__one")
    return row.drop("__one")


def timing_counts(diagnostics: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts reduced to counts of (keys, status, pre-service fill, overflow), stored once.

    Counts, shares and exact medians of attempt timing all follow from this
    table, so the attempt join runs a single time.
    """
    return cut_lineage(
        diagnostics.groupBy(*keys, "collection_status", "pre_service_fill_pct", "overflow_at_attempt").agg(
            n_rows().alias("n")
        )
    )


def n_where(cond: Column) -> Column:
    """Weighted count over a table of counts."""
    return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))


def q13(diagnostics, k=25):
    """Median at attempt grain goes through the skew-safe quantile, for kept bins only."""
    counts = timing_counts(diagnostics, ["bin_id", "zone_id"])
    flagged = (
        counts.groupBy("bin_id", "zone_id")
        .agg(F.sum("n").alias("attempts"), n_where(is_early()).alias("early_successes_lt35_pct"))
        .where(F.col("early_successes_lt35_pct") > 0)
    )
    top = top_ranked(flagged, [F.desc("early_successes_lt35_pct")], ["bin_id"], k, "early_rank")
    kept = counts.join(F.broadcast(top.select("bin_id")), "bin_id", "left_semi")
    medians = exact_quantiles(
        kept, ["bin_id"], "pre_service_fill_pct", {"median_pre_service_fill_pct_true": 0.5}, weight="n"
    )
    return top.join(medians, "bin_id")


def q14(diagnostics, min_attempts=MIN_ATTEMPTS, k=25):
    per_bin = (
        diagnostics.groupBy("bin_id", "zone_id")
        .agg(
            n_rows().alias("attempts"),
            count_where(is_late()).alias("late_risk_attempts"),
            count_where(F.col("collection_status") == "missed").alias("missed_attempts"),
        )
        .where(F.col("attempts") >= min_attempts)
        .withColumn("late_risk_attempt_pct", F.lit(100.0) * F.col("late_risk_attempts") / F.col("attempts"))
    )
    return top_ranked(per_bin, [F.desc("late_risk_attempt_pct")], ["bin_id"], k, "late_rank")


def q15(city_day, diagnostics, city_id=None):
    daily = (
        only_city(city_day, city_id)
        .groupBy("city_id", "city_name")
        .agg(
            F.max("bins").alias("bin_count"),
            n_rows().alias("days"),
            F.sum("scheduled_readings").alias("scheduled_readings"),
            F.sum("received_readings").alias("received_readings"),
            ratio_of_sums("fill_sum_pct", "received_readings").alias("average_observed_fill_pct"),
            F.sum("generated_l").alias("generated_l"),
            ratio_of_sums("generated_l", "bins").alias("generated_l_per_bin_day"),
            ratio_of_sums("overflow_slots", "scheduled_readings", 100.0).alias("overflow_slot_pct"),
            F.sum("overflow_l").alias("overflow_l"),
            F.sum("successful_collections").alias("successful_collections"),
            ratio_of_sums("successful_collections", "bins").alias("collections_per_bin_day"),
            ratio_of_sums("collected_kg", "successful_collections").alias("collected_kg_per_success"),
        )
    )
    timing = (
        only_city(diagnostics, city_id)
        .groupBy("city_id")
        .agg(
            n_rows().alias("attempts"),
            count_where(is_early()).alias("early_successes"),
            count_where(is_late()).alias("__late"),
        )
    )
    return daily.join(timing, "city_id").select(
        *daily.columns,
        "attempts",
        "early_successes",
        (100.0 * safe_div("early_successes", "successful_collections")).alias("early_success_pct"),
        (100.0 * safe_div("__late", "attempts")).alias("late_risk_attempt_pct"),
    )


def q16(zone_day, city_id=None, min_bin_days=365):
    load = (
        only_city(zone_day, city_id)
        .groupBy("city_id", "city_name", "zone_key")
        .agg(
            ratio_of_sums("arrivals_l_simulated", "bins").alias("litres_per_bin_day"),
            ratio_of_sums("successful_collections", "bins").alias("services_per_bin_day"),
            F.sum("bins").alias("__bin_days"),
        )
        .where(F.col("__bin_days") >= min_bin_days)
        .drop("__bin_days")
    )
    w = Window.partitionBy("city_id").orderBy(F.desc("litres_per_bin_day"))
    return load.withColumn("within_city_rank", F.rank().over(w).cast("bigint"))


def q17(bin_day, dim_bin, city_id=None):
    per_bin = (
        only_city(bin_day, city_id)
        .groupBy("city_id", "city_name", "bin_key")
        .agg(
            F.sum("successful_collections").alias("annual_services"),
            F.avg("arrivals_l_simulated").alias("__mean_l"),
            count_where(F.col("overflow_l_simulated") > 0).alias("overflow_days"),
        )
        .where(F.col("annual_services") > 0)
    )
    return per_bin.join(dim_bin.select("city_id", "bin_key", "capacity_l"), ["city_id", "bin_key"]).select(
        "city_id",
        "city_name",
        "bin_key",
        "capacity_l",
        "annual_services",
        (F.col("__mean_l") / F.col("capacity_l") * 100).alias("gross_capacity_pct_per_day"),
        "overflow_days",
    )


def q18(city_day, city_id=None):
    w = Window.partitionBy("city_id").orderBy("service_date_local")
    return only_city(city_day, city_id).select(
        "city_id",
        "city_name",
        "service_date_local",
        "mean_fill_pct",
        "overflow_slot_pct",
        "generated_l_per_bin_day",
        F.lag("generated_l_per_bin_day").over(w).alias("previous_day_l_per_bin"),
        trailing_mean("generated_l_per_bin_day", 7, w).alias("rolling7_l_per_bin"),
    )


def q19(route_scenarios, city_id=None):
    return only_city(route_scenarios, city_id).select(
        "city_id",
        "city_name",
        "scenario",
        "status",
        "required_bins",
        "bins_serviced",
        "baseline_km",
        "optimized_km",
        "km_saved",
        "distance_reduction_pct",
        safe_div("optimized_km", "bins_serviced").alias("optimized_km_per_served_bin"),
        "travel_hours_saved",
        "fuel_l_saved_assumed",
        "fuel_cost_inr_saved_historical_proxy",
        "tailpipe_co2_kg_saved_proxy",
        "price_scope",
    )


def q20(fact_routes, city_id=None):
    used = F.col("volume_utilization_pct")
    return only_city(fact_routes, city_id).select(
        "city_id",
        "city_name",
        "scenario",
        "method",
        "vehicle_key",
        "bins",
        "volume_utilization_pct",
        "payload_utilization_pct",
        (F.col("duration_seconds") / 3600).alias("shift_hours"),
        (F.col("distance_m") / 1000).alias("route_km"),
        choose(
            [
                (F.col("bins") == 0, F.lit("unused")),
                (used >= 90, F.lit("near reserved volume limit")),
            ],
            F.lit("reserve available"),
        ).alias("reserve_status"),
    )


def q21(forecast_evaluation, city_id=None):
    return only_city(forecast_evaluation, city_id).select(
        "city_id", "split", "group", "model", "n", "mae_pct_points", "rmse_pct_points", "wape_pct", "near_full_recall"
    )


def q22(priority, city_id=None):
    return (
        only_city(priority, city_id)
        .where("required")
        .select(
            "city_id",
            "bin_key",
            "zone_key",
            "current_fill_pct",
            "prediction_pct",
            "risk_upper_pct",
            "reasons",
            "dispatch_status",
            "priority_rank",
        )
    )


def q23(zone_day, priority, dim_zone, k=5):
    """Zones to audit: top k per city by overflow litres per bin-day."""
    days = (
        zone_day.groupBy("city_id", "zone_key")
        .agg(
            n_rows().alias("observed_days"),
            F.sum("bins").alias("bin_days"),
            ratio_of_sums("arrivals_l_simulated", "bins").alias("generated_l_per_bin_day"),
            ratio_of_sums("overflow_l_simulated", "bins").alias("overflow_l_per_bin_day"),
            ratio_of_sums("successful_collections", "bins").alias("completed_per_bin_day"),
        )
    )
    w = Window.partitionBy("city_id").orderBy(F.desc("overflow_l_per_bin_day"))
    top = days.withColumn("city_overflow_rank", F.rank().over(w).cast("bigint")).where(F.col("city_overflow_rank") <= k)
    dispatch = priority.groupBy("city_id", "zone_key").agg(
        count_where(F.col("required")).alias("required_bins"),
        count_where(~F.col("network_accessible")).alias("access_review_bins"),
    )
    labels = dim_zone.select(
        "city_id", "zone_key", "boundary_version", "source_id", F.col("data_origin").alias("boundary_origin")
    )
    return top.join(dispatch, ["city_id", "zone_key"], "left").join(labels, ["city_id", "zone_key"])


def q24(route_scenarios, overflow_comparison, scenarios=("base_3_trucks", "trigger_70", "trigger_90")):
    chosen = route_scenarios.where(F.col("scenario").isin(*scenarios))
    spill = overflow_comparison.select("city_id", "scenario_key", "overflow_l_avoided_modelled")
    return chosen.join(spill, ["city_id", "scenario_key"], "left").select(
        "city_id",
        "scenario",
        "status",
        "required_bins",
        "bins_serviced",
        "baseline_km",
        "optimized_km",
        "km_saved",
        "distance_reduction_pct",
        "overflow_l_avoided_modelled",
        "fuel_l_saved_assumed",
        "fuel_cost_inr_saved_historical_proxy",
        "price_scope",
    )


def q25_month(zone_day, start, end):
    inside = zone_day.where(F.col("service_date_local").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return inside.agg(
        n_rows().alias("rows"),
        F.sum("scheduled_readings").alias("scheduled_readings"),
        F.sum("received_readings").alias("received_readings"),
        F.sum("collected_kg_simulated").alias("collected_kg_simulated"),
    )


def q25(zone_day, start, end):
    w = Window.partitionBy("zone_id").orderBy("service_date_local")
    return zone_day.where(
        F.col("service_date_local").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    ).select(
        "zone_id",
        "service_date_local",
        "collected_kg_simulated",
        trailing_sum("collected_kg_simulated", 7, w).alias("trailing_7day_kg"),
    )


def q26(bin_day, dim_bin):
    per_bin = bin_day.groupBy("bin_id").agg(
        n_rows().alias("days"),
        F.sum("arrivals_l_simulated").alias("__total"),
        count_where(F.col("overflow_l_simulated") > 0).alias("overflow_days"),
        F.sum("overflow_l_simulated").alias("annual_overflow_l_simulated"),
        F.sum("successful_collections").alias("successful_collections"),
        F.sum("missed_collections").alias("missed_collections"),
        F.avg("mean_observed_fill_pct").alias("mean_observed_fill_pct"),
    )
    dims = dim_bin.select("bin_id", "zone_id", "latitude", "longitude", "capacity_l", "demand_factor")
    return per_bin.join(dims, "bin_id").select(
        *dims.columns,
        "days",
        (F.col("__total") / F.col("days")).alias("mean_arrival_l_day"),
        (F.lit(100.0) * F.col("__total") / (F.col("days") * F.col("capacity_l"))).alias("gross_capacity_pct_day"),
        "overflow_days",
        "annual_overflow_l_simulated",
        "successful_collections",
        "missed_collections",
        "mean_observed_fill_pct",
    )


def q27_zones(zone_day):
    return zone_day.groupBy("zone_id").agg(
        F.max("bins").alias("bins"),
        n_rows().alias("days"),
        (F.sum("arrivals_l_simulated") * KG_PER_LITRE).alias("generated_kg_simulated"),
        ratio_of_sums("arrivals_l_simulated", "bins").alias("mean_arrival_l_bin_day"),
        F.sum("overflow_l_simulated").alias("overflow_l_simulated"),
        ratio_of_sums("successful_collections", "bins", 7.0).alias("collections_per_bin_week"),
    )


def q27_status(events):
    return events.groupBy("collection_status").agg(
        n_rows().alias("attempts"),
        F.sum("collected_kg").alias("collected_kg_simulated"),
        F.avg("collected_kg").alias("mean_collected_kg_attempt"),
    )


def q27_timing(diagnostics):
    table = timing_counts(diagnostics, [])
    counts = table.agg(
        F.sum("n").alias("attempts"),
        n_where(succeeded()).alias("successful_attempts"),
        n_where(is_early()).alias("early_successes_lt35_pct"),
        n_where(is_late()).alias("near_full_or_overflow_attempts"),
    ).withColumn("__one", F.lit(1))
    median = exact_quantiles(
        table, [], "pre_service_fill_pct", {"median_pre_service_fill_pct_true": 0.5}, weight="n"
    ).withColumn("__one", F.lit(1))
    return counts.join(median, "__one").drop("__one")


def q28(zone_day, truth):
    w = Window.orderBy("service_date")
    slots = truth.groupBy(F.col("service_date_local").alias("service_date")).agg(
        count_where(F.col("overflow_l_true") > 0).alias("overflowing_slots"),
        n_rows().alias("scheduled_slots"),
    )
    return (
        city_totals_by_day(zone_day)
        .join(slots, "service_date")
        .withColumn("overflow_slot_pct", 100.0 * F.col("overflowing_slots") / F.col("scheduled_slots"))
        .withColumn("weekday", F.date_format("service_date", "EEEE"))
        .withColumn("weekend", is_weekend("service_date"))
        .withColumn("month", F.month("service_date"))
        .withColumn("trailing_7day_kg", trailing_mean("generated_kg_simulated", 7, w))
    )


def q29(city_frame, bin_summary, route_day, events, diagnostics, obs, low=LOW_STOPS):
    """The 21 run totals, each from the grain that owns it; the day frame is stored once."""
    city_frame = cut_lineage(city_frame)
    days = city_frame.agg(
        F.sum("scheduled_readings").alias("readings"),
        F.sum("generated_kg_simulated").alias("generated_kg_simulated"),
        (F.sum("generated_kg_simulated") / 1000).alias("generated_tonnes_simulated"),
        F.sum("overflow_l_simulated").alias("overflow_l_simulated"),
        F.sum("overflowing_slots").alias("overflow_slots"),
        ratio_of_sums("overflowing_slots", "scheduled_slots", 100.0).alias("overflow_slot_pct"),
        F.sum("successful_collections").alias("successful_collections"),
        F.sum("missed_collections").alias("missed_attempts"),
        F.avg(F.when(~F.col("weekend"), F.col("generated_kg_simulated"))).alias("weekday_mean_kg_day"),
        F.avg(F.when(F.col("weekend"), F.col("generated_kg_simulated"))).alias("weekend_mean_kg_day"),
    )
    fills = obs.agg(F.count("fill_level_pct").alias("observed_fill_readings"))
    partial = events.agg(count_where(F.col("collection_status") == "partial").alias("partial_collections"))
    timing = q27_timing(diagnostics).drop("successful_attempts")
    pair = ["gross_capacity_pct_day", "overflow_days"]
    stored = cut_lineage(bin_summary.select("bin_id", *pair))
    rho = None
    for method in ("spearman", "pearson"):
        one_value = corr_matrix(stored, "bin_id", pair, method).select(
            F.col("correlation").alias(f"bin_gross_rate_overflow_{method}"), F.lit(1).alias("__one")
        )
        rho = one_value if rho is None else rho.join(one_value, "__one")
    rho = rho.drop("__one")
    routes = route_day.agg(
        count_where(F.col("successful_stops") < low).alias("route_low_stop_days_lt4"),
        n_rows().alias("route_active_days"),
        F.max("distance_origin").alias("distance_origin"),
    )
    one = [p.withColumn("__one", F.lit(1)) for p in (days, fills, partial, timing, rho, routes)]
    row = one[0]
    for p in one[1:]:
        row = row.join(p, "__one")
    return row.drop("__one")
