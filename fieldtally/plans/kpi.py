"""Semantic-layer measures.

``apply_filters`` pushes dimension filters along the many-to-one links of the
star; each measure function aggregates one fact, for the whole model or per
group.  A ratio with a zero divisor, or a guarded measure whose context names
more than one city or scenario, is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldtally.functions.expressions import ratio_of_sums
from fieldtally.plans.star import LINKS
from fieldtally.settings import KG_PER_LITRE, TRUCK_VOLUME_L


def n_rows() -> Column:
    return F.count(F.lit(1))


def apply_filters(tables: dict[str, DataFrame], filters: dict[str, Column]) -> dict[str, DataFrame]:
    """Tables after filters on dimensions; only children of a filtered table are restricted."""
    out = dict(tables)
    touched = set()
    for name, cond in filters.items():
        out[name] = out[name].where(cond)
        touched.add(name)
    for parent, pk, child, fk in LINKS:
        if parent in touched and child in out:
            keys = out[parent].select(F.col(pk).alias(fk))
            out[child] = out[child].join(keys, fk, "left_semi")
            touched.add(child)
    return out


def _agg(df: DataFrame, by: list[str], aggs: list[Column]) -> DataFrame:
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def bin_measures(dim_bin: DataFrame, by: list[str] = []) -> DataFrame:
    return _agg(dim_bin, by, [F.count_distinct("bin_key").alias("bin_count")])


def city_day_measures(fact: DataFrame, by: list[str] = []) -> DataFrame:
    return _agg(
        fact,
        by,
        [
            (F.sum("generated_l") * KG_PER_LITRE / 1000).alias("waste_generated_t"),
            ratio_of_sums("generated_l", "bins").alias("generated_l_per_bin_day"),
            ratio_of_sums("overflow_slots", "scheduled_readings", 100.0).alias("overflow_slot_pct"),
            ratio_of_sums("successful_collections", "bins").alias("collections_per_bin_day"),
            F.sum("generated_l").alias("generated_litres"),
        ],
    )


def bin_day_measures(fact: DataFrame, by: list[str] = []) -> DataFrame:
    return _agg(
        fact,
        by,
        [
            n_rows().alias("bin_day_count"),
            (F.sum("generated_l") / F.nullif(n_rows(), F.lit(0))).alias("bin_generated_l_per_bin_day"),
            (F.sum("overflow_l") / F.nullif(n_rows(), F.lit(0))).alias("overflow_l_per_bin_day"),
            ratio_of_sums("fill_sum_pct", "received_readings").alias("average_bin_fill_pct"),
            F.sum("overflow_day_count").alias("overflow_bin_days"),
            (F.lit(100.0) * F.sum("overflow_day_count") / F.nullif(n_rows(), F.lit(0))).alias("overflow_bin_day_pct"),
        ],
    )


def attempt_measures(fact: DataFrame, by: list[str] = []) -> DataFrame:
    return _agg(
        fact,
        by,
        [
            (F.sum("collected_kg") / 1000).alias("waste_collected_t"),
            n_rows().alias("collection_attempts"),
            F.sum("successful_attempt_count").alias("collections_completed"),
            (F.lit(100.0) * F.avg("successful_attempt_count")).alias("collection_completion_pct"),
            ratio_of_sums("early_success_count", "successful_attempt_count", 100.0).alias("early_collection_pct"),
            (F.lit(100.0) * F.avg("late_risk_attempt_count")).alias("late_risk_attempt_pct"),
        ],
    )


def dispatch_measures(fact: DataFrame, by: list[str] = []) -> DataFrame:
    """Fixed snapshot counts; no date filter reaches this fact."""
    return _agg(
        fact,
        by,
        [
            F.count_if(F.col("required")).alias("bins_requiring_collection"),
            F.count_if(F.col("required") & (F.col("tier") == 1)).alias("high_priority_bins"),
            F.count_if(F.col("forecast_trigger")).alias("forecast_triggered_bins"),
            F.count_if(~F.col("network_accessible")).alias("access_review_bins"),
        ],
    )


def one_value(*columns: str) -> Column:
    """True when the context holds exactly one value of each column."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & (F.min(c) == F.max(c))
    return cond


ROUTE_SUMS = {
    "fuel_saved_l": ("fuel_l_saved_assumed", 1.0),
    "fuel_cost_saved_proxy": ("fuel_cost_inr_saved_historical_proxy", 1.0),
    "travel_minutes_saved": ("travel_hours_saved", 60.0),
    "pilot_bins_serviced": ("bins_serviced", 1.0),
}


def route_measures(fact: DataFrame, by: list[str] = []) -> DataFrame:
    """Route measures of one city and one scenario, feasible plans only; blank otherwise."""
    single = one_value("city_id", "scenario_key")
    feasible = lambda c: F.sum(F.when(F.col("status") == "feasible", F.col(c)))
    base = F.when(single, feasible("baseline_km"))
    best = F.when(single, feasible("optimized_km"))
    aggs = [base.alias("baseline_route_km"), best.alias("optimized_route_km"), (base - best).alias("distance_saved_km")]
    aggs.append((F.lit(100.0) * (base - best) / F.nullif(base, F.lit(0.0))).alias("distance_reduction_pct"))
    for name, (c, k) in ROUTE_SUMS.items():
        aggs.append(F.when((base - best).isNotNull(), k * F.sum(c).cast("double")).alias(name))
    return _agg(fact, by, aggs)


def truck_measures(fact: DataFrame, by: list[str] = []) -> DataFrame:
    """Route kilometres, and reserved volume of the optimised routes against truck capacity."""
    single = one_value("city_id", "scenario_key")
    optimized = F.col("method") == "optimized"
    reserved = (
        F.lit(100.0) * F.sum(F.when(optimized, F.col("load_l")))
        / F.nullif(F.lit(TRUCK_VOLUME_L) * F.count_if(optimized), F.lit(0))
    )
    return _agg(
        fact,
        by,
        [
            F.sum("distance_km").alias("route_distance_km"),
            F.when(single, reserved).alias("reserved_truck_capacity_pct"),
        ],
    )


def spill_measures(fact: DataFrame, by: list[str] = []) -> DataFrame:
    single = one_value("city_id", "scenario_key")
    return _agg(
        fact, by, [F.when(single, F.sum("overflow_l_avoided_modelled")).alias("modelled_spill_avoided_l")]
    )


def score_measures(fact: DataFrame, by: list[str] = []) -> DataFrame:
    """Forecast scores are never averaged: one city, model, split and group, else blank."""
    single = one_value("city_id", "model", "split", "evaluation_group")
    return _agg(
        fact,
        by,
        [
            F.when(single, F.max("mae_pct_points")).alias("forecast_mae_pp"),
            F.when(single, 100 * F.max("near_full_recall")).alias("forecast_near_full_recall_pct"),
        ],
    )
