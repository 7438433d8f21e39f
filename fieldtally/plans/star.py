"""Star-schema tables: projections of the marts at asserted grains."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldtally.functions.expressions import fill_band, fill_band_sort
from fieldtally.operators.aggregates import pivot_fixed
from fieldtally.plans.quality import check_pk
from fieldtally.plans.questions import is_early, is_late
from fieldtally.plans.marts import succeeded
from fieldtally.settings import TRUCK_PAYLOAD_KG, TRUCK_VOLUME_L
from fieldtally.sources.sinks import calendar_of


def ward_label():
    return F.concat(F.col("city_name"), F.lit(" ward "), F.col("zone_id")).alias("ward_label")


def dim_location(dim_bin: DataFrame) -> DataFrame:
    return dim_bin.select(
        F.col("bin_key").alias("location_key"),
        "bin_key",
        "bin_id",
        "city_id",
        "city_name",
        "latitude",
        "longitude",
        "coordinate_origin",
    )


def dim_zone(zones: DataFrame) -> DataFrame:
    return zones.select(
        "zone_key",
        "city_id",
        "city_name",
        "zone_id",
        ward_label(),
        "admin_zone_name",
        "boundary_version",
        "source_id",
        "data_origin",
        ((F.col("min_lat") + F.col("max_lat")) / 2).alias("map_latitude"),
        ((F.col("min_lon") + F.col("max_lon")) / 2).alias("map_longitude"),
    )


def dim_bin(bins: DataFrame) -> DataFrame:
    return bins.select(
        "bin_key",
        "city_id",
        "city_name",
        "zone_key",
        "zone_id",
        ward_label(),
        "capacity_l",
        "latitude",
        "longitude",
        "coordinate_origin",
        "data_origin",
        "source_id",
    )


def dim_scenario(route_scenarios: DataFrame, base: str = "base_3_trucks") -> DataFrame:
    return route_scenarios.select(
        "scenario_key",
        "city_id",
        "scenario",
        "vehicles_available",
        "trigger_pct",
        "demand_multiplier",
        "fuel_price_multiplier",
        "status",
        "price_scope",
        (F.col("scenario") == base).alias("base_scenario"),
    )


def fact_city_day(city_day: DataFrame) -> DataFrame:
    return city_day.select(
        "city_id",
        F.col("service_date_local").alias("service_date"),
        "bins",
        "generated_l",
        "overflow_l",
        "successful_collections",
        "missed_collections",
        "collected_kg",
        "scheduled_readings",
        "received_readings",
        "fill_sum_pct",
        "overflow_slots",
    )


def fact_bin_day(bin_day: DataFrame) -> DataFrame:
    return bin_day.select(
        "bin_key",
        F.col("service_date_local").alias("service_date"),
        "scheduled_readings",
        "received_readings",
        (F.col("mean_observed_fill_pct") * F.col("received_readings")).alias("fill_sum_pct"),
        "max_observed_fill_pct",
        fill_band("mean_observed_fill_pct").alias("mean_fill_band"),
        fill_band_sort("mean_observed_fill_pct").alias("mean_fill_band_sort"),
        F.col("arrivals_l_simulated").alias("generated_l"),
        F.col("overflow_l_simulated").alias("overflow_l"),
        (F.col("overflow_l_simulated") > 0).cast("int").alias("overflow_day_count"),
        F.col("collected_kg_simulated").alias("collected_kg"),
        "successful_collections",
        "missed_collections",
        "data_origin",
    )


def fact_zone_day(zone_day: DataFrame) -> DataFrame:
    return zone_day.select(
        "zone_key",
        F.col("service_date_local").alias("service_date"),
        "bins",
        "scheduled_readings",
        "received_readings",
        F.col("arrivals_l_simulated").alias("generated_l"),
        F.col("overflow_l_simulated").alias("overflow_l"),
        F.col("collected_kg_simulated").alias("collected_kg"),
        "successful_collections",
        "missed_collections",
    )


def fact_collection_attempt(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.select(
        F.col("collection_id").alias("collection_key"),
        "bin_key",
        F.col("service_date_local").alias("service_date"),
        "attempted_at_utc",
        "collection_status",
        "collected_kg",
        "pre_service_fill_pct",
        succeeded().cast("int").alias("successful_attempt_count"),
        is_early().cast("int").alias("early_success_count"),
        is_late().cast("int").alias("late_risk_attempt_count"),
        "data_origin",
    )


def fact_dispatch_snapshot(priority: DataFrame) -> DataFrame:
    return priority.select(
        "bin_key",
        "city_id",
        "issue_date",
        "target_date",
        "current_fill_pct",
        "prediction_pct",
        "upper90_pct",
        "required",
        "forecast_trigger",
        "network_accessible",
        "in_routing_pilot",
        "dispatch_status",
        "priority_rank",
        "tier",
        "reasons",
        "trigger_pct",
    )


def fact_route_scenario(route_scenarios: DataFrame) -> DataFrame:
    return route_scenarios.select(
        "scenario_key",
        "city_id",
        "scenario",
        "status",
        "required_bins",
        "bins_serviced",
        "baseline_complete",
        "baseline_km",
        "optimized_km",
        "km_saved",
        "distance_reduction_pct",
        "travel_hours_saved",
        "vehicle_hours_saved",
        "fuel_l_saved_assumed",
        "fuel_cost_inr_saved_historical_proxy",
        "tailpipe_co2_kg_saved_proxy",
        "full_capacity_l_required",
    )


def fact_truck_route(fact_routes: DataFrame) -> DataFrame:
    return fact_routes.select(
        "route_key",
        "scenario_key",
        "city_id",
        "method",
        "vehicle",
        "bins",
        (F.col("distance_m") / 1000).alias("distance_km"),
        (F.col("travel_seconds") / 60).alias("travel_minutes"),
        "load_l",
        (F.col("duration_seconds") / 60).alias("route_minutes"),
        "load_kg_assumed",
        "volume_utilization_pct",
        "payload_utilization_pct",
    )


def fact_forecast_score(evaluation: DataFrame) -> DataFrame:
    return evaluation.select(
        "city_id",
        "split",
        F.col("group").alias("evaluation_group"),
        "model",
        "n",
        "mae_pct_points",
        "rmse_pct_points",
        "wape_pct",
        "near_full_recall",
    )


def fact_counterfactual(comparison: DataFrame) -> DataFrame:
    return comparison.select(
        "scenario_key", "city_id", "baseline_overflow_l", "optimized_overflow_l", "overflow_l_avoided_modelled"
    )


# table -> (parent key columns), and the sixteen many-to-one links of the model
GRAINS = {
    "dim_city": ["city_id"],
    "dim_date": ["service_date"],
    "dim_zone": ["zone_key"],
    "dim_bin": ["bin_key"],
    "dim_scenario": ["scenario_key"],
    "fact_city_day": ["city_id", "service_date"],
    "fact_bin_day": ["bin_key", "service_date"],
    "fact_zone_day": ["zone_key", "service_date"],
    "fact_collection_attempt": ["collection_key"],
    "fact_dispatch_snapshot": ["bin_key"],
    "fact_route_scenario": ["scenario_key"],
    "fact_truck_route": ["route_key"],
    "fact_forecast_score": ["city_id", "split", "evaluation_group", "model"],
    "fact_counterfactual": ["scenario_key"],
}
# The links of the model as parent, its key, child, the child's column.
LINKS = [
    ("dim_city", "city_id", "dim_bin", "city_id"),
    ("dim_city", "city_id", "dim_zone", "city_id"),
    ("dim_city", "city_id", "dim_scenario", "city_id"),
    ("dim_city", "city_id", "fact_city_day", "city_id"),
    ("dim_city", "city_id", "fact_forecast_score", "city_id"),
    ("dim_date", "service_date", "fact_city_day", "service_date"),
    ("dim_date", "service_date", "fact_bin_day", "service_date"),
    ("dim_date", "service_date", "fact_zone_day", "service_date"),
    ("dim_date", "service_date", "fact_collection_attempt", "service_date"),
    ("dim_bin", "bin_key", "fact_bin_day", "bin_key"),
    ("dim_bin", "bin_key", "fact_collection_attempt", "bin_key"),
    ("dim_bin", "bin_key", "fact_dispatch_snapshot", "bin_key"),
    ("dim_zone", "zone_key", "fact_zone_day", "zone_key"),
    ("dim_scenario", "scenario_key", "fact_route_scenario", "scenario_key"),
    ("dim_scenario", "scenario_key", "fact_truck_route", "scenario_key"),
    ("dim_scenario", "scenario_key", "fact_counterfactual", "scenario_key"),
]


def core_star(w) -> dict[str, DataFrame]:
    """The operational tables of the model."""
    return {
        "dim_city": w.dim_city,
        "dim_date": calendar_of(w.obs, "service_date_local"),
        "dim_zone": dim_zone(w.dim_zone),
        "dim_bin": dim_bin(w.dim_bin),
        "fact_city_day": fact_city_day(w.city_day),
        "fact_bin_day": fact_bin_day(w.bin_day),
        "fact_zone_day": fact_zone_day(w.zone_day),
        "fact_collection_attempt": fact_collection_attempt(w.diagnostics),
    }


def planning_star(w) -> dict[str, DataFrame]:
    """The dispatch, route and forecast tables of the model."""
    return {
        "dim_scenario": dim_scenario(w.route_scenarios),
        "fact_dispatch_snapshot": fact_dispatch_snapshot(w.priority),
        "fact_route_scenario": fact_route_scenario(w.route_scenarios),
        "fact_truck_route": fact_truck_route(w.fact_routes),
        "fact_forecast_score": fact_forecast_score(w.forecast_evaluation),
        "fact_counterfactual": fact_counterfactual(w.overflow_comparison),
    }


def star_tables(w) -> dict[str, DataFrame]:
    return {**core_star(w), **planning_star(w)}


# tables whose keys grow with the readings, orders or events
GROWING = ("fact_bin_day", "fact_collection_attempt", "fact_dispatch_snapshot", "fact_truck_route")


def grain_report(tables: dict[str, DataFrame], parts: int | None = None) -> DataFrame:
    """Rows and surplus key copies of each table at its declared grain; ``parts`` tasks for each growing one."""
    out = None
    for name, df in tables.items():
        row = check_pk(df, GRAINS[name], name, parts if name in GROWING else None).select("table_name", "rows", "duplicates")
        out = row if out is None else out.unionByName(row)
    return out


def overflow_comparison(totals: DataFrame, keys: list[str]) -> DataFrame:
    """Baseline and optimised spill side by side, and the difference."""
    wide = pivot_fixed(totals, keys, "method", ["baseline", "optimized"], F.sum("overflow_l"))
    return wide.select(
        *keys,
        F.col("baseline").alias("baseline_overflow_l"),
        F.col("optimized").alias("optimized_overflow_l"),
        (F.col("baseline") - F.col("optimized")).alias("overflow_l_avoided_modelled"),
    )


def enrich_routes(routes: DataFrame, volume: float = TRUCK_VOLUME_L, payload: float = TRUCK_PAYLOAD_KG) -> DataFrame:
    return routes.withColumns(
        {
            "volume_utilization_pct": F.lit(100.0) * F.col("load_l") / volume,
            "payload_utilization_pct": F.lit(100.0) * F.col("load_kg_assumed") / payload,
        }
    )
