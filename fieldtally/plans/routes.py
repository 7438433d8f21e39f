"""Evaluation of route plans: metrics, feasibility, matched comparison, sensitivities.

Plans arrive as a stop table: one row per (route, stop_sequence) with the
location index of the stop, 0 being the depot.  Distances come from a long
matrix (i, j, distance_m, travel_seconds) that need only hold the legs used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldtally.operators.ordering import running_sum_split
from fieldtally.settings import (
    CO2_KG_PER_LITRE,
    FUEL_PRICE,
    KG_PER_LITRE,
    KM_PER_LITRE_FUEL,
    SERVICE_MINUTES_PER_STOP,
    SHIFT_MINUTES,
    TRUCK_PAYLOAD_KG,
    TRUCK_VOLUME_L,
    UNLOAD_MINUTES,
)

ROUTE = ["city_id", "scenario", "method", "vehicle"]


def legs(stops: DataFrame, route: list[str] = ROUTE) -> DataFrame:
    """Consecutive stop pairs by an equi-join on (route, sequence); no ordering of a whole route."""
    here = stops.select(*route, "stop_sequence", F.col("matrix_index").alias("i"))
    after = stops.select(
        *route, (F.col("stop_sequence") - 1).alias("stop_sequence"), F.col("matrix_index").alias("j")
    )
    return here.join(after, [*route, "stop_sequence"])


def reached_stops(stops: DataFrame, matrix: DataFrame, route: list[str] = ROUTE) -> DataFrame:
    """Every stop with the leg that leads to it: ``from_index``, distance_m, travel_seconds; ``has_leg`` is false at a start."""
    step = (
        legs(stops, route)
        .join(matrix, ["i", "j"], "left")
        .select(
            *route,
            (F.col("stop_sequence") + 1).alias("stop_sequence"),
            F.lit(True).alias("has_leg"),
            F.col("i").alias("from_index"),
            "distance_m",
            "travel_seconds",
        )
    )
    return stops.join(step, [*route, "stop_sequence"], "left").withColumn("has_leg", F.coalesce("has_leg", F.lit(False)))


def route_metrics(stops: DataFrame, matrix: DataFrame, route: list[str] = ROUTE) -> DataFrame:
    """Metres, seconds, reserved load and duration of every route."""
    return metrics_of(reached_stops(stops, matrix, route), route)


def metrics_of(reached: DataFrame, route: list[str] = ROUTE) -> DataFrame:
    """``route_metrics`` from stops that carry their legs: one grouping."""
    served, leg = F.col("matrix_index") != 0, F.col("has_leg")
    sums = reached.groupBy(*route).agg(
        F.count_if(served).alias("bins"),
        F.coalesce(F.sum(F.when(served, F.col("planned_capacity_l"))), F.lit(0)).alias("load_l"),
        F.sum("distance_m").alias("distance_m"),
        F.sum("travel_seconds").alias("travel_seconds"),
        F.count_if(leg & F.col("distance_m").isNull()).alias("unknown_legs"),
        F.count_if(leg).alias("__legs"),
    )
    unload = F.when(F.col("bins") > 0, F.lit(UNLOAD_MINUTES * 60)).otherwise(F.lit(0))
    return sums.where(F.col("__legs") > 0).drop("__legs").withColumns(
        {
            "duration_seconds": F.col("travel_seconds") + F.col("bins") * (SERVICE_MINUTES_PER_STOP * 60) + unload,
            "load_kg_assumed": F.col("load_l") * KG_PER_LITRE,
        }
    )


def stop_times(stops: DataFrame, matrix: DataFrame, route: list[str] = ROUTE) -> DataFrame:
    """Arrival minutes after the start at every stop."""
    return times_of(reached_stops(stops, matrix, route), route).select(*stops.columns, "arrival_minutes")


def times_of(reached: DataFrame, route: list[str] = ROUTE, parts: int | None = None) -> DataFrame:
    """``stop_times`` from stops that carry their legs."""
    served = F.when(F.col("from_index") != 0, F.lit(float(SERVICE_MINUTES_PER_STOP))).otherwise(0.0)
    timed = reached.withColumn("__m", F.coalesce(F.col("travel_seconds") / 60 + served, F.lit(0.0)))
    return running_sum_split(timed, route, "stop_sequence", "__m", "arrival_minutes", parts=parts).drop("__m")


def check_routes(stops: DataFrame, metrics: DataFrame, route: list[str] = ROUTE) -> DataFrame:
    """Feasibility flags per route: capacity, payload, shift, depot ends, no repeated bin."""
    ends = stops.groupBy(*route).agg(
        F.min_by("matrix_index", "stop_sequence").alias("__first"),
        F.max_by("matrix_index", "stop_sequence").alias("__last"),
    )
    repeats = (
        stops.where(F.col("matrix_index") != 0)
        .groupBy(*route, "matrix_index")
        .agg(F.count(F.lit(1)).alias("__c"))
        .groupBy(*route)
        .agg(F.count_if(F.col("__c") > 1).alias("repeated_bins"))
    )
    return (
        metrics.join(ends, route)
        .join(repeats, route, "left")
        .select(
            *route,
            (F.col("load_l") <= TRUCK_VOLUME_L).alias("volume_ok"),
            (F.col("load_kg_assumed") <= TRUCK_PAYLOAD_KG).alias("payload_ok"),
            (F.col("duration_seconds") <= SHIFT_MINUTES * 60).alias("shift_ok"),
            ((F.col("__first") == 0) & (F.col("__last") == 0)).alias("depot_ok"),
            (F.coalesce("repeated_bins", F.lit(0)) == 0).alias("visits_ok"),
        )
        .withColumn(
            "feasible",
            F.col("volume_ok") & F.col("payload_ok") & F.col("shift_ok") & F.col("depot_ok") & F.col("visits_ok"),
        )
    )


def capacity_certificate(required: DataFrame, volume: float = TRUCK_VOLUME_L) -> DataFrame:
    """Scenarios whose planned volume exceeds the fleet's are proven infeasible."""
    too_much = F.col("full_capacity_l_required") > F.col("vehicles_available") * volume
    return required.withColumn(
        "status", F.when(too_much, "proven_infeasible_capacity").otherwise("feasible")
    )


def compare_methods(metrics: DataFrame, scenarios: DataFrame, keys: list[str] = ["city_id", "scenario"]) -> DataFrame:
    """Baseline against optimised plan of each scenario; savings are NULL when infeasible.

    ``scenarios`` carries status and fuel_price_multiplier per key.
    """
    sums = {
        "km": F.sum("distance_m") / 1000,
        "vehicle_hours": F.sum("duration_seconds") / 3600,
        "travel_hours": F.sum("travel_seconds") / 3600,
    }
    wide = metrics.groupBy(*keys, "method").agg(*[c.alias(n) for n, c in sums.items()])
    wide = wide.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("method") == m, F.col(n))).alias(f"{m}_{n}")
            for m in ("baseline", "optimized")
            for n in sums
        ]
    )
    ok = F.col("status") == "feasible"
    joined = scenarios.join(wide, keys, "left")
    for m in ("baseline", "optimized"):
        for n in sums:
            joined = joined.withColumn(f"{m}_{n}", F.when(ok, F.col(f"{m}_{n}")))
    saved = F.col("baseline_km") - F.col("optimized_km")
    fuel = F.col("km_saved") / KM_PER_LITRE_FUEL
    return (
        joined.withColumn("km_saved", saved)
        .withColumn("distance_reduction_pct", 100 * F.col("km_saved") / F.nullif("baseline_km", F.lit(0.0)))
        .withColumn("travel_hours_saved", F.col("baseline_travel_hours") - F.col("optimized_travel_hours"))
        .withColumn("vehicle_hours_saved", F.col("baseline_vehicle_hours") - F.col("optimized_vehicle_hours"))
        .withColumn("fuel_l_saved_assumed", fuel)
        .withColumn(
            "fuel_cost_inr_saved_historical_proxy",
            F.col("fuel_l_saved_assumed") * FUEL_PRICE * F.col("fuel_price_multiplier"),
        )
        .withColumn("tailpipe_co2_kg_saved_proxy", F.col("fuel_l_saved_assumed") * CO2_KG_PER_LITRE)
    )


def fuel_sensitivity(comparison: DataFrame, economies: tuple = (3.0, 4.5, 6.0)) -> DataFrame:
    """Fuel and cost saved under a few assumed fuel economies."""
    wide = comparison.withColumn("km_per_l_assumed", F.explode(F.array(*[F.lit(float(e)) for e in economies])))
    return wide.withColumn("fuel_l_saved", F.col("km_saved") / F.col("km_per_l_assumed")).withColumn(
        "historical_cost_saved", F.col("fuel_l_saved") * FUEL_PRICE
    )
