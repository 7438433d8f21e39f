"""Daily marts at declared grains."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldtally.functions.expressions import count_where, safe_div, to_type
from fieldtally.settings import (
    ATTEMPTED,
    DEPOT_KM_PER_ROUTE,
    KG_PER_LITRE,
    KM_PER_LITRE_FUEL,
    KM_PER_STOP,
    PROXY_FLEET_SIZE,
    SUCCESS,
)

def synthetic():
    return F.lit("synthetic").alias("data_origin")


def succeeded(status: str = "collection_status"):
    return F.col(status).isin(*SUCCESS)


def fact_pair(facts: DataFrame, latent: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """1:1 join of two facts.  Facts grow with the data, so neither is ever broadcast."""
    return facts.join(latent.hint("merge"), list(key))


def _attempts(interim: DataFrame, key: tuple[str, ...], extra: tuple[str, ...]) -> DataFrame:
    named = ["reading_id", "bin_id", "service_date_local", "collection_status", *extra]
    return interim.where(F.col("collection_status").isin(*ATTEMPTED)).select(
        *named, *[k for k in key if k not in named], F.col("timestamp_utc").alias("attempted_at_utc")
    )


EVENT_COLUMNS = (
    "collection_id",
    "bin_id",
    "zone_id",
    "service_date_local",
    "attempted_at_utc",
    "collection_status",
    "collected_kg",
    "residual_kg",
    "data_origin",
)


def collection_events(interim: DataFrame, truth: DataFrame, key: tuple[str, ...] = ("reading_id",)) -> DataFrame:
    """One row per service attempt; the status filter runs below the join."""
    return collection_diagnostics(interim, truth, (), key).select(*EVENT_COLUMNS)


def collection_diagnostics(
    interim: DataFrame,
    truth: DataFrame,
    extra: tuple[str, ...] = (),
    key: tuple[str, ...] = ("reading_id",),
) -> DataFrame:
    """Attempts with the latent fill before service, in one join with truth.

    Attempt and truth share the reading key, so the attempt mart and the
    diagnostic columns come out of the same join.
    """
    attempts = _attempts(interim, key, ("zone_id", *extra))
    latent = truth.select(*key, "removed_l_true", "inventory_l_true", "overflow_l_true", "capacity_l")
    return attempt_rows(fact_pair(attempts, latent, key), extra)


def attempt_rows(paired: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The diagnostic mart from attempts that stand beside their latent columns."""
    return paired.select(
        F.col("reading_id").alias("collection_id"),
        "bin_id",
        "zone_id",
        F.col("service_date_local").cast("date").alias("service_date_local"),
        "attempted_at_utc",
        "collection_status",
        *extra,
        (F.col("removed_l_true") * KG_PER_LITRE).alias("collected_kg"),
        (F.col("inventory_l_true") * KG_PER_LITRE).alias("residual_kg"),
        (
            F.lit(100.0)
            * (F.col("inventory_l_true") + F.col("removed_l_true"))
            / F.col("capacity_l")
        ).alias("pre_service_fill_pct"),
        (F.col("overflow_l_true") > 0).alias("overflow_at_attempt"),
        synthetic(),
    )


# sums the city mart needs on top of the published bin-day columns
ROLLUP_COLUMNS = ("fill_sum_pct", "overflow_slots")


def bin_daily(
    obs: DataFrame,
    truth: DataFrame,
    dim_bin: DataFrame,
    keep: tuple[str, ...] = ("zone_id",),
    key: tuple[str, ...] = ("reading_id",),
    rollup: bool = False,
) -> DataFrame:
    """Bin-day mart.

    The 1:1 reading join carries only the measured columns; rows collapse to
    bin-days before the dimension is attached, so the dimension join moves
    bin-days and not readings.  ``rollup`` adds the sums from which the city
    mart follows without another pass over readings.
    """
    facts = obs.select(
        *key,
        *[c for c in ("bin_id", "service_date_local") if c not in key],
        "fill_level_pct",
        "sensor_status",
        "collection_status",
    )
    latent = truth.select(*key, "arrivals_l_true", "overflow_l_true", "removed_l_true")
    return bin_days(fact_pair(facts, latent, key), dim_bin, keep, rollup)


def bin_days(paired: DataFrame, dim_bin: DataFrame, keep: tuple[str, ...] = ("zone_id",), rollup: bool = False) -> DataFrame:
    """The same mart from readings that stand beside their latent columns."""
    day = F.col("service_date_local").cast("date").alias("service_date_local")
    extra = [F.sum("fill_level_pct").alias("fill_sum_pct"), count_where(F.col("overflow_l_true") > 0).alias("overflow_slots")]
    daily = (
        paired.groupBy("bin_id", day)
        .agg(
            F.count(F.lit(1)).alias("scheduled_readings"),
            F.count("fill_level_pct").alias("received_readings"),
            count_where(F.col("sensor_status") == "missing").alias("missing_readings"),
            F.avg("fill_level_pct").alias("mean_observed_fill_pct"),
            F.max("fill_level_pct").alias("max_observed_fill_pct"),
            F.sum("arrivals_l_true").alias("arrivals_l_simulated"),
            F.sum("overflow_l_true").alias("overflow_l_simulated"),
            (F.sum("removed_l_true") * KG_PER_LITRE).alias("collected_kg_simulated"),
            count_where(succeeded()).alias("successful_collections"),
            count_where(F.col("collection_status") == "missed").alias("missed_collections"),
            *(extra if rollup else []),
        )
    )
    return daily.join(dim_bin.select("bin_id", *keep), "bin_id").withColumn(
        "data_origin", F.lit("synthetic")
    )


MART_SUMS = (
    "scheduled_readings",
    "received_readings",
    "missing_readings",
    "arrivals_l_simulated",
    "overflow_l_simulated",
    "collected_kg_simulated",
    "successful_collections",
    "missed_collections",
)


def zone_daily(bin_day: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return (
        bin_day.groupBy("zone_id", *keep, "service_date_local")
        .agg(F.count(F.lit(1)).alias("bins"), *[F.sum(c).alias(c) for c in MART_SUMS])
        .withColumn("data_origin", F.lit("synthetic"))
    )


def route_daily(events: DataFrame, fleet: int = PROXY_FLEET_SIZE) -> DataFrame:
    """Formula fleet: vehicle from the zone number, distance from the stop count."""
    vehicle = F.lit(1) + (to_type("zone_id", "int", safe=True) - 1) % F.lit(fleet)
    done = count_where(succeeded())
    return (
        events.withColumn("vehicle_id", vehicle)
        .groupBy("service_date_local", "vehicle_id")
        .agg(
            F.count(F.lit(1)).alias("service_attempts"),
            done.alias("successful_stops"),
            count_where(F.col("collection_status") == "missed").alias("missed_stops"),
            F.sum("collected_kg").alias("collected_kg_simulated"),
            (F.lit(DEPOT_KM_PER_ROUTE) + F.lit(KM_PER_STOP) * done).alias("distance_km_assumed"),
        )
        .select(
            "service_date_local",
            "vehicle_id",
            F.concat_ws("_", F.col("service_date_local").cast("string"), F.col("vehicle_id").cast("string")).alias("route_id"),
            "service_attempts",
            "successful_stops",
            "missed_stops",
            "collected_kg_simulated",
            "distance_km_assumed",
            F.lit("assumption").alias("distance_origin"),
            synthetic(),
        )
    )


def vehicle_daily(route_day: DataFrame, kmpl: float = KM_PER_LITRE_FUEL) -> DataFrame:
    return route_day.groupBy("service_date_local", "vehicle_id").agg(
        F.count(F.lit(1)).alias("routes"),
        *[
            F.sum(c).alias(c)
            for c in ("service_attempts", "successful_stops", "collected_kg_simulated", "distance_km_assumed")
        ],
        (F.sum("distance_km_assumed") / kmpl).alias("diesel_l_assumed"),
    ).withColumn("data_origin", F.lit("synthetic"))


def _city_columns(joined: DataFrame) -> DataFrame:
    return joined.select(
        "city_id",
        "city_name",
        "service_date_local",
        "bins",
        "generated_l",
        "overflow_l",
        "successful_collections",
        "missed_collections",
        "collected_kg",
        "scheduled_readings",
        "received_readings",
        "fill_sum_pct",
        safe_div("fill_sum_pct", "received_readings").alias("mean_fill_pct"),
        "overflow_slots",
        (F.lit(100.0) * F.col("overflow_slots") / F.col("scheduled_readings")).alias("overflow_slot_pct"),
        (F.col("generated_l") / F.col("bins")).alias("generated_l_per_bin_day"),
        (F.lit(1.0) * F.col("successful_collections") / F.col("bins")).alias("collections_per_bin_day"),
        synthetic(),
    )


def _city_sums() -> list:
    return [
        F.count(F.lit(1)).alias("bins"),
        F.sum("arrivals_l_simulated").alias("generated_l"),
        F.sum("overflow_l_simulated").alias("overflow_l"),
        F.sum("successful_collections").alias("successful_collections"),
        F.sum("missed_collections").alias("missed_collections"),
        F.sum("collected_kg_simulated").alias("collected_kg"),
    ]


def city_daily(obs: DataFrame, truth: DataFrame, bin_day: DataFrame) -> DataFrame:
    """City-day mart: each fact is reduced to city-days first, then joined."""
    keys = ["city_id", "service_date_local"]
    seen = obs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("scheduled_readings"),
        F.count("fill_level_pct").alias("received_readings"),
        F.sum("fill_level_pct").alias("fill_sum_pct"),
    )
    spilled = truth.groupBy(*keys).agg(count_where(F.col("overflow_l_true") > 0).alias("overflow_slots"))
    daily = bin_day.groupBy("city_id", "city_name", "service_date_local").agg(*_city_sums())
    return _city_columns(daily.join(seen, keys).join(spilled, keys))


def city_daily_rollup(bin_day: DataFrame) -> DataFrame:
    """The same mart from a bin-day mart built with ``rollup``: one pass over readings feeds all marts."""
    sums = [F.sum(c).alias(c) for c in ("scheduled_readings", "received_readings", *ROLLUP_COLUMNS)]
    return _city_columns(
        bin_day.groupBy("city_id", "city_name", "service_date_local").agg(*_city_sums(), *sums)
    )
