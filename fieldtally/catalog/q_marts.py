"""Marts and star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.catalog.q_columns import BAND_SORT_SQL, BAND_SQL
from fieldtally.catalog.q_sources import CALENDAR_SQL
from fieldtally.catalog.registry import query
from fieldtally.functions.expressions import global_key
from fieldtally.operators.joins import distinct_union
from fieldtally.plans import marts, star
from fieldtally.sources.sinks import calendar_of


@query(
    "K1",
    """SELECT collection_id, bin_id, zone_id, service_date_local, attempted_at_utc, collection_status, collected_kg,
              residual_kg FROM attempt""",
    "collected_kg residual_kg",
)
def _(w):
    return w.events.drop("data_origin")


@query(
    "K2",
    "SELECT * FROM binday",
    "mean_observed_fill_pct max_observed_fill_pct arrivals_l_simulated overflow_l_simulated collected_kg_simulated",
)
def _(w):
    return w.bin_day.drop("data_origin")


@query("K3", "SELECT * FROM zoneday", "arrivals_l_simulated overflow_l_simulated collected_kg_simulated")
def _(w):
    return w.zone_day.drop("data_origin")


@query("K4", "SELECT * FROM routeday", "collected_kg_simulated distance_km_assumed")
def _(w):
    return w.route_day.drop("data_origin", "distance_origin")


@query("K5", "SELECT * FROM vehicleday", "collected_kg_simulated distance_km_assumed diesel_l_assumed")
def _(w):
    return w.vehicle_day.drop("data_origin")


@query(
    "K6",
    "SELECT * FROM cityday",
    "generated_l overflow_l collected_kg fill_sum_pct mean_fill_pct overflow_slot_pct generated_l_per_bin_day collections_per_bin_day",
)
def _(w):
    return w.city_day.drop("data_origin")


@query("K6_joined", "SELECT city_id, service_date_local, fill_sum_pct, overflow_slots, scheduled_readings FROM cityday", "fill_sum_pct")
def _(w):
    """The city mart from three separately reduced facts."""
    return marts.city_daily(w.obs_city, w.truth_city, w.bin_day).select(
        "city_id", "service_date_local", "fill_sum_pct", "overflow_slots", "scheduled_readings"
    )


@query(
    "K7",
    "SELECT * FROM attempt",
    "collected_kg residual_kg pre_service_fill_pct",
)
def _(w):
    return w.diagnostics.drop("data_origin")


@query("K8", "SELECT * FROM city_dim")
def _(w):
    return w.dim_city


@query(
    "K8_location",
    "SELECT bin_key AS location_key, bin_key, bin_id, city_id, city_name, latitude, longitude, coordinate_origin FROM bin_dim",
    "latitude longitude",
)
def _(w):
    return star.dim_location(w.dim_bin)


@query(
    "K8_vehicle",
    """SELECT DISTINCT city_id, city_id || ':P:' || (1 + (CAST(zone_id AS INTEGER) - 1) % 50) AS vehicle_key,
              'formula_proxy' AS fleet_scope, CAST(NULL AS DOUBLE) AS capacity_l FROM attempt
       UNION ALL SELECT DISTINCT city_id, city_id || ':R:' || (bin_id % 3 + 1), 'routing_scenario', 12000.0::DOUBLE FROM bin_dim""",
    "capacity_l",
)
def _(w):
    proxy = w.diagnostics.select(
        "city_id",
        global_key("city_id", F.lit("P"), 1 + (F.col("zone_id").cast("int") - 1) % 50).alias("vehicle_key"),
        F.lit("formula_proxy").alias("fleet_scope"),
        F.lit(None).cast("double").alias("capacity_l"),
    )
    routed = w.dim_bin.select(
        "city_id",
        global_key("city_id", F.lit("R"), F.col("bin_id") % 3 + 1).alias("vehicle_key"),
        F.lit("routing_scenario").alias("fleet_scope"),
        F.lit(12000.0).alias("capacity_l"),
    )
    return distinct_union(proxy, routed)


@query("K8_date", CALENDAR_SQL)
def _(w):
    return calendar_of(w.obs, "service_date_local")


@query(
    "K9",
    f"""SELECT bin_key, service_date_local AS service_date, scheduled_readings, received_readings,
               mean_observed_fill_pct * received_readings AS fill_sum_pct, max_observed_fill_pct,
               {BAND_SQL} AS mean_fill_band, {BAND_SORT_SQL} AS mean_fill_band_sort,
               arrivals_l_simulated AS generated_l, overflow_l_simulated AS overflow_l,
               CAST(overflow_l_simulated > 0 AS INTEGER) AS overflow_day_count, collected_kg_simulated AS collected_kg,
               successful_collections, missed_collections FROM binday""",
    "fill_sum_pct max_observed_fill_pct generated_l overflow_l collected_kg",
)
def _(w):
    return star.fact_bin_day(w.bin_day).drop("data_origin")


@query(
    "K9_attempt",
    """SELECT collection_id AS collection_key, bin_key, service_date_local AS service_date, attempted_at_utc, collection_status,
              collected_kg, pre_service_fill_pct, CAST(collection_status <> 'missed' AS INTEGER) AS successful_attempt_count,
              CAST(collection_status <> 'missed' AND pre_service_fill_pct < 35 AS INTEGER) AS early_success_count,
              CAST(pre_service_fill_pct >= 95 OR overflow_at_attempt AS INTEGER) AS late_risk_attempt_count FROM attempt""",
    "collected_kg pre_service_fill_pct",
)
def _(w):
    return star.fact_collection_attempt(w.diagnostics).drop("data_origin")


@query(
    "K9_zone",
    """SELECT zone_key, city_id, city_name, zone_id, city_name || ' ward ' || zone_id AS ward_label, admin_zone_name,
              boundary_version, source_id, data_origin, (min_lat + max_lat) / 2 AS map_latitude,
              (min_lon + max_lon) / 2 AS map_longitude FROM zone_dim""",
    "map_latitude map_longitude",
)
def _(w):
    return star.dim_zone(w.dim_zone)


@query(
    "K9_grains",
    """SELECT 'dim_city' AS table_name, count(*) AS rows, 0::BIGINT AS duplicates FROM city_dim
       UNION ALL SELECT 'dim_zone', count(*), 0 FROM zone_dim
       UNION ALL SELECT 'dim_bin', count(*), 0 FROM bin_dim
       UNION ALL SELECT 'dim_date', date_diff('day', min(service_date_local), max(service_date_local)) + 1, 0 FROM slot
       UNION ALL SELECT 'fact_city_day', count(*), 0 FROM cityday
       UNION ALL SELECT 'fact_bin_day', count(*), 0 FROM binday
       UNION ALL SELECT 'fact_zone_day', count(*), 0 FROM zoneday
       UNION ALL SELECT 'fact_collection_attempt', count(*), count(*) - count(DISTINCT collection_id) FROM attempt""",
)
def _(w):
    return star.grain_report(star.core_star(w), w.store.buckets)


@query(
    "K10",
    """SELECT city_id, 'overflow' AS scenario, sum(overflow_l) FILTER (WHERE m = 0) AS baseline_overflow_l,
              sum(overflow_l) FILTER (WHERE m = 1) AS optimized_overflow_l,
              sum(overflow_l) FILTER (WHERE m = 0) - sum(overflow_l) FILTER (WHERE m = 1) AS overflow_l_avoided_modelled
       FROM (SELECT city_id, bin_id % 2 AS m, overflow_l_true AS overflow_l FROM slot_city) GROUP BY 1""",
    "baseline_overflow_l optimized_overflow_l overflow_l_avoided_modelled",
)
def _(w):
    """Methods stand for two halves of the bins; totals come from the readings."""
    method = F.when(F.col("bin_id") % 2 == 0, "baseline").otherwise("optimized")
    totals = (
        w._with_bin(w.truth, "city_id")
        .groupBy("city_id", F.lit("overflow").alias("scenario"), method.alias("method"))
        .agg(F.sum("overflow_l_true").alias("overflow_l"))
    )
    return star.overflow_comparison(totals, ["city_id", "scenario"])


@query(
    "K11",
    """SELECT l_orderkey AS vehicle, sum(l_quantity) * 10 AS load_l, 100 * sum(l_quantity) * 10 / 12000 AS volume_utilization_pct,
              100 * sum(l_quantity) * 10 * 0.12 / 5000 AS payload_utilization_pct FROM lineitem GROUP BY 1""",
    "load_l volume_utilization_pct payload_utilization_pct",
)
def _(w):
    routes = w.table("lineitem").groupBy(F.col("l_orderkey").alias("vehicle")).agg((F.sum("l_quantity") * 10).alias("load_l"))
    routes = routes.withColumn("load_kg_assumed", F.col("load_l") * 0.12)
    return star.enrich_routes(routes).drop("load_kg_assumed")
