"""Route evaluation and replay: each order is read as one vehicle's route."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.catalog.registry import query
from fieldtally.plans import questions as q, replay, routes, star

METRIC_DOUBLES = "distance_m travel_seconds duration_seconds load_kg_assumed"


@query("M18", "SELECT * FROM route_kpi", METRIC_DOUBLES, digits=3)
def _(w):
    return w.route_metrics.drop("unknown_legs")


@query(
    "M18_arrivals",
    "SELECT vehicle, stop_sequence, matrix_index, arrival_minutes FROM arrive_row",
    "arrival_minutes",
    digits=4,
)
def _(w):
    return routes.times_of(w.reached_stops, parts=w.route_store.buckets).select(
        "vehicle", "stop_sequence", "matrix_index", "arrival_minutes"
    )


@query(
    "M19",
    """SELECT vehicle, load_l <= 12000 AS volume_ok, load_kg_assumed <= 5000 AS payload_ok, duration_seconds <= 28800 AS shift_ok,
              TRUE AS depot_ok, n = u AS visits_ok,
              load_l <= 12000 AND load_kg_assumed <= 5000 AND duration_seconds <= 28800 AND n = u AS feasible
       FROM route_kpi JOIN (SELECT l_orderkey AS vehicle, count(*) AS n, count(DISTINCT l_suppkey) AS u FROM lineitem GROUP BY 1)
       USING (vehicle)""",
)
def _(w):
    return routes.check_routes(w.route_stops, w.stored_metrics).drop("city_id", "scenario", "method")


@query(
    "M20",
    "SELECT city_id, scenario, vehicles_available, full_capacity_l_required, status FROM plan_row",
)
def _(w):
    return routes.capacity_certificate(w.scenario_frame).select(
        "city_id", "scenario", "vehicles_available", "full_capacity_l_required", "status"
    )


COMPARE = [
    "baseline_km",
    "optimized_km",
    "baseline_vehicle_hours",
    "optimized_vehicle_hours",
    "baseline_travel_hours",
    "optimized_travel_hours",
    "km_saved",
    "distance_reduction_pct",
    "travel_hours_saved",
    "vehicle_hours_saved",
    "fuel_l_saved_assumed",
    "fuel_cost_inr_saved_historical_proxy",
    "tailpipe_co2_kg_saved_proxy",
]


@query("M22", f"SELECT scenario_key, status, {', '.join(COMPARE)} FROM plan_cmp", " ".join(COMPARE))
def _(w):
    return w.route_scenarios.select("scenario_key", "status", *COMPARE)


@query(
    "M23",
    """SELECT scenario_key, km_per_l_assumed, km_saved / km_per_l_assumed AS fuel_l_saved,
              km_saved / km_per_l_assumed * 92.39 AS historical_cost_saved
       FROM plan_cmp, (SELECT unnest([3.0, 4.5, 6.0]) AS km_per_l_assumed)""",
    "km_per_l_assumed fuel_l_saved historical_cost_saved",
)
def _(w):
    return routes.fuel_sensitivity(w.route_scenarios).select(
        "scenario_key", "km_per_l_assumed", "fuel_l_saved", "historical_cost_saved"
    )


REPLAY_DOUBLES = "initial_l arrivals_l terminal_l overflow_l collected_l"


@query("M24", "SELECT * FROM replayed", REPLAY_DOUBLES + " capacity_l")
def _(w):
    return w.replay_rows


@query(
    "M24_balance",
    "SELECT 0.0::DOUBLE AS max_gap_l, count(*) AS rows FROM replayed",
    "max_gap_l",
)
def _(w):
    return replay.balance_gap(w.replay_rows)


@query(
    "M25",
    """SELECT scenario, method, sum(initial_l) AS initial_l, sum(arrivals_l) AS arrivals_l, sum(terminal_l) AS terminal_l,
              sum(overflow_l) AS overflow_l, sum(collected_l) AS collected_l,
              CAST(sum(collection_count) AS BIGINT) AS collection_count FROM replayed GROUP BY 1, 2""",
    REPLAY_DOUBLES,
)
def _(w):
    return replay.replay_totals(w.replay_rows, ["scenario", "method"])


@query(
    "K10_replay",
    "SELECT * FROM spill_cmp",
    "baseline_overflow_l optimized_overflow_l overflow_l_avoided_modelled",
)
def _(w):
    return w.overflow_comparison


@query(
    "K11_trucks",
    """SELECT route_key, scenario_key, vehicle_key, bins, load_l, volume_utilization_pct, payload_utilization_pct FROM truck_row""",
    "volume_utilization_pct payload_utilization_pct",
)
def _(w):
    return w.fact_routes.select(
        "route_key", "scenario_key", "vehicle_key", "bins", "load_l", "volume_utilization_pct", "payload_utilization_pct"
    )


@query(
    "K9_planning",
    """SELECT 'dim_scenario' AS table_name, count(*) AS rows, 0::BIGINT AS duplicates FROM plan_row
       UNION ALL SELECT 'fact_dispatch_snapshot', count(*), 0 FROM snapshot
       UNION ALL SELECT 'fact_route_scenario', count(*), 0 FROM plan_row
       UNION ALL SELECT 'fact_truck_route', count(*), 0 FROM truck_row
       UNION ALL SELECT 'fact_forecast_score', count(*), 0 FROM score
       UNION ALL SELECT 'fact_counterfactual', count(*), 0 FROM spill_cmp""",
)
def _(w):
    return star.grain_report(star.planning_star(w), w.route_store.buckets)


@query(
    "Q19",
    """SELECT city_id, city_name, scenario, status, required_bins, bins_serviced, baseline_km, optimized_km, km_saved,
              distance_reduction_pct, optimized_km / nullif(bins_serviced, 0) AS optimized_km_per_served_bin, travel_hours_saved,
              fuel_l_saved_assumed, fuel_cost_inr_saved_historical_proxy, tailpipe_co2_kg_saved_proxy, price_scope FROM plan_cmp""",
    "baseline_km optimized_km km_saved distance_reduction_pct optimized_km_per_served_bin travel_hours_saved fuel_l_saved_assumed "
    "fuel_cost_inr_saved_historical_proxy tailpipe_co2_kg_saved_proxy",
)
def _(w):
    return q.q19(w.route_scenarios)


@query(
    "Q20",
    """SELECT city_id, city_name, scenario, method, vehicle_key, bins, volume_utilization_pct, payload_utilization_pct,
              duration_seconds / 3600 AS shift_hours, distance_m / 1000 AS route_km,
              CASE WHEN bins = 0 THEN 'unused' WHEN volume_utilization_pct >= 90 THEN 'near reserved volume limit'
                   ELSE 'reserve available' END AS reserve_status FROM truck_row""",
    "volume_utilization_pct payload_utilization_pct shift_hours route_km",
)
def _(w):
    return q.q20(w.fact_routes)


@query(
    "Q24",
    """SELECT p.city_id, p.scenario, status, required_bins, bins_serviced, baseline_km, optimized_km, km_saved, distance_reduction_pct,
              overflow_l_avoided_modelled, fuel_l_saved_assumed, fuel_cost_inr_saved_historical_proxy, price_scope
       FROM plan_cmp p LEFT JOIN spill_cmp s ON s.scenario_key = p.scenario_key
       WHERE p.scenario IN ('base_3_trucks', 'trigger_70', 'trigger_90')""",
    "baseline_km optimized_km km_saved distance_reduction_pct overflow_l_avoided_modelled fuel_l_saved_assumed "
    "fuel_cost_inr_saved_historical_proxy",
)
def _(w):
    return q.q24(w.route_scenarios, w.overflow_comparison)
