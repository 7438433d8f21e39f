"""KPI measures per city (and filtered), and the expected-versus-actual summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.catalog.q_quality import METRICS
from fieldtally.catalog.registry import query
from fieldtally.functions.expressions import ratio_of_sums
from fieldtally.operators.aggregates import to_long
from fieldtally.plans import kpi, quality as ql, star
from fieldtally.session import cut_lineage
from fieldtally.settings import FUEL_PRICE, KG_PER_LITRE, KM_PER_LITRE_FUEL, TRUCK_VOLUME_L


def with_city(w, fact):
    return fact.join(w.dim_bin.select("bin_key", "city_id"), "bin_key")


@query(
    "P1",
    """SELECT * FROM (SELECT city_id, count(DISTINCT bin_key) AS bin_count FROM bin_dim GROUP BY 1)
       JOIN (SELECT city_id, count(*) AS bin_day_count FROM binday GROUP BY 1) USING (city_id)
       JOIN (SELECT city_id, count(*) AS collection_attempts FROM attempt GROUP BY 1) USING (city_id)""",
)
def _(w):
    days = kpi.bin_day_measures(with_city(w, star.fact_bin_day(w.bin_day)), ["city_id"])
    tries = kpi.attempt_measures(with_city(w, star.fact_collection_attempt(w.diagnostics)), ["city_id"])
    return (
        kpi.bin_measures(star.dim_bin(w.dim_bin), ["city_id"])
        .join(days.select("city_id", "bin_day_count"), "city_id")
        .join(tries.select("city_id", "collection_attempts"), "city_id")
    )


@query(
    "P2",
    """SELECT * FROM (SELECT city_id, sum(generated_l) * 0.12 / 1000 AS waste_generated_t, sum(generated_l) AS generated_litres
                      FROM cityday GROUP BY 1)
       JOIN (SELECT city_id, sum(collected_kg) / 1000 AS waste_collected_t FROM attempt GROUP BY 1) USING (city_id)""",
    "waste_generated_t generated_litres waste_collected_t",
)
def _(w):
    made = kpi.city_day_measures(star.fact_city_day(w.city_day), ["city_id"])
    taken = kpi.attempt_measures(with_city(w, star.fact_collection_attempt(w.diagnostics)), ["city_id"])
    return made.select("city_id", "waste_generated_t", "generated_litres").join(
        taken.select("city_id", "waste_collected_t"), "city_id"
    )


@query(
    "P3",
    """SELECT * FROM (SELECT city_id, sum(generated_l) / sum(bins) AS generated_l_per_bin_day,
                             1.0 * sum(successful_collections) / sum(bins) AS collections_per_bin_day FROM cityday GROUP BY 1)
       JOIN (SELECT city_id, sum(arrivals_l_simulated) / count(*) AS bin_generated_l_per_bin_day,
                    sum(overflow_l_simulated) / count(*) AS overflow_l_per_bin_day FROM binday GROUP BY 1) USING (city_id)""",
    "generated_l_per_bin_day collections_per_bin_day bin_generated_l_per_bin_day overflow_l_per_bin_day",
)
def _(w):
    a = kpi.city_day_measures(star.fact_city_day(w.city_day), ["city_id"])
    b = kpi.bin_day_measures(with_city(w, star.fact_bin_day(w.bin_day)), ["city_id"])
    return a.select("city_id", "generated_l_per_bin_day", "collections_per_bin_day").join(
        b.select("city_id", "bin_generated_l_per_bin_day", "overflow_l_per_bin_day"), "city_id"
    )


@query(
    "P4",
    """SELECT * FROM (SELECT city_id, 100.0 * sum(overflow_slots) / sum(scheduled_readings) AS overflow_slot_pct FROM cityday GROUP BY 1)
       JOIN (SELECT city_id, sum(mean_observed_fill_pct * received_readings) / sum(received_readings) AS average_bin_fill_pct,
                    count(*) FILTER (WHERE overflow_l_simulated > 0) AS overflow_bin_days,
                    100.0 * count(*) FILTER (WHERE overflow_l_simulated > 0) / count(*) AS overflow_bin_day_pct
             FROM binday GROUP BY 1) USING (city_id)""",
    "overflow_slot_pct average_bin_fill_pct overflow_bin_day_pct",
)
def _(w):
    a = kpi.city_day_measures(star.fact_city_day(w.city_day), ["city_id"]).select("city_id", "overflow_slot_pct")
    b = kpi.bin_day_measures(with_city(w, star.fact_bin_day(w.bin_day)), ["city_id"])
    return a.join(b.select("city_id", "average_bin_fill_pct", "overflow_bin_days", "overflow_bin_day_pct"), "city_id")


ATTEMPT_KPI = """SELECT city_id, CAST(count(*) FILTER (WHERE collection_status <> 'missed') AS BIGINT) AS collections_completed,
       100.0 * count(*) FILTER (WHERE collection_status <> 'missed') / count(*) AS collection_completion_pct,
       100.0 * count(*) FILTER (WHERE collection_status <> 'missed' AND pre_service_fill_pct < 35)
         / count(*) FILTER (WHERE collection_status <> 'missed') AS early_collection_pct,
       100.0 * count(*) FILTER (WHERE pre_service_fill_pct >= 95 OR overflow_at_attempt) / count(*) AS late_risk_attempt_pct
       FROM attempt {where} GROUP BY 1"""
ATTEMPT_DOUBLES = "collection_completion_pct early_collection_pct late_risk_attempt_pct"


@query("P5", ATTEMPT_KPI.format(where=""), ATTEMPT_DOUBLES)
def _(w):
    tries = kpi.attempt_measures(with_city(w, star.fact_collection_attempt(w.diagnostics)), ["city_id"])
    return tries.drop("waste_collected_t", "collection_attempts")


@query(
    "P5_filtered",
    ATTEMPT_KPI.format(where="WHERE city_id = 'ASIA' AND year(service_date_local) = 1997"),
    ATTEMPT_DOUBLES,
)
def _(w):
    """The same measures under a city and a year filter that flow to the fact along the links."""
    tables = kpi.apply_filters(
        star.core_star(w), {"dim_city": F.col("city_id") == "ASIA", "dim_date": F.col("calendar_year") == 1997}
    )
    tries = kpi.attempt_measures(with_city(w, tables["fact_collection_attempt"]), ["city_id"])
    return tries.drop("waste_collected_t", "collection_attempts")


@query(
    "P6",
    """SELECT city_id, count(*) FILTER (WHERE required) AS bins_requiring_collection,
              count(*) FILTER (WHERE required AND tier = 1) AS high_priority_bins, count(*) FILTER (WHERE t4) AS forecast_triggered_bins,
              count(*) FILTER (WHERE NOT network_accessible) AS access_review_bins FROM prio GROUP BY 1""",
)
def _(w):
    return kpi.dispatch_measures(star.fact_dispatch_snapshot(w.priority), ["city_id"])


ROUTE_COLUMNS = (
    "baseline_route_km optimized_route_km distance_saved_km distance_reduction_pct fuel_saved_l fuel_cost_saved_proxy "
    "travel_minutes_saved pilot_bins_serviced"
)
ROUTE_KPI = """SELECT {key} AS context, baseline_km AS baseline_route_km, optimized_km AS optimized_route_km, km_saved AS distance_saved_km,
       distance_reduction_pct, fuel_l_saved_assumed AS fuel_saved_l, fuel_cost_inr_saved_historical_proxy AS fuel_cost_saved_proxy,
       60 * travel_hours_saved AS travel_minutes_saved,
       CASE WHEN km_saved IS NOT NULL THEN CAST(bins_serviced AS DOUBLE) END AS pilot_bins_serviced FROM plan_cmp"""


@query(
    "P7",
    ROUTE_KPI.format(key="scenario_key")
    + " UNION ALL SELECT DISTINCT city_id, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM plan_cmp",
    ROUTE_COLUMNS,
)
def _(w):
    """Per scenario, and per city, where several scenarios are in context and the measures are blank."""
    fact = cut_lineage(star.fact_route_scenario(w.route_scenarios))
    one = kpi.route_measures(fact, ["scenario_key"]).withColumnRenamed("scenario_key", "context")
    many = kpi.route_measures(fact, ["city_id"]).withColumnRenamed("city_id", "context")
    return one.unionByName(many)


@query(
    "P8",
    """SELECT scenario_key AS context, sum(distance_m) / 1000 AS route_distance_km,
              100.0 * sum(load_l) FILTER (WHERE method = 'optimized') / (12000 * count(*) FILTER (WHERE method = 'optimized'))
                AS reserved_truck_capacity_pct FROM truck_row GROUP BY 1
       UNION ALL SELECT city_id, sum(distance_m) / 1000, NULL FROM truck_row GROUP BY 1""",
    "route_distance_km reserved_truck_capacity_pct",
    digits=4,
)
def _(w):
    fact = star.fact_truck_route(w.fact_routes)
    one = kpi.truck_measures(fact, ["scenario_key"]).withColumnRenamed("scenario_key", "context")
    many = kpi.truck_measures(fact, ["city_id"]).withColumnRenamed("city_id", "context")
    return one.unionByName(many)


@query(
    "P9",
    """SELECT scenario_key AS context, overflow_l_avoided_modelled AS modelled_spill_avoided_l FROM spill_cmp
       UNION ALL SELECT DISTINCT city_id, NULL::DOUBLE FROM spill_cmp""",
    "modelled_spill_avoided_l",
)
def _(w):
    fact = cut_lineage(star.fact_counterfactual(w.overflow_comparison))
    one = kpi.spill_measures(fact, ["scenario_key"]).withColumnRenamed("scenario_key", "context")
    many = kpi.spill_measures(fact, ["city_id"]).withColumnRenamed("city_id", "context")
    return one.unionByName(many)


@query(
    "P10",
    """SELECT city_id || ':' || model AS context, mae_pct_points AS forecast_mae_pp, 100 * near_full_recall AS forecast_near_full_recall_pct
       FROM score WHERE split = 'test' AND grp = 'known_bins'
       UNION ALL SELECT DISTINCT city_id, NULL::DOUBLE, NULL::DOUBLE FROM score""",
    "forecast_mae_pp forecast_near_full_recall_pct",
)
def _(w):
    fact = star.fact_forecast_score(w.forecast_evaluation)
    known = fact.where((F.col("split") == "test") & (F.col("evaluation_group") == "known_bins"))
    one = kpi.score_measures(known, ["city_id", "model"]).select(
        F.concat_ws(":", "city_id", "model").alias("context"), "forecast_mae_pp", "forecast_near_full_recall_pct"
    )
    many = kpi.score_measures(fact, ["city_id"]).withColumnRenamed("city_id", "context")
    return one.unionByName(many)


@query(
    "P11",
    """SELECT count(*) AS checks, count(*) AS passed, 0::BIGINT AS failed, 0.0::DOUBLE AS max_absolute_difference, '' AS failed_names
       FROM (SELECT DISTINCT city_id FROM cityday), (SELECT unnest(range(0, 4)))""",
    "max_absolute_difference",
)
def _(w):
    """Measures of the star against a direct computation from readings, summarised in one row."""
    direct = w._with_bin(w.interim, "city_id").groupBy("city_id").agg(
        F.sum(METRICS["generated_l"][0]).alias("generated_l"),
        F.sum(METRICS["overflow_l"][0]).alias("overflow_l"),
        (100.0 * F.avg((F.col("overflow_l_true") > 0).cast("int"))).alias("overflow_slot_pct"),
        F.avg("fill_level_pct").alias("fill_pct"),
    )
    model = star.fact_city_day(w.city_day).groupBy("city_id").agg(
        F.sum("generated_l").alias("generated_l"),
        F.sum("overflow_l").alias("overflow_l"),
        ratio_of_sums("overflow_slots", "scheduled_readings", 100.0).alias("overflow_slot_pct"),
        ratio_of_sums("fill_sum_pct", "received_readings").alias("fill_pct"),
    )
    names = ["generated_l", "overflow_l", "overflow_slot_pct", "fill_pct"]
    checks = ql.reconcile_kpis(to_long(direct, ["city_id"], names), to_long(model, ["city_id"], names), ["city_id"])
    return ql.reconciliation_summary(checks, F.concat_ws(":", "city_id", "metric"))


# metric -> absolute tolerance, besides 1e-7 of the value
RECONCILED = {
    "bins": 0.0,
    "collected_kg": 0.01,
    "daily_collected_kg": 0.01,
    "fill_pct": 1e-7,
    "overflow_slot_pct": 1e-7,
    "generated_l_per_bin_day": 1e-6,
    "overflow_days": 0.0,
    "completed_collections": 0.0,
    "early_success_pct": 1e-7,
    "late_risk_attempt_pct": 1e-7,
    "required_bins": 0.0,
    "high_priority_bins": 0.0,
    "forecast_trigger_bins": 0.0,
    "baseline_km": 1e-6,
    "optimized_km": 1e-6,
    "saved_km": 1e-6,
    "distance_reduction_pct": 1e-6,
    "pilot_bins_serviced": 0.0,
    "optimized_truck_km": 1e-6,
    "reserved_truck_capacity_pct": 1e-7,
    "fuel_saved_l": 1e-6,
    "fuel_cost_saved_proxy": 1e-6,
    "travel_minutes_saved": 1e-6,
    "modelled_spill_avoided_l": 1e-6,
    "forecast_known_test_mae_pp": 1e-6,
    "forecast_near_full_recall_pct": 1e-6,
}
BASE = "base_3_trucks"


def share(part, whole):
    return F.lit(100.0) * part / F.nullif(whole, F.lit(0))


def _per_city(w, frames):
    """All metrics of all cities in long form; a city without rows of a kind has NULL there."""
    wide = w.dim_city.select("city_id")
    for df in frames:
        wide = wide.join(df, "city_id", "left")
    return to_long(wide, ["city_id"], list(RECONCILED))


def direct_kpis(w):
    """The 26 metrics from readings, route rows, replayed bins, dispatch rows and predictions, without star or measures."""
    done = F.col("collection_status").isin("collected", "partial")
    tried = F.col("collection_status") != "none"
    before = F.lit(100.0) * (F.col("inventory_l_true") + F.col("removed_l_true")) / F.col("capacity_l")
    # dealt over as many tasks as the store, since nearly every reading is a bin-day of its own
    dealt = w.interim_zoned.repartition(w.store.buckets, "bin_id", "service_date_local")
    bin_days = dealt.groupBy("city_id", "bin_id", "service_date_local").agg(
        F.sum("arrivals_l_true").alias("made"),
        F.sum("overflow_l_true").alias("spilt"),
        F.sum(F.when(tried, F.col("removed_l_true"))).alias("tried_l"),
        F.sum("removed_l_true").alias("taken_l"),
        F.sum("fill_level_pct").alias("fill"),
        F.count("fill_level_pct").alias("received"),
        F.count(F.lit(1)).alias("slots"),
        F.count_if(F.col("overflow_l_true") > 0).alias("over"),
        F.count_if(tried).alias("tries"),
        F.count_if(done).alias("completed"),
        F.count_if(done & (before < 35)).alias("early"),
        F.count_if(tried & ((before >= 95) | (F.col("overflow_l_true") > 0))).alias("late"),
    )
    readings = bin_days.groupBy("city_id").agg(
        (F.sum("tried_l") * KG_PER_LITRE).alias("collected_kg"),
        (F.sum("taken_l") * KG_PER_LITRE).alias("daily_collected_kg"),
        ratio_of_sums("fill", "received").alias("fill_pct"),
        ratio_of_sums("over", "slots", 100.0).alias("overflow_slot_pct"),
        F.avg("made").alias("generated_l_per_bin_day"),
        F.count_if(F.col("spilt") > 0).alias("overflow_days"),
        F.sum("completed").alias("completed_collections"),
        ratio_of_sums("early", "completed", 100.0).alias("early_success_pct"),
        ratio_of_sums("late", "tries", 100.0).alias("late_risk_attempt_pct"),
    )
    zones = w.dim_zone.select(F.col("zone_id").cast("int").alias("s_nationkey"), "city_id")
    bins = w.table("supplier").join(zones, "s_nationkey").groupBy("city_id").agg(F.count(F.lit(1)).alias("bins"))
    dispatch = w.priority.groupBy("city_id").agg(
        F.sum(F.col("required").cast("int")).alias("required_bins"),
        F.sum((F.col("required") & (F.col("tier") == 1)).cast("int")).alias("high_priority_bins"),
        F.sum(F.col("forecast_trigger").cast("int")).alias("forecast_trigger_bins"),
    )
    of = lambda m, c: F.sum(F.when(F.col("method") == m, F.col(c)))
    plans = w.stored_metrics.where(F.col("scenario") == BASE).groupBy("city_id").agg(
        (of("baseline", "distance_m") / 1000).alias("b"),
        (of("optimized", "distance_m") / 1000).alias("o"),
        ((of("baseline", "travel_seconds") - of("optimized", "travel_seconds")) / 60).alias("minutes"),
        of("optimized", "bins").alias("stops"),
        of("optimized", "load_l").alias("load"),
        (F.count_if(F.col("method") == "optimized") * F.lit(TRUCK_VOLUME_L)).alias("room"),
    )
    ok = F.col("load") <= F.col("room")
    saved = F.col("b") - F.col("o")
    both = lambda c: F.when(ok & saved.isNotNull(), c)
    routes = plans.select(
        "city_id",
        F.when(ok, F.col("b")).alias("baseline_km"),
        F.when(ok, F.col("o")).alias("optimized_km"),
        both(saved).alias("saved_km"),
        both(share(saved, F.col("b"))).alias("distance_reduction_pct"),
        both(F.col("stops")).alias("pilot_bins_serviced"),
        F.col("o").alias("optimized_truck_km"),
        share(F.col("load"), F.col("room")).alias("reserved_truck_capacity_pct"),
        both(saved / KM_PER_LITRE_FUEL).alias("fuel_saved_l"),
        both(saved / KM_PER_LITRE_FUEL * FUEL_PRICE).alias("fuel_cost_saved_proxy"),
        both(F.col("minutes")).alias("travel_minutes_saved"),
    )
    places = w.dim_bin.select((F.col("bin_id") + 1).alias("bin_id"), "city_id")
    spill = w.replay_rows.where(F.col("scenario") == BASE).join(places, "bin_id").groupBy("city_id").agg(
        (of("baseline", "overflow_l") - of("optimized", "overflow_l")).alias("modelled_spill_avoided_l")
    )
    known = (F.col("split") == "test") & (F.col("group") == "known_bins") & (F.col("model") == "ridge")
    high = F.col("target_fill_pct") >= 95
    scores = w.ridge_forecast[1].where(known).groupBy("city_id").agg(
        (F.sum(F.abs(F.col("target_fill_pct") - F.col("prediction_pct"))) / F.count("prediction_pct")).alias("forecast_known_test_mae_pp"),
        F.coalesce(share(F.count_if(high & (F.col("prediction_pct") >= 95)), F.count_if(high)), F.lit(0.0)).alias(
            "forecast_near_full_recall_pct"
        ),
    )
    return _per_city(w, [bins, readings, dispatch, routes, spill, scores])


def star_kpis(w):
    """The same metrics as measures of the star over the stored marts."""
    by = ["city_id"]
    city_days = star.fact_city_day(w.city_day)
    days = kpi.city_day_measures(city_days, by).select("city_id", "overflow_slot_pct", "generated_l_per_bin_day")
    more = city_days.groupBy("city_id").agg(
        F.sum("collected_kg").alias("daily_collected_kg"), ratio_of_sums("fill_sum_pct", "received_readings").alias("fill_pct")
    )
    bins = kpi.bin_measures(star.dim_bin(w.dim_bin), by).withColumnRenamed("bin_count", "bins")
    bin_days = kpi.bin_day_measures(with_city(w, star.fact_bin_day(w.bin_day)), by).select(
        "city_id", F.col("overflow_bin_days").alias("overflow_days")
    )
    tries = kpi.attempt_measures(with_city(w, star.fact_collection_attempt(w.diagnostics)), by).select(
        "city_id",
        (F.col("waste_collected_t") * 1000).alias("collected_kg"),
        F.col("collections_completed").alias("completed_collections"),
        F.col("early_collection_pct").alias("early_success_pct"),
        "late_risk_attempt_pct",
    )
    dispatch = kpi.dispatch_measures(star.fact_dispatch_snapshot(w.priority), by).select(
        "city_id",
        F.col("bins_requiring_collection").alias("required_bins"),
        "high_priority_bins",
        F.col("forecast_triggered_bins").alias("forecast_trigger_bins"),
    )
    base = F.col("scenario_key") == F.concat_ws(":", "city_id", F.lit(BASE))
    routes = (
        kpi.route_measures(star.fact_route_scenario(w.route_scenarios).where(base), by)
        .withColumnsRenamed({"baseline_route_km": "baseline_km", "optimized_route_km": "optimized_km", "distance_saved_km": "saved_km"})
    )
    trucks = star.fact_truck_route(w.fact_routes).where(base)
    reserved = kpi.truck_measures(trucks, by).select("city_id", "reserved_truck_capacity_pct")
    optimized = kpi.truck_measures(trucks.where(F.col("method") == "optimized"), by).select(
        "city_id", F.col("route_distance_km").alias("optimized_truck_km")
    )
    spill = kpi.spill_measures(star.fact_counterfactual(w.overflow_comparison).where(base), by)
    known = (F.col("split") == "test") & (F.col("evaluation_group") == "known_bins") & (F.col("model") == "ridge")
    scores = kpi.score_measures(star.fact_forecast_score(w.ridge_forecast[2]).where(known), by).withColumnRenamed(
        "forecast_mae_pp", "forecast_known_test_mae_pp"
    )
    return _per_city(w, [bins, days, more, bin_days, tries, dispatch, routes, reserved, optimized, spill, scores])


def reconciled_kpis(w):
    """All 26 metrics of every city, from both sides."""
    w.build_marts()
    w.__dict__["replay_rows"] = cut_lineage(w.replay_rows)
    tolerance = F.create_map(*[F.lit(x) for item in RECONCILED.items() for x in item])
    return ql.reconcile_kpis(direct_kpis(w), star_kpis(w), ["city_id"], tolerance[F.col("metric")])


@query("L8_all")
def _(w):
    return reconciled_kpis(w)


@query("P11_all")
def _(w):
    return ql.reconciliation_summary(reconciled_kpis(w), F.concat_ws(":", "city_id", "metric"))
