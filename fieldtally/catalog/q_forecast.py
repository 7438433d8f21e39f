"""Features, forecast evaluation, intervals and dispatch priorities on the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.bindings import EVENT_CALENDAR, ISSUE_DATE
from fieldtally.catalog.registry import query
from fieldtally.plans import forecast as fc, priority as pr, quality as ql, questions as q

FEATURE_DOUBLES = (
    "current_fill_pct fill04 fill06 ma7_04 ewm7_04 seasonal7_04 history_growth_pct recent_growth_pct "
    "hours_since_collection sensor_age_hours target_fill_pct"
)
FEATURE_SQL = f"""SELECT city_id, bin_id, bin_key, zone_id, zone_key, issue_date, issue_time_utc, target_date, target_time_utc,
       last_sensor_utc, last_service_utc, {", ".join(FEATURE_DOUBLES.split()[:-1])}, capacity_l,
       {", ".join(f"CAST(isodow(target_date) = {i + 1} AS INTEGER) AS target_dow_{i}" for i in range(7))},
       bin_holdout, split, target_fill_pct FROM feat"""


@query("M7", FEATURE_SQL, FEATURE_DOUBLES, digits=8)
def _(w):
    return w.features


@query(
    "M8",
    """SELECT city_id, split, bin_holdout, count(*) AS rows, count(target_fill_pct) AS labelled, min(target_date) AS first_target,
              max(target_date) AS last_target FROM feat GROUP BY 1, 2, 3""",
)
def _(w):
    return w.features.groupBy("city_id", "split", "bin_holdout").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("target_fill_pct").alias("labelled"),
        F.min("target_date").alias("first_target"),
        F.max("target_date").alias("last_target"),
    )


@query(
    "M9",
    'SELECT city_id, bin_id, target_time_utc, split, grp AS "group", target_fill_pct, model, prediction_pct FROM pred',
    "target_fill_pct prediction_pct",
)
def _(w):
    return fc.predictions(fc.labelled(w.features, EVENT_CALENDAR))


@query("M10")
def _(w):
    """Ridge models per city and fit, with their coefficients."""
    models = w.ridge_forecast[0]
    return models.select("city_id", "fit", "n", "offset", F.posexplode("coef").alias("position", "coefficient"))


@query(
    "M11",
    """SELECT city_id, split, grp AS "group", model, n, mae_pct_points, rmse_pct_points, wape_pct, near_full_recall FROM score""",
    "mae_pct_points rmse_pct_points wape_pct near_full_recall",
)
def _(w):
    return w.forecast_evaluation


@query("M11_ridge")
def _(w):
    return w.ridge_forecast[2].where(F.col("model") == "ridge")


@query(
    "M12",
    "SELECT city_id, selected_model AS best_simple, best_simple_mae, selected_model FROM choice",
    "best_simple_mae",
)
def _(w):
    return w.simple_forecast[3].drop("ridge_mae")


@query("M12_ridge")
def _(w):
    return w.ridge_forecast[3]


@query(
    "M13",
    """SELECT city_id, w80, w90, w95, n, coverage90 FROM width JOIN (
         SELECT city_id, count(*) AS n, avg(CAST(target_fill_pct BETWEEN greatest(prediction_pct - w90, 0)
                  AND least(prediction_pct + w90, 100) AS INTEGER)) AS coverage90
         FROM pred JOIN choice USING (city_id) JOIN width USING (city_id)
         WHERE model = selected_model AND split = 'test' GROUP BY 1) USING (city_id)""",
    "w80 w90 w95 coverage90",
)
def _(w):
    _, preds, _, selected, widths = w.simple_forecast
    return widths.join(fc.coverage(fc.test_predictions(preds, selected, widths)), "city_id")


@query(
    "M14",
    """SELECT city_id, strftime(target_time_utc + INTERVAL 330 MINUTE, '%Y-%m') AS target_month, grp AS "group", count(*) AS n,
              avg(abs(prediction_pct - target_fill_pct)) AS mae_pct_points
       FROM pred JOIN choice USING (city_id) WHERE model = selected_model AND split = 'test' GROUP BY 1, 2, 3""",
    "mae_pct_points",
)
def _(w):
    _, preds, _, selected, widths = w.simple_forecast
    return fc.monthly_mae(fc.test_predictions(preds, selected, widths))


@query(
    "M15",
    """SELECT city_id, bin_id, issue_date, model, current_fill_pct, prediction_pct, upper80_pct, upper90_pct, upper95_pct,
              network_accessible, in_routing_pilot FROM snapshot""",
    "current_fill_pct prediction_pct upper80_pct upper90_pct upper95_pct",
)
def _(w):
    return w.dispatch.select(
        "city_id",
        "bin_id",
        "issue_date",
        "model",
        "current_fill_pct",
        "prediction_pct",
        "upper80_pct",
        "upper90_pct",
        "upper95_pct",
        "network_accessible",
        "in_routing_pilot",
    )


@query("M15_ridge")
def _(w):
    models, _, _, selected, widths = w.ridge_forecast
    rows = fc.dispatch_rows(w.stored_features, ISSUE_DATE, selected, widths, models)
    return rows.select("city_id", "bin_id", "issue_date", "model", "prediction_pct", "upper90_pct")


@query(
    "M16",
    """SELECT city_id, bin_id, risk_upper_pct, t1 AS current_trigger, t2 AS telemetry_trigger, t3 AS gap_trigger,
              t4 AS forecast_trigger, required, tier, reasons, dispatch_status, priority_rank FROM prio""",
    "risk_upper_pct",
)
def _(w):
    return w.priority.select(
        "city_id",
        "bin_id",
        "risk_upper_pct",
        *pr.TRIGGERS,
        "required",
        "tier",
        "reasons",
        "dispatch_status",
        "priority_rank",
    )


GRID_SQL = """SELECT CAST(t AS INTEGER) AS trigger_pct, CAST(lv AS INTEGER) AS interval_level, CAST(g AS INTEGER) AS max_gap_hours,
       count(*) FILTER (WHERE need) AS required_bins, count(*) FILTER (WHERE need AND in_routing_pilot) AS pilot_required_bins,
       count(*) FILTER (WHERE need AND NOT network_accessible) AS access_exceptions,
       CAST(coalesce(sum(capacity_l) FILTER (WHERE need AND in_routing_pilot), 0) AS BIGINT) AS full_capacity_l_required_pilot
       FROM (SELECT *, coalesce(current_fill_pct >= t, FALSE) OR coalesce(sensor_age_hours > 6, TRUE) OR current_fill_pct IS NULL
                    OR coalesce(hours_since_collection >= g, TRUE)
                    OR coalesce(least(current_fill_pct + greatest(up - current_fill_pct, 0), 100) >= t, FALSE) AS need
             FROM (SELECT *, CASE lv WHEN 80 THEN upper80_pct WHEN 90 THEN upper90_pct ELSE upper95_pct END AS up
                   FROM snapshot, (SELECT unnest([70, 80, 90]) AS t), (SELECT unnest([80, 90, 95]) AS lv),
                        (SELECT unnest([36, 48, 72]) AS g)))
       GROUP BY 1, 2, 3"""


@query("M17", GRID_SQL)
def _(w):
    return pr.priority_grid(w.dispatch)


@query(
    "M21",
    f"""SELECT city_id, scenario, CAST(v AS INTEGER) AS vehicles_available, trigger_pct, count(*) AS required_bins,
               CAST(sum(capacity_l) AS BIGINT) AS full_capacity_l_required
        FROM (SELECT * FROM snapshot, (VALUES {", ".join(f"('{n}', {v}, {t}::DOUBLE, {d}::DOUBLE)" for n, v, t, d, _ in pr.SCENARIOS)})
                s(scenario, v, trigger_pct, demand) WHERE in_routing_pilot)
        WHERE coalesce(current_fill_pct >= trigger_pct, FALSE) OR coalesce(sensor_age_hours > 6, TRUE) OR current_fill_pct IS NULL
           OR coalesce(hours_since_collection >= 48, TRUE)
           OR coalesce(least(current_fill_pct + greatest(upper90_pct - current_fill_pct, 0) * demand, 100) >= trigger_pct, FALSE)
        GROUP BY 1, 2, 3, 4""",
    "trigger_pct",
)
def _(w):
    sets = pr.scenario_sets(w.dispatch)
    return sets.groupBy("city_id", "scenario", "vehicles_available", "trigger_pct").agg(
        F.count(F.lit(1)).alias("required_bins"), F.sum("capacity_l").alias("full_capacity_l_required")
    )


@query(
    "L12",
    """UNPIVOT (SELECT count(*) FILTER (WHERE last_sensor_utc > issue_time_utc) AS sensor_after_issue,
              count(*) FILTER (WHERE last_service_utc > issue_time_utc) AS service_after_issue,
              count(*) FILTER (WHERE date_diff('second', issue_time_utc, target_time_utc) <> 72000) AS wrong_horizon,
              count(*) FILTER (WHERE bin_holdout <> (bin_id % 5 = 0)) AS wrong_holdout,
              count(*) - count(DISTINCT (bin_id, issue_date)) AS repeated_key FROM feat)
       ON COLUMNS(*) INTO NAME rule VALUE violations""",
)
def _(w):
    return ql.check_leakage(w.stored_features)


@query(
    "Q21",
    """SELECT city_id, split, grp AS "group", model, n, mae_pct_points, rmse_pct_points, wape_pct, near_full_recall FROM score""",
    "mae_pct_points rmse_pct_points wape_pct near_full_recall",
)
def _(w):
    return q.q21(w.forecast_evaluation)


@query(
    "Q22",
    """SELECT city_id, bin_key, zone_key, current_fill_pct, prediction_pct, risk_upper_pct, reasons, dispatch_status, priority_rank
       FROM prio WHERE required""",
    "current_fill_pct prediction_pct risk_upper_pct",
)
def _(w):
    return q.q22(w.priority)


@query(
    "Q23",
    """SELECT z.*, required_bins, access_review_bins, boundary_version, source_id, data_origin AS boundary_origin FROM (
         SELECT *, rank() OVER (PARTITION BY city_id ORDER BY overflow_l_per_bin_day DESC) AS city_overflow_rank FROM (
           SELECT city_id, zone_key, count(*) AS observed_days, CAST(sum(bins) AS BIGINT) AS bin_days,
                  sum(arrivals_l_simulated) / sum(bins) AS generated_l_per_bin_day,
                  sum(overflow_l_simulated) / sum(bins) AS overflow_l_per_bin_day,
                  1.0 * sum(successful_collections) / sum(bins) AS completed_per_bin_day FROM zoneday GROUP BY 1, 2)) z
       LEFT JOIN (SELECT city_id, zone_key, count(*) FILTER (WHERE required) AS required_bins,
                         count(*) FILTER (WHERE NOT network_accessible) AS access_review_bins FROM prio GROUP BY 1, 2) d
         USING (city_id, zone_key)
       JOIN zone_dim w USING (city_id, zone_key) WHERE city_overflow_rank <= 5""",
    "generated_l_per_bin_day overflow_l_per_bin_day completed_per_bin_day",
)
def _(w):
    return q.q23(w.zone_day, w.priority, w.dim_zone)
