"""The bindings and marts once more, as SQL common table expressions.

``with_ctes`` prefixes a query with exactly the definitions it refers to.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def with_ctes(body: str, doubles: tuple[str, ...] = (), digits: int = 6) -> str:
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                order.append(name)

    visit(body)
    # inputs before users
    ranked: list[str] = []

    def place(name: str) -> None:
        if name in ranked:
            return
        for other in order:
            if other != name and re.search(rf"\b{other}\b", CTES[name]):
                place(other)
        ranked.append(name)

    for name in order:
        place(name)
    parts = [f"{n} AS ({CTES[n]})" for n in ranked] + [f"answer AS ({body.strip()})"]
    if doubles:
        fixed = ", ".join(f"ROUND(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in doubles)
        tail = f"SELECT * REPLACE ({fixed}) FROM answer"
    else:
        tail = "SELECT * FROM answer"
    return "WITH " + ",\n".join(parts) + "\n" + tail


cte(
    "city_dim",
    """SELECT r_name AS city_id, 'Region ' || r_regionkey AS city_name, r_regionkey AS district,
       'derived' AS data_origin, 'synthetic' AS operational_data_origin FROM region""",
)
cte(
    "zone_dim",
    """SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS zone_id, r_name AS city_id,
       'Region ' || r_regionkey AS city_name,
       r_name || ':' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS zone_key,
       n_name AS admin_zone_name, 'v1' AS boundary_version, 'SRC_NATION' AS source_id,
       'derived' AS data_origin,
       80.14995 + 0.046 * (n_nationkey % 5) AS min_lon, 12.89995 + 0.07 * (n_nationkey // 5) AS min_lat,
       80.14995 + 0.046 * (n_nationkey % 5) + 0.046 AS max_lon,
       12.89995 + 0.07 * (n_nationkey // 5) + 0.07 AS max_lat
       FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
cte(
    "bin_dim",
    """SELECT s_suppkey AS bin_id, z.zone_id, z.city_id, z.city_name,
       z.city_id || ':' || s_suppkey AS bin_key, z.zone_key,
       80.15 + CAST((s_suppkey * 7919) % 2300 AS DOUBLE) / 10000.0 AS longitude,
       12.90 + CAST((s_suppkey * 104729) % 3500 AS DOUBLE) / 10000.0 AS latitude,
       50 AS capacity_l, 1.0 + s_acctbal / 10000.0 AS demand_factor,
       'derived' AS coordinate_origin, 'synthetic' AS data_origin, 'SRC_SUPPLIER' AS source_id
       FROM supplier JOIN zone_dim z ON z.zone_id = lpad(CAST(s_nationkey AS VARCHAR), 3, '0')""",
)
cte(
    "slot",
    """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS reading_id,
       l_suppkey AS bin_id,
       l_shipdate - INTERVAL 330 MINUTE
         + to_hours(CAST(2 * ((l_orderkey + l_linenumber) % 12) AS BIGINT)) AS timestamp_utc,
       CAST(l_shipdate AS DATE) AS service_date_local,
       CASE WHEN l_linenumber <> 7 THEN least(100.0, l_quantity * 2) END AS fill_level_pct,
       CASE WHEN l_linenumber = 7 THEN 'missing' ELSE 'ok' END AS sensor_status,
       100.0 - l_tax * 100 AS battery_pct,
       CASE WHEN l_linenumber = 1 THEN 'none' WHEN l_returnflag = 'N' THEN 'collected'
            WHEN l_returnflag = 'A' THEN 'partial' ELSE 'missed' END AS collection_status,
       l_quantity AS arrivals_l_true,
       CASE WHEN l_linenumber <> 1 AND l_returnflag IN ('N', 'A')
            THEN l_quantity * (1 - l_discount) ELSE 0.0 END AS removed_l_true,
       l_quantity - CASE WHEN l_linenumber <> 1 AND l_returnflag IN ('N', 'A')
            THEN l_quantity * (1 - l_discount) ELSE 0.0 END AS inventory_l_true,
       greatest(l_quantity - 40, 0.0) AS overflow_l_true, 50 AS capacity_l
       FROM lineitem""",
)
cte(
    "slot_city",
    """SELECT s.*, b.zone_id, b.zone_key, b.city_id, b.city_name, b.bin_key
       FROM slot s JOIN bin_dim b ON s.bin_id = b.bin_id""",
)
cte(
    "attempt",
    """SELECT reading_id AS collection_id, bin_id, zone_id, zone_key, city_id, city_name, bin_key,
       service_date_local, timestamp_utc AS attempted_at_utc, collection_status,
       removed_l_true * 0.12 AS collected_kg, inventory_l_true * 0.12 AS residual_kg,
       100.0 * (inventory_l_true + removed_l_true) / capacity_l AS pre_service_fill_pct,
       overflow_l_true > 0 AS overflow_at_attempt
       FROM slot_city WHERE collection_status <> 'none'""",
)
cte(
    "binday",
    """SELECT bin_id, bin_key, zone_id, zone_key, city_id, city_name, service_date_local,
       count(*) AS scheduled_readings, count(fill_level_pct) AS received_readings,
       count(*) FILTER (WHERE sensor_status = 'missing') AS missing_readings,
       avg(fill_level_pct) AS mean_observed_fill_pct, max(fill_level_pct) AS max_observed_fill_pct,
       sum(arrivals_l_true) AS arrivals_l_simulated, sum(overflow_l_true) AS overflow_l_simulated,
       sum(removed_l_true) * 0.12 AS collected_kg_simulated,
       count(*) FILTER (WHERE collection_status IN ('collected', 'partial')) AS successful_collections,
       count(*) FILTER (WHERE collection_status = 'missed') AS missed_collections
       FROM slot_city GROUP BY ALL""",
)
cte(
    "zoneday",
    """SELECT zone_id, zone_key, city_id, city_name, service_date_local, count(*) AS bins,
       CAST(sum(scheduled_readings) AS BIGINT) AS scheduled_readings,
       CAST(sum(received_readings) AS BIGINT) AS received_readings,
       CAST(sum(missing_readings) AS BIGINT) AS missing_readings,
       sum(arrivals_l_simulated) AS arrivals_l_simulated,
       sum(overflow_l_simulated) AS overflow_l_simulated,
       sum(collected_kg_simulated) AS collected_kg_simulated,
       CAST(sum(successful_collections) AS BIGINT) AS successful_collections,
       CAST(sum(missed_collections) AS BIGINT) AS missed_collections
       FROM binday GROUP BY ALL""",
)
cte(
    "routeday",
    """SELECT service_date_local, 1 + (TRY_CAST(zone_id AS INTEGER) - 1) % 50 AS vehicle_id,
       service_date_local || '_' || (1 + (TRY_CAST(zone_id AS INTEGER) - 1) % 50) AS route_id,
       count(*) AS service_attempts,
       count(*) FILTER (WHERE collection_status <> 'missed') AS successful_stops,
       count(*) FILTER (WHERE collection_status = 'missed') AS missed_stops,
       sum(collected_kg) AS collected_kg_simulated,
       5.0 + 0.35 * count(*) FILTER (WHERE collection_status <> 'missed') AS distance_km_assumed
       FROM attempt GROUP BY ALL""",
)
cte(
    "vehicleday",
    """SELECT service_date_local, vehicle_id, count(*) AS routes,
       CAST(sum(service_attempts) AS BIGINT) AS service_attempts,
       CAST(sum(successful_stops) AS BIGINT) AS successful_stops,
       sum(collected_kg_simulated) AS collected_kg_simulated,
       CAST(sum(distance_km_assumed) AS DOUBLE) AS distance_km_assumed,
       CAST(sum(distance_km_assumed) AS DOUBLE) / 4.5 AS diesel_l_assumed
       FROM routeday GROUP BY ALL""",
)
cte(
    "cityday",
    """SELECT d.*, o.scheduled_readings, o.received_readings, o.fill_sum_pct,
       o.fill_sum_pct / nullif(o.received_readings, 0) AS mean_fill_pct, o.overflow_slots,
       100.0 * o.overflow_slots / o.scheduled_readings AS overflow_slot_pct,
       d.generated_l / d.bins AS generated_l_per_bin_day,
       1.0 * d.successful_collections / d.bins AS collections_per_bin_day
       FROM (SELECT city_id, city_name, service_date_local, count(*) AS bins,
                    sum(arrivals_l_simulated) AS generated_l, sum(overflow_l_simulated) AS overflow_l,
                    CAST(sum(successful_collections) AS BIGINT) AS successful_collections,
                    CAST(sum(missed_collections) AS BIGINT) AS missed_collections,
                    sum(collected_kg_simulated) AS collected_kg FROM binday GROUP BY ALL) d
       JOIN (SELECT city_id, service_date_local, count(*) AS scheduled_readings,
                    count(fill_level_pct) AS received_readings, sum(fill_level_pct) AS fill_sum_pct,
                    count(*) FILTER (WHERE overflow_l_true > 0) AS overflow_slots
             FROM slot_city GROUP BY ALL) o
       ON d.city_id = o.city_id AND d.service_date_local = o.service_date_local""",
)

cte(
    "bin_xy",
    "SELECT *, (longitude - 80.0) * 108000.0 AS x, (latitude - 12.0) * 110600.0 AS y FROM bin_dim",
)
cte(
    "poi_xy",
    """SELECT *, (longitude - 80.0) * 108000.0 AS x, (latitude - 12.0) * 110600.0 AS y FROM (
         SELECT c_custkey AS poi_id, lower(c_mktsegment) AS poi_type,
                80.15 + CAST(((c_custkey * 3 + 1) * 7919) % 2300 AS DOUBLE) / 10000.0 AS longitude,
                12.90 + CAST(((c_custkey * 3 + 1) * 104729) % 3500 AS DOUBLE) / 10000.0 AS latitude FROM customer)""",
)

cte(
    "tod_bin",
    """SELECT c_custkey AS bin_id, z.zone_id, z.zone_key, z.city_id, z.city_id || ':' || c_custkey AS bin_key,
       CASE c_custkey % 3 WHEN 0 THEN 240 WHEN 1 THEN 660 ELSE 1100 END AS capacity_l,
       c_custkey % 7 <> 0 AS network_accessible, c_custkey % 7 <> 0 AND c_custkey % 2 = 0 AS in_routing_pilot
       FROM customer JOIN zone_dim z ON z.zone_id = lpad(CAST(c_nationkey AS VARCHAR), 3, '0')""",
)
cte(
    "tod_slot",
    """SELECT event_id AS reading_id, user_id AS bin_id, d AS service_date_local, h AS local_hour,
       CAST(d AS TIMESTAMP) - INTERVAL 330 MINUTE + to_hours(h) + to_milliseconds(event_id % 3600000) AS timestamp_utc,
       CASE WHEN event_type <> 'error' THEN least(100.0, value) END AS fill_level_pct,
       CASE event_type WHEN 'error' THEN 'missing' WHEN 'signup' THEN 'stuck' ELSE 'ok' END AS sensor_status,
       CASE WHEN event_type <> 'purchase' THEN 'none' WHEN k % 25 = 0 THEN 'missed' WHEN k % 10 = 0 THEN 'partial'
            ELSE 'collected' END AS collection_status
       FROM (SELECT *, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS d, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
                    CASE WHEN hour(ts + INTERVAL 330 MINUTE) < 10 THEN 4 WHEN hour(ts + INTERVAL 330 MINUTE) < 17 THEN 6
                         ELSE 7 END AS h FROM events)""",
)
cte(
    "tod_day",
    """SELECT bin_id, service_date_local AS issue_date,
       arg_max(fill_level_pct, timestamp_utc) FILTER (WHERE sensor_status = 'ok') AS current_fill_pct,
       max(timestamp_utc) FILTER (WHERE sensor_status = 'ok' AND fill_level_pct IS NOT NULL) AS last_sensor_utc,
       max(fill_level_pct) FILTER (WHERE local_hour = 4 AND sensor_status = 'ok') AS fill04,
       max(fill_level_pct) FILTER (WHERE local_hour = 6 AND sensor_status = 'ok') AS fill06,
       max(timestamp_utc) FILTER (WHERE collection_status IN ('collected', 'partial')) AS service_utc
       FROM tod_slot GROUP BY 1, 2""",
)
cte(
    "tod_ewm",
    """SELECT bin_id, ds[i] AS issue_date, CASE WHEN st.n >= 3 THEN st.w END AS ewm7_04 FROM (
         SELECT bin_id, ds, i, list_reduce(xs[1:i],
                lambda acc, x: {'w': CASE WHEN x.w IS NULL THEN acc.w WHEN acc.w IS NULL THEN x.w
                                         ELSE (acc.w * acc.d * 0.75 + x.w * 0.25) / (acc.d * 0.75 + 0.25) END,
                                'n': acc.n + x.n,
                                'd': CASE WHEN x.w IS NOT NULL THEN 1.0 WHEN acc.w IS NULL THEN acc.d ELSE acc.d * 0.75 END},
                {'w': CAST(NULL AS DOUBLE), 'n': 0, 'd': CAST(1.0 AS DOUBLE)}) AS st
         FROM (SELECT bin_id, ds, xs, unnest(range(1, len(xs) + 1)) AS i FROM (
                 SELECT bin_id, list(issue_date ORDER BY issue_date) AS ds,
                        list({'w': fill04, 'n': CAST(fill04 IS NOT NULL AS INTEGER), 'd': CAST(1.0 AS DOUBLE)}
                             ORDER BY issue_date) AS xs FROM tod_day GROUP BY 1)))""",
)
cte(
    "feat",
    """SELECT f.*, e.ewm7_04, b.city_id, b.bin_key, b.zone_id, b.zone_key, b.capacity_l,
       CAST(issue_date AS TIMESTAMP) + INTERVAL 150 MINUTE AS issue_time_utc,
       CAST(issue_date AS TIMESTAMP) + INTERVAL 1350 MINUTE AS target_time_utc, issue_date + 1 AS target_date,
       epoch_us(CAST(issue_date AS TIMESTAMP) + INTERVAL 150 MINUTE) / 3.6e9 - epoch_us(last_service_utc) / 3.6e9
         AS hours_since_collection,
       epoch_us(CAST(issue_date AS TIMESTAMP) + INTERVAL 150 MINUTE) / 3.6e9 - epoch_us(last_sensor_utc) / 3.6e9
         AS sensor_age_hours,
       f.bin_id % 5 = 0 AS bin_holdout,
       CASE WHEN issue_date + 1 <= DATE '2024-01-15' THEN 'train' WHEN issue_date + 1 <= DATE '2024-01-20' THEN 'validation'
            ELSE 'test' END AS split
       FROM (SELECT *, CASE WHEN count(overnight) OVER w7 >= 3 THEN avg(overnight) OVER w7 END AS history_growth_pct FROM (
               SELECT *, lead(fill04) OVER seq AS target_fill_pct, lag(fill04, 6) OVER seq AS seasonal7_04,
                      CASE WHEN count(fill04) OVER w7 >= 3 THEN avg(fill04) OVER w7 END AS ma7_04,
                      CASE WHEN fill04 - lag(current_fill_pct) OVER seq IS NOT NULL
                           THEN least(greatest(fill04 - lag(current_fill_pct) OVER seq, 0), 100) END AS overnight,
                      CASE WHEN current_fill_pct - fill06 IS NOT NULL
                           THEN least(greatest((current_fill_pct - fill06) / 2, 0), 50) END AS recent_growth_pct,
                      last_value(service_utc IGNORE NULLS) OVER (PARTITION BY bin_id ORDER BY issue_date
                        ROWS UNBOUNDED PRECEDING) AS last_service_utc
               FROM tod_day WINDOW seq AS (PARTITION BY bin_id ORDER BY issue_date),
                                   w7 AS (PARTITION BY bin_id ORDER BY issue_date ROWS 6 PRECEDING))
             WINDOW w7 AS (PARTITION BY bin_id ORDER BY issue_date ROWS 6 PRECEDING)) f
       JOIN tod_ewm e USING (bin_id, issue_date) JOIN tod_bin b USING (bin_id)
       WHERE issue_date >= DATE '2024-01-08'""",
)
cte(
    "pred",
    """SELECT city_id, bin_id, target_time_utc, split, CASE WHEN bin_holdout THEN 'unseen_bins' ELSE 'known_bins' END AS grp,
       target_fill_pct, model, pos, least(greatest(coalesce(v, ma7_04, current_fill_pct, 50), 0), 100) AS prediction_pct
       FROM (SELECT *, unnest(['persistence', 'seasonal_naive7', 'moving_average7', 'exponential_smoothing7']) AS model,
                    unnest([0, 1, 2, 3]) AS pos, unnest([current_fill_pct, seasonal7_04, ma7_04, ewm7_04]) AS v FROM feat
             WHERE target_fill_pct IS NOT NULL AND target_date <= DATE '2024-01-30'
               AND (split = 'test' OR (split = 'validation' AND NOT bin_holdout)))""",
)
cte(
    "score",
    """SELECT city_id, split, grp, model, min(pos) AS pos, count(*) AS n, avg(abs(prediction_pct - target_fill_pct)) AS mae_pct_points,
       sqrt(avg(pow(prediction_pct - target_fill_pct, 2))) AS rmse_pct_points,
       100 * sum(abs(prediction_pct - target_fill_pct)) / sum(target_fill_pct) AS wape_pct,
       count(*) FILTER (WHERE prediction_pct >= 95 AND target_fill_pct >= 95)
         / greatest(1, count(*) FILTER (WHERE target_fill_pct >= 95)) AS near_full_recall
       FROM pred GROUP BY 1, 2, 3, 4""",
)
cte(
    "choice",
    """SELECT city_id, model AS selected_model, mae_pct_points AS best_simple_mae FROM (
         SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY mae_pct_points, pos) AS r FROM score WHERE split = 'validation')
       WHERE r = 1""",
)
cte(
    "width",
    """SELECT city_id, s[1 + CAST(ceil(0.8 * (len(s) - 1) - 1e-9) AS BIGINT)] AS w80,
       s[1 + CAST(ceil(0.9 * (len(s) - 1) - 1e-9) AS BIGINT)] AS w90,
       s[1 + CAST(ceil(0.95 * (len(s) - 1) - 1e-9) AS BIGINT)] AS w95
       FROM (SELECT city_id, list_sort(list(abs(prediction_pct - target_fill_pct))) AS s
             FROM pred JOIN choice USING (city_id) WHERE model = selected_model AND split = 'validation' GROUP BY 1)""",
)
cte(
    "snapshot",
    """SELECT f.*, selected_model AS model, p AS prediction_pct, least(p + w80, 100) AS upper80_pct,
       least(p + w90, 100) AS upper90_pct, least(p + w95, 100) AS upper95_pct, b.network_accessible, b.in_routing_pilot
       FROM (SELECT feat.*, selected_model, least(greatest(coalesce(
               CASE selected_model WHEN 'persistence' THEN current_fill_pct WHEN 'seasonal_naive7' THEN seasonal7_04
                    WHEN 'moving_average7' THEN ma7_04 ELSE ewm7_04 END, ma7_04, current_fill_pct, 50), 0), 100) AS p
             FROM feat JOIN choice USING (city_id) WHERE issue_date = DATE '2024-01-25') f
       JOIN width USING (city_id) JOIN tod_bin b USING (bin_id)""",
)
cte(
    "ruled",
    """SELECT *, CASE WHEN t1 THEN 1 WHEN t2 THEN 2 WHEN t3 THEN 3 WHEN t4 THEN 4 ELSE 5 END AS tier,
       t1 OR t2 OR t3 OR t4 AS required,
       CASE WHEN t1 OR t2 OR t3 OR t4 THEN concat_ws(';', CASE WHEN t1 THEN 'current_trigger' END,
              CASE WHEN t2 THEN 'telemetry_trigger' END, CASE WHEN t3 THEN 'gap_trigger' END,
              CASE WHEN t4 THEN 'forecast_trigger' END) ELSE 'below_rules' END AS reasons
       FROM (SELECT *, coalesce(current_fill_pct >= 80, FALSE) AS t1,
                    coalesce(sensor_age_hours > 6, TRUE) OR current_fill_pct IS NULL AS t2,
                    coalesce(hours_since_collection >= 48, TRUE) AS t3, coalesce(risk_upper_pct >= 80, FALSE) AS t4
             FROM (SELECT *, CASE WHEN current_fill_pct IS NOT NULL
                                  THEN least(current_fill_pct + greatest(upper90_pct - current_fill_pct, 0), 100) END
                             AS risk_upper_pct FROM snapshot))""",
)
cte(
    "prio",
    """SELECT *, CASE WHEN required AND NOT network_accessible THEN 'access_review'
                      WHEN required AND in_routing_pilot THEN 'pilot_required'
                      WHEN required THEN 'required_outside_pilot' ELSE 'monitor' END AS dispatch_status,
       row_number() OVER (PARTITION BY city_id ORDER BY tier, risk_upper_pct DESC NULLS LAST,
         current_fill_pct DESC NULLS LAST, hours_since_collection DESC NULLS LAST, bin_id) AS priority_rank FROM ruled""",
)

cte(
    "order_city",
    """SELECT o_orderkey AS vehicle, city_id, city_name,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'base_3_trucks' WHEN '2' THEN 'trigger_70' WHEN '3' THEN 'trigger_90'
            WHEN '4' THEN 'demand_plus20' ELSE 'fuel_minus20' END AS scenario,
       CASE WHEN o_orderkey % 2 = 0 THEN 'baseline' ELSE 'optimized' END AS method
       FROM orders JOIN customer ON c_custkey = o_custkey
       JOIN zone_dim ON zone_id = lpad(CAST(c_nationkey AS VARCHAR), 3, '0')""",
)
cte(
    "stop_row",
    """SELECT vehicle, stop_sequence, matrix_index, planned_capacity_l, city_id, scenario, method FROM (
         SELECT l_orderkey AS vehicle, row_number() OVER (PARTITION BY l_orderkey
                  ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS stop_sequence, l_suppkey + 1 AS matrix_index,
                CASE l_suppkey % 3 WHEN 0 THEN 240 WHEN 1 THEN 660 ELSE 1100 END AS planned_capacity_l FROM lineitem
         UNION ALL SELECT l_orderkey, unnest([0, count(*) + 1]), 0, 0 FROM lineitem GROUP BY 1)
       JOIN order_city USING (vehicle)""",
)
cte(
    "leg_row",
    """SELECT a.city_id, a.scenario, a.method, a.vehicle, a.stop_sequence, a.matrix_index AS i, b.matrix_index AS j
       FROM stop_row a JOIN stop_row b ON a.vehicle = b.vehicle AND b.stop_sequence = a.stop_sequence + 1""",
)
cte(
    "place_xy",
    """SELECT s_suppkey + 1 AS k, 80.15 + CAST((s_suppkey * 7919) % 2300 AS DOUBLE) / 10000.0 AS lon,
       12.90 + CAST((s_suppkey * 104729) % 3500 AS DOUBLE) / 10000.0 AS lat FROM supplier
       UNION ALL SELECT 0, 80.2707, 13.0827""",
)
cte(
    "hop_row",
    """SELECT i, j, d AS distance_m, d / (20 / 3.6) AS travel_seconds FROM (
         SELECT i, j, 1.3 * 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(q.lat - p.lat) / 2), 2)
                + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2)))) AS d
         FROM (SELECT DISTINCT i, j FROM leg_row) JOIN place_xy p ON p.k = i JOIN place_xy q ON q.k = j)""",
)
cte(
    "route_kpi",
    """SELECT *, travel_seconds + bins * 240 + CASE WHEN bins > 0 THEN 900 ELSE 0 END AS duration_seconds,
       load_l * 0.12 AS load_kg_assumed
       FROM (SELECT city_id, scenario, method, vehicle, count(*) FILTER (WHERE matrix_index <> 0) AS bins,
                    CAST(sum(planned_capacity_l) AS BIGINT) AS load_l FROM stop_row GROUP BY ALL)
       JOIN (SELECT city_id, scenario, method, vehicle, sum(distance_m) AS distance_m, sum(travel_seconds) AS travel_seconds
             FROM leg_row JOIN hop_row USING (i, j) GROUP BY ALL) USING (city_id, scenario, method, vehicle)""",
)
cte(
    "plan_row",
    """SELECT city_id || ':' || scenario AS scenario_key, *, CASE WHEN full_capacity_l_required > vehicles_available * 12000
              THEN 'proven_infeasible_capacity' ELSE 'feasible' END AS status FROM (
         SELECT city_id, scenario, CASE WHEN scenario = 'fuel_minus20' THEN count(*) // 10 ELSE count(*) END AS vehicles_available,
                CASE scenario WHEN 'trigger_70' THEN 70.0 WHEN 'trigger_90' THEN 90.0 ELSE 80.0 END AS trigger_pct,
                CASE scenario WHEN 'demand_plus20' THEN 1.2 ELSE 1.0 END AS demand_multiplier,
                CASE scenario WHEN 'fuel_minus20' THEN 0.8 ELSE 1.0 END AS fuel_price_multiplier,
                CAST(sum(bins) AS BIGINT) AS required_bins, CAST(sum(load_l) AS BIGINT) AS full_capacity_l_required
         FROM route_kpi WHERE method = 'optimized' GROUP BY 1, 2)""",
)
cte(
    "plan_cmp",
    """SELECT *, baseline_km - optimized_km AS km_saved, 100 * (baseline_km - optimized_km) / baseline_km AS distance_reduction_pct,
       baseline_travel_hours - optimized_travel_hours AS travel_hours_saved,
       baseline_vehicle_hours - optimized_vehicle_hours AS vehicle_hours_saved,
       (baseline_km - optimized_km) / 4.5 AS fuel_l_saved_assumed,
       (baseline_km - optimized_km) / 4.5 * 92.39 * fuel_price_multiplier AS fuel_cost_inr_saved_historical_proxy,
       (baseline_km - optimized_km) / 4.5 * 2.689 AS tailpipe_co2_kg_saved_proxy,
       CASE WHEN status = 'feasible' THEN required_bins ELSE 0 END AS bins_serviced,
       CASE WHEN status = 'feasible' THEN TRUE END AS baseline_complete,
       CASE WHEN city_id = 'ASIA' THEN 'Historical common-price proxy' ELSE 'Historical price proxy' END AS price_scope
       FROM (SELECT r.*, c.city_name,
                    CASE WHEN status = 'feasible' THEN b.km END AS baseline_km, CASE WHEN status = 'feasible' THEN o.km END AS optimized_km,
                    CASE WHEN status = 'feasible' THEN b.vh END AS baseline_vehicle_hours,
                    CASE WHEN status = 'feasible' THEN o.vh END AS optimized_vehicle_hours,
                    CASE WHEN status = 'feasible' THEN b.th END AS baseline_travel_hours,
                    CASE WHEN status = 'feasible' THEN o.th END AS optimized_travel_hours
             FROM plan_row r JOIN city_dim c USING (city_id)
             LEFT JOIN (SELECT city_id, scenario, sum(distance_m) / 1000 AS km, sum(duration_seconds) / 3600 AS vh,
                               sum(travel_seconds) / 3600 AS th FROM route_kpi WHERE method = 'baseline' GROUP BY 1, 2) b
               USING (city_id, scenario)
             LEFT JOIN (SELECT city_id, scenario, sum(distance_m) / 1000 AS km, sum(duration_seconds) / 3600 AS vh,
                               sum(travel_seconds) / 3600 AS th FROM route_kpi WHERE method = 'optimized' GROUP BY 1, 2) o
               USING (city_id, scenario))""",
)
cte(
    "truck_row",
    """SELECT r.*, c.city_name, r.city_id || ':' || scenario AS scenario_key, r.city_id || ':R:' || vehicle AS vehicle_key,
       concat_ws(':', r.city_id, scenario, method, vehicle) AS route_key, 100.0 * load_l / 12000 AS volume_utilization_pct,
       100.0 * load_kg_assumed / 5000 AS payload_utilization_pct FROM route_kpi r JOIN city_dim c USING (city_id)""",
)
cte(
    "arrive_row",
    """SELECT s.*, coalesce(sum(travel_seconds / 60 + CASE WHEN i <> 0 THEN 4 ELSE 0 END) OVER
         (PARTITION BY s.vehicle ORDER BY s.stop_sequence), 0) AS arrival_minutes
       FROM stop_row s LEFT JOIN (SELECT * FROM leg_row JOIN hop_row USING (i, j)) l
       ON l.vehicle = s.vehicle AND l.stop_sequence + 1 = s.stop_sequence""",
)
cte(
    "replayed",
    """SELECT scenario, method, bin_id, initial_l, list_sum(arr) AS arrivals_l, z.inv AS terminal_l, z.spill AS overflow_l,
       z.removed AS collected_l, CAST(minute IS NOT NULL AS INTEGER) AS collection_count, capacity_l FROM (
         SELECT *, list_reduce(list_transform(range(1, len(cuts)), lambda i: {'a': cuts[i], 'b': cuts[i + 1],
                     'add': arr[1 + CAST(floor(cuts[i] / 120) AS BIGINT)] * (cuts[i + 1] - cuts[i]) / 120,
                     'keep': CASE WHEN cuts[i] = minute THEN 0.05 ELSE 1.0 END::DOUBLE, 'inv': 0.0::DOUBLE,
                     'spill': 0.0::DOUBLE, 'removed': 0.0::DOUBLE}),
                   lambda s, p: {'a': p.a, 'b': p.b, 'add': p.add, 'keep': p.keep,
                     'inv': least(capacity_l, s.inv * p.keep + p.add),
                     'spill': s.spill + greatest(0, s.inv * p.keep + p.add - capacity_l),
                     'removed': s.removed + s.inv * (1 - p.keep)},
                   {'a': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 'add': 0.0::DOUBLE, 'keep': 1.0::DOUBLE, 'inv': initial_l,
                    'spill': 0.0::DOUBLE, 'removed': 0.0::DOUBLE}) AS z
         FROM (SELECT *, list_sort(list_distinct(CASE WHEN minute < 1440
                        THEN list_append(list_transform(range(0, 13), lambda i: i * 120.0::DOUBLE), minute)
                        ELSE list_transform(range(0, 13), lambda i: i * 120.0::DOUBLE) END)) AS cuts FROM (
                 SELECT p.scenario, p.method, b.bin_id, initial_l, capacity_l, minute,
                        list_transform(arrivals, lambda v: v * CASE p.scenario WHEN 'demand_plus20' THEN 1.2::DOUBLE ELSE 1.0 END) AS arr
                 FROM (SELECT k + 1 AS bin_id, sum(q) / sum(c) * 4 AS initial_l,
                              (CASE k % 3 WHEN 0 THEN 240 WHEN 1 THEN 660 ELSE 1100 END)::DOUBLE AS capacity_l,
                              list_transform(range(0, 12), lambda i: coalesce(map_from_entries(list((s, a)))[i], 0)) AS arrivals
                       FROM (SELECT l_suppkey AS k, (l_orderkey + l_linenumber) % 12 AS s, avg(l_quantity) * 4 AS a,
                                    sum(l_quantity * (1 - l_discount)) AS q, count(*) AS c FROM lineitem GROUP BY 1, 2) GROUP BY k) b
                 CROSS JOIN (SELECT DISTINCT scenario, method FROM stop_row) p
                 LEFT JOIN (SELECT scenario, method, matrix_index AS bin_id, min(arrival_minutes) + 4 AS minute FROM arrive_row
                            WHERE matrix_index <> 0 GROUP BY 1, 2, 3) f
                 ON f.scenario = p.scenario AND f.method = p.method AND f.bin_id = b.bin_id)))""",
)
cte(
    "spill_cmp",
    """SELECT city_id, scenario, city_id || ':' || scenario AS scenario_key,
       sum(overflow_l) FILTER (WHERE method = 'baseline') AS baseline_overflow_l,
       sum(overflow_l) FILTER (WHERE method = 'optimized') AS optimized_overflow_l,
       sum(overflow_l) FILTER (WHERE method = 'baseline') - sum(overflow_l) FILTER (WHERE method = 'optimized')
         AS overflow_l_avoided_modelled
       FROM replayed r JOIN bin_dim b ON b.bin_id + 1 = r.bin_id GROUP BY 1, 2""",
)
