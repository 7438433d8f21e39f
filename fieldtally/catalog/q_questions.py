"""Named operational questions."""

from __future__ import annotations

from fieldtally.catalog.registry import query
from fieldtally.plans import questions as q

MONTH = ("1996-01-01", "1996-01-31")


@query(
    "Q01",
    """WITH per_day AS (
         SELECT r.zone_id, r.service_date_local AS d, count(DISTINCT r.bin_id) AS k, sum(r.arrivals_l_true) AS litres,
                sum(r.overflow_l_true) AS spilt
         FROM slot_city r GROUP BY r.zone_id, r.service_date_local),
       z AS (SELECT zone_id, count(*) AS n, max(k) AS bins, sum(litres) AS litres, sum(spilt) AS spilt, sum(k) AS bin_days
             FROM per_day GROUP BY zone_id),
       q AS (SELECT *, litres / bin_days AS rate FROM z WHERE n >= 300)
       SELECT q.zone_id, n AS observed_days, bins, 0.12 * litres AS generated_kg_simulated, rate AS litres_per_bin_day,
              spilt AS overflow_l_simulated, 1 + (SELECT count(*) FROM q o WHERE o.rate > q.rate) AS per_bin_rank
       FROM q ORDER BY rate DESC, q.zone_id LIMIT 25""",
    "generated_kg_simulated litres_per_bin_day overflow_l_simulated",
)
def _(w):
    return q.q01(w.zone_day)


@query(
    "Q02",
    """WITH litres AS (
         SELECT bin_id, service_date_local AS d, sum(arrivals_l_true) AS v, avg(fill_level_pct) AS f FROM slot GROUP BY 1, 2),
       spread AS (SELECT bin_id, list(v ORDER BY v) AS vs, avg(f) AS f FROM litres GROUP BY bin_id),
       stats AS (
         SELECT bin_id, len(vs) AS n, list_sum(vs) AS total, f, 0.9 * (len(vs) - 1) AS place, vs FROM spread WHERE len(vs) >= 300),
       one AS (
         SELECT bin_id, n, total, f,
                vs[1 + floor(place)::INT] + (place - floor(place)) * (vs[1 + ceil(place)::INT] - vs[1 + floor(place)::INT]) AS p90
         FROM stats),
       full_rows AS (SELECT one.*, s.zone_id, s.capacity_l, total * 100.0 / (s.capacity_l * n) AS pct FROM bin_dim s JOIN one USING (bin_id))
       SELECT bin_id, zone_id, capacity_l, n AS days, total / n AS mean_arrival_l_day, pct AS gross_capacity_pct_day,
              p90 AS p90_arrival_l_day, f AS mean_observed_fill_pct,
              1 + (SELECT count(*) FROM full_rows o WHERE round(o.pct, 9) > round(e.pct, 9)) AS fill_rate_rank
       FROM full_rows e ORDER BY fill_rate_rank, bin_id LIMIT 25""",
    "mean_arrival_l_day gross_capacity_pct_day p90_arrival_l_day mean_observed_fill_pct",
)
def _(w):
    return q.q02(w.bin_day, w.dim_bin)


@query(
    "Q03",
    """WITH wet AS (
         SELECT bin_id, service_date_local AS d, sum(overflow_l_true) AS spilt, bool_or(overflow_l_true > 0) AS any_spilt
         FROM slot GROUP BY 1, 2),
       bins AS (SELECT bin_id, count(*) AS n, sum(any_spilt::INT)::BIGINT AS wet_days, sum(spilt) AS spilt FROM wet GROUP BY bin_id),
       lost AS (SELECT bin_id, count(*) AS missed FROM slot WHERE collection_status = 'missed' GROUP BY bin_id),
       r AS (SELECT bins.*, coalesce(missed, 0) AS missed FROM bins LEFT JOIN lost USING (bin_id) WHERE wet_days > 0)
       SELECT r.bin_id, b.zone_id, n AS days, wet_days AS overflow_days, spilt AS overflow_l_simulated, missed AS missed_attempts,
              round(wet_days * 100.0 / n, 2) AS overflow_day_pct,
              1 + (SELECT count(*) FROM r o WHERE (o.wet_days, o.spilt) > (r.wet_days, r.spilt)) AS risk_rank
       FROM r JOIN bin_dim b ON b.bin_id = r.bin_id
       ORDER BY risk_rank, r.bin_id LIMIT 25""",
    "overflow_l_simulated overflow_day_pct",
)
def _(w):
    return q.q03(w.bin_day)


@query(
    "Q04",
    """SELECT *, round(100.0 * early_successes_lt35_pct / attempts, 2) AS early_attempt_pct,
              round(100.0 * late_risk_attempts_ge95_pct_or_overflow / attempts, 2) AS late_risk_attempt_pct
       FROM (SELECT zone_id, count(*) AS attempts,
                    count(*) FILTER (WHERE collection_status <> 'missed' AND pre_service_fill_pct < 35)
                      AS early_successes_lt35_pct,
                    count(*) FILTER (WHERE pre_service_fill_pct >= 95 OR overflow_at_attempt)
                      AS late_risk_attempts_ge95_pct_or_overflow,
                    count(*) FILTER (WHERE collection_status = 'missed') AS missed_attempts
             FROM attempt GROUP BY zone_id HAVING count(*) >= 100)
       ORDER BY late_risk_attempt_pct DESC, zone_id LIMIT 25""",
    "early_attempt_pct late_risk_attempt_pct",
)
def _(w):
    return q.q04(w.diagnostics)


@query(
    "Q05",
    """SELECT CAST(hour(timestamp_utc + INTERVAL 330 MINUTE) AS INTEGER) AS local_hour,
              count(*) AS scheduled_bin_slots, avg(arrivals_l_true) AS mean_arrival_l_per_bin_slot,
              sum(arrivals_l_true) * 0.12 AS generated_kg_simulated,
              count(*) FILTER (WHERE overflow_l_true > 0) AS overflow_slots
       FROM slot GROUP BY 1""",
    "mean_arrival_l_per_bin_slot generated_kg_simulated",
)
def _(w):
    return q.q05(w.truth)


FLEET_DAY = """SELECT service_date_local AS service_date,
       sum(arrivals_l_simulated) * 0.12 AS generated_kg_simulated,
       sum(overflow_l_simulated) AS overflow_l_simulated,
       CAST(sum(successful_collections) AS BIGINT) AS successful_collections,
       CAST(sum(missed_collections) AS BIGINT) AS missed_collections,
       CAST(sum(scheduled_readings) AS BIGINT) AS scheduled_readings
       FROM zoneday GROUP BY 1"""


@query(
    "Q06",
    """WITH f AS (
         SELECT service_date_local AS service_date, 0.12 * sum(arrivals_l_true) AS kg, sum(overflow_l_true) AS spilt,
                sum((collection_status IN ('collected', 'partial'))::INT)::BIGINT AS good,
                sum((collection_status = 'missed')::INT)::BIGINT AS bad, row_number() OVER (ORDER BY service_date_local) AS i
         FROM slot GROUP BY service_date_local)
       SELECT a.service_date, a.kg AS generated_kg_simulated, a.spilt AS overflow_l_simulated,
              a.good AS successful_collections, a.bad AS missed_collections, p.kg AS prior_day_kg, n.kg AS next_day_kg,
              (SELECT avg(t.kg) FROM f t WHERE t.i > a.i - 7 AND t.i <= a.i) AS trailing_7day_kg
       FROM f a LEFT JOIN f p ON p.i = a.i - 1 LEFT JOIN f n ON n.i = a.i + 1""",
    "generated_kg_simulated overflow_l_simulated prior_day_kg next_day_kg trailing_7day_kg",
)
def _(w):
    return q.q06(w.zone_day)


@query(
    "Q07",
    """WITH f AS (
         SELECT service_date_local AS d, 0.12 * sum(arrivals_l_true) AS kg, sum(overflow_l_true) AS spilt FROM slot GROUP BY 1),
       g AS (SELECT ((date_diff('day', DATE '1990-01-01', d) % 7) + 1)::INTEGER AS wd, list(kg ORDER BY kg) AS kgs, avg(spilt) AS spilt
             FROM f GROUP BY 1)
       SELECT wd AS iso_weekday, if(wd < 6, 'weekday', 'weekend') AS day_type, len(kgs) AS days,
              list_avg(kgs) AS mean_generated_kg_day,
              (kgs[(len(kgs) + 1) // 2] + kgs[len(kgs) // 2 + 1]) / 2 AS median_generated_kg_day, spilt AS mean_overflow_l_day
       FROM g""",
    "mean_generated_kg_day median_generated_kg_day mean_overflow_l_day",
)
def _(w):
    return q.q07(w.zone_day)


@query(
    "Q08",
    """WITH d AS (
         SELECT zone_id, service_date_local AS d, count(DISTINCT bin_id) AS k,
                sum((collection_status IN ('collected', 'partial'))::INT) AS good, sum((collection_status = 'missed')::INT) AS bad,
                sum(overflow_l_true) AS spilt
         FROM slot_city GROUP BY 1, 2),
       z AS (SELECT zone_id, max(k) AS bins, count(*) AS days, sum(k) AS bin_days, sum(good) AS good, sum(bad) AS bad, sum(spilt) AS spilt
             FROM d GROUP BY zone_id)
       SELECT zone_id, bins, days, good::BIGINT AS successful_collections, bad::BIGINT AS missed_attempts,
              good / (bin_days / 7.0) AS collections_per_bin_week, spilt / bin_days AS overflow_l_per_bin_day
       FROM z WHERE days >= 300 ORDER BY round(good * 7.0 / bin_days, 9) DESC, zone_id LIMIT 25""",
    "collections_per_bin_week overflow_l_per_bin_day",
)
def _(w):
    return q.q08(w.zone_day)


@query(
    "Q09",
    """SELECT vehicle_id, count(*) AS active_days,
              count(*) FILTER (WHERE successful_stops < 4) AS low_stop_days,
              avg(successful_stops) AS mean_successful_stops_day,
              avg(successful_stops / nullif(distance_km_assumed, 0)) AS mean_stops_per_assumed_km,
              sum(collected_kg_simulated) AS collected_kg_simulated,
              CAST(sum(distance_km_assumed) AS DOUBLE) AS distance_km_assumed
       FROM routeday GROUP BY vehicle_id HAVING count(*) >= 300
       ORDER BY low_stop_days DESC, vehicle_id LIMIT 25""",
    "mean_successful_stops_day mean_stops_per_assumed_km collected_kg_simulated distance_km_assumed",
)
def _(w):
    return q.q09(w.route_day)


TOP_ANOMALIES = """WITH d AS (
         SELECT zone_id, service_date_local AS day, sum(arrivals_l_true) AS v,
                row_number() OVER (PARTITION BY zone_id ORDER BY service_date_local) AS i
         FROM slot_city GROUP BY zone_id, service_date_local),
       h AS (SELECT x.zone_id, x.day, x.v, count(*) AS n, sum(y.v) / 28 AS m, sum(y.v * y.v) AS sq
             FROM d x JOIN d y ON y.zone_id = x.zone_id AND x.i - y.i BETWEEN 1 AND 28 GROUP BY ALL),
       z AS (SELECT *, (v - m) / nullif(sqrt((sq - 28 * m * m) / 27), 0) AS dev FROM h WHERE n = 28)
       SELECT zone_id, day AS service_date_local, v AS arrivals_l_simulated, m AS prior_28day_mean_l, dev AS prior_window_z,
              'investigate' AS review_flag
       FROM z WHERE dev >= 3 OR dev <= -3
       QUALIFY row_number() OVER (ORDER BY greatest(dev, -dev) DESC, zone_id, day) <= {k}"""
ANOMALY = TOP_ANOMALIES.format(k=50)


@query("Q10", ANOMALY, "arrivals_l_simulated prior_28day_mean_l prior_window_z")
def _(w):
    return q.q10(w.zone_day)


@query(
    "Q11",
    f"""SELECT CAST(date_trunc('month', service_date) AS DATE) AS service_month, count(*) AS days,
               avg(generated_kg_simulated) AS mean_generated_kg_day,
               avg(overflow_l_simulated) AS mean_overflow_l_day,
               avg(successful_collections) AS mean_successful_collections_day
        FROM ({FLEET_DAY}) GROUP BY 1""",
    "mean_generated_kg_day mean_overflow_l_day mean_successful_collections_day",
)
def _(w):
    return q.q11(w.zone_day)


@query(
    "Q12",
    """SELECT (SELECT count(*) FROM slot) AS fact_scheduled_readings,
              (SELECT count(*) FROM slot) AS truth_scheduled_readings,
              (SELECT sum(arrivals_l_true) FROM slot) AS truth_arrivals_l,
              (SELECT CAST(sum(scheduled_readings) AS BIGINT) FROM binday) AS bin_mart_scheduled_readings,
              (SELECT CAST(sum(successful_collections + missed_collections) AS BIGINT) FROM binday)
                AS bin_mart_attempts,
              (SELECT sum(arrivals_l_simulated) FROM binday) AS bin_mart_arrivals_l,
              (SELECT CAST(sum(scheduled_readings) AS BIGINT) FROM zoneday) AS zone_mart_scheduled_readings,
              (SELECT sum(arrivals_l_simulated) FROM zoneday) AS zone_mart_arrivals_l,
              (SELECT count(*) FROM attempt) AS collection_attempts""",
    "truth_arrivals_l bin_mart_arrivals_l zone_mart_arrivals_l",
)
def _(w):
    w.build_marts()
    return q.q12(w.obs, w.truth, w.bin_day, w.zone_day, w.events)


@query(
    "Q13",
    """SELECT *, rank() OVER (ORDER BY early_successes_lt35_pct DESC) AS early_rank FROM (
         SELECT bin_id, zone_id, count(*) AS attempts,
                count(*) FILTER (WHERE collection_status <> 'missed' AND pre_service_fill_pct < 35)
                  AS early_successes_lt35_pct,
                median(pre_service_fill_pct) AS median_pre_service_fill_pct_true
         FROM attempt GROUP BY bin_id, zone_id)
       WHERE early_successes_lt35_pct > 0 ORDER BY early_rank, bin_id LIMIT 25""",
    "median_pre_service_fill_pct_true",
)
def _(w):
    return q.q13(w.diagnostics)


@query(
    "Q14",
    """SELECT *, rank() OVER (ORDER BY late_risk_attempt_pct DESC) AS late_rank FROM (
         SELECT bin_id, zone_id, count(*) AS attempts,
                count(*) FILTER (WHERE pre_service_fill_pct >= 95 OR overflow_at_attempt) AS late_risk_attempts,
                count(*) FILTER (WHERE collection_status = 'missed') AS missed_attempts,
                100.0 * count(*) FILTER (WHERE pre_service_fill_pct >= 95 OR overflow_at_attempt) / count(*)
                  AS late_risk_attempt_pct
         FROM attempt GROUP BY bin_id, zone_id HAVING count(*) >= 100)
       ORDER BY late_rank, bin_id LIMIT 25""",
    "late_risk_attempt_pct",
)
def _(w):
    return q.q14(w.diagnostics)


CITY_SUMMARY = """WITH r AS (SELECT * FROM slot_city {where}),
       days AS (SELECT city_id, service_date_local, count(DISTINCT bin_id) AS k FROM r GROUP BY ALL),
       size AS (SELECT city_id, max(k) AS widest, count(*) AS n, sum(k) AS bin_days FROM days GROUP BY city_id),
       t AS (
         SELECT city_id, any_value(city_name) AS city_name, count(*) AS slots, count(fill_level_pct) AS seen,
                avg(fill_level_pct) AS fill, sum(arrivals_l_true) AS litres, avg((overflow_l_true > 0)::INT) AS wet,
                sum(overflow_l_true) AS spilt, sum((collection_status IN ('collected', 'partial'))::INT)::BIGINT AS good,
                sum((collection_status <> 'none')::INT)::BIGINT AS tried, 0.12 * sum(removed_l_true) AS kg
         FROM r GROUP BY city_id),
       timed AS (
         SELECT city_id, sum((pre_service_fill_pct < 35 AND collection_status IN ('collected', 'partial'))::INT)::BIGINT AS soon,
                sum((overflow_at_attempt OR pre_service_fill_pct >= 95)::INT)::BIGINT AS late
         FROM attempt GROUP BY city_id)
       SELECT t.city_id, t.city_name, widest AS bin_count, n AS days, slots AS scheduled_readings, seen AS received_readings,
              fill AS average_observed_fill_pct, litres AS generated_l, litres / bin_days AS generated_l_per_bin_day,
              100 * wet AS overflow_slot_pct, spilt AS overflow_l, good AS successful_collections,
              good / bin_days AS collections_per_bin_day, kg / nullif(good, 0) AS collected_kg_per_success,
              tried AS attempts, soon AS early_successes, soon * 100.0 / nullif(good, 0) AS early_success_pct,
              late * 100.0 / tried AS late_risk_attempt_pct
       FROM t JOIN size USING (city_id) JOIN timed USING (city_id)"""
CITY_DOUBLES = (
    "average_observed_fill_pct generated_l generated_l_per_bin_day overflow_slot_pct overflow_l "
    "collections_per_bin_day collected_kg_per_success early_success_pct late_risk_attempt_pct"
)


@query("Q15", CITY_SUMMARY.format(where=""), CITY_DOUBLES)
def _(w):
    return q.q15(w.city_day, w.diagnostics)


@query(
    "Q16",
    """WITH k AS (
         SELECT zone_key, service_date_local, count(DISTINCT bin_id) AS k FROM slot_city GROUP BY ALL),
       days AS (SELECT zone_key, sum(k) AS bin_days FROM k GROUP BY zone_key HAVING sum(k) > 364),
       v AS (SELECT city_id, city_name, zone_key, sum(arrivals_l_true) AS litres,
                    sum((collection_status IN ('collected', 'partial'))::INT) AS good FROM slot_city GROUP BY ALL),
       e AS (SELECT v.*, bin_days, litres / bin_days AS rate FROM v JOIN days USING (zone_key))
       SELECT city_id, city_name, zone_key, rate AS litres_per_bin_day, good / bin_days AS services_per_bin_day,
              1 + (SELECT count(*) FROM e o WHERE o.city_id = e.city_id AND o.rate > e.rate) AS within_city_rank
       FROM e""",
    "litres_per_bin_day services_per_bin_day",
)
def _(w):
    return q.q16(w.zone_day)


@query(
    "Q17",
    """WITH d AS (
         SELECT bin_id, service_date_local, sum(arrivals_l_true) AS v, max(overflow_l_true) > 0 AS wet FROM slot GROUP BY 1, 2),
       e AS (SELECT bin_id, avg(v) AS mean, sum(wet::INT)::BIGINT AS wet_days FROM d GROUP BY bin_id),
       served AS (SELECT bin_id, count(*) AS n FROM slot WHERE collection_status IN ('collected', 'partial') GROUP BY bin_id)
       SELECT b.city_id, b.city_name, b.bin_key, b.capacity_l, n AS annual_services,
              mean * 100 / b.capacity_l AS gross_capacity_pct_per_day, wet_days AS overflow_days
       FROM served JOIN e USING (bin_id) JOIN bin_dim b USING (bin_id)""",
    "gross_capacity_pct_per_day",
)
def _(w):
    return q.q17(w.bin_day, w.dim_bin)


@query(
    "Q18",
    """WITH c AS (
         SELECT city_id, city_name, service_date_local, avg(fill_level_pct) AS fill,
                100 * avg((overflow_l_true > 0)::INT) AS wet, sum(arrivals_l_true) / count(DISTINCT bin_id) AS rate,
                row_number() OVER (PARTITION BY city_id ORDER BY service_date_local) AS i
         FROM slot_city GROUP BY city_id, city_name, service_date_local)
       SELECT c.city_id, c.city_name, c.service_date_local, c.fill AS mean_fill_pct, c.wet AS overflow_slot_pct,
              c.rate AS generated_l_per_bin_day, y.rate AS previous_day_l_per_bin,
              (SELECT avg(w.rate) FROM c w WHERE w.city_id = c.city_id AND c.i - w.i BETWEEN 0 AND 6) AS rolling7_l_per_bin
       FROM c LEFT JOIN c y ON y.city_id = c.city_id AND y.i = c.i - 1""",
    "mean_fill_pct overflow_slot_pct generated_l_per_bin_day previous_day_l_per_bin rolling7_l_per_bin",
)
def _(w):
    return q.q18(w.city_day)


@query(
    "Q25",
    f"""SELECT zone_id, service_date_local, collected_kg_simulated,
               sum(collected_kg_simulated) OVER (PARTITION BY zone_id ORDER BY service_date_local
                 ROWS 6 PRECEDING) AS trailing_7day_kg
        FROM zoneday WHERE service_date_local BETWEEN DATE '{MONTH[0]}' AND DATE '{MONTH[1]}'""",
    "collected_kg_simulated trailing_7day_kg",
)
def _(w):
    return q.q25(w.zone_day, *MONTH)


@query(
    "Q25_month",
    f"""SELECT count(*) AS rows, CAST(sum(scheduled_readings) AS BIGINT) AS scheduled_readings,
               CAST(sum(received_readings) AS BIGINT) AS received_readings,
               sum(collected_kg_simulated) AS collected_kg_simulated
        FROM zoneday WHERE service_date_local BETWEEN DATE '{MONTH[0]}' AND DATE '{MONTH[1]}'""",
    "collected_kg_simulated",
)
def _(w):
    return q.q25_month(w.zone_day, *MONTH)


BIN_SUMMARY = """SELECT b.bin_id, b.zone_id, latitude, longitude, capacity_l, demand_factor,
       count(*) AS days, sum(arrivals_l_simulated) / count(*) AS mean_arrival_l_day,
       100.0 * sum(arrivals_l_simulated) / (count(*) * capacity_l) AS gross_capacity_pct_day,
       count(*) FILTER (WHERE overflow_l_simulated > 0) AS overflow_days,
       sum(overflow_l_simulated) AS annual_overflow_l_simulated,
       CAST(sum(successful_collections) AS BIGINT) AS successful_collections,
       CAST(sum(missed_collections) AS BIGINT) AS missed_collections,
       avg(mean_observed_fill_pct) AS mean_observed_fill_pct
       FROM binday d JOIN bin_dim b ON b.bin_id = d.bin_id
       GROUP BY b.bin_id, b.zone_id, latitude, longitude, capacity_l, demand_factor"""


@query(
    "Q26",
    BIN_SUMMARY,
    "latitude longitude demand_factor mean_arrival_l_day gross_capacity_pct_day "
    "annual_overflow_l_simulated mean_observed_fill_pct",
)
def _(w):
    return q.q26(w.bin_day, w.dim_bin)


@query(
    "Q27",
    """SELECT zone_id, max(bins) AS bins, count(*) AS days,
              sum(arrivals_l_simulated) * 0.12 AS generated_kg_simulated,
              sum(arrivals_l_simulated) / sum(bins) AS mean_arrival_l_bin_day,
              sum(overflow_l_simulated) AS overflow_l_simulated,
              7.0 * sum(successful_collections) / sum(bins) AS collections_per_bin_week
       FROM zoneday GROUP BY zone_id""",
    "generated_kg_simulated mean_arrival_l_bin_day overflow_l_simulated collections_per_bin_week",
)
def _(w):
    return q.q27_zones(w.zone_day)


@query(
    "Q27_status",
    """SELECT collection_status, count(*) AS attempts, sum(collected_kg) AS collected_kg_simulated,
              avg(collected_kg) AS mean_collected_kg_attempt FROM attempt GROUP BY 1""",
    "collected_kg_simulated mean_collected_kg_attempt",
)
def _(w):
    return q.q27_status(w.events)


TIMING = """SELECT count(*) AS attempts,
       count(*) FILTER (WHERE collection_status <> 'missed') AS successful_attempts,
       count(*) FILTER (WHERE collection_status <> 'missed' AND pre_service_fill_pct < 35)
         AS early_successes_lt35_pct,
       count(*) FILTER (WHERE pre_service_fill_pct >= 95 OR overflow_at_attempt)
         AS near_full_or_overflow_attempts,
       median(pre_service_fill_pct) AS median_pre_service_fill_pct_true FROM attempt"""


@query("Q27_timing", TIMING, "median_pre_service_fill_pct_true")
def _(w):
    return q.q27_timing(w.diagnostics)


CITY_FRAME = f"""SELECT f.*, s.overflowing_slots, s.scheduled_slots,
       100.0 * s.overflowing_slots / s.scheduled_slots AS overflow_slot_pct,
       dayname(f.service_date) AS weekday, isodow(f.service_date) >= 6 AS weekend,
       CAST(month(f.service_date) AS INTEGER) AS month,
       avg(generated_kg_simulated) OVER (ORDER BY f.service_date ROWS 6 PRECEDING) AS trailing_7day_kg
       FROM ({FLEET_DAY}) f
       JOIN (SELECT service_date_local, count(*) FILTER (WHERE overflow_l_true > 0) AS overflowing_slots,
                    count(*) AS scheduled_slots FROM slot GROUP BY 1) s
       ON s.service_date_local = f.service_date"""


@query(
    "Q28",
    CITY_FRAME,
    "generated_kg_simulated overflow_l_simulated overflow_slot_pct trailing_7day_kg",
)
def _(w):
    return q.q28(w.zone_day, w.truth)


@query(
    "Q29",
    f"""SELECT * FROM (
          SELECT CAST(sum(scheduled_readings) AS BIGINT) AS readings,
                 sum(generated_kg_simulated) AS generated_kg_simulated,
                 sum(generated_kg_simulated) / 1000 AS generated_tonnes_simulated,
                 sum(overflow_l_simulated) AS overflow_l_simulated,
                 CAST(sum(overflowing_slots) AS BIGINT) AS overflow_slots,
                 100.0 * sum(overflowing_slots) / sum(scheduled_slots) AS overflow_slot_pct,
                 CAST(sum(successful_collections) AS BIGINT) AS successful_collections,
                 CAST(sum(missed_collections) AS BIGINT) AS missed_attempts,
                 avg(generated_kg_simulated) FILTER (WHERE NOT weekend) AS weekday_mean_kg_day,
                 avg(generated_kg_simulated) FILTER (WHERE weekend) AS weekend_mean_kg_day
          FROM ({CITY_FRAME})),
        (SELECT count(fill_level_pct) AS observed_fill_readings FROM slot),
        (SELECT count(*) FILTER (WHERE collection_status = 'partial') AS partial_collections FROM attempt),
        (SELECT * EXCLUDE (successful_attempts) FROM ({TIMING})),
        (SELECT corr(ra, rb) AS bin_gross_rate_overflow_spearman,
                corr(gross_capacity_pct_day, overflow_days) AS bin_gross_rate_overflow_pearson
         FROM (SELECT gross_capacity_pct_day, overflow_days,
                      rank() OVER (ORDER BY gross_capacity_pct_day)
                        + (count(*) OVER (PARTITION BY gross_capacity_pct_day) - 1) / 2.0 AS ra,
                      rank() OVER (ORDER BY overflow_days)
                        + (count(*) OVER (PARTITION BY overflow_days) - 1) / 2.0 AS rb
               FROM ({BIN_SUMMARY}))),
        (SELECT count(*) FILTER (WHERE successful_stops < 4) AS route_low_stop_days_lt4,
                count(*) AS route_active_days, 'assumption' AS distance_origin FROM routeday)""",
    "generated_kg_simulated generated_tonnes_simulated overflow_l_simulated overflow_slot_pct "
    "weekday_mean_kg_day weekend_mean_kg_day median_pre_service_fill_pct_true "
    "bin_gross_rate_overflow_spearman bin_gross_rate_overflow_pearson",
)
def _(w):
    return q.q29(
        q.q28(w.zone_day, w.truth), q.q26(w.bin_day, w.dim_bin), w.route_day, w.events, w.diagnostics, w.obs
    )
