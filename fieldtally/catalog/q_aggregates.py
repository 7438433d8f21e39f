"""Aggregation, sort and top-k operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.catalog.q_questions import BIN_SUMMARY, CITY_FRAME
from fieldtally.catalog.registry import query
from fieldtally.functions.expressions import ratio_of_sums
from fieldtally.operators import aggregates as ag, sampling
from fieldtally.operators.ordering import exact_quantiles, total_position
from fieldtally.operators.scan import CappedSum, final_fold
from fieldtally.plans import questions as q


def n_rows(name="rows"):
    return F.count(F.lit(1)).alias(name)


@query(
    "D1",
    """SELECT bin_id, sum(arrivals_l_true) AS s, avg(arrivals_l_true) AS a, min(fill_level_pct) AS lo,
              max(fill_level_pct) AS hi, count(*) AS rows FROM slot GROUP BY 1""",
    "s a lo hi",
)
def _(w):
    return w.interim.groupBy("bin_id").agg(
        F.sum("arrivals_l_true").alias("s"),
        F.avg("arrivals_l_true").alias("a"),
        F.min("fill_level_pct").alias("lo"),
        F.max("fill_level_pct").alias("hi"),
        n_rows(),
    )


@query(
    "D2",
    """SELECT collection_status, count(*) AS scheduled, count(fill_level_pct) AS received,
              count(*) FILTER (WHERE sensor_status = 'missing') AS missing FROM slot GROUP BY 1""",
)
def _(w):
    return w.obs.groupBy("collection_status").agg(
        n_rows("scheduled"),
        F.count("fill_level_pct").alias("received"),
        F.count_if(F.col("sensor_status") == "missing").alias("missing"),
    )


@query("D3", "SELECT city_id, zone_id, collection_status, count(*) AS rows FROM attempt GROUP BY ALL")
def _(w):
    view = "fieldtally_attempts"
    w.events.join(w.dim_bin.select("bin_id", "city_id"), "bin_id").createOrReplaceTempView(view)
    return w.spark.sql(f"SELECT city_id, zone_id, collection_status, count(*) AS rows FROM {view} GROUP BY ALL")


@query(
    "D4",
    """SELECT bin_id, count(*) AS days, count(*) FILTER (WHERE overflow_l_simulated > 0) AS overflow_days FROM binday
       GROUP BY 1 HAVING count(*) >= 500 AND count(*) FILTER (WHERE overflow_l_simulated > 0) > 100""",
)
def _(w):
    per_bin = w.bin_day.groupBy("bin_id").agg(
        n_rows("days"), F.count_if(F.col("overflow_l_simulated") > 0).alias("overflow_days")
    )
    return per_bin.where((F.col("days") >= 500) & (F.col("overflow_days") > 100))


@query(
    "D5",
    """SELECT count(*) AS rows, count(fill_level_pct) AS received, avg(fill_level_pct) AS mean_fill,
              sum(overflow_l_true) AS overflow_l FROM slot""",
    "mean_fill overflow_l",
)
def _(w):
    return ag.totals(
        w.interim,
        [
            n_rows(),
            F.count("fill_level_pct").alias("received"),
            F.avg("fill_level_pct").alias("mean_fill"),
            F.sum("overflow_l_true").alias("overflow_l"),
        ],
    )


@query(
    "D6",
    """SELECT count(DISTINCT bin_id) AS bins, count(DISTINCT (bin_id, service_date_local)) AS bin_days FROM slot""",
)
def _(w):
    """Pairs first (map-side), then bins: one shuffle level per distinct, no wide distinct expansion."""
    pairs = w.obs.select("bin_id", "service_date_local").distinct()
    per_bin = pairs.groupBy("bin_id").agg(n_rows("d"))
    return per_bin.agg(n_rows("bins"), F.sum("d").alias("bin_days"))


@query(
    "D7",
    """SELECT collection_status, median(fill_level_pct) AS median, quantile_cont(fill_level_pct, 0.25) AS q1,
              quantile_cont(fill_level_pct, 0.9) AS p90, quantile_cont(fill_level_pct, 0.95) AS p95
       FROM slot WHERE fill_level_pct IS NOT NULL GROUP BY 1""",
    "median q1 p90 p95",
)
def _(w):
    return exact_quantiles(
        w.obs, ["collection_status"], "fill_level_pct", {"median": 0.5, "q1": 0.25, "p90": 0.9, "p95": 0.95}
    )


@query(
    "D8",
    """SELECT event_type, list_extract(s, 1 + CAST(ceil(0.8 * (len(s) - 1) - 1e-9) AS BIGINT)) AS w80,
              list_extract(s, 1 + CAST(ceil(0.9 * (len(s) - 1) - 1e-9) AS BIGINT)) AS w90,
              list_extract(s, 1 + CAST(ceil(0.95 * (len(s) - 1) - 1e-9) AS BIGINT)) AS w95
       FROM (SELECT event_type, list_sort(list(value)) AS s FROM events GROUP BY 1)""",
    "w80 w90 w95",
)
def _(w):
    return exact_quantiles(
        w.table("events"), ["event_type"], "value", {"w80": 0.8, "w90": 0.9, "w95": 0.95}, how="higher"
    )


@query(
    "D9",
    """SELECT user_id, CAST(ts AS DATE) AS day, arg_max(value, ts) FILTER (WHERE hour(ts) <= 8 AND event_type <> 'error')
              AS latest_value FROM events GROUP BY 1, 2""",
    "latest_value",
)
def _(w):
    good = (F.hour("ts") <= 8) & (F.col("event_type") != "error")
    return (
        w.table("events")
        .groupBy("user_id", F.col("ts").cast("date").alias("day"))
        .agg(ag.latest_value("value", "ts", good).alias("latest_value"))
    )


@query(
    "D10",
    "SELECT bin_id, var_samp(arrivals_l_true) AS variance, stddev_samp(arrivals_l_true) AS sd FROM slot GROUP BY 1",
    "variance sd",
)
def _(w):
    return w.truth.groupBy("bin_id").agg(
        F.var_samp("arrivals_l_true").alias("variance"), F.stddev_samp("arrivals_l_true").alias("sd")
    )


@query("D11", "SELECT bin_id, skewness(arrivals_l_true) AS skew FROM slot GROUP BY 1", "skew")
def _(w):
    return w.truth.groupBy("bin_id").agg(ag.skew_adj("arrivals_l_true").alias("skew"))


@query(
    "D12",
    """SELECT bin_id, l_quantity AS mode FROM (
         SELECT l_suppkey AS bin_id, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_quantity)
                AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1""",
    "mode",
)
def _(w):
    return ag.mode_min(w.truth, ["bin_id"], "arrivals_l_true")


@query(
    "D13",
    """SELECT event_type, q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high,
              count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers, count(*) AS n
       FROM events JOIN (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
                         FROM events GROUP BY 1) USING (event_type) GROUP BY event_type, q1, q3""",
    "q1 q3 iqr low high",
)
def _(w):
    return ag.tukey(w.table("events"), ["event_type"], "value")


SUMMARY_LONG = f"""
       SELECT 'city_daily_generated_mass' AS metric, generated_kg_simulated AS value FROM ({CITY_FRAME})
       UNION ALL SELECT 'city_daily_overflow_slot_share', overflow_slot_pct FROM ({CITY_FRAME})
       UNION ALL SELECT 'bin_mean_daily_arrival', mean_arrival_l_day FROM ({BIN_SUMMARY})
       UNION ALL SELECT 'bin_annual_successful_collections', successful_collections FROM ({BIN_SUMMARY})
       UNION ALL SELECT 'bin_annual_overflow_days', overflow_days FROM ({BIN_SUMMARY})
       UNION ALL SELECT 'route_proxy_successful_stops', successful_stops FROM routeday
       UNION ALL SELECT 'observed_fill_readings', fill_level_pct FROM slot WHERE fill_level_pct IS NOT NULL"""
DISCRETE = ("bin_annual_successful_collections", "bin_annual_overflow_days", "route_proxy_successful_stops")


@query(
    "D14",
    f"""SELECT m.*, t.tukey_outlier_count, o.mode_if_useful FROM (
          SELECT metric, count(*) AS n, avg(value) AS mean, var_samp(value) AS variance, stddev_samp(value) AS std_dev,
                 skewness(value) AS skewness, quantile_cont(value, 0.25) AS q1, median(value) AS median,
                 quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.95) AS p95,
                 quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr
          FROM ({SUMMARY_LONG}) GROUP BY 1) m
        JOIN (SELECT metric, count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))
                     AS tukey_outlier_count
              FROM ({SUMMARY_LONG}) JOIN (SELECT metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
                                          FROM ({SUMMARY_LONG}) GROUP BY 1) USING (metric) GROUP BY 1) t USING (metric)
        LEFT JOIN (SELECT metric, value AS mode_if_useful FROM (
                     SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY count(*) DESC, value) AS r
                     FROM ({SUMMARY_LONG}) WHERE metric IN {DISCRETE} GROUP BY 1, 2) WHERE r = 1) o USING (metric)""",
    "mean variance std_dev skewness q1 median q3 p05 p95 iqr mode_if_useful",
    digits=4,
)
def _(w):
    city = q.q28(w.zone_day, w.truth)
    bins = q.q26(w.bin_day, w.dim_bin)
    long = ag.to_long(
        city.select(
            F.lit(1).alias("i"),
            F.col("generated_kg_simulated").alias("city_daily_generated_mass"),
            F.col("overflow_slot_pct").alias("city_daily_overflow_slot_share"),
        ),
        ["i"],
        ["city_daily_generated_mass", "city_daily_overflow_slot_share"],
    )
    per_bin = {
        "bin_mean_daily_arrival": "mean_arrival_l_day",
        "bin_annual_successful_collections": "successful_collections",
        "bin_annual_overflow_days": "overflow_days",
    }
    long = long.union(
        ag.to_long(
            bins.select(F.lit(1).alias("i"), *[F.col(c).alias(n) for n, c in per_bin.items()]), ["i"], list(per_bin)
        )
    )
    stops = w.route_day.select(F.col("successful_stops").cast("double").alias("value"))
    fills = w.obs.select(F.col("fill_level_pct").alias("value"))
    long = long.select("metric", "value").unionByName(
        stops.withColumn("metric", F.lit("route_proxy_successful_stops"))
    ).unionByName(fills.withColumn("metric", F.lit("observed_fill_readings")))
    return ag.describe_metrics(long, discrete=DISCRETE)


@query(
    "D15",
    """SELECT CAST(least(100, floor(fill_level_pct / 5) * 5) AS INTEGER) AS bucket_lower, count(*) AS rows FROM slot
       WHERE fill_level_pct IS NOT NULL GROUP BY 1""",
)
def _(w):
    return ag.hist_step(w.obs, "fill_level_pct", 5, 100)


@query(
    "D16",
    """SELECT CAST(CASE WHEN hi > lo THEN least(24, floor((value - lo) / ((hi - lo) / 25))) ELSE 0 END AS INTEGER) AS bin,
              lo + (hi - lo) / 25 * CASE WHEN hi > lo THEN least(24, floor((value - lo) / ((hi - lo) / 25))) ELSE 0 END AS lower,
              count(*) AS rows
       FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1, 2""",
    "lower",
)
def _(w):
    return ag.hist_n(w.table("events"), "value", 25)


@query("D16_unit", "SELECT successful_stops AS bin, count(*) AS rows FROM routeday GROUP BY 1")
def _(w):
    return ag.hist_unit(w.route_day, "successful_stops")


@query(
    "D17",
    """SELECT zone_id, sum(arrivals_l_simulated) / sum(bins) AS litres_per_bin_day,
              sum(collected_kg_simulated) / nullif(sum(successful_collections), 0) AS kg_per_success,
              100.0 * sum(received_readings) / sum(scheduled_readings) AS received_pct FROM zoneday GROUP BY 1""",
    "litres_per_bin_day kg_per_success received_pct",
)
def _(w):
    return w.zone_day.groupBy("zone_id").agg(
        ratio_of_sums("arrivals_l_simulated", "bins").alias("litres_per_bin_day"),
        ratio_of_sums("collected_kg_simulated", "successful_collections").alias("kg_per_success"),
        ratio_of_sums("received_readings", "scheduled_readings", 100.0).alias("received_pct"),
    )


@query(
    "D18",
    """SELECT city_id, avg(collected_kg) FILTER (WHERE collection_status = 'collected') AS collected,
              avg(collected_kg) FILTER (WHERE collection_status = 'partial') AS partial,
              avg(collected_kg) FILTER (WHERE collection_status = 'missed') AS missed FROM attempt GROUP BY 1""",
    "collected partial missed",
)
def _(w):
    return ag.pivot_fixed(
        w.diagnostics, ["city_id"], "collection_status", ["collected", "partial", "missed"], F.avg("collected_kg")
    )


@query(
    "D19",
    """SELECT city_id, metric, sum(value) AS value FROM (
         SELECT city_id, 'generated_l' AS metric, generated_l AS value FROM cityday
         UNION ALL SELECT city_id, 'overflow_l', overflow_l FROM cityday
         UNION ALL SELECT city_id, 'bins', bins FROM cityday) GROUP BY 1, 2""",
    "value",
)
def _(w):
    long = ag.to_long(w.city_day, ["city_id"], ["generated_l", "overflow_l", "bins"])
    return long.groupBy("city_id", "metric").agg(F.sum("value").alias("value"))


@query("D20", "SELECT event_type, count(*) AS rows FROM events GROUP BY 1")
def _(w):
    return ag.value_counts(w.table("events"), "event_type")


@query(
    "D21",
    """SELECT strftime(ts + INTERVAL 330 MINUTE, '%Y-%m') AS target_month, event_type, count(*) AS n,
              avg(abs(value - 100)) AS mae FROM events GROUP BY 1, 2""",
    "mae",
)
def _(w):
    from fieldtally.functions.expressions import to_local

    return ag.metric_by_month(
        w.table("events"),
        to_local("ts"),
        ["event_type"],
        [n_rows("n"), F.avg(F.abs(F.col("value") - 100)).alias("mae")],
    )


@query(
    "D22",
    """SELECT user_id, list_reduce(list_sort(list(value)), lambda a, v: least(400.0::DOUBLE, a * 0.95 + v), 0.0::DOUBLE) AS state
       FROM events GROUP BY 1""",
    "state",
)
def _(w):
    """Decayed, capped fold over each user's sorted values; equal values are one row."""
    counts = w.table("events").groupBy("user_id", "value").agg(F.count(F.lit(1)).alias("times"))
    return final_fold(counts, ["user_id"], "value", "value", "state", CappedSum(400.0, 0.95), "times")


# sorts and top-k ----------------------------------------------------------


@query(
    "F1",
    """SELECT bin_id, service_date_local, arrivals_l_simulated, row_number() OVER (
                ORDER BY arrivals_l_simulated DESC, bin_id, service_date_local) AS place FROM binday""",
    "arrivals_l_simulated",
)
def _(w):
    """The whole order, in ranges of litres, bins and days taken together."""
    order = [F.desc("arrivals_l_simulated"), F.col("bin_id"), F.col("service_date_local")]
    return total_position(w.bin_day.select("bin_id", "service_date_local", "arrivals_l_simulated"), order, "place")


@query(
    "F2",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
    "o_totalprice",
)
def _(w):
    return w.table("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


HAVERSINE_SQL = """2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2)
       + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"""


@query(
    "F3",
    f"""SELECT bin_id, {HAVERSINE_SQL.format(lat1="13.0827", lon1="80.2707", lat2="latitude", lon2="longitude")} AS center_distance_m
        FROM bin_dim ORDER BY center_distance_m, bin_id LIMIT 60""",
    "center_distance_m",
    digits=3,
)
def _(w):
    from fieldtally.operators.spatial import k_nearest_to

    return k_nearest_to(w.dim_bin, 80.2707, 13.0827, 60, "bin_id").select("bin_id", "center_distance_m")


@query(
    "F4",
    """SELECT c_nationkey AS stratum, c_custkey AS id FROM (
         SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('7|' || c_custkey), c_custkey) AS r FROM customer)
       WHERE r <= 5""",
)
def _(w):
    people = w.table("customer").select(F.col("c_nationkey").alias("stratum"), F.col("c_custkey").alias("id"))
    chosen, _ = sampling.stratified_sample(people, "stratum", "id", 5, seed=7, top_up=False)
    return chosen.select("stratum", "id")


F4_DRAWS = """WITH d AS (SELECT s_nationkey AS stratum, s_suppkey AS id, md5('7|' || s_suppkey) AS draw FROM supplier),
       r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY draw, id) AS r FROM d),
       missing AS (SELECT stratum, count(*) AS available, 5 - count(*) AS shortfall FROM d GROUP BY stratum HAVING count(*) < 5)"""


@query(
    "F4_top_up",
    f"""{F4_DRAWS}
       SELECT stratum, id FROM r WHERE r <= 5
       UNION ALL (SELECT stratum, id FROM r WHERE r > 5
                  QUALIFY row_number() OVER (ORDER BY draw, id) <= (SELECT coalesce(sum(shortfall), 0) FROM missing))""",
)
def _(w):
    makers = w.table("supplier").select(F.col("s_nationkey").alias("stratum"), F.col("s_suppkey").alias("id"))
    return sampling.stratified_sample(makers, "stratum", "id", 5, seed=7)[0].select("stratum", "id")


@query("F4_shortfall", f"{F4_DRAWS} SELECT stratum, available, shortfall FROM missing")
def _(w):
    makers = w.table("supplier").select(F.col("s_nationkey").alias("stratum"), F.col("s_suppkey").alias("id"))
    return sampling.stratified_sample(makers, "stratum", "id", 5, seed=7)[1]
