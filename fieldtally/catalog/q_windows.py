"""Window operations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from fieldtally.catalog.q_questions import TOP_ANOMALIES
from fieldtally.catalog.registry import query
from fieldtally.operators import ordering, windows as win
from fieldtally.plans import questions as q

ZONE_DATE = "PARTITION BY zone_id ORDER BY service_date_local"
ARRIVED = "SELECT zone_id, service_date_local, arrivals_l_simulated"


def zone_window():
    return Window.partitionBy("zone_id").orderBy("service_date_local")


def zone_frame(w):
    return w.zone_day.select("zone_id", "service_date_local", "arrivals_l_simulated")


@query(
    "E1",
    """SELECT s_suppkey, s_acctbal, rank() OVER (ORDER BY s_acctbal DESC) AS place FROM supplier
       ORDER BY s_acctbal DESC, s_suppkey LIMIT 25""",
    "s_acctbal",
)
def _(w):
    rows = w.table("supplier").select("s_suppkey", "s_acctbal")
    return win.top_ranked(rows, [F.desc("s_acctbal")], ["s_suppkey"], 25, "place")


@query(
    "E2",
    """SELECT * FROM (SELECT city_id, zone_key, overflow_l, rank() OVER (PARTITION BY city_id ORDER BY overflow_l DESC) AS place
         FROM (SELECT city_id, zone_key, sum(overflow_l_simulated) AS overflow_l FROM zoneday GROUP BY 1, 2)) WHERE place <= 5""",
    "overflow_l",
)
def _(w):
    load = w.zone_day.groupBy("city_id", "zone_key").agg(F.sum("overflow_l_simulated").alias("overflow_l"))
    return win.top_ranked_by(load, ["city_id"], [F.desc("overflow_l")], 5, "place")


@query(
    "E3",
    f"""{ARRIVED}, lag(arrivals_l_simulated) OVER ({ZONE_DATE}) AS previous_l,
               lead(arrivals_l_simulated) OVER ({ZONE_DATE}) AS next_l FROM zoneday""",
    "arrivals_l_simulated previous_l next_l",
)
def _(w):
    win_ = zone_window()
    return zone_frame(w).withColumns(
        {
            "previous_l": F.lag("arrivals_l_simulated").over(win_),
            "next_l": F.lead("arrivals_l_simulated").over(win_),
        }
    )


@query(
    "E4",
    f"{ARRIVED}, avg(arrivals_l_simulated) OVER ({ZONE_DATE} ROWS 6 PRECEDING) AS trailing_7 FROM zoneday",
    "arrivals_l_simulated trailing_7",
)
def _(w):
    return zone_frame(w).withColumn("trailing_7", win.trailing_mean("arrivals_l_simulated", 7, zone_window()))


@query(
    "E5",
    f"{ARRIVED}, sum(arrivals_l_simulated) OVER ({ZONE_DATE} ROWS 6 PRECEDING) AS trailing_7 FROM zoneday",
    "arrivals_l_simulated trailing_7",
)
def _(w):
    return zone_frame(w).withColumn("trailing_7", win.trailing_sum("arrivals_l_simulated", 7, zone_window()))


BIN_SERIES = "PARTITION BY bin_id ORDER BY service_date_local"


@query(
    "E6",
    f"""SELECT bin_id, service_date_local,
               CASE WHEN count(mean_observed_fill_pct) OVER ({BIN_SERIES} ROWS 6 PRECEDING) >= 3
                    THEN avg(mean_observed_fill_pct) OVER ({BIN_SERIES} ROWS 6 PRECEDING) END AS rolling_fill,
               CASE WHEN count(mean_observed_fill_pct) OVER ({BIN_SERIES} ROWS 6 PRECEDING) >= 7
                    THEN avg(mean_observed_fill_pct) OVER ({BIN_SERIES} ROWS 6 PRECEDING) END AS rolling_full
        FROM binday""",
    "rolling_fill rolling_full",
)
def _(w):
    wd = Window.partitionBy("bin_id").orderBy("service_date_local")
    return w.bin_day.select(
        "bin_id",
        "service_date_local",
        win.rolling_mean("mean_observed_fill_pct", 7, 3, wd).alias("rolling_fill"),
        win.rolling_mean("mean_observed_fill_pct", 7, 7, wd).alias("rolling_full"),
    )


@query(
    "E7",
    f"""SELECT zone_id, service_date_local,
               avg(arrivals_l_simulated) OVER ({ZONE_DATE} ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS prior_mean,
               stddev_samp(arrivals_l_simulated) OVER ({ZONE_DATE} ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS prior_sd,
               count(*) OVER ({ZONE_DATE} ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS prior_n FROM zoneday""",
    "prior_mean prior_sd",
)
def _(w):
    mean, sd, n = win.prior_stats("arrivals_l_simulated", 28, zone_window())
    return zone_frame(w).select(
        "zone_id", "service_date_local", mean.alias("prior_mean"), sd.alias("prior_sd"), n.alias("prior_n")
    )


# the rule of Q10 with the query's 200 rows (index raises if the rule's wording changes)
E8_SQL = TOP_ANOMALIES[: TOP_ANOMALIES.index("QUALIFY")] + "ORDER BY greatest(dev, -dev) DESC, zone_id, day LIMIT 200"


@query("E8", E8_SQL, "arrivals_l_simulated prior_28day_mean_l prior_window_z")
def _(w):
    return q.anomalies(w.zone_day, k=200)


@query("E8_top200", TOP_ANOMALIES.format(k=200), "arrivals_l_simulated prior_28day_mean_l prior_window_z")
def _(w):
    return q.anomalies(w.zone_day, k=200)


@query(
    "E9",
    f"""SELECT bin_id, service_date_local, lag(mean_observed_fill_pct, 6) OVER ({BIN_SERIES}) AS back6,
               lead(mean_observed_fill_pct) OVER ({BIN_SERIES}) AS forward1,
               lag(mean_observed_fill_pct) OVER ({BIN_SERIES}) AS back1 FROM binday""",
    "back6 forward1 back1",
)
def _(w):
    wd = Window.partitionBy("bin_id").orderBy("service_date_local")
    c = "mean_observed_fill_pct"
    return w.bin_day.select(
        "bin_id",
        "service_date_local",
        F.lag(c, 6).over(wd).alias("back6"),
        F.lead(c, 1).over(wd).alias("forward1"),
        F.lag(c, 1).over(wd).alias("back1"),
    )


@query(
    "E10",
    f"""SELECT bin_id, service_date_local, last_value(mean_observed_fill_pct IGNORE NULLS) OVER
               ({BIN_SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM binday""",
    "filled",
)
def _(w):
    wd = Window.partitionBy("bin_id").orderBy("service_date_local")
    return w.bin_day.select("bin_id", "service_date_local", win.ffill("mean_observed_fill_pct", wd).alias("filled"))


# each day refolds the 150 days before it: older values weigh less than 1e-18
@query(
    "E11",
    """SELECT bin_id, service_date_local, CASE WHEN n >= 3 THEN w END AS ewm_fill FROM (
         SELECT bin_id, service_date_local, unnest(st, recursive := true) FROM (
           SELECT bin_id, unnest(list_zip(ds, states)) AS z, z[1] AS service_date_local, z[2] AS st FROM (
             SELECT bin_id, ds, list_transform(range(1, len(xs) + 1), lambda i: list_reduce(xs[greatest(1, i - 150):i],
                      lambda acc, x: {'w': CASE WHEN x.w IS NULL THEN acc.w WHEN acc.w IS NULL THEN x.w
                                               ELSE (acc.w * acc.d * 0.75 + x.w * 0.25) / (acc.d * 0.75 + 0.25) END,
                                      'n': acc.n + x.n,
                                      'd': CASE WHEN x.w IS NOT NULL THEN 1.0 WHEN acc.w IS NULL THEN acc.d ELSE acc.d * 0.75 END},
                      {'w': CAST(NULL AS DOUBLE), 'n': 0, 'd': CAST(1.0 AS DOUBLE)})) AS states
             FROM (SELECT bin_id, list(service_date_local ORDER BY service_date_local) AS ds,
                          list({'w': mean_observed_fill_pct, 'n': CAST(mean_observed_fill_pct IS NOT NULL AS INTEGER),
                                'd': CAST(1.0 AS DOUBLE)} ORDER BY service_date_local) AS xs FROM binday GROUP BY 1))))""",
    "ewm_fill",
)
def _(w):
    frame = w.bin_day.select("bin_id", "service_date_local", "mean_observed_fill_pct")
    out = win.ewm(frame, ["bin_id"], "service_date_local", "mean_observed_fill_pct", "ewm_fill", 7, 3)
    return out.select("bin_id", "service_date_local", "ewm_fill")


@query(
    "E12",
    """SELECT max(abs(p + arrivals_l_true - overflow_l_true - removed_l_true - inventory_l_true)) AS max_residual_l,
              count(*) FILTER (WHERE timestamp_utc - pt <> INTERVAL 2 HOUR) AS irregular_steps,
              count(p) AS compared FROM (
         SELECT *, lag(inventory_l_true) OVER s AS p, lag(timestamp_utc) OVER s AS pt FROM slot
         WINDOW s AS (PARTITION BY bin_id ORDER BY timestamp_utc, reading_id))""",
    "max_residual_l",
)
def _(w):
    from fieldtally.plans.quality import balance_residual

    return balance_residual(w.truth, ["bin_id"], ["timestamp_utc", "reading_id"])


@query(
    "E13",
    """SELECT city_id, corr(generated_l_per_bin_day, p) AS autocorr1 FROM (
         SELECT *, lag(generated_l_per_bin_day) OVER (PARTITION BY city_id ORDER BY service_date_local) AS p FROM cityday)
       GROUP BY 1""",
    "autocorr1",
)
def _(w):
    from fieldtally.plans.statistics import autocorr1

    return autocorr1(w.city_day, ["city_id"], "service_date_local", "generated_l_per_bin_day")


@query(
    "E14",
    """SELECT city_id, bin_id, row_number() OVER (PARTITION BY city_id ORDER BY floor(demand_factor * 10), latitude DESC, bin_id)
              AS priority_rank FROM bin_dim""",
)
def _(w):
    """Position within a city, counted over coarse latitude bands."""
    tier = F.floor(F.col("demand_factor") * 10)
    out = ordering.split_position(
        w.dim_bin.select("city_id", "bin_id", "demand_factor", "latitude"),
        ["city_id"],
        [tier, -F.floor(F.col("latitude") * 100)],
        [tier, F.desc("latitude"), F.col("bin_id")],
        "priority_rank",
    )
    return out.select("city_id", "bin_id", "priority_rank")


@query(
    "E15",
    """SELECT l_orderkey AS u, l_suppkey AS v, min(l_quantity) AS length_m FROM lineitem GROUP BY 1, 2""",
    "length_m",
)
def _(w):
    rows = w.table("lineitem").select(
        F.col("l_orderkey").alias("u"), F.col("l_suppkey").alias("v"), F.col("l_quantity").alias("length_m")
    )
    return rows.groupBy("u", "v").agg(F.min_by(F.struct("length_m"), F.col("length_m")).alias("s")).select("u", "v", "s.length_m")


@query(
    "E16",
    """SELECT l_orderkey, seq, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY seq) AS elapsed FROM (
         SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey
                  ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS seq FROM lineitem)""",
    "elapsed",
)
def _(w):
    seq = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    stops = w.table("lineitem").select("l_orderkey", "l_quantity", F.row_number().over(seq).cast("bigint").alias("seq"))
    return ordering.running_sum_split(stops, ["l_orderkey"], "seq", "l_quantity", "elapsed").select(
        "l_orderkey", "seq", "elapsed"
    )


@query(
    "E17",
    """SELECT c_custkey, rank() OVER (ORDER BY round(c_acctbal / 100)) + (count(*) OVER (PARTITION BY round(c_acctbal / 100)) - 1) / 2.0
              AS avg_rank FROM customer""",
    "avg_rank",
)
def _(w):
    rows = w.table("customer").select("c_custkey", F.round(F.col("c_acctbal") / 100).alias("v"))
    return ordering.rank_average(rows, [], "v", "avg_rank").select("c_custkey", "avg_rank")


@query(
    "E18",
    """SELECT CAST(date_trunc('week', service_date_local) AS DATE) AS week_start,
              count(*) FILTER (WHERE isodow(service_date_local) < 6) AS weekdays,
              count(*) FILTER (WHERE isodow(service_date_local) >= 6) AS weekend_days
       FROM (SELECT DISTINCT service_date_local FROM slot) GROUP BY 1
       HAVING count(*) FILTER (WHERE isodow(service_date_local) < 6) = 5
          AND count(*) FILTER (WHERE isodow(service_date_local) >= 6) = 2""",
)
def _(w):
    from fieldtally.plans.statistics import complete_weeks

    return complete_weeks(w.obs.select("service_date_local").distinct(), "service_date_local")
