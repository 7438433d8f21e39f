"""Join and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.catalog.registry import query
from fieldtally.operators import joins


def n_rows(name="rows"):
    return F.count(F.lit(1)).alias(name)


@query(
    "C1",
    """SELECT collection_status, count(*) AS rows, sum(fill_level_pct) AS fill_sum, sum(removed_l_true) AS removed_l
       FROM slot GROUP BY 1""",
    "fill_sum removed_l",
)
def _(w):
    both = joins.join_truth(w.obs, w.truth)
    return both.groupBy("collection_status").agg(
        n_rows(), F.sum("fill_level_pct").alias("fill_sum"), F.sum("removed_l_true").alias("removed_l")
    )


@query(
    "C2",
    "SELECT zone_id, count(*) AS rows, avg(fill_level_pct) AS mean_fill FROM slot_city GROUP BY 1",
    "mean_fill",
)
def _(w):
    """Readings reduce to bins before the dimension join."""
    per_bin = w.obs.groupBy("bin_id").agg(
        n_rows(), F.sum("fill_level_pct").alias("s"), F.count("fill_level_pct").alias("c")
    )
    return (
        joins.join_dim(per_bin, w.dim_bin.select("bin_id", "zone_id"), "bin_id")
        .groupBy("zone_id")
        .agg(F.sum("rows").alias("rows"), (F.sum("s") / F.sum("c")).alias("mean_fill"))
    )


@query(
    "C3",
    """SELECT d.city_id, d.bin_key, max(capacity_l) AS capacity_l, count(*) AS days FROM binday d
       JOIN bin_dim b ON b.city_id = d.city_id AND b.bin_key = d.bin_key GROUP BY 1, 2""",
)
def _(w):
    days = w.bin_day.groupBy("city_id", "bin_key").agg(n_rows("days"))
    return joins.join_dim(days, w.dim_bin.select("city_id", "bin_key", "capacity_l"), ["city_id", "bin_key"])


ERROR_DAYS = """SELECT c_nationkey AS zone, count(*) AS bins, CAST(sum(e) AS BIGINT) AS error_events, count(e) AS bins_with_errors
       FROM customer LEFT JOIN (SELECT user_id, count(*) AS e FROM events WHERE event_type = 'error' GROUP BY 1)
       ON user_id = c_custkey GROUP BY 1"""


@query("C4", ERROR_DAYS)
def _(w):
    errors = (
        w.table("events")
        .where(F.col("event_type") == "error")
        .groupBy(F.col("user_id").alias("c_custkey"))
        .agg(n_rows("e"))
    )
    return (
        joins.left_keep(w.table("customer"), errors, ["c_custkey"])
        .groupBy(F.col("c_nationkey").alias("zone"))
        .agg(n_rows("bins"), F.sum("e").alias("error_events"), F.count("e").alias("bins_with_errors"))
    )


@query(
    "C5",
    """SELECT c_custkey AS customer_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""",
)
def _(w):
    placed = w.table("events").select(F.col("user_id").alias("customer_id"))
    return joins.orphans(w.table("customer").select(F.col("c_custkey").alias("customer_id")), placed, "customer_id")


@query(
    "C6",
    """SELECT count(*) AS orphans FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F'
       WHERE o_orderkey IS NULL""",
)
def _(w):
    finished = w.table("orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("l_orderkey"))
    return joins.missing_parent(w.table("lineitem").select("l_orderkey"), finished, "l_orderkey")


@query(
    "C7",
    """SELECT o_orderstatus, count(*) AS orders FROM orders
       WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) GROUP BY 1""",
)
def _(w):
    large = w.table("lineitem").where(F.col("l_quantity") > 49).select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.restrict_to(w.table("orders"), large, "o_orderkey").groupBy("o_orderstatus").agg(n_rows("orders"))


@query(
    "C8",
    """SELECT count(*) AS pairs, count(*) FILTER (WHERE a.fill_level_pct = b.fill_level_pct) AS equal_pairs,
              CAST(count(*) FILTER (WHERE a.fill_level_pct = b.fill_level_pct) AS DOUBLE) / count(*) AS equal_share
       FROM slot_city a JOIN slot_city b ON a.bin_id % 10 = b.bin_id % 10 AND a.timestamp_utc = b.timestamp_utc
       WHERE a.city_id = 'ASIA' AND b.city_id = 'EUROPE' AND a.fill_level_pct IS NOT NULL
         AND b.fill_level_pct IS NOT NULL""",
    "equal_share",
)
def _(w):
    rows = w.obs_city.withColumn("local_id", F.col("bin_id") % 10)
    return joins.cross_city_equal_share(rows, "ASIA", "EUROPE", ["local_id", "timestamp_utc"], "fill_level_pct")


@query("C9", "SELECT (SELECT count(*) FROM slot) AS fact_rows, (SELECT count(*) FROM slot_city) AS joined_rows")
def _(w):
    dims = [
        (w.dim_bin, ["city_id", "bin_key"]),
        (w.dim_zone, ["city_id", "zone_key"]),
        (w.dim_city, ["city_id"]),
    ]
    return joins.star_count(w.obs_city.select("city_id", "bin_key", "zone_key"), dims)


@query(
    "C10",
    """SELECT service_date_local, sum(arrivals_l_simulated) AS arrivals_l, max(o.overflow_slots) AS overflow_slots
       FROM zoneday z JOIN (SELECT service_date_local AS d, count(*) FILTER (WHERE overflow_l_true > 0) AS overflow_slots
                            FROM slot GROUP BY 1) o ON o.d = z.service_date_local GROUP BY 1""",
    "arrivals_l",
)
def _(w):
    days = w.zone_day.groupBy("service_date_local").agg(F.sum("arrivals_l_simulated").alias("arrivals_l"))
    slots = w.truth.groupBy("service_date_local").agg(F.count_if(F.col("overflow_l_true") > 0).alias("overflow_slots"))
    return joins.join_checked(days, slots, ["service_date_local"], "one_to_one")


@query(
    "C11",
    """SELECT city_id, service_date_local, scheduled_readings, overflow_slots, bins FROM cityday""",
)
def _(w):
    keys = ["city_id", "service_date_local"]
    seen = w.obs_city.groupBy(*keys).agg(n_rows("scheduled_readings"))
    spilled = w.truth_city.groupBy(*keys).agg(F.count_if(F.col("overflow_l_true") > 0).alias("overflow_slots"))
    days = w.bin_day.groupBy(*keys).agg(n_rows("bins"))
    return joins.join_aggregates([days, seen, spilled], keys)


@query(
    "C13",
    """SELECT l_orderkey, count(*) AS hops, count(length_m) AS known_hops, sum(length_m) AS length_m,
              sum(travel_seconds) AS travel_seconds
       FROM (SELECT l_orderkey, unnest(range(1, len(p))) AS i, p FROM
              (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS p FROM lineitem GROUP BY 1))
       LEFT JOIN (SELECT a.s_suppkey AS u, b.s_suppkey AS v, a.s_acctbal + b.s_acctbal AS length_m,
                         (a.s_acctbal + b.s_acctbal) / 10 AS travel_seconds
                  FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey) ON u = p[i] AND v = p[i + 1]
       GROUP BY 1""",
    "length_m travel_seconds",
)
def _(w):
    """Edges are the pairs the paths use, within one zone; none are enumerated beyond those."""
    paths = w.table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("nodes"))
    hops = paths.select(
        F.explode(
            F.arrays_zip(
                F.slice("nodes", F.lit(1), F.greatest(F.size("nodes") - 1, F.lit(0))).alias("u"),
                F.slice("nodes", F.lit(2), F.greatest(F.size("nodes") - 1, F.lit(0))).alias("v"),
            )
        ).alias("h")
    )
    node = w.table("supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    a = node.toDF("u", "nu", "bu")
    b = node.toDF("v", "nv", "bv")
    edges = (
        hops.select("h.u", "h.v")
        .distinct()
        .join(a, "u")
        .join(b, "v")
        .where(F.col("nu") == F.col("nv"))
        .select("u", "v", (F.col("bu") + F.col("bv")).alias("length_m"))
        .withColumn("travel_seconds", F.col("length_m") / 10)
    )
    return joins.sum_path(paths, edges, ["l_orderkey"], "nodes")


# set operations -----------------------------------------------------------


@query(
    "G1",
    """SELECT city_id, count(*) AS rows, count(extra) AS with_extra FROM (
         SELECT city_id, bin_key, NULL AS extra FROM bin_dim WHERE city_id < 'B'
         UNION ALL BY NAME SELECT bin_key, 'x' AS extra, city_id FROM bin_dim WHERE city_id >= 'B') GROUP BY 1""",
)
def _(w):
    first = w.dim_bin.where(F.col("city_id") < "B").select("city_id", "bin_key")
    others = w.dim_bin.where(F.col("city_id") >= "B").select(F.lit("x").alias("extra"), "bin_key", "city_id")
    return joins.union_by_name(first, others).groupBy("city_id").agg(n_rows(), F.count("extra").alias("with_extra"))


CITIES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@query("G2", "SELECT city_id, zone_id, count(*) AS bins FROM bin_dim GROUP BY 1, 2")
def _(w):
    frames = [w.dim_bin.where(F.col("city_id") == c) for c in CITIES]
    return joins.union_by_name(*frames).groupBy("city_id", "zone_id").agg(n_rows("bins"))


@query(
    "G3",
    """SELECT city_id, vehicle_key, fleet_scope, capacity_l FROM (
         SELECT DISTINCT city_id, city_id || ':P:' || (bin_id % 50) AS vehicle_key, 'formula_proxy' AS fleet_scope,
                CAST(NULL AS DOUBLE) AS capacity_l FROM slot_city
         UNION ALL SELECT DISTINCT city_id, city_id || ':R:' || (bin_id % 3), 'routing_scenario', 12000.0::DOUBLE FROM bin_dim)""",
    "capacity_l",
)
def _(w):
    from fieldtally.functions.expressions import global_key

    proxy = w.obs_city.select(
        "city_id",
        global_key("city_id", F.lit("P"), F.col("bin_id") % 50).alias("vehicle_key"),
        F.lit("formula_proxy").alias("fleet_scope"),
        F.lit(None).cast("double").alias("capacity_l"),
    )
    routed = w.dim_bin.select(
        "city_id",
        global_key("city_id", F.lit("R"), F.col("bin_id") % 3).alias("vehicle_key"),
        F.lit("routing_scenario").alias("fleet_scope"),
        F.lit(12000.0).alias("capacity_l"),
    )
    return joins.distinct_union(proxy, routed)


@query("G4", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def _(w):
    return w.table("lineitem").select("l_orderkey", "l_linenumber").dropDuplicates()


SUBSETS = """SELECT '90 in 80' AS pair, count(*) AS missing, count(*) = 0 AS subset FROM
         (SELECT bin_id, service_date_local FROM binday WHERE max_observed_fill_pct >= 90
          EXCEPT SELECT bin_id, service_date_local FROM binday WHERE max_observed_fill_pct >= 80)
       UNION ALL SELECT '80 in 90', count(*), count(*) = 0 FROM
         (SELECT bin_id, service_date_local FROM binday WHERE max_observed_fill_pct >= 80
          EXCEPT SELECT bin_id, service_date_local FROM binday WHERE max_observed_fill_pct >= 90)"""


@query("G5", SUBSETS)
def _(w):
    key = F.concat_ws("|", "bin_id", "service_date_local").alias("k")
    chosen = {t: w.bin_day.where(F.col("max_observed_fill_pct") >= t).select(key) for t in (80, 90)}
    down = joins.is_subset(chosen[90], chosen[80], "k").withColumn("pair", F.lit("90 in 80"))
    up = joins.is_subset(chosen[80], chosen[90], "k").withColumn("pair", F.lit("80 in 90"))
    return down.union(up).select("pair", "missing", "subset")


@query(
    "G6",
    """SELECT coalesce(c.k, u.k) AS key, CASE WHEN u.k IS NULL THEN 'left_only' ELSE 'right_only' END AS side
       FROM (SELECT DISTINCT c_custkey AS k FROM customer) c
       FULL JOIN (SELECT DISTINCT user_id * 2 AS k FROM events) u ON u.k = c.k WHERE c.k IS NULL OR u.k IS NULL""",
)
def _(w):
    customers = w.table("customer").select(F.col("c_custkey").alias("key"))
    users = w.table("events").select((F.col("user_id") * 2).alias("key"))
    return joins.sym_diff(customers, users, ["key"])
