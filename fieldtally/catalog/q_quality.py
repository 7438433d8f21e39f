"""Data-quality, reconciliation and contract checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from fieldtally.bindings import reading_id
from fieldtally.catalog.q_sources import OBSERVED, with_parts
from fieldtally.catalog.registry import query
from fieldtally.plans import quality as ql, questions as q, star
from fieldtally.schemas import CONTRACTS
from fieldtally.session import cut_lineage, scratch_path, store_rows
from fieldtally.sources import files, sinks

PK_SQL = """SELECT '{name}' AS table_name, CAST(sum(c) AS BIGINT) AS rows, count(*) AS distinct_keys,
       CAST(sum(c - 1) AS BIGINT) AS duplicates, count(*) FILTER (WHERE c > 1) AS repeated_keys
       FROM (SELECT {keys}, count(*) AS c FROM {table} GROUP BY ALL)"""


@query(
    "L1",
    " UNION ALL ".join(
        [
            PK_SQL.format(name="readings", keys="reading_id", table="slot"),
            PK_SQL.format(name="order_lines", keys="l_orderkey, l_linenumber", table="lineitem"),
            PK_SQL.format(name="whole_rows", keys="*", table="lineitem"),
        ]
    ).replace("SELECT *, count(*)", "SELECT COLUMNS(*), count(*)"),
)
def _(w):
    lines = w.table("lineitem")
    return (
        ql.check_pk(w.obs, ["reading_id"], "readings")
        .union(ql.check_pk(lines, ["l_orderkey", "l_linenumber"], "order_lines"))
        .union(ql.check_pk(lines, lines.columns, "whole_rows"))
    )


@query(
    "L2",
    """SELECT 'orders.o_orderkey' AS parent, 'lineitem.l_orderkey' AS child, count(DISTINCT l_orderkey) AS orphan_keys,
              count(*) AS orphan_rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
       UNION ALL SELECT 'customer.c_custkey', 'orders.o_custkey', count(DISTINCT o_custkey), count(*) FROM orders
         WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
       UNION ALL SELECT 'events.user_id', 'customer.c_custkey', count(DISTINCT c_custkey), count(*) FROM customer
         WHERE c_custkey NOT IN (SELECT user_id FROM events)
       UNION ALL SELECT 'supplier.s_suppkey', 'lineitem.l_suppkey', count(DISTINCT l_suppkey), count(*) FROM lineitem
         WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
       UNION ALL SELECT 'nation.n_nationkey', 'supplier.s_nationkey', count(DISTINCT s_nationkey), count(*) FROM supplier
         WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)""",
)
def _(w):
    names = ("orders", "lineitem", "customer", "events", "supplier", "nation")
    return ql.check_links(
        {t: w.table(t) for t in names},
        [
            ("orders", "o_orderkey", "lineitem", "l_orderkey"),
            ("customer", "c_custkey", "orders", "o_custkey"),
            ("events", "user_id", "customer", "c_custkey"),
            ("supplier", "s_suppkey", "lineitem", "l_suppkey"),
            ("nation", "n_nationkey", "supplier", "s_nationkey"),
        ],
    )


@query(
    "L3",
    """UNPIVOT (SELECT count(*) FILTER (WHERE fill_level_pct NOT BETWEEN 0 AND 100) AS fill_out_of_range,
              count(*) FILTER (WHERE battery_pct NOT BETWEEN 0 AND 100) AS battery_out_of_range,
              count(*) FILTER (WHERE (fill_level_pct IS NULL) <> (sensor_status = 'missing')) AS null_iff_missing,
              count(*) FILTER (WHERE collection_status NOT IN ('none', 'collected', 'partial', 'missed')) AS unknown_status,
              count(*) FILTER (WHERE fill_level_pct > 99) AS nearly_full FROM slot)
       ON COLUMNS(*) INTO NAME rule VALUE violations""",
)
def _(w):
    return ql.check_rules(
        w.obs,
        {
            "fill_out_of_range": ~F.col("fill_level_pct").between(0, 100),
            "battery_out_of_range": ~F.col("battery_pct").between(0, 100),
            "null_iff_missing": F.col("fill_level_pct").isNull() != (F.col("sensor_status") == "missing"),
            "unknown_status": ~F.col("collection_status").isin("none", "collected", "partial", "missed"),
            "nearly_full": F.col("fill_level_pct") > 99,
        },
    )


PROFILE_SQL = """SELECT 'orders' AS table_name, '{c}' AS field, '{t}' AS type, count(*) AS rows,
       100.0 * (count(*) - count({c})) / count(*) AS null_pct, CAST(min({c}) AS VARCHAR) AS min_value,
       CAST(max({c}) AS VARCHAR) AS max_value, count(DISTINCT {c}) AS distinct_values FROM orders"""


@query(
    "L4",
    " UNION ALL ".join(
        PROFILE_SQL.format(c=c, t=t)
        for c, t in (
            ("o_orderkey", "bigint"),
            ("o_custkey", "bigint"),
            ("o_orderstatus", "string"),
            ("o_totalprice", "double"),
            ("o_orderdate", "timestamp_ntz"),
            ("o_orderpriority", "string"),
        )
    ),
    "null_pct",
)
def _(w):
    return ql.profile(w.table("orders"), "orders")


PROFILED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


# star tables that are expressions over one stored mart, so they need not be stored again
MART_COLUMNS = ("fact_city_day", "fact_bin_day", "fact_zone_day", "fact_collection_attempt")


def profiled_tables(w):
    """The input tables, every dimension and fact of the readings, every day mart, places and roads."""
    # stored bins have a known size, so readings need no shuffle where the bins can be broadcast
    place = w.stored_bins.select("bin_id", "zone_id", "city_id", "city_name", "bin_key", "zone_key")
    derived = {
        "dim_city": w.dim_city,
        "dim_zone": w.dim_zone,
        "dim_bin": w.dim_bin,
        "fact_bin_readings": w.obs_city,
        "simulation_truth": w.truth_city,
        "interim_readings": w.interim.join(place, "bin_id"),
        "collection_events": w.events,
        "collection_diagnostics": w.diagnostics,
        "bin_daily_metrics": w.bin_day,
        "zone_daily_metrics": w.zone_day,
        "city_daily_metrics": w.city_day,
        "route_daily_metrics": w.route_day,
        "vehicle_daily_metrics": w.vehicle_day,
        "pois": w.pois_xy,
        "road_nodes": w.road_nodes.withColumn("tags", F.to_json("tags")),
        "road_ways": w.road_ways.withColumn("tags", F.to_json("tags")),
    }
    star_only = {
        t: df if t in MART_COLUMNS else store_rows(df) for t, df in star.star_tables(w).items() if t not in derived
    }
    return {t: w.table(t) for t in PROFILED} | derived | star_only


# tables that are some columns of all rows of another one
COLUMNS_OF = {
    "fact_bin_readings": "interim_readings",
    "simulation_truth": "interim_readings",
    "collection_events": "collection_diagnostics",
}


@query("L4_all")
def _(w):
    """Each table's profile is stored as it is made, so that the plans of all tables never stand in one.

    The profile of a table in ``COLUMNS_OF`` is that of its columns in the whole table, which are counted once.
    """
    tables = profiled_tables(w.build_marts())
    done = {t: cut_lineage(ql.profile(df, t)) for t, df in tables.items() if t not in COLUMNS_OF}
    for t, whole in COLUMNS_OF.items():
        if t not in tables:
            continue
        done[t] = done[whole].where(F.col("field").isin(tables[t].columns)).withColumn("table_name", F.lit(t))
    return reduce(DataFrame.unionByName, done.values())


CRITICAL_SQL = """SELECT check_name, CAST(violations AS BIGINT) AS violations, violations > 0 AS is_issue FROM (
         SELECT 'reading_id_duplicates' AS check_name, count(*) - count(DISTINCT reading_id) AS violations FROM slot
         UNION ALL SELECT 'reading_orphan_bin', count(*) FROM slot WHERE bin_id NOT IN (SELECT bin_id FROM bin_dim)
         UNION ALL SELECT 'invalid_fill', count(*) FROM slot WHERE fill_level_pct < 0 OR fill_level_pct > 100
         UNION ALL SELECT 'invalid_bin_coordinates', count(*) FROM bin_dim
           WHERE latitude NOT BETWEEN -90 AND 90 OR longitude NOT BETWEEN -180 AND 180
         UNION ALL SELECT 'bin_orphan_zone', count(*) FROM bin_dim WHERE zone_id NOT IN (SELECT zone_id FROM zone_dim)
         UNION ALL SELECT 'negative_route_distance', count(*) FROM routeday WHERE distance_km_assumed < 0
         UNION ALL SELECT 'invalid_collection_status', count(*) FROM attempt
           WHERE collection_status NOT IN ('collected', 'partial', 'missed')
         UNION ALL SELECT 'order_line_duplicates', count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem)"""


def known(df: DataFrame, parents: DataFrame, key: str, flag: str) -> DataFrame:
    """Rows with a flag that their key stands among the parents' keys (null keys do not)."""
    marked = parents.select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(marked, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def checks_of(w):
    """Each table is read once for all of its checks."""
    readings = known(w.obs, w.stored_bins, "bin_id", "has_bin")
    bins = known(w.stored_bins, w.dim_zone, "zone_id", "has_zone")
    return [
        ql.check_table(
            readings,
            {"reading_id_duplicates": ["reading_id"], "order_line_duplicates": ["order_id", "line_id"]},
            {
                "reading_orphan_bin": ~F.col("has_bin"),
                "invalid_fill": ~F.col("fill_level_pct").between(0, 100),
            },
        ),
        ql.check_table(
            bins,
            {},
            {
                "invalid_bin_coordinates": ~F.col("latitude").between(-90, 90) | ~F.col("longitude").between(-180, 180),
                "bin_orphan_zone": ~F.col("has_zone"),
            },
        ),
        ql.check_table(w.route_day, {}, {"negative_route_distance": F.col("distance_km_assumed") < 0}),
        ql.check_table(
            w.events,
            {},
            {"invalid_collection_status": ~F.col("collection_status").isin("collected", "partial", "missed")},
        ),
    ]


@query("L5", CRITICAL_SQL)
def _(w):
    return ql.critical_checks(checks_of(w))


MISMATCH_SQL = """
         UNION ALL SELECT 'reading_zone_mismatch', count(*) FROM slot_city r JOIN bin_dim b USING (bin_id)
           WHERE r.zone_id <> b.zone_id)"""


@query("L5_all", CRITICAL_SQL.removesuffix(")") + MISMATCH_SQL)
def _(w):
    """The checks of L5, and readings stored under another zone than their bin's."""
    own = w.stored_bins.select("bin_id", F.col("zone_id").alias("__own"))
    placed = w.obs_city.select("bin_id", "zone_id").join(own, "bin_id")
    stray = ql.check_table(placed, {}, {"reading_zone_mismatch": F.col("zone_id") != F.col("__own")})
    return ql.critical_checks([*checks_of(w), stray])


RECONCILE_SQL = """SELECT check_name, a AS left_value, b AS right_value, abs(a - b) AS absolute_difference,
       abs(a - b) <= 0.01 + 1e-7 * abs(b) AS passed FROM (
         SELECT 'fact_vs_truth_rows' AS check_name, (SELECT count(*) FROM slot)::DOUBLE AS a, (SELECT count(*) FROM slot)::DOUBLE AS b
         UNION ALL SELECT 'fact_vs_bin_rows', (SELECT count(*) FROM slot), (SELECT sum(scheduled_readings) FROM binday)
         UNION ALL SELECT 'bin_vs_zone_rows', (SELECT sum(scheduled_readings) FROM binday), (SELECT sum(scheduled_readings) FROM zoneday)
         UNION ALL SELECT 'attempts_vs_bin', (SELECT count(*) FROM attempt),
           (SELECT sum(successful_collections + missed_collections) FROM binday)
         UNION ALL SELECT 'truth_vs_bin_litres', (SELECT sum(arrivals_l_true) FROM slot), (SELECT sum(arrivals_l_simulated) FROM binday)
         UNION ALL SELECT 'bin_vs_zone_litres', (SELECT sum(arrivals_l_simulated) FROM binday),
           (SELECT sum(arrivals_l_simulated) FROM zoneday)
         UNION ALL SELECT 'route_vs_vehicle_km', (SELECT sum(distance_km_assumed) FROM routeday),
           (SELECT sum(distance_km_assumed) FROM vehicleday))"""


@query("L6", RECONCILE_SQL, "left_value right_value absolute_difference")
def _(w):
    w.build_marts()
    row = q.q12(w.obs, w.truth, w.bin_day, w.zone_day, w.events).withColumn("__one", F.lit(1))
    km = lambda df, name: df.agg(F.sum("distance_km_assumed").alias(name)).withColumn("__one", F.lit(1))
    row = row.join(km(w.route_day, "route_km"), "__one").join(km(w.vehicle_day, "vehicle_km"), "__one")
    return ql.reconcile(
        {
            "fact_vs_truth_rows": ("fact_scheduled_readings", "truth_scheduled_readings"),
            "fact_vs_bin_rows": ("fact_scheduled_readings", "bin_mart_scheduled_readings"),
            "bin_vs_zone_rows": ("bin_mart_scheduled_readings", "zone_mart_scheduled_readings"),
            "attempts_vs_bin": ("collection_attempts", "bin_mart_attempts"),
            "truth_vs_bin_litres": ("truth_arrivals_l", "bin_mart_arrivals_l"),
            "bin_vs_zone_litres": ("bin_mart_arrivals_l", "zone_mart_arrivals_l"),
            "route_vs_vehicle_km": ("route_km", "vehicle_km"),
        },
        row,
    )


@query(
    "L7",
    """SELECT 'bin_day' AS table_name, count(*) AS rows, count(DISTINCT (bin_id, service_date_local)) AS distinct_keys FROM binday
       UNION ALL SELECT 'zone_day', count(*), count(DISTINCT (zone_id, service_date_local)) FROM zoneday
       UNION ALL SELECT 'fact_truth_join', count(*), count(DISTINCT reading_id) FROM slot""",
)
def _(w):
    """The stored pairs are the join; a reading's id names its bin and day, so all keys lie in the stored buckets."""
    joined = w.paired.select("bin_id", "service_date_local", reading_id().alias("reading_id"))
    return (
        ql.check_pk(w.bin_day, ["bin_id", "service_date_local"], "bin_day")
        .union(ql.check_pk(w.zone_day, ["zone_id", "service_date_local"], "zone_day"))
        .union(ql.check_pk(joined, joined.columns, "fact_truth_join"))
        .select("table_name", "rows", "distinct_keys")
    )


METRICS = {
    "generated_l": ("arrivals_l_true", "generated_l"),
    "overflow_l": ("overflow_l_true", "overflow_l"),
}


@query(
    "L8",
    """SELECT city_id, metric, expected, actual, abs(expected - actual) AS absolute_difference,
              abs(expected - actual) <= 0.001 + 1e-7 * abs(actual) AS passed
       FROM (UNPIVOT (SELECT city_id, sum(arrivals_l_true) AS generated_l, sum(overflow_l_true) AS overflow_l,
                             100.0 * count(*) FILTER (WHERE overflow_l_true > 0) / count(*) AS overflow_slot_pct,
                             sum(fill_level_pct) / count(fill_level_pct) AS fill_pct FROM slot_city GROUP BY 1)
             ON COLUMNS(* EXCLUDE (city_id)) INTO NAME metric VALUE expected)
       JOIN (UNPIVOT (SELECT city_id, sum(generated_l) AS generated_l, sum(overflow_l) AS overflow_l,
                             100.0 * sum(overflow_slots) / sum(scheduled_readings) AS overflow_slot_pct,
                             sum(fill_sum_pct) / sum(received_readings) AS fill_pct FROM cityday GROUP BY 1)
             ON COLUMNS(* EXCLUDE (city_id)) INTO NAME metric VALUE actual) USING (city_id, metric)""",
    "expected actual absolute_difference",
)
def _(w):
    from fieldtally.functions.expressions import ratio_of_sums
    from fieldtally.operators.aggregates import to_long

    names = ["generated_l", "overflow_l", "overflow_slot_pct", "fill_pct"]
    direct = w._with_bin(w.interim, "city_id").groupBy("city_id").agg(
        F.sum("arrivals_l_true").alias("generated_l"),
        F.sum("overflow_l_true").alias("overflow_l"),
        (100.0 * F.count_if(F.col("overflow_l_true") > 0) / F.count(F.lit(1))).alias("overflow_slot_pct"),
        F.avg("fill_level_pct").alias("fill_pct"),
    )
    marts = w.city_day.groupBy("city_id").agg(
        F.sum("generated_l").alias("generated_l"),
        F.sum("overflow_l").alias("overflow_l"),
        ratio_of_sums("overflow_slots", "scheduled_readings", 100.0).alias("overflow_slot_pct"),
        ratio_of_sums("fill_sum_pct", "received_readings").alias("fill_pct"),
    )
    return ql.reconcile_kpis(to_long(direct, ["city_id"], names), to_long(marts, ["city_id"], names), ["city_id"])


@query(
    "L9",
    """SELECT city_id, attempt_kg, daily_kg, attempt_kg - daily_kg AS difference_kg FROM
         (SELECT city_id, sum(collected_kg) AS attempt_kg FROM attempt GROUP BY 1)
         JOIN (SELECT city_id, sum(collected_kg) AS daily_kg FROM cityday GROUP BY 1) USING (city_id)""",
    "attempt_kg daily_kg difference_kg",
    digits=3,
)
def _(w):
    return ql.mass_gap(w.diagnostics, w.city_day)


@query(
    "L10",
    """UNPIVOT (SELECT count(*) FILTER (WHERE s AND removed_l_true <= 0) AS success_without_removal,
              count(*) FILTER (WHERE s AND inventory_l_true >= capacity_l) AS success_left_full,
              count(*) FILTER (WHERE inventory_l_true > capacity_l + 0.001) AS inventory_above_capacity,
              count(*) FILTER (WHERE arrivals_l_true < 0 OR overflow_l_true < 0 OR removed_l_true < 0) AS negative_measure
         FROM (SELECT *, collection_status IN ('collected', 'partial') AS s FROM slot))
       ON COLUMNS(*) INTO NAME rule VALUE violations""",
)
def _(w):
    return ql.check_physics(w.interim)


@query("L11", "SELECT 0::BIGINT AS only_filtered, 0::BIGINT AS only_whole FROM region LIMIT 1")
def _(w):
    """The query asked for each city in turn against the rows of that city in the whole result."""
    days = cut_lineage(w.zone_day)
    asked = [r["city_id"] for r in w.dim_city.select("city_id").orderBy("city_id").toLocalIterator()]  # one row per city
    mark = lambda df, city: df.select(F.lit(city).alias("asked"), "*")
    one = reduce(DataFrame.unionByName, [mark(q.q16(days, city), city) for city in asked])
    whole = q.q16(days)
    return ql.check_filter_consistency(one, whole.select(F.col("city_id").alias("asked"), "*"))


@query(
    "L13",
    """SELECT * FROM (VALUES ('dim_city', 'city_id', 'key', 'ok'), ('dim_zone', 'zone_key', 'key', 'ok'),
         ('dim_zone', 'city_id', 'references dim_city.city_id', 'ok'), ('dim_bin', 'bin_key', 'key', 'ok'),
         ('dim_bin', 'city_id', 'references dim_city.city_id', 'ok'), ('dim_bin', 'zone_key', 'references dim_zone.zone_key', 'ok'),
         ('fact_bin_readings', 'reading_id', 'key', 'ok'), ('fact_bin_readings', 'bin_key', 'references dim_bin.bin_key', 'ok'),
         ('simulation_truth', 'reading_id', 'key', 'ok'), ('simulation_truth', 'bin_key', 'references dim_bin.bin_key', 'ok'),
         ('collection_events', 'collection_id', 'key', 'ok'), ('collection_events', 'bin_key', 'references dim_bin.bin_key', 'ok'),
         ('bin_daily_metrics', 'bin_id', 'key', 'ok'), ('bin_daily_metrics', 'service_date_local', 'key', 'ok'),
         ('bin_daily_metrics', 'bin_id', 'references dim_bin.bin_id', 'ok'), ('zone_daily_metrics', 'zone_id', 'key', 'ok'),
         ('zone_daily_metrics', 'service_date_local', 'key', 'ok'),
         ('zone_daily_metrics', 'zone_id', 'references dim_zone.zone_id', 'ok'), ('city_daily_metrics', 'city_id', 'key', 'ok'),
         ('city_daily_metrics', 'service_date_local', 'key', 'ok'),
         ('city_daily_metrics', 'city_id', 'references dim_city.city_id', 'ok')) v(table_name, field, role, status)""",
)
def _(w):
    return ql.check_contract(
        w.spark,
        {
            "dim_city": w.dim_city,
            "dim_zone": w.dim_zone,
            "dim_bin": w.dim_bin,
            "fact_bin_readings": w.obs_city,
            "simulation_truth": w.truth_city,
            "collection_events": w.diagnostics,
            "bin_daily_metrics": w.bin_day,
            "zone_daily_metrics": w.zone_day,
            "city_daily_metrics": w.city_day,
        },
        CONTRACTS,
    )


@query(
    "L14",
    """SELECT count(*) AS rows, count(DISTINCT bin_id) AS bins, TRUE AS pruned FROM slot
       WHERE year(service_date_local) = 1997 AND month(service_date_local) = 1""",
)
def _(w):
    root = scratch_path(w.spark, "pruning")
    sinks.write_split(with_parts(w.obs), {root: OBSERVED}, ["year", "month"])
    january = files.read_partitioned(w.spark, root).where((F.col("year") == "1997") & (F.col("month") == "01"))
    ql.assert_pruned(january, ["year", "month"])
    return january.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("bin_id").alias("bins"), F.lit(True).alias("pruned")
    )


# where the SQL side has parent and child too; a dispatched bin need not be among the fleet's bins
STAR_SQL = {
    ("dim_city", "dim_bin"): ("city_dim", "city_id", "bin_dim", "city_id"),
    ("dim_city", "dim_zone"): ("city_dim", "city_id", "zone_dim", "city_id"),
    ("dim_city", "fact_city_day"): ("city_dim", "city_id", "cityday", "city_id"),
    ("dim_date", "fact_city_day"): ("slot", "service_date_local", "cityday", "service_date_local"),
    ("dim_date", "fact_bin_day"): ("slot", "service_date_local", "binday", "service_date_local"),
    ("dim_date", "fact_zone_day"): ("slot", "service_date_local", "zoneday", "service_date_local"),
    ("dim_date", "fact_collection_attempt"): ("slot", "service_date_local", "attempt", "service_date_local"),
    ("dim_bin", "fact_bin_day"): ("bin_dim", "bin_key", "binday", "bin_key"),
    ("dim_bin", "fact_collection_attempt"): ("bin_dim", "bin_key", "attempt", "bin_key"),
    ("dim_bin", "fact_dispatch_snapshot"): ("bin_dim", "bin_key", "prio", "city_id || ':' || bin_id"),
    ("dim_zone", "fact_zone_day"): ("zone_dim", "zone_key", "zoneday", "zone_key"),
}


def link_sql(parent: str, key: str, child: str, column: str) -> str:
    names = f"SELECT '{parent}.{key}' AS parent, '{child}.{column}' AS child, "
    if (parent, child) not in STAR_SQL:
        return names + "0::BIGINT AS orphan_keys, 0::BIGINT AS orphan_rows"
    p, k, c, expr = STAR_SQL[parent, child]
    return f"""{names}count(DISTINCT x) AS orphan_keys, count(*) AS orphan_rows
        FROM (SELECT {expr} AS x FROM {c}) WHERE x IS NOT NULL AND x NOT IN (SELECT {k} FROM {p} WHERE {k} IS NOT NULL)"""


@query("L2_star", " UNION ALL ".join(link_sql(*link) for link in star.LINKS))
def _(w):
    return ql.check_links(star.star_tables(w.build_marts()), star.LINKS)
