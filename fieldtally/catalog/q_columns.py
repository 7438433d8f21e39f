"""Projections, predicates, conversions and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.catalog.registry import query
from fieldtally.functions import expressions as x
from fieldtally.settings import ROAD_SPEED_KMH


def n_rows(name="rows"):
    return F.count(F.lit(1)).alias(name)


@query(
    "B1",
    """SELECT bin_key, zone_key, city_name || ' ward ' || zone_id AS ward_label, capacity_l * 2 AS double_capacity_l,
              longitude AS map_longitude FROM bin_dim""",
    "map_longitude",
)
def _(w):
    return w.dim_bin.select(
        "bin_key",
        "zone_key",
        F.concat(F.col("city_name"), F.lit(" ward "), F.col("zone_id")).alias("ward_label"),
        (F.col("capacity_l") * 2).alias("double_capacity_l"),
        F.col("longitude").alias("map_longitude"),
    )


@query(
    "B2",
    """SELECT collection_status, count(*) AS rows FROM slot
       WHERE collection_status IN ('collected', 'partial', 'missed') AND fill_level_pct BETWEEN 20 AND 80
         AND battery_pct NOT BETWEEN 0 AND 95 AND fill_level_pct IS NOT NULL GROUP BY 1""",
)
def _(w):
    return (
        w.obs.where(
            F.col("collection_status").isin("collected", "partial", "missed")
            & F.col("fill_level_pct").between(20, 80)
            & ~F.col("battery_pct").between(0, 95)
            & F.col("fill_level_pct").isNotNull()
        )
        .groupBy("collection_status")
        .agg(n_rows())
    )


@query(
    "B3",
    """SELECT count(*) FILTER (WHERE fill_level_pct IS DISTINCT FROM 100) AS not_full,
              count(*) FILTER (WHERE sensor_status IS DISTINCT FROM 'ok') AS not_ok,
              count(*) FILTER (WHERE fill_level_pct IS DISTINCT FROM NULL) AS known FROM slot""",
)
def _(w):
    return w.obs.agg(
        F.count_if(x.is_distinct("fill_level_pct", F.lit(100.0))).alias("not_full"),
        F.count_if(x.is_distinct("sensor_status", F.lit("ok"))).alias("not_ok"),
        F.count_if(x.is_distinct("fill_level_pct", F.lit(None).cast("double"))).alias("known"),
    )


@query(
    "B4",
    """SELECT CASE WHEN collection_status = 'missed' THEN 'missed' WHEN fill_level_pct < 35 THEN 'early'
                   WHEN fill_level_pct >= 95 THEN 'late' ELSE 'regular' END AS timing, count(*) AS rows
       FROM slot GROUP BY 1""",
)
def _(w):
    timing = x.choose(
        [
            (F.col("collection_status") == "missed", F.lit("missed")),
            (F.col("fill_level_pct") < 35, F.lit("early")),
            (F.col("fill_level_pct") >= 95, F.lit("late")),
        ],
        F.lit("regular"),
    )
    return w.obs.groupBy(timing.alias("timing")).agg(n_rows())


@query(
    "B5",
    """SELECT collection_status, CAST(sum(CAST(overflow_l_true > 0 AS INTEGER)) AS BIGINT) AS overflow_count,
              CAST(sum(TRY_CAST(sensor_status AS INTEGER)) AS BIGINT) AS bad_cast,
              CAST(max(CAST(capacity_l AS SMALLINT)) AS INTEGER) AS capacity_l,
              count(*) FILTER (WHERE service_date_local >= DATE '1998-01-01') AS from_1998 FROM slot GROUP BY 1""",
)
def _(w):
    return w.interim.groupBy("collection_status").agg(
        F.sum(x.to_type(F.col("overflow_l_true") > 0, "int")).alias("overflow_count"),
        F.sum(x.to_type("sensor_status", "int", safe=True)).alias("bad_cast"),
        F.max(x.to_type("capacity_l", "smallint")).cast("int").alias("capacity_l"),
        F.count_if(F.col("service_date_local") >= F.lit("1998-01-01").cast("date")).alias("from_1998"),
    )


@query(
    "B6",
    """SELECT bin_id, service_date_local, coalesce(mean_observed_fill_pct, max_observed_fill_pct, 50.0) AS fill_pct,
              collected_kg_simulated / nullif(successful_collections, 0) AS kg_per_service FROM binday""",
    "fill_pct kg_per_service",
)
def _(w):
    return w.bin_day.select(
        "bin_id",
        "service_date_local",
        x.first_of("mean_observed_fill_pct", "max_observed_fill_pct", F.lit(50.0)).alias("fill_pct"),
        x.safe_div("collected_kg_simulated", "successful_collections").alias("kg_per_service"),
    )


@query(
    "B7",
    """SELECT bin_id, service_date_local,
              CASE WHEN mean_observed_fill_pct IS NOT NULL
                   THEN least(greatest(mean_observed_fill_pct * 1.5 - 20, 0), 100) END AS stressed_pct FROM binday""",
    "stressed_pct",
)
def _(w):
    stressed = x.clip(F.col("mean_observed_fill_pct") * 1.5 - 20, 0.0, 100.0)
    return w.bin_day.select("bin_id", "service_date_local", stressed.alias("stressed_pct"))


BAND_SQL = """CASE WHEN mean_observed_fill_pct IS NULL THEN 'Missing' WHEN mean_observed_fill_pct < 20 THEN '0–19%'
       WHEN mean_observed_fill_pct < 40 THEN '20–39%' WHEN mean_observed_fill_pct < 60 THEN '40–59%'
       WHEN mean_observed_fill_pct < 80 THEN '60–79%' ELSE '80–100%' END"""
BAND_SORT_SQL = """CASE WHEN mean_observed_fill_pct IS NULL THEN 6
       ELSE least(5, 1 + CAST(floor(mean_observed_fill_pct / 20) AS INTEGER)) END"""


@query(
    "B8",
    f"SELECT {BAND_SQL} AS mean_fill_band, {BAND_SORT_SQL} AS mean_fill_band_sort, count(*) AS rows FROM binday GROUP BY 1, 2",
)
def _(w):
    return w.bin_day.groupBy(
        x.fill_band("mean_observed_fill_pct").alias("mean_fill_band"),
        x.fill_band_sort("mean_observed_fill_pct").alias("mean_fill_band_sort"),
    ).agg(n_rows())


@query(
    "B9",
    """SELECT DISTINCT city_id || ':' || bin_id AS bin_key, city_id || ':P:' || (bin_id % 50) AS vehicle_key,
              city_id || ':base:optimized:' || (bin_id % 50) AS route_key FROM slot_city""",
)
def _(w):
    veh = F.col("bin_id") % 50
    return w.obs_city.select(
        x.global_key("city_id", "bin_id").alias("bin_key"),
        x.global_key("city_id", F.lit("P"), veh).alias("vehicle_key"),
        x.global_key("city_id", F.lit("base"), F.lit("optimized"), veh).alias("route_key"),
    ).distinct()


@query(
    "B10",
    """SELECT city_id, CASE WHEN city_id = 'ASIA' THEN 'common price proxy' ELSE 'local price proxy' END AS price_scope,
              count(*) AS bins FROM bin_dim GROUP BY ALL""",
)
def _(w):
    scope = F.when(F.col("city_id") == "ASIA", F.lit("common price proxy")).otherwise(F.lit("local price proxy"))
    return w.dim_bin.withColumn("price_scope", scope).groupBy("city_id", "price_scope").agg(n_rows("bins"))


@query(
    "B11",
    """SELECT l_orderkey, count(*) AS stops, count(CASE WHEN l_suppkey <> 0 THEN l_suppkey END) AS bin_stops
       FROM lineitem GROUP BY 1""",
)
def _(w):
    key = x.null_unless("l_suppkey", F.col("l_suppkey") != 0)
    return w.table("lineitem").groupBy("l_orderkey").agg(n_rows("stops"), F.count(key).alias("bin_stops"))


@query(
    "B12",
    "SELECT service_date_local, "
    + ", ".join(
        f"CAST(isodow(service_date_local + 1) = {i + 1} AS INTEGER) AS target_dow_{i}" for i in range(7)
    )
    + " FROM (SELECT DISTINCT service_date_local FROM slot)",
)
def _(w):
    days = w.obs.select("service_date_local").distinct()
    return days.select("service_date_local", *x.dow_flags(F.date_add("service_date_local", 1)))


@query(
    "B13",
    """SELECT reasons, count(*) AS rows FROM (
         SELECT CASE WHEN r = '' THEN 'below_rules' ELSE r END AS reasons FROM (
           SELECT concat_ws(';', CASE WHEN fill_level_pct >= 80 THEN 'current_trigger' END,
                                 CASE WHEN sensor_status = 'missing' THEN 'telemetry_trigger' END,
                                 CASE WHEN overflow_l_true > 0 THEN 'overflow_trigger' END) AS r FROM slot))
       GROUP BY 1""",
)
def _(w):
    flags = {
        "current_trigger": F.col("fill_level_pct") >= 80,
        "telemetry_trigger": F.col("sensor_status") == "missing",
        "overflow_trigger": F.col("overflow_l_true") > 0,
    }
    flagged = w.interim.select(*[c.alias(n) for n, c in flags.items()])
    return flagged.groupBy(x.reason_list(list(flags)).alias("reasons")).agg(n_rows())


LIMIT_TEXT = """CASE p_size % 5 WHEN 0 THEN p_size || ' t' WHEN 1 THEN p_size || '.5 m' WHEN 2 THEN 'none'
       WHEN 3 THEN NULL ELSE CAST(p_size AS VARCHAR) END"""


def limit_text():
    size = F.col("p_size").cast("string")
    return x.choose(
        [
            (F.col("p_size") % 5 == 0, F.concat(size, F.lit(" t"))),
            (F.col("p_size") % 5 == 1, F.concat(size, F.lit(".5 m"))),
            (F.col("p_size") % 5 == 2, F.lit("none")),
            (F.col("p_size") % 5 == 3, F.lit(None).cast("string")),
        ],
        size,
    )


@query(
    "B14",
    f"""SELECT tag, CASE WHEN tag IS NULL THEN NULL
                         ELSE coalesce(TRY_CAST(regexp_extract(tag, '^([0-9.]+)( t| m)?$', 1) AS DOUBLE), -1.0) END AS limit_value,
               count(*) AS rows FROM (SELECT {LIMIT_TEXT} AS tag FROM part) GROUP BY ALL""",
    "limit_value",
)
def _(w):
    tags = w.table("part").select(limit_text().alias("tag"))
    return tags.withColumn("limit_value", x.numeric_limit("tag")).groupBy("tag", "limit_value").agg(n_rows())


CLASS_SQL = """CASE p_size % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'residential' WHEN 2 THEN 'motorway' ELSE 'track' END"""
POSTED_SQL = """CASE p_size % 3 WHEN 0 THEN p_size || ' km/h' WHEN 1 THEN 'signals' END"""


@query(
    "B15",
    f"""SELECT cls, posted, least(base, TRY_CAST(split_part(posted, ' ', 1) AS DOUBLE)) AS speed_kmh, count(*) AS rows
        FROM (SELECT {CLASS_SQL} AS cls, {POSTED_SQL} AS posted FROM part)
        LEFT JOIN (VALUES ('primary', 35.0::DOUBLE), ('residential', 15.0), ('motorway', 50.0)) v(c, base) ON c = cls
        GROUP BY ALL""",
    "speed_kmh",
)
def _(w):
    size = F.col("p_size")
    cls = x.choose(
        [
            (size % 4 == 0, F.lit("primary")),
            (size % 4 == 1, F.lit("residential")),
            (size % 4 == 2, F.lit("motorway")),
        ],
        F.lit("track"),
    )
    posted = x.choose(
        [(size % 3 == 0, F.concat(size.cast("string"), F.lit(" km/h"))), (size % 3 == 1, F.lit("signals"))],
        F.lit(None).cast("string"),
    )
    tagged = w.table("part").select(cls.alias("cls"), posted.alias("posted"))
    return (
        tagged.withColumn("speed_kmh", x.speed_of("cls", "posted", ROAD_SPEED_KMH))
        .groupBy("cls", "posted", "speed_kmh")
        .agg(n_rows())
    )


# scalar functions ---------------------------------------------------------


@query(
    "H1",
    """SELECT DISTINCT CAST(service_date_local AS VARCHAR) || '_' || CAST(bin_id % 50 AS VARCHAR) AS route_id,
              lpad(CAST(bin_id AS VARCHAR), 3, '0') AS padded, strftime(service_date_local, '%B') AS month_name
       FROM slot""",
)
def _(w):
    return w.obs.select(
        F.concat(F.col("service_date_local").cast("string"), F.lit("_"), (F.col("bin_id") % 50).cast("string")).alias(
            "route_id"
        ),
        F.lpad(F.col("bin_id").cast("string"), 3, "0").alias("padded"),
        F.date_format("service_date_local", "MMMM").alias("month_name"),
    ).distinct()


@query(
    "H2",
    """SELECT CAST(date_trunc('month', service_date_local) AS DATE) AS month_start,
              CAST(hour(timestamp_utc) AS INTEGER) AS hour_utc, CAST(isodow(service_date_local) AS INTEGER) AS isodow,
              CAST(dayofweek(service_date_local) AS INTEGER) AS sunday_zero,
              CAST(year(service_date_local) AS INTEGER) AS year, CAST(month(service_date_local) AS INTEGER) AS month,
              CAST(timestamp_utc AS DATE) AS utc_date, count(*) AS rows FROM slot GROUP BY ALL""",
)
def _(w):
    d = F.col("service_date_local")
    return w.obs.groupBy(
        F.trunc(d, "month").alias("month_start"),
        F.hour("timestamp_utc").alias("hour_utc"),
        x.iso_weekday(d).alias("isodow"),
        x.sunday_zero(d).alias("sunday_zero"),
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.col("timestamp_utc").cast("date").alias("utc_date"),
    ).agg(n_rows())


@query(
    "H3",
    """SELECT CAST(hour(ts + INTERVAL 330 MINUTE) AS INTEGER) AS local_hour,
              CAST(ts + INTERVAL 330 MINUTE AS DATE) AS local_date, count(*) AS rows FROM events GROUP BY 1, 2""",
)
def _(w):
    local = x.to_local("ts")
    return (
        w.table("events")
        .groupBy(F.hour(local).alias("local_hour"), local.cast("date").alias("local_date"))
        .agg(n_rows())
    )


@query(
    "H4",
    """SELECT user_id, epoch_us(max(ts)) / 3.6e9 - epoch_us(min(ts)) / 3.6e9 AS span_hours FROM events GROUP BY 1""",
    "span_hours",
    digits=4,
)
def _(w):
    spans = w.table("events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return spans.select("user_id", x.hours_between("a", "b").alias("span_hours"))


@query(
    "H5",
    """SELECT CAST(date_trunc('week', service_date_local) AS DATE) AS week_start, count(*) AS rows FROM slot GROUP BY 1""",
)
def _(w):
    return w.obs.groupBy(x.week_start("service_date_local").alias("week_start")).agg(n_rows())


@query(
    "H6",
    """SELECT bin_id, abs(latitude - 13) AS a, floor(longitude * 10) AS f, ceil(longitude * 10) AS c,
              least(latitude, 13.0) AS lo, greatest(latitude, 13.0) AS hi, round(demand_factor, 2) AS r,
              bin_id % 7 AS m, sqrt(latitude) AS s, sin(radians(latitude)) AS sn, cos(radians(latitude)) AS cs,
              asin(0.5) AS asn FROM bin_dim""",
    "a f c lo hi r s sn cs asn",
)
def _(w):
    lat, lon = F.col("latitude"), F.col("longitude")
    return w.dim_bin.select(
        "bin_id",
        F.abs(lat - 13).alias("a"),
        F.floor(lon * 10).cast("double").alias("f"),
        F.ceil(lon * 10).cast("double").alias("c"),
        F.least(lat, F.lit(13.0)).alias("lo"),
        F.greatest(lat, F.lit(13.0)).alias("hi"),
        F.round("demand_factor", 2).alias("r"),
        (F.col("bin_id") % 7).alias("m"),
        F.sqrt(lat).alias("s"),
        F.sin(F.radians(lat)).alias("sn"),
        F.cos(F.radians(lat)).alias("cs"),
        F.asin(F.lit(0.5)).alias("asn"),
    )


@query(
    "H7",
    """SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey,
              l_quantity FROM lineitem)) AS duplicate_rows FROM lineitem""",
)
def _(w):
    """Rows that repeat over the chosen columns, grouped by row hash and the row itself."""
    cols = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]
    groups = w.table("lineitem").groupBy(F.xxhash64(*cols).alias("h"), *cols).agg(n_rows("n"))
    return groups.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicate_rows"))


@query(
    "H8",
    """SELECT l_orderkey, list_transform(range(1, len(p)), lambda i: p[i] || '>' || p[i + 1]) AS hops
       FROM (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS p FROM lineitem GROUP BY 1)""",
)
def _(w):
    paths = w.table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("p"))
    return paths.select(
        "l_orderkey",
        F.transform(
            x.consecutive_pairs("p"), lambda h: F.concat(h["u"].cast("string"), F.lit(">"), h["v"].cast("string"))
        ).alias("hops"),
    )


@query("H9", "SELECT s_suppkey, sha256(s_name) AS digest FROM supplier")
def _(w):
    return w.table("supplier").select("s_suppkey", F.sha2(F.col("s_name").cast("binary"), 256).alias("digest"))


@query(
    "H10",
    """SELECT s_suppkey, CASE WHEN a >= 2
                THEN 2 * exp(-a * a / 2) / 2.5066282746310002 / list_reduce(list_transform(range(0, 60),
                     lambda i: 60.0::DOUBLE - i), lambda acc, k: a + k / acc, a)
                ELSE 1 - list_sum(list_transform(range(0, 40), lambda i:
                     (CASE i % 2 WHEN 0 THEN 2.0 ELSE -2.0 END)::DOUBLE * pow(a, 2 * i + 1)
                     / (2.5066282746310002 * pow(2.0::DOUBLE, i) * gamma(i + 1.0) * (2 * i + 1)))) END AS p
       FROM (SELECT s_suppkey, abs(s_acctbal) / 1000.0 AS a FROM supplier)""",
    "p",
    digits=9,
)
def _(w):
    z = w.table("supplier").select("s_suppkey", (F.abs("s_acctbal") / 1000.0).alias("a"))
    return z.select("s_suppkey", x.normal_two_sided_p("a").alias("p"))
