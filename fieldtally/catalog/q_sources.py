"""Sources, sinks and catalogue operations, each round-tripping the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from fieldtally.catalog.registry import query
from fieldtally.plans import questions as q
from fieldtally.session import cut_lineage, scratch_path
from fieldtally.sources import files, sinks
from fieldtally.sources.commits import TargetGroup
from fieldtally.sources.tables import TableRegistry

STORED = (
    "reading_id string, bin_id bigint, timestamp_utc timestamp_ntz, service_date_local date, "
    "fill_level_pct double, sensor_status string, collection_status string, arrivals_l_true double, "
    "inventory_l_true double, overflow_l_true double, removed_l_true double, capacity_l int"
)
STORED_NAMES = [part.split()[0] for part in STORED.split(", ")]
OBSERVED = STORED_NAMES[:7]
TRUTH = STORED_NAMES[:4] + STORED_NAMES[7:]

PART_SQL = """year(service_date_local) AS year, lpad(CAST(month(service_date_local) AS VARCHAR), 2, '0') AS month"""


def with_parts(df):
    return df.withColumn("year", F.year("service_date_local")).withColumn(
        "month", F.date_format("service_date_local", "MM")
    )


def stored_csv(w) -> str:
    path = scratch_path(w.spark, "readings-csv")
    w.interim.select(*STORED_NAMES).write.option("header", True).csv(path)
    return path


@query(
    "A1",
    """SELECT collection_status, count(*) AS rows, count(fill_level_pct) AS observed,
              sum(fill_level_pct) AS fill_sum, min(timestamp_utc) AS first_at, max(service_date_local) AS last_day
       FROM slot GROUP BY 1""",
    "fill_sum",
)
def _(w):
    df = files.read_events_csv(w.spark, stored_csv(w), STORED)
    return df.groupBy("collection_status").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("fill_level_pct").alias("observed"),
        F.sum("fill_level_pct").alias("fill_sum"),
        F.min("timestamp_utc").alias("first_at"),
        F.max("service_date_local").alias("last_day"),
    )


@query(
    "A2",
    f"""SELECT year, month, count(*) AS rows, sum(fill_level_pct) AS fill_sum
        FROM (SELECT *, {PART_SQL} FROM slot) WHERE month = '01' GROUP BY 1, 2""",
    "fill_sum",
)
def _(w):
    root = scratch_path(w.spark, "readings")
    sinks.write_split(with_parts(w.obs), {root: OBSERVED}, ["year", "month"])
    schema = "fill_level_pct double, year bigint, month string"
    return (
        files.read_partitioned(w.spark, root, schema)
        .where(F.col("month") == "01")
        .groupBy("year", "month")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("fill_level_pct").alias("fill_sum"))
    )


@query("A3", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier", "s_acctbal")
def _(w):
    return files.read_table(w.spark, f"{w.sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey", "s_acctbal")


@query(
    "A4",
    f"""SELECT name AS layer, year, count(*) AS rows, columns FROM
        (SELECT *, {PART_SQL} FROM slot), (VALUES ('interim', 12), ('observed', 7), ('truth', 9)) v(name, columns)
        GROUP BY ALL""",
)
def _(w):
    """The three layers are committed as one batch; a reader never finds one without the others."""
    layers = {"interim": STORED_NAMES, "observed": OBSERVED, "truth": TRUTH}
    group = TargetGroup(w.spark, scratch_path(w.spark, "layers"), layers, ["year", "month"])
    group.write("load", with_parts(w.interim), replace=True)
    out = None
    for name in layers:
        df = group.read(name)
        counted = df.groupBy(F.col("year").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("rows"))
        counted = counted.select(F.lit(name).alias("layer"), "year", "rows", F.lit(len(df.columns) - 2).alias("columns"))
        out = counted if out is None else out.union(counted)
    return out


@query(
    "A5",
    f"""SELECT city_id, CAST(year AS BIGINT) AS year, month, count(*) AS rows, count(DISTINCT bin_key) AS bins
        FROM (SELECT *, {PART_SQL} FROM slot_city) GROUP BY ALL""",
)
def _(w):
    """Loaded in two batches: the second brings only partitions that the first did not."""
    parts, columns = ["city_id", "year", "month"], ["reading_id", "bin_key", "fill_level_pct"]
    rows = with_parts(w.obs_city).select(*columns, *parts)
    group = TargetGroup(w.spark, scratch_path(w.spark, "city-readings"), {"readings": columns}, parts)
    group.write_missing("to 1997", rows.where(F.col("year") <= 1997))
    group.write_missing("all", rows)
    return (
        group.read("readings")
        .groupBy("city_id", F.col("year").cast("bigint").alias("year"), "month")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("bin_key").alias("bins"))
    )


@query(
    "A6",
    """SELECT collection_status, count(*) AS attempts, sum(collected_kg) AS collected_kg_simulated,
              'synthetic' AS data_origin FROM attempt GROUP BY 1""",
    "collected_kg_simulated",
)
def _(w):
    path = scratch_path(w.spark, "result")
    sinks.write_result_csv(q.q27_status(w.events).drop("mean_collected_kg_attempt"), path, "synthetic")
    schema = "collection_status string, attempts bigint, collected_kg_simulated double, data_origin string"
    return files.read_events_csv(w.spark, path, schema)


@query(
    "A7",
    """SELECT 'q08' AS query_id, count(*) AS rows, 7 AS columns
         FROM (SELECT zone_id FROM zoneday GROUP BY 1 HAVING count(*) >= 300 LIMIT 25)
       UNION ALL SELECT 'q27_status', count(DISTINCT collection_status), 4 FROM attempt
       UNION ALL SELECT 'q11', count(DISTINCT date_trunc('month', service_date_local)), 5 FROM zoneday""",
)
def _(w):
    path = scratch_path(w.spark, "manifest")
    results = {"q08": q.q08(w.zone_day), "q27_status": q.q27_status(w.events), "q11": q.q11(w.zone_day)}
    sinks.write_manifest(results, path)
    stored = w.spark.read.schema("query_id string, rows bigint, columns array<string>").json(path)
    return stored.select("query_id", "rows", F.size("columns").alias("columns"))


RING_SQL = """SELECT zone_id, city_id, min_lon, min_lat, max_lon, max_lat, 5 AS points FROM zone_dim"""


def corner(lon, lat):
    return F.array(F.round(F.col(lon), 6), F.round(F.col(lat), 6))


def ring_bounds(df):
    """Bounds and vertex count of the first ring."""
    lons = F.transform(F.col("rings")[0], lambda p: p["lon"])
    lats = F.transform(F.col("rings")[0], lambda p: p["lat"])
    return df.select(
        "zone_id",
        "city_id",
        F.array_min(lons).alias("min_lon"),
        F.array_min(lats).alias("min_lat"),
        F.array_max(lons).alias("max_lon"),
        F.array_max(lats).alias("max_lat"),
        F.size(F.col("rings")[0]).alias("points"),
    )


@query("A8", RING_SQL, "min_lon min_lat max_lon max_lat")
def _(w):
    """The zone table (25 rows by construction) is one FeatureCollection document."""
    path = scratch_path(w.spark, "zones-geojson")
    ring = F.array(
        corner("min_lon", "min_lat"),
        corner("max_lon", "min_lat"),
        corner("max_lon", "max_lat"),
        corner("min_lon", "max_lat"),
        corner("min_lon", "min_lat"),
    )
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct("zone_id", "city_id").alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    document = w.dim_zone.agg(
        F.to_json(
            F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))
        ).alias("value")
    )
    document.write.text(path)
    return ring_bounds(files.read_geojson(w.spark, path, "zone_id:string,city_id:string"))


@query("A9", RING_SQL, "min_lon min_lat max_lon max_lat")
def _(w):
    """The zone table (25 rows by construction) is one KML document."""
    path = scratch_path(w.spark, "zones-kml")
    fix = lambda c: F.format_string("%.6f", F.col(c))
    pair = lambda lon, lat: F.concat(fix(lon), F.lit(","), fix(lat), F.lit(",0"))
    coords = F.concat_ws(
        " ",
        pair("min_lon", "min_lat"),
        pair("max_lon", "min_lat"),
        pair("max_lon", "max_lat"),
        pair("min_lon", "max_lat"),
        pair("min_lon", "min_lat"),
    )
    simple = lambda name: F.concat(
        F.lit(f'<SimpleData name="{name}">'), F.col(name), F.lit("</SimpleData>")
    )
    placemark = F.concat(
        F.lit("<Placemark><ExtendedData><SchemaData>"),
        simple("zone_id"),
        simple("city_id"),
        F.lit("</SchemaData></ExtendedData><Polygon><outerBoundaryIs><LinearRing><coordinates>"),
        coords,
        F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"),
    )
    body = F.concat_ws("", F.collect_list(placemark))
    document = F.concat(F.lit("<kml><Document>"), body, F.lit("</Document></kml>"))
    w.dim_zone.agg(document.alias("value")).write.text(path)
    rows = files.read_kml(w.spark, path)
    return ring_bounds(
        rows.select(
            F.col("attributes")["zone_id"].alias("zone_id"), F.col("attributes")["city_id"].alias("city_id"), "rings"
        )
    )


WEATHER_SQL = """SELECT r_name AS city_id, CAST(l_shipdate AS DATE) AS date,
       avg(24 + l_tax * 100) AS temperature_c,
       CASE WHEN count(*) % 5 = 0 THEN NULL ELSE sum(l_discount) END AS rainfall_mm
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"""


@query("A10", WEATHER_SQL, "temperature_c rainfall_mm")
def _(w):
    """One document per city; each map holds one entry per calendar day."""
    path = scratch_path(w.spark, "weather")
    bins = w.dim_bin.select(F.col("bin_id").alias("l_suppkey"), "city_id")
    daily = (
        w.table("lineitem")
        .join(bins, "l_suppkey")
        .groupBy("city_id", F.date_format("l_shipdate", "yyyyMMdd").alias("day"))
        .agg(
            F.avg(24 + F.col("l_tax") * 100).alias("t"),
            F.when(F.count(F.lit(1)) % 5 == 0, F.lit(-999.0)).otherwise(F.sum("l_discount")).alias("p"),
        )
    )
    entries = lambda c: F.map_from_entries(F.collect_list(F.struct("day", c)))
    daily.groupBy("city_id").agg(
        F.struct(F.struct(entries("t").alias("T2M"), entries("p").alias("PRECTOTCORR")).alias("parameter")).alias(
            "properties"
        )
    ).write.json(path)
    schema = "city_id string, properties struct<parameter:struct<T2M:map<string,double>,PRECTOTCORR:map<string,double>>>"
    raw = w.spark.read.schema(schema).json(path).select("city_id", "properties.parameter.*")
    return files.explode_dated_maps(raw, {"T2M": "temperature_c", "PRECTOTCORR": "rainfall_mm"}, ["city_id"])


def zone_files(w) -> str:
    path = scratch_path(w.spark, "zone-files")
    daily = w.zone_day.select("zone_id", "service_date_local", "bins", "scheduled_readings")
    daily.repartition("zone_id").write.partitionBy("zone_id").option("header", True).csv(path)
    return path


def zone_of(path: str = "path"):
    return F.regexp_extract(path, r"zone_id=([^/]+)/", 1)


@query("A11", "SELECT zone_id, 'ok' AS status, count(DISTINCT 1) AS files FROM zoneday GROUP BY 1")
def _(w):
    path = zone_files(w)
    manifest_path = scratch_path(w.spark, "manifest-hashes")
    files.hash_files(w.spark, path, "*.csv").write.parquet(manifest_path)
    manifest = w.spark.read.schema("path string, bytes bigint, sha256 string").parquet(manifest_path)
    audit = files.audit_hashes(files.hash_files(w.spark, path, "*.csv"), manifest)
    return audit.groupBy(zone_of().alias("zone_id"), "status").agg(F.count(F.lit(1)).alias("files"))


@query(
    "A11_states",
    """SELECT city_id, status, count(*) AS zones FROM (
         SELECT city_id, zone_id, CASE WHEN city_id = 'EUROPE' THEN 'unlisted' WHEN city_id = 'ASIA' THEN 'missing'
                WHEN city_id = 'AMERICA' AND max(service_date_local) > DATE '1997-12-31' THEN 'changed' ELSE 'ok' END AS status
         FROM zoneday GROUP BY city_id, zone_id) GROUP BY ALL""",
)
def _(w):
    """Two deliveries of zone files: the second lacks one city, brings another anew and cuts the years of a third."""
    daily = w.zone_day.select("city_id", "zone_id", "service_date_local", "bins", "scheduled_readings")
    cut = (F.col("city_id") == "AMERICA") & (F.col("service_date_local") > F.lit("1997-12-31").cast("date"))

    def delivered(label, rows):
        path = scratch_path(w.spark, label)
        ordered = rows.repartition("city_id", "zone_id").sortWithinPartitions("city_id", "zone_id", "service_date_local")
        ordered.write.partitionBy("city_id", "zone_id").option("header", True).csv(path)
        folder = F.regexp_extract("path", r"(city_id=[^/]+/zone_id=[^/]+)/", 1).alias("zone_folder")
        return files.hash_files(w.spark, path, "*.csv").select(folder, "bytes", "sha256")

    manifest = delivered("delivery-1", daily.where(F.col("city_id") != "EUROPE"))
    found = delivered("delivery-2", daily.where((F.col("city_id") != "ASIA") & ~cut))
    city = F.regexp_extract("zone_folder", r"city_id=([^/]+)/", 1)
    return (
        files.audit_hashes(found, manifest, "zone_folder")
        .groupBy(F.url_decode(city).alias("city_id"), "status")
        .agg(F.count(F.lit(1)).alias("zones"))
    )


@query(
    "A12",
    """SELECT zone_id, '.csv' AS kind, 'service_date_local,bins,scheduled_readings' AS header,
              count(*) AS rows FROM zoneday GROUP BY 1""",
)
def _(w):
    path = zone_files(w)
    stored = files.file_inventory(w.spark, path, "*.csv").select(zone_of().alias("zone_id"), "kind")
    counted = files.csv_headers(w.spark, path).select(zone_of().alias("zone_id"), "header", "rows")
    return stored.join(counted, "zone_id")


@query("A13", "SELECT city_id, count(*) AS bins FROM bin_dim GROUP BY 1")
def _(w):
    """Asked through an alias of the stored table."""
    registry = TableRegistry(w.spark, scratch_path(w.spark, "tables"))
    registry.put("dim_bin", w.dim_bin)
    registry.alias("bins", "dim_bin")
    return registry.table("bins").groupBy("city_id").agg(F.count(F.lit(1)).alias("bins"))


@query(
    "A13_replace",
    """SELECT moment, city_id, count(*) AS bins FROM bin_dim JOIN supplier ON s_suppkey = bin_id
       JOIN (VALUES ('before', 0.0), ('during', 0.0), ('after', -1e9)) v(moment, least) ON s_acctbal >= least GROUP BY ALL""",
)
def _(w):
    """One question before, while and after a table is replaced: first the bins of at least average demand, then all."""
    registry = TableRegistry(w.spark, scratch_path(w.spark, "tables"))
    registry.put("dim_bin", w.dim_bin.where(F.col("demand_factor") >= 1))
    registry.alias("bins", "dim_bin")
    ask = lambda moment: (
        registry.table("bins").groupBy(F.lit(moment).alias("moment"), "city_id").agg(F.count(F.lit(1)).alias("bins"))
    )
    before = ask("before")
    staged = registry.stage("dim_bin", w.dim_bin)
    during = ask("during")
    staged.publish()
    return before.union(during).union(ask("after"))


@query(
    "A14",
    """SELECT scenario, count(*) AS lines FROM lineitem
       JOIN (VALUES ('A', 'returned'), ('N', 'new'), ('R', 'refused')) v(flag, scenario) ON flag = l_returnflag
       GROUP BY 1""",
)
def _(w):
    names = sinks.from_rows(
        w.spark, [("A", "returned"), ("N", "new"), ("R", "refused")], "l_returnflag string, scenario string"
    )
    lines = w.table("lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("lines"))
    return lines.join(names, "l_returnflag").select("scenario", "lines")


CALENDAR_SQL = """SELECT service_date, CAST(year(service_date) AS INTEGER) AS calendar_year,
       CAST(month(service_date) AS INTEGER) AS month_number, strftime(service_date, '%B') AS month_name,
       CAST(year(service_date) * 100 + month(service_date) AS INTEGER) AS year_month_sort,
       CAST(dayofweek(service_date) AS INTEGER) AS weekday_sunday_zero,
       dayofweek(service_date) IN (0, 6) AS weekend
       FROM (SELECT CAST(unnest(generate_series(min(service_date_local), max(service_date_local), INTERVAL 1 DAY))
             AS DATE) AS service_date FROM slot)"""


@query("A15", CALENDAR_SQL)
def _(w):
    return sinks.calendar_of(w.obs, "service_date_local")


@query(
    "A16",
    """SELECT 'zone_daily' AS query_id, 'daily workload per zone' AS purpose, count(*) AS rows FROM zoneday
       UNION ALL SELECT 'city_daily', 'daily workload per city', count(*) FROM cityday""",
)
def _(w):
    catalogue = {"zone_daily": ("daily workload per zone", w.zone_day), "city_daily": ("daily workload per city", w.city_day)}
    rows = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("query_id"), F.lit(purpose).alias("purpose"), "rows"
        )
        for name, (purpose, df) in catalogue.items()
    ]
    return rows[0].union(rows[1])


@query(
    "A17",
    """SELECT zone_id, count(*) AS days, sum(collected_kg_simulated) AS collected_kg FROM zoneday
       WHERE service_date_local BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' GROUP BY 1""",
    "collected_kg",
)
def _(w):
    path = scratch_path(w.spark, "clustered")
    month = w.zone_day.withColumn("service_month", F.trunc("service_date_local", "month"))
    sinks.write_clustered(month, path, "service_month", "zone_id")
    return (
        files.read_table(w.spark, path)
        .where(F.col("service_month").between(F.lit("1996-01-01").cast("date"), F.lit("1996-03-31").cast("date")))
        .groupBy("zone_id")
        .agg(F.count(F.lit(1)).alias("days"), F.sum("collected_kg_simulated").alias("collected_kg"))
    )


@query(
    "A18",
    """SELECT 'all' AS asked, city_id, city_name, count(*) AS days, sum(generated_l) AS generated_l FROM cityday GROUP BY ALL
       UNION ALL SELECT city_id, city_id, city_name, count(*), sum(generated_l) FROM cityday GROUP BY ALL""",
    "generated_l",
)
def _(w):
    """The parameter unset (every city), then set to each city in turn."""
    days = cut_lineage(w.city_day)
    asked = [None, *[r["city_id"] for r in w.dim_city.select("city_id").orderBy("city_id").toLocalIterator()]]  # one row per city
    parts = [
        q.only_city(days, city).groupBy(F.lit(city or "all").alias("asked"), "city_id", "city_name").agg(
            F.count(F.lit(1)).alias("days"), F.sum("generated_l").alias("generated_l")
        )
        for city in asked
    ]
    return reduce(DataFrame.unionByName, parts)


DICTIONARY_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query(
    "A19",
    """SELECT table_name, column_name AS field,
              CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
                             WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE data_type END
                AS type
       FROM duckdb_columns() WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders',
                                                  'lineitem', 'events')""",
)
def _(w):
    return sinks.data_dictionary(w.spark, {t: w.table(t) for t in DICTIONARY_TABLES})


@query(
    "A20",
    """SELECT 'fact_bin_readings' AS table_name, count(*) AS rows FROM slot
       UNION ALL SELECT 'collection_events', count(*) FROM attempt
       UNION ALL SELECT 'bin_daily_metrics', count(*) FROM binday
       UNION ALL SELECT 'zone_daily_metrics', count(*) FROM zoneday
       UNION ALL SELECT 'route_daily_metrics', count(*) FROM routeday
       UNION ALL SELECT 'city_daily_metrics', count(*) FROM cityday
       UNION ALL SELECT 'dim_bin', count(*) FROM bin_dim
       UNION ALL SELECT 'dim_zone', count(*) FROM zone_dim""",
)
def _(w):
    w.build_marts()
    return sinks.row_counts(
        {
            "fact_bin_readings": w.obs,
            "collection_events": w.events,
            "bin_daily_metrics": w.bin_day,
            "zone_daily_metrics": w.zone_day,
            "route_daily_metrics": w.route_day,
            "city_daily_metrics": w.city_day,
            "dim_bin": w.dim_bin,
            "dim_zone": w.dim_zone,
        }
    )


@query(
    "A21",
    """SELECT count(*) AS rows, count(value) AS observed, sum(value) AS sum_measure FROM events
       WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'""",
    "sum_measure",
)
def _(w):
    return sinks.month_scan(w.table("events"), 2024, 1, "ts", "value")


@query(
    "A21_csv",
    """SELECT count(*) AS rows, count(value) AS observed, sum(value) AS sum_measure FROM events
       WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'""",
    "sum_measure",
)
def _(w):
    """The month scan over CSV, written from the table first: two columns are read, the month is filtered."""
    folder = scratch_path(w.spark, "month-csv")
    w.table("events").write.option("header", True).csv(folder)
    rows = w.spark.read.schema(w.table("events").schema).option("header", True).csv(folder)
    return sinks.month_scan(rows, 2024, 1, "ts", "value")
