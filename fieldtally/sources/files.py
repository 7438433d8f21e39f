"""File sources: typed CSV, partitioned Parquet, GeoJSON, KML, dated JSON maps, file audits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldtally.functions.expressions import parse_coords


def read_events_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a declared schema; a malformed row fails the job."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("enforceSchema", False)
        .csv(path)
    )


def read_partitioned(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """Hive-partitioned Parquet whose partition values stay text (``month='01'``).

    With a schema the declared types apply.  Without one, type inference of
    partition values is switched off for the moment the reader resolves them.
    """
    if schema is not None:
        return spark.read.schema(schema).parquet(root)
    setting = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        return spark.read.parquet(root)
    finally:
        spark.conf.set(setting, before)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_geojson(spark: SparkSession, path: str, props: str) -> DataFrame:
    """FeatureCollection files -> one row per feature, rings as lon/lat structs.

    ``props`` is the DDL of the wanted properties.  Polygon and MultiPolygon
    come out alike: an array of rings, even-odd interior.
    """
    geometry = "struct<type:string,coordinates:string>"
    schema = f"type string, features array<struct<properties:struct<{props}>,geometry:{geometry}>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    feature = raw.select(F.explode("features").alias("f")).select(
        "f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("__c")
    )
    polygon = F.from_json("__c", "array<array<array<double>>>")
    multi = F.flatten(F.from_json("__c", "array<array<array<array<double>>>>"))
    rings = F.when(F.col("geometry_type") == "MultiPolygon", multi).otherwise(polygon)
    return feature.withColumn(
        "rings",
        F.transform(
            rings,
            lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))),
        ),
    ).drop("__c")


def _one_tag(ring_tag: str) -> str:
    return f"{ring_tag}:array<struct<LinearRing:struct<coordinates:string>>>"


POLYGON_XML = f"struct<{_one_tag('outerBoundaryIs')},{_one_tag('innerBoundaryIs')}>"


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """KML placemarks -> attribute map and rings (outer and inner, of every polygon)."""
    data = "struct<_name:string,_VALUE:string>"
    schema = (
        f"name string, ExtendedData struct<SchemaData:struct<SimpleData:array<{data}>>>, "
        f"Polygon array<{POLYGON_XML}>, MultiGeometry struct<Polygon:array<{POLYGON_XML}>>"
    )
    raw = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    polygons = F.coalesce(F.col("MultiGeometry.Polygon"), F.col("Polygon"))
    texts = F.flatten(
        F.transform(
            polygons,
            lambda p: F.concat(
                F.coalesce(p["outerBoundaryIs"], F.array()), F.coalesce(p["innerBoundaryIs"], F.array())
            ),
        )
    )
    return raw.select(
        F.map_from_entries(
            F.transform(
                F.col("ExtendedData.SchemaData.SimpleData"), lambda d: F.struct(d["_name"], d["_VALUE"])
            )
        ).alias("attributes"),
        F.transform(texts, lambda t: parse_coords(t["LinearRing"]["coordinates"])).alias("rings"),
    )


def explode_dated_maps(
    df: DataFrame, columns: dict[str, str], keep: Iterable[str] = (), sentinel: float = -999.0
) -> DataFrame:
    """``{"yyyyMMdd": value}`` map columns -> one row per date, sentinel -> NULL.

    Dates are those of the first map; the others are looked up by the same key.
    """
    keep = list(keep)
    first = next(iter(columns))
    rows = df.select(*keep, *columns, F.explode(F.map_keys(first)).alias("__d"))
    return rows.select(
        *keep,
        F.to_date("__d", "yyyyMMdd").alias("date"),
        *[
            F.nullif(F.try_element_at(F.col(src), F.col("__d")), F.lit(sentinel)).alias(name)
            for src, name in columns.items()
        ],
    )


def file_inventory(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Path, size and suffix of every file; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    return files.select(
        "path",
        F.col("length").alias("bytes"),
        F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("kind"),
    )


def csv_headers(spark: SparkSession, root: str) -> DataFrame:
    """Header line and data-row count of each CSV file, counted split by split."""
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .text(root)
        .select(
            "value",
            F.col("_metadata.file_path").alias("path"),
            F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("__at"),
        )
    )
    return lines.groupBy("path").agg(
        F.min_by("value", "__at").alias("header"), (F.count(F.lit(1)) - 1).alias("rows")
    )


def hash_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def audit_hashes(files: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Status of every file named on either side; ``key`` is what names a file on both."""
    a, b = files.alias("a"), manifest.alias("b")
    same = (F.col("a.bytes") == F.col("b.bytes")) & (F.col("a.sha256") == F.col("b.sha256"))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(
        F.coalesce(f"a.{key}", f"b.{key}").alias(key),
        F.when(F.col(f"a.{key}").isNull(), "missing")
        .when(F.col(f"b.{key}").isNull(), "unlisted")
        .when(same, "ok")
        .otherwise("changed")
        .alias("status"),
    )
