import os

import pytest
from pyspark.sql import functions as F

from fieldtally.plans.quality import assert_pruned
from fieldtally.sources import files, sinks
from fieldtally.streaming.ingest import ingest_new_files

KML = """<?xml version="1.0" encoding="UTF-8"?>
<kml xmlns="http://www.opengis.net/kml/2.2"><Document>
<Placemark><ExtendedData><SchemaData schemaUrl="#s"><SimpleData name="code">7</SimpleData></SchemaData></ExtendedData>
<MultiGeometry><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0,0 4,0,0 4,4,0 0,4,0 0,0,0</coordinates></LinearRing></outerBoundaryIs>
<innerBoundaryIs><LinearRing><coordinates>1,1 2,1 2,2 1,2 1,1</coordinates></LinearRing></innerBoundaryIs></Polygon></MultiGeometry></Placemark>
<Placemark><ExtendedData><SchemaData schemaUrl="#s"><SimpleData name="code">8</SimpleData></SchemaData></ExtendedData>
<Polygon><outerBoundaryIs><LinearRing><coordinates>5,5 6,5 6,6 5,5</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>
</Document></kml>"""
GEOJSON = """{"type":"FeatureCollection","features":[
 {"type":"Feature","properties":{"ward":"01"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},
 {"type":"Feature","properties":{"ward":"02"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[2,0],[2,2],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}}]}"""
WEATHER = '{"properties":{"parameter":{"T2M":{"20250101":25.1,"20250102":26.0},"PRECTOTCORR":{"20250101":-999,"20250102":1.5}}}}'


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_kml_rings_and_attributes(spark, tmp_path):
    rows = files.read_kml(spark, put(tmp_path / "a.kml", KML)).orderBy(F.col("attributes")["code"]).collect()
    assert [r.attributes["code"] for r in rows] == ["7", "8"]
    assert [len(r.rings) for r in rows] == [2, 1] and (rows[0].rings[1][2].lon, rows[0].rings[1][2].lat) == (2.0, 2.0)


def test_geojson_polygon_and_multipolygon(spark, tmp_path):
    rows = files.read_geojson(spark, put(tmp_path / "a.geojson", GEOJSON), "ward:string").orderBy("ward").collect()
    assert [(r.ward, len(r.rings)) for r in rows] == [("01", 1), ("02", 2)]
    assert rows[1].rings[1][0].lon == 5.0


def test_dated_maps_with_sentinel(spark, tmp_path):
    schema = "properties struct<parameter:struct<T2M:map<string,double>,PRECTOTCORR:map<string,double>>>"
    raw = spark.read.schema(schema).json(put(tmp_path / "w.json", WEATHER)).select("properties.parameter.*")
    rows = files.explode_dated_maps(raw, {"T2M": "t", "PRECTOTCORR": "p"}).orderBy("date").collect()
    assert [(str(r.date), r.t, r.p) for r in rows] == [("2025-01-01", 25.1, None), ("2025-01-02", 26.0, 1.5)]


def test_csv_types_and_failfast(spark, tmp_path):
    good = put(tmp_path / "g.csv", "id,zone,fill\n1,007,\n2,010,3.5\n")
    rows = files.read_events_csv(spark, good, "id bigint, zone string, fill float").orderBy("id").collect()
    assert [(r.zone, r.fill) for r in rows] == [("007", None), ("010", 3.5)]
    bad = put(tmp_path / "b.csv", "id,zone,fill\nx,007,1\n")
    with pytest.raises(Exception):
        files.read_events_csv(spark, bad, "id bigint, zone string, fill float").collect()


def frame(spark, months):
    rows = [(i, f"00{i}", float(i), m) for i, m in enumerate(months)]
    return spark.createDataFrame(rows, "id bigint, zone string, truth double, month string").withColumn("year", F.lit(2026))


def test_split_write_keeps_zero_padded_months_and_replaces(spark, tmp_path):
    obs, truth = str(tmp_path / "obs"), str(tmp_path / "truth")
    targets = {str(tmp_path / "all"): ["id", "zone", "truth"], obs: ["id", "zone"], truth: ["id", "truth"]}
    sinks.write_split(frame(spark, ["01", "01", "02"]), targets, ["year", "month"])
    sinks.write_split(frame(spark, ["02", "02", "02", "02"]), targets, ["year", "month"])
    got = files.read_partitioned(spark, obs)
    assert "truth" not in got.columns
    assert {r.month: r["count"] for r in got.groupBy("month").count().collect()} == {"01": 2, "02": 4}
    assert set(files.read_partitioned(spark, truth).columns) == {"id", "truth", "year", "month"}
    january = got.where("month = '01'")
    assert_pruned(january, ["month"])
    with pytest.raises(AssertionError):
        assert_pruned(got.where("id = 1"), ["month"])


def test_append_only_missing_partitions(spark, tmp_path):
    target = str(tmp_path / "t")
    sinks.append_missing_partitions(frame(spark, ["01", "01"]), target, ["year", "month"])
    sinks.append_missing_partitions(frame(spark, ["01", "02", "02"]), target, ["year", "month"])
    got = files.read_partitioned(spark, target)
    assert {r.month: r["count"] for r in got.groupBy("month").count().collect()} == {"01": 2, "02": 2}


def test_hash_audit_reports_every_state(spark, tmp_path):
    root = tmp_path / "raw"
    root.mkdir()
    for name in ("same", "edited", "extra"):
        put(root / f"{name}.txt", name)
    manifest = files.hash_files(spark, str(root)).where(~F.col("path").contains("extra")).collect()
    rows = [(r.path, r.bytes, r.sha256) for r in manifest] + [("file:/gone.txt", 1, "0")]
    put(root / "edited.txt", "EDITED")
    listed = spark.createDataFrame(rows, "path string, bytes bigint, sha256 string")
    got = {os.path.basename(r.path): r.status for r in files.audit_hashes(files.hash_files(spark, str(root)), listed).collect()}
    assert got == {"same.txt": "ok", "edited.txt": "changed", "extra.txt": "unlisted", "gone.txt": "missing"}


def test_inventory_and_headers(spark, tmp_path):
    put(tmp_path / "a.csv", "x,y\n1,2\n3,4\n")
    assert [(r.bytes, r.kind) for r in files.file_inventory(spark, str(tmp_path)).collect()] == [(12, ".csv")]
    assert [(r.header, r.rows) for r in files.csv_headers(spark, str(tmp_path)).collect()] == [("x,y", 2)]


def test_manifest_and_calendar(spark, tmp_path):
    out = str(tmp_path / "m")
    sinks.write_manifest({"q": spark.range(3)}, out)
    assert [(r.query_id, r.rows, r.columns) for r in spark.read.json(out).collect()] == [("q", 3, ["id"])]
    days = sinks.date_dim(spark, "2026-01-03", "2026-01-05").orderBy("service_date").collect()
    assert [(r.weekday_sunday_zero, r.weekend, r.month_name) for r in days] == [
        (6, True, "January"), (0, True, "January"), (1, False, "January")
    ]


def test_new_files_are_ingested_once(spark, tmp_path):
    inbox, out, seen = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    inbox.mkdir()
    schema = "id bigint, service_date_local date"
    for month in ("01", "02"):
        put(inbox / f"{month}.csv", f"id,service_date_local\n1,2026-{month}-05\n")
        for _ in range(2):
            ingest_new_files(spark, str(inbox), schema, {out: ["id", "service_date_local"]}, seen).awaitTermination()
    got = files.read_partitioned(spark, out)
    assert {r.month: r["count"] for r in got.groupBy("month").count().collect()} == {"01": 1, "02": 1}
