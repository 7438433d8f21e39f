import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.operators import spatial as sp


def points(spark, xy, name="id"):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], f"{name} bigint, x double, y double")


@pytest.fixture(scope="module")
def clouds():
    """Targets in one dense cluster with copies plus a few far away; points everywhere."""
    rng = np.random.default_rng(11)
    dense = rng.normal(0, 30, (150, 2)).round(1)
    targets = np.vstack([dense, dense[:40], rng.uniform(-50000, 50000, (15, 2)).round(1)])
    pts = np.vstack([rng.uniform(-60000, 60000, (60, 2)), rng.normal(0, 50, (60, 2)), dense[:10]]).round(1)
    return pts, targets


def distances(a, b):
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))


def test_nearest_equals_brute_force(spark, clouds):
    pts, targets = clouds
    got = sp.nearest(points(spark, pts), points(spark, targets, "tid"), "tid").toPandas().sort_values("id")
    d = distances(pts, targets)
    assert np.allclose(got.nearest_m, d.min(1))
    assert (d[np.arange(len(pts)), got.nearest_id] == d.min(1)).all()


def test_nearest_other_skips_only_itself(spark, clouds):
    _, targets = clouds
    got = sp.nearest_other(points(spark, targets), "id").toPandas().sort_values("id")
    d = distances(targets, targets)
    np.fill_diagonal(d, np.inf)
    assert np.allclose(got.nearest_other_m, d.min(1))


@pytest.mark.parametrize("radius", [5.0, 60.0, 20000.0, 1e6])
def test_count_within_equals_brute_force(spark, clouds, radius):
    pts, targets = clouds
    got = sp.count_within(points(spark, pts), points(spark, targets, "tid"), radius, name="n").toPandas().sort_values("id")
    assert list(got.n) == list((distances(pts, targets) <= radius).sum(1))


def ring(*xy):
    return "array(" + ",".join(f"named_struct('lon',{float(x)}D,'lat',{float(y)}D)" for x, y in xy) + ")"


SQUARE = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
HOLE = ring((1, 1), (2, 1), (2, 2), (1, 2), (1, 1))


def shapes(spark):
    return spark.sql(f"SELECT 'a' AS zone_id, array({SQUARE}, {HOLE}) AS rings UNION ALL SELECT 'b', array({ring((3, 3), (6, 3), (6, 6), (3, 3))})")


def test_point_in_polygon_with_hole_and_edges(spark):
    cases = {(0.5, 0.5): ("a", 1), (1.5, 1.5): (None, 0), (4.0, 1.0): ("a", 1), (1.0, 1.5): ("a", 1), (3.6, 3.3): ("a", 2), (9.0, 9.0): (None, 0)}
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(cases)], "id int, longitude double, latitude double")
    got = sp.assign_zone(df, shapes(spark), cell=1.0).orderBy("id").collect()
    assert [(r.assigned_zone_id, r.match_count) for r in got] == list(cases.values())


def test_polygon_measures_subtract_holes(spark):
    got = {r.zone_id: r for r in sp.polygon_measures(shapes(spark), utm_zone=None).collect()}
    assert (got["a"].area, got["b"].area) == (15.0, 4.5)
    assert (got["a"].min_lon, got["a"].max_lat, got["b"].map_longitude) == (0.0, 4.0, 4.5)


def test_distance_to_polygons(spark):
    df = spark.createDataFrame([(0, 0.5, 0.5), (1, 1.5, 1.4), (2, -3.0, 0.0), (3, 7.0, 7.0)], "id int, x double, y double")
    got = sp.nearest_polygon_m(df, shapes(spark), cell=1.0).orderBy("id").toPandas().nearest_polygon_m
    assert np.allclose(got, [0.0, 0.4, 3.0, np.sqrt(2)])


def test_representative_point(spark):
    df = spark.sql(f"SELECT {SQUARE} AS r UNION ALL SELECT {ring((0, 0), (2, 2))}")
    got = df.select(sp.representative_point("r").alias("p")).select("p.*").toPandas()
    assert np.allclose(got, [[2, 2], [1, 1]])


def test_utm_on_known_points(spark):
    # central meridian: easting is the false easting; equator: northing is zero
    df = spark.createDataFrame([(81.0, 0.0), (81.0, 45.0)], "lon double, lat double")
    e, n = sp.to_utm("lon", "lat", 44)
    got = df.select(e.alias("e"), n.alias("n")).orderBy("n").toPandas()
    assert np.allclose(got.e, 500000, atol=1e-6)
    assert np.allclose(got.n, [0, 4982950.400], atol=0.01)


def test_haversine(spark):
    d = spark.range(1).select(sp.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0)).alias("d")).first().d
    assert np.isclose(d, np.pi * 6371000)
