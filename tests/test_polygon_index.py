import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.operators import polygon_index as px, spatial as sp

RINGS = "zone_id string, rings array<array<struct<lon:double,lat:double>>>"


def star(rng, n, at=(0.0, 0.0), grid=None):
    """A closed ring of n corners around a centre, radius changing from corner to corner."""
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    radius = rng.uniform(2, 10, n)
    xy = np.column_stack([at[0] + radius * np.cos(angle), at[1] + radius * np.sin(angle)])
    if grid:
        xy = np.round(xy / grid) * grid
    return [(float(a), float(b)) for a, b in [*xy, xy[0]]]


def holds(rings, points):
    """Even-odd rule over all edges; on an edge counts as inside."""
    odd, on = np.zeros(len(points), bool), np.zeros(len(points), bool)
    x, y = points[:, 0], points[:, 1]
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            spans = (y1 > y) != (y2 > y)
            with np.errstate(divide="ignore", invalid="ignore"):
                odd ^= spans & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            near = np.abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) <= 1e-12
            on |= near & (x >= min(x1, x2)) & (x <= max(x1, x2)) & (y >= min(y1, y2)) & (y <= max(y1, y2))
    return odd | on


def places(spark, points):
    return spark.createDataFrame(
        [(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id int, longitude double, latitude double"
    )


@pytest.mark.parametrize("grid, cell", [(None, None), (None, 3.7), (0.5, 0.5), (1.0, None)])
def test_equals_the_rule_over_all_edges(spark, grid, cell):
    rng = np.random.default_rng(5)
    shapes = {
        "a": [star(rng, 40, grid=grid), star(rng, 9, grid=grid)],  # the second ring cuts holes
        "b": [star(rng, 7, (4.0, 3.0), grid)],
        "c": [star(rng, 25, (-6.0, 1.0), grid), star(rng, 12, (30.0, 30.0), grid)],
    }
    corners = np.array([p for rings in shapes.values() for r in rings for p in r])
    points = np.vstack([
        rng.uniform(-18, 18, (300, 2)),
        corners,
        np.round(rng.uniform(-12, 12, (200, 2)) * 2) / 2,  # many on borders of cells
        (corners[:-1] + corners[1:]) / 2,
    ])
    got = sp.assign_zone(places(spark, points), spark.createDataFrame(list(shapes.items()), RINGS), cell=cell)
    inside = {z: holds(r, points) for z, r in shapes.items()}
    want = [
        (min((z for z in shapes if inside[z][i]), default=None), sum(bool(inside[z][i]) for z in shapes))
        for i in range(len(points))
    ]
    assert [(r.assigned_zone_id, r.match_count) for r in got.orderBy("id").collect()] == want


def test_many_corners_are_spread_over_cells(spark):
    """100,000 edges: listed about once each, no cell with more than a small share."""
    n = 100_000
    angle = np.linspace(0, 2 * np.pi, n, endpoint=False)
    radius = 50 + 5 * np.sin(40 * angle)
    ring = np.column_stack([radius * np.cos(angle), radius * np.sin(angle)])
    ring = [(float(a), float(b)) for a, b in [*ring, ring[0]]]
    polygon = spark.createDataFrame([("a", [ring])], RINGS)
    shapes = polygon.select("zone_id", sp.ring_edges("rings").alias("edges"))
    side = px.cell_side(shapes)
    index = px.build_index(shapes, ["zone_id"], side).cache()
    t = index.agg(
        F.sum(F.size("edges")).alias("listed"), F.max(F.size("edges")).alias("most"), F.count(F.lit(1)).alias("cells")
    ).first()
    assert t.listed < 1.1 * n and t.most < n / 50 and t.cells < 1.5 * n
    rng = np.random.default_rng(6)
    points = rng.uniform(-60, 60, (400, 2))
    got = sp.assign_zone(places(spark, points), polygon).orderBy("id").toPandas()
    a = np.arctan2(points[:, 1], points[:, 0])
    gap = np.hypot(*points.T) - (50 + 5 * np.sin(40 * a))
    clear = np.abs(gap) > 1e-3
    assert ((got.match_count == 1) == (gap < 0))[clear].all()
    index.unpersist()


def test_open_repeated_empty_and_incomplete_rings(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    rows = [
        ("a", [square]),  # open: closed by its first point
        ("a", [square]),  # the same row again counts again
        ("b", [[(0.0, 0.0), (None, 1.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]),
        ("c", []),
        ("d", None),
        ("e", [[(9.0, 9.0)]]),
        (None, [[(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]]),
    ]
    at = [(3.0, 1.0), (1.8, 1.2), (9.0, 9.0), (None, 1.0), (-1.0, 1.0)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "id int, longitude double, latitude double")
    got = sp.assign_zone(points, spark.createDataFrame(rows, RINGS)).orderBy("id").collect()
    assert [(r.assigned_zone_id, r.match_count) for r in got] == [("a", 3), ("a", 4), ("e", 1), (None, 0), (None, 0)]
    none = sp.assign_zone(points, spark.createDataFrame([], RINGS)).collect()
    assert {(r.assigned_zone_id, r.match_count) for r in none} == {(None, 0)}
