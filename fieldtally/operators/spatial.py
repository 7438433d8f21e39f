"""Spatial expressions and joins.

Distances to the nearest target, counts within a radius and point-in-polygon
tests use a pyramid of grid cells held as ordinary tables: a point walks down
from coarse to fine cells by equi-joins and keeps only cells that can still
matter.  No step pairs every point with every target of a cell block, and equal
coordinates are collapsed before the walk, so crowded places stay cheap.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldtally.functions.expressions import choose, col
from fieldtally.operators.polygon_index import build_index, cell_side, containing, crossing, touches
from fieldtally.session import cut_lineage
from fieldtally.settings import EARTH_RADIUS_M, MAX_SNAP_M

FAN = 4  # children per axis of one cell
BROADCAST_LEVELS = 3  # a level holds at most 16**level cells: 4096 rows at level 3


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    half = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(
        F.sin(F.radians(col(lon2) - col(lon1)) / 2), 2
    )
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


# WGS84 ellipsoid and the UTM scale factor and false easting.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_EAST = 500000.0


def to_utm(lon, lat, zone: int) -> tuple[Column, Column]:
    """Northern-hemisphere UTM easting and northing (transverse Mercator series, USGS PP 1395)."""
    e2 = WGS84_F * (2 - WGS84_F)
    ep2 = e2 / (1 - e2)
    phi = F.radians(col(lat))
    n = F.lit(WGS84_A) / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t = F.pow(F.tan(phi), 2)
    c = ep2 * F.pow(F.cos(phi), 2)
    a = F.radians(col(lon) - (6 * zone - 183)) * F.cos(phi)
    m = WGS84_A * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    x = UTM_SCALE * n * (
        a
        + (1 - t + c) * F.pow(a, 3) / 6
        + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(a, 5) / 120
    ) + UTM_EAST
    y = UTM_SCALE * (
        m
        + n
        * F.tan(phi)
        * (
            F.pow(a, 2) / 2
            + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24
            + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(a, 6) / 720
        )
    )
    return x, y


def in_bbox(lon, lat, box: tuple[float, float, float, float]) -> Column:
    """Inside (min_lon, min_lat, max_lon, max_lat), borders included."""
    west, south, east, north = box
    return col(lon).between(west, east) & col(lat).between(south, north)


def k_nearest_to(df: DataFrame, lon: float, lat: float, k: int, id_col: str) -> DataFrame:
    """k rows nearest to a fixed point, smaller id first on ties (distributed top-k)."""
    d = haversine_m(F.lit(lon), F.lit(lat), "longitude", "latitude")
    return df.withColumn("center_distance_m", d).orderBy("center_distance_m", id_col).limit(k)


def flag_access(df: DataFrame, snap: str = "snap_m", max_m: float = MAX_SNAP_M) -> DataFrame:
    return df.withColumn("network_accessible", F.col(snap) <= max_m)


def hotspot_class(c, cuts: tuple[int, int] = (100, 200)) -> Column:
    low, high = cuts
    c = col(c)
    return choose([(c >= high, F.lit("high")), (c >= low, F.lit("medium"))], F.lit("low"))


# cell pyramid -------------------------------------------------------------


@dataclass
class Pyramid:
    """``levels[i]`` holds the non-empty cells of level i + 1; ``items`` carry leaf keys."""

    levels: list[DataFrame]
    items: DataFrame


def build_pyramid(items: DataFrame, leaf_side: float | None = None, max_depth: int = 12) -> Pyramid:
    """Cells over items with bounds x0, y0, x1, y1 and weight n, keyed by their midpoints.

    Only the extent and the item count come to the driver; they set the depth so
    that a leaf holds about one item, or is as small as ``leaf_side``.  Items
    are stored once, and finer levels roll up into coarser ones.
    """
    items = cut_lineage(items)
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    box = items.agg(
        F.min(mx).alias("a"), F.min(my).alias("b"), F.max(mx).alias("c"), F.max(my).alias("d"),
        F.count(F.lit(1)).alias("items"),
    ).first()
    if box["a"] is None:
        raise ValueError("no targets to search")
    side = max(box["c"] - box["a"], box["d"] - box["b"]) * (1 + 1e-9) or 1.0
    depth = math.ceil(math.log(math.sqrt(box["items"]), FAN)) + 1
    if leaf_side is not None:
        depth = math.ceil(math.log(max(side / leaf_side, 1.0), FAN))
    depth = max(1, min(depth, max_depth))
    leaf = side / FAN**depth
    keyed = items.select(
        "*",
        F.floor((mx - F.lit(box["a"])) / leaf).alias("cx"),
        F.floor((my - F.lit(box["b"])) / leaf).alias("cy"),
    )
    bounds = [
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("x1").alias("x1"),
        F.max("y1").alias("y1"),
        F.sum("n").alias("n"),
    ]
    cells = keyed.groupBy("cx", "cy").agg(*bounds)
    levels = [cells]
    for _ in range(depth - 1):
        cells = cells.groupBy(
            F.floor(F.col("cx") / FAN).alias("cx"), F.floor(F.col("cy") / FAN).alias("cy")
        ).agg(*bounds)
        levels.insert(0, cells)
    return Pyramid(levels, keyed)


def _near(px, py) -> Column:
    """Smallest possible distance from the point to the box x0..x1, y0..y1."""
    dx = F.greatest(F.col("x0") - px, px - F.col("x1"), F.lit(0.0))
    dy = F.greatest(F.col("y0") - py, py - F.col("y1"), F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def _far(px, py) -> Column:
    """Distance to the farthest corner: everything in the box is at most this far."""
    dx = F.greatest(F.abs(px - F.col("x0")), F.abs(px - F.col("x1")))
    dy = F.greatest(F.abs(py - F.col("y0")), F.abs(py - F.col("y1")))
    return F.sqrt(dx * dx + dy * dy)


def _children(candidates: DataFrame, cells: DataFrame, level: int, how: str = "inner") -> DataFrame:
    kids = cells.select(
        F.floor(F.col("cx") / FAN).alias("gx"),
        F.floor(F.col("cy") / FAN).alias("gy"),
        "cx",
        "cy",
        "x0",
        "y0",
        "x1",
        "y1",
        "n",
    )
    if level <= BROADCAST_LEVELS:
        kids = F.broadcast(kids)
    return candidates.join(kids, ["gx", "gy"], how)


def _start(places: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return places.withColumns({"gx": zero, "gy": zero})


def _descend_nearest(places: DataFrame, tree: Pyramid, others_only: bool) -> DataFrame:
    """(px, py, gx, gy) leaf cells that may hold the nearest item of each place."""
    candidates = _start(places)
    mine = Window.partitionBy("px", "py")
    for i, cells in enumerate(tree.levels, 1):
        step = _children(candidates, cells, i).withColumns(
            {"__lo": _near(F.col("px"), F.col("py")), "__hi": _far(F.col("px"), F.col("py"))}
        )
        bound = F.col("__hi")
        if others_only:
            # a lone item at distance zero may be the place's own
            bound = F.when((F.col("n") >= 2) | (F.col("__lo") > 0), F.col("__hi"))
        step = step.withColumn("__best", F.min(bound).over(mine))
        keep = F.col("__best").isNull() | (F.col("__lo") <= F.col("__best"))
        candidates = step.where(keep).select("px", "py", F.col("cx").alias("gx"), F.col("cy").alias("gy"))
    return candidates


def _places(points: DataFrame, x: str, y: str) -> DataFrame:
    return points.select(F.col(x).alias("px"), F.col(y).alias("py")).distinct()


def _as_items(targets: DataFrame, tid: str, x: str, y: str) -> DataFrame:
    """Distinct target coordinates with their smallest and largest id."""
    return targets.groupBy(F.col(x).alias("x0"), F.col(y).alias("y0")).agg(
        F.min(tid).alias("id_lo"), F.max(tid).alias("id_hi"), F.count(F.lit(1)).alias("n")
    ).withColumns({"x1": F.col("x0"), "y1": F.col("y0")})


def _back(points: DataFrame, found: DataFrame, x: str, y: str) -> DataFrame:
    return points.join(
        found.withColumnsRenamed({"px": x, "py": y}), [x, y], "left"
    )


def nearest(
    points: DataFrame, targets: DataFrame, tid: str, x: str = "x", y: str = "y",
    distance: str = "nearest_m", target: str = "nearest_id",
) -> DataFrame:
    """Nearest target of every point (planar metres); the smaller id wins a tie."""
    tree = build_pyramid(_as_items(targets, tid, x, y))
    cells = _descend_nearest(_places(points, x, y), tree, False)
    leaf = tree.items.select(F.col("cx").alias("gx"), F.col("cy").alias("gy"), "x0", "y0", "id_lo")
    d = F.sqrt(F.pow(F.col("px") - F.col("x0"), 2) + F.pow(F.col("py") - F.col("y0"), 2))
    best = (
        cells.join(leaf, ["gx", "gy"])
        .groupBy("px", "py")
        .agg(F.min(F.struct(d.alias("d"), F.col("id_lo").alias("id"))).alias("m"))
    )
    found = best.select("px", "py", F.col("m.d").alias(distance), F.col("m.id").alias(target))
    return _back(points, found, x, y)


def nearest_other(
    points: DataFrame, pid: str, x: str = "x", y: str = "y", distance: str = "nearest_other_m"
) -> DataFrame:
    """Distance of every point to the nearest other point of the same table."""
    items = _as_items(points, pid, x, y)
    tree = build_pyramid(items)
    cells = _descend_nearest(_places(points, x, y), tree, True)
    leaf = tree.items.select(F.col("cx").alias("gx"), F.col("cy").alias("gy"), "x0", "y0", "n")
    same = (F.col("px") == F.col("x0")) & (F.col("py") == F.col("y0"))
    d = F.sqrt(F.pow(F.col("px") - F.col("x0"), 2) + F.pow(F.col("py") - F.col("y0"), 2))
    found = (
        cells.join(leaf, ["gx", "gy"])
        .where(~same | (F.col("n") >= 2))
        .groupBy("px", "py")
        .agg(F.min(d).alias(distance))
    )
    return _back(points, found, x, y)


def count_within(
    points: DataFrame, targets: DataFrame, radius: float, x: str = "x", y: str = "y", name: str = "within",
) -> DataFrame:
    """Number of targets within ``radius`` of every point.

    Cells wholly inside the circle add their totals, cells wholly outside drop
    out, and only cells cut by the circle are opened further.
    """
    items = (
        targets.groupBy(F.col(x).alias("x0"), F.col(y).alias("y0"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"x1": F.col("x0"), "y1": F.col("y0")})
    )
    tree = build_pyramid(items, leaf_side=radius / 16)
    # settled rows keep their count and get a key that matches no cell, spread by place
    settled_key = -1 - F.pmod(F.xxhash64("px", "py"), F.lit(1_000_003))
    walk = _start(_places(points, x, y)).withColumn("c", F.lit(0).cast("bigint"))
    for i, cells in enumerate(tree.levels, 1):
        step = _children(walk, cells, i, "left").withColumns(
            {"__lo": _near(F.col("px"), F.col("py")), "__hi": _far(F.col("px"), F.col("py"))}
        )
        settled = F.col("cx").isNull()
        whole = F.col("__hi") <= radius
        walk = step.where(settled | (F.col("__lo") <= radius)).select(
            "px",
            "py",
            F.when(settled | whole, settled_key).otherwise(F.col("cx")).alias("gx"),
            F.when(settled | whole, F.lit(-1)).otherwise(F.col("cy")).cast("bigint").alias("gy"),
            F.when(settled, F.col("c")).when(whole, F.col("n")).otherwise(0).alias("c"),
        )
    leaf = tree.items.select(F.col("cx").alias("gx"), F.col("cy").alias("gy"), "x0", "y0", "n")
    d = F.sqrt(F.pow(F.col("px") - F.col("x0"), 2) + F.pow(F.col("py") - F.col("y0"), 2))
    hit = F.when(F.col("n").isNull(), F.col("c")).when(d <= radius, F.col("n")).otherwise(0)
    found = walk.join(leaf, ["gx", "gy"], "left").groupBy("px", "py").agg(F.sum(hit).alias(name))
    return _back(points, found, x, y).withColumn(name, F.coalesce(name, F.lit(0)))


# polygons -----------------------------------------------------------------


def ring_edges(rings) -> Column:
    """All edges of all rings as one array of x1, y1, x2, y2."""

    def edges(ring):
        n = F.greatest(F.size(ring) - 1, F.lit(0))
        zipped = F.arrays_zip(
            F.slice(ring, F.lit(1), n).alias("a"), F.slice(ring, F.lit(2), n).alias("b")
        )
        return F.transform(
            zipped,
            lambda e: F.struct(
                e["a"]["lon"].alias("x1"),
                e["a"]["lat"].alias("y1"),
                e["b"]["lon"].alias("x2"),
                e["b"]["lat"].alias("y2"),
            ),
        )

    return F.flatten(F.transform(col(rings), edges))


def contains(edges, x, y) -> Column:
    """Even-odd test over the edges; a point on an edge counts as inside."""
    edges, x, y = col(edges), col(x), col(y)

    def crosses(e):
        spans = (e["y1"] > y) != (e["y2"] > y)
        return F.coalesce(spans & (x < crossing(e, y)), F.lit(False))

    odd = F.aggregate(edges, F.lit(False), lambda acc, e: acc != crosses(e))
    return odd | F.exists(edges, lambda e: touches(e, x, y))


def _closed(rings) -> Column:
    """Rings without missing or infinite points, ended where they began."""
    finite = lambda v: F.abs(v) < F.lit(float("inf"))

    def close(ring):
        whole = F.filter(ring, lambda p: finite(p["lon"]) & finite(p["lat"]))
        return F.concat(whole, F.slice(whole, 1, 1))

    return F.transform(F.filter(rings, lambda r: r.isNotNull()), close)


def assign_zone(
    points: DataFrame, polygons: DataFrame, zone: str = "zone_id", lon: str = "longitude", lat: str = "latitude",
    cell: float | None = None,
) -> DataFrame:
    """First containing polygon (smallest id) and number of containing polygons.

    Distinct places meet the cells of a polygon index (``polygon_index``): inside cells
    answer at once, edge cells by their own edges.  ``cell`` is the side of a cell; without
    it the side follows from the polygons' bounds and edges.  Open rings count as closed, points
    with a missing coordinate lie in no polygon, and repeated polygons count each time.
    """
    shapes = (
        polygons.groupBy(F.col(zone).alias("__z"), F.xxhash64("rings").alias("__h"))
        .agg(F.any_value("rings").alias("rings"), F.count(F.lit(1)).alias("__n"))
        .select("__z", "__h", "__n", ring_edges(_closed("rings")).alias("edges"))
    )
    side = cell or cell_side(shapes)
    found = (
        containing(_places(points, lon, lat), build_index(shapes, ["__z", "__h", "__n"], side), side)
        .groupBy("px", "py")
        .agg(F.min("__z").alias(f"assigned_{zone}"), F.sum("__n").alias("match_count"))
    )
    return _back(points, found, lon, lat).withColumn("match_count", F.coalesce("match_count", F.lit(0)))


def ring_area(ring) -> Column:
    """Unsigned shoelace area of one closed ring of x / y structs."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(ring, F.lit(1), n).alias("a"), F.slice(ring, F.lit(2), n).alias("b"))
    twice = F.aggregate(
        pairs,
        F.lit(0.0),
        lambda acc, p: acc + p["a"]["lon"] * p["b"]["lat"] - p["b"]["lon"] * p["a"]["lat"],
    )
    return F.abs(twice) / 2


def polygon_measures(polygons: DataFrame, utm_zone: int | None = 44) -> DataFrame:
    """Bounds, box centre and area (holes subtracted) per polygon.

    ``outer`` (array<boolean>, one flag per ring) marks outer rings; without it
    the first ring is the outer one.  Areas are square metres in the UTM zone,
    or square input units when ``utm_zone`` is None.
    """
    flat = lambda f: F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p[f])))

    def project(p):
        e, n = to_utm(p["lon"], p["lat"], utm_zone)
        return F.struct(e.alias("lon"), n.alias("lat"))

    planar = F.col("rings") if utm_zone is None else F.transform("rings", lambda r: F.transform(r, project))
    sign = (
        (lambda i: F.when(F.get("outer", i), 1.0).otherwise(-1.0))
        if "outer" in polygons.columns
        else (lambda i: F.when(i == 0, 1.0).otherwise(-1.0))
    )
    signed = F.transform(planar, lambda r, i: ring_area(r) * sign(i))
    return polygons.withColumns(
        {
            "min_lon": F.array_min(flat("lon")),
            "min_lat": F.array_min(flat("lat")),
            "max_lon": F.array_max(flat("lon")),
            "max_lat": F.array_max(flat("lat")),
            "area": F.aggregate(signed, F.lit(0.0), lambda a, v: a + v),
        }
    ).withColumns(
        {
            "map_longitude": (F.col("min_lon") + F.col("max_lon")) / 2,
            "map_latitude": (F.col("min_lat") + F.col("max_lat")) / 2,
        }
    )


def representative_point(ring) -> Column:
    """Area centroid of a closed ring, vertex mean of anything else (an approximation)."""
    ring = col(ring)
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    first, last = F.get(ring, F.lit(0)), F.element_at(ring, F.lit(-1))
    pairs = F.arrays_zip(F.slice(ring, F.lit(1), n).alias("a"), F.slice(ring, F.lit(2), n).alias("b"))

    def add(acc, p):
        # relative to the first vertex, so that small shapes keep their digits
        ax, ay = p["a"]["lon"] - first["lon"], p["a"]["lat"] - first["lat"]
        bx, by = p["b"]["lon"] - first["lon"], p["b"]["lat"] - first["lat"]
        k = ax * by - bx * ay
        return F.struct(
            (acc["k"] + k).alias("k"), (acc["x"] + (ax + bx) * k).alias("x"), (acc["y"] + (ay + by) * k).alias("y")
        )

    start = F.struct(F.lit(0.0).alias("k"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    s = F.aggregate(pairs, start, add)
    closed = (F.size(ring) >= 4) & (first == last) & (s["k"] != 0)
    mean = lambda f: F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[f]) / F.size(ring)
    three_k = F.nullif(s["k"] * 3, F.lit(0.0))
    return F.struct(
        F.when(closed, first["lon"] + s["x"] / three_k).otherwise(mean("lon")).alias("lon"),
        F.when(closed, first["lat"] + s["y"] / three_k).otherwise(mean("lat")).alias("lat"),
    )


def segment_distance(px, py, x1, y1, x2, y2) -> Column:
    px, py, x1, y1, x2, y2 = (col(c) for c in (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    along = ((px - x1) * dx + (py - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.coalesce(F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return F.sqrt(F.pow(px - (x1 + t * dx), 2) + F.pow(py - (y1 + t * dy), 2))


def nearest_polygon_m(
    points: DataFrame, polygons: DataFrame, zone: str = "zone_id", x: str = "x", y: str = "y",
    cell: float | None = None, name: str = "nearest_polygon_m",
) -> DataFrame:
    """Distance to the nearest polygon (planar rings), 0 on or inside one."""
    edges = polygons.select(F.explode(ring_edges("rings")).alias("e")).select("e.*")
    items = edges.select(
        F.least("x1", "x2").alias("x0"),
        F.least("y1", "y2").alias("y0"),
        F.greatest("x1", "x2").alias("x9"),
        F.greatest("y1", "y2").alias("y9"),
        F.col("x1").alias("ax"),
        F.col("y1").alias("ay"),
        F.col("x2").alias("bx"),
        F.col("y2").alias("by"),
        F.lit(1).alias("n"),
    ).withColumnsRenamed({"x9": "x1", "y9": "y1"})
    tree = build_pyramid(items)
    cells = _descend_nearest(_places(points, x, y), tree, False)
    leaf = tree.items.select(F.col("cx").alias("gx"), F.col("cy").alias("gy"), "ax", "ay", "bx", "by")
    border = (
        cells.join(leaf, ["gx", "gy"])
        .groupBy("px", "py")
        .agg(F.min(segment_distance("px", "py", "ax", "ay", "bx", "by")).alias(name))
    )
    out = _back(points, border, x, y)
    inside = assign_zone(out, polygons, zone, x, y, cell)
    return inside.withColumn(name, F.when(F.col("match_count") > 0, F.lit(0.0)).otherwise(F.col(name))).drop(
        f"assigned_{zone}", "match_count"
    )


def coverage_kpis(pois: DataFrame, distance: str = "nearest_m") -> DataFrame:
    """Share of points of interest within 250 and 500 m, and their number."""
    return pois.agg(
        F.count(F.lit(1)).alias("poi_count"),
        (F.lit(100.0) * F.avg((F.col(distance) <= 250).cast("int"))).alias("within_250m_pct"),
        (F.lit(100.0) * F.avg((F.col(distance) <= 500).cast("int"))).alias("within_500m_pct"),
    )


def asymmetric_pairs(matrix: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Ordered pairs of a long distance matrix whose two directions differ."""
    back = matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("distance_m").alias("__d"))
    return matrix.join(back, ["i", "j"]).agg(
        F.count_if(F.abs(F.col("distance_m") - F.col("__d")) > tolerance).alias("asymmetric_pairs")
    )
