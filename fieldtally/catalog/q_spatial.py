"""Spatial operations over the derived bin, zone and point-of-interest coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.catalog.q_aggregates import HAVERSINE_SQL
from fieldtally.catalog.registry import query
from fieldtally.operators import spatial as sp
from fieldtally.operators.ordering import exact_quantiles
from fieldtally.session import cut_lineage

CENTER = (80.2707, 13.0827)


@query(
    "J1",
    f"""SELECT bin_id, {HAVERSINE_SQL.format(lat1=CENTER[1], lon1=CENTER[0], lat2="latitude", lon2="longitude")} AS center_m
        FROM bin_dim""",
    "center_m",
    digits=3,
)
def _(w):
    return w.dim_bin.select(
        "bin_id", sp.haversine_m(F.lit(CENTER[0]), F.lit(CENTER[1]), "longitude", "latitude").alias("center_m")
    )


# Krueger's series in n = f / (2 - f): an independent form of the projection
UTM_SQL = """SELECT bin_id,
       500000 + 0.9996e0 * 6.367449145823415e6 * (e + 8.377318206244698e-4 * cos(2 * z) * sinh(2 * e)
         + 7.608527773572307e-7 * cos(4 * z) * sinh(4 * e) + 1.197645503329453e-9 * cos(6 * z) * sinh(6 * e)) AS easting,
       0.9996e0 * 6.367449145823415e6 * (z + 8.377318206244698e-4 * sin(2 * z) * cosh(2 * e)
         + 7.608527773572307e-7 * sin(4 * z) * cosh(4 * e) + 1.197645503329453e-9 * sin(6 * z) * cosh(6 * e)) AS northing
       FROM (SELECT bin_id, atan2(t, cos(l)) AS z, atanh(sin(l) / sqrt(1 + t * t)) AS e
             FROM (SELECT bin_id, l, sinh(atanh(sin(p)) - 8.181919084262149e-2 * atanh(8.181919084262149e-2 * sin(p))) AS t
                   FROM (SELECT bin_id, radians(latitude) AS p, radians(longitude - 81) AS l FROM bin_dim)))"""


@query("J2", UTM_SQL, "easting northing", digits=2)
def _(w):
    east, north = sp.to_utm("longitude", "latitude", 44)
    return w.dim_bin.select("bin_id", east.alias("easting"), north.alias("northing"))


@query(
    "J3",
    """SELECT zone_id, count(*) AS bins, count(*) FILTER (WHERE longitude BETWEEN 80.2 AND 80.3 AND latitude BETWEEN 13 AND 13.2)
              AS inside FROM bin_dim GROUP BY 1""",
)
def _(w):
    inside = sp.in_bbox("longitude", "latitude", (80.2, 13.0, 80.3, 13.2))
    return w.dim_bin.groupBy("zone_id").agg(F.count(F.lit(1)).alias("bins"), F.count_if(inside).alias("inside"))


@query(
    "J4",
    """SELECT poi_id, min(zone_id) AS assigned_zone_id, count(zone_id) AS match_count FROM poi_xy LEFT JOIN zone_dim
       ON longitude BETWEEN min_lon AND max_lon AND latitude BETWEEN min_lat AND max_lat GROUP BY 1""",
)
def _(w):
    out = sp.assign_zone(w.pois_xy, w.zone_rings)
    return out.select("poi_id", "assigned_zone_id", "match_count")


@query(
    "J5",
    """SELECT zone_id, min_lon, min_lat, max_lon, max_lat, (max_lon - min_lon) * (max_lat - min_lat) AS area,
              (min_lon + max_lon) / 2 AS map_longitude, (min_lat + max_lat) / 2 AS map_latitude FROM zone_dim""",
    "min_lon min_lat max_lon max_lat area map_longitude map_latitude",
)
def _(w):
    return sp.polygon_measures(w.zone_rings, utm_zone=None).drop("rings", "city_id")


PAIR = "sqrt(pow(b.x - p.x, 2) + pow(b.y - p.y, 2))"


@query(
    "J6",
    f"""SELECT poi_id, min(d) AS nearest_m, min(bin_id) FILTER (WHERE d = m) AS nearest_id FROM (
          SELECT *, min(d) OVER (PARTITION BY poi_id) AS m FROM (
            SELECT p.poi_id, b.bin_id, {PAIR} AS d FROM poi_xy p, bin_xy b)) GROUP BY 1""",
    "nearest_m",
    digits=3,
)
def _(w):
    return sp.nearest(w.pois_xy, w.bins_xy, "bin_id").select("poi_id", "nearest_m", "nearest_id")


@query(
    "J7",
    f"""SELECT p.bin_id, min({PAIR}) AS nearest_other_m FROM bin_xy p JOIN bin_xy b ON b.bin_id <> p.bin_id GROUP BY 1""",
    "nearest_other_m",
    digits=3,
)
def _(w):
    return sp.nearest_other(w.bins_xy, "bin_id").select("bin_id", "nearest_other_m")


@query(
    "J8",
    f"""SELECT p.bin_id, count(b.poi_id) AS pois_within_500m FROM bin_xy p LEFT JOIN poi_xy b ON {PAIR} <= 500 GROUP BY 1""",
)
def _(w):
    return sp.count_within(w.bins_xy, w.pois_xy, 500.0, name="pois_within_500m").select("bin_id", "pois_within_500m")


@query(
    "J9",
    """SELECT poi_id, min(sqrt(pow(greatest((min_lon - 80) * 108000.0 - x, 0, x - (max_lon - 80) * 108000.0), 2)
              + pow(greatest((min_lat - 12) * 110600.0 - y, 0, y - (max_lat - 12) * 110600.0), 2))) AS nearest_polygon_m
       FROM poi_xy, zone_dim WHERE CAST(zone_id AS INTEGER) % 3 = 0 GROUP BY 1""",
    "nearest_polygon_m",
    digits=3,
)
def _(w):
    """Every third zone stands for residential land."""
    metres = lambda p: F.struct(
        ((p["lon"] - 80.0) * 108000.0).alias("lon"), ((p["lat"] - 12.0) * 110600.0).alias("lat")
    )
    land = w.zone_rings.where(F.col("zone_id").cast("int") % 3 == 0).withColumn(
        "rings", F.transform("rings", lambda r: F.transform(r, metres))
    )
    return sp.nearest_polygon_m(w.pois_xy, land).select("poi_id", "nearest_polygon_m")


@query(
    "J10",
    f"""SELECT bin_id, snap_m <= 400 AS network_accessible, coalesce(r <= 60 AND snap_m <= 400, FALSE) AS in_routing_pilot FROM (
          SELECT *, row_number() OVER (PARTITION BY snap_m <= 400 ORDER BY center_m, bin_id) AS r FROM (
            SELECT p.bin_id, min({PAIR}) AS snap_m,
                   min({HAVERSINE_SQL.format(lat1=CENTER[1], lon1=CENTER[0], lat2="p.latitude", lon2="p.longitude")}) AS center_m
            FROM bin_xy p, poi_xy b GROUP BY 1))""",
)
def _(w):
    """Access within 400 m of a mapped place; the pilot is the 60 nearest accessible bins."""
    snapped = cut_lineage(sp.nearest(w.bins_xy, w.pois_xy, "poi_id", distance="snap_m", target="node_id"))
    flagged = sp.flag_access(snapped, "snap_m", 400)
    pilot = sp.k_nearest_to(flagged.where("network_accessible"), *CENTER, 60, "bin_id").select(
        "bin_id", F.lit(True).alias("in_routing_pilot")
    )
    return flagged.join(F.broadcast(pilot), "bin_id", "left").select(
        "bin_id", "network_accessible", F.coalesce("in_routing_pilot", F.lit(False)).alias("in_routing_pilot")
    )


@query(
    "J11",
    f"""SELECT count(*) AS poi_count, 100.0 * avg(CAST(d <= 250 AS INTEGER)) AS within_250m_pct,
               100.0 * avg(CAST(d <= 500 AS INTEGER)) AS within_500m_pct, median(d) AS median_nearest_m,
               quantile_cont(d, 0.95) AS p95_nearest_m
        FROM (SELECT poi_id, min({PAIR}) AS d FROM poi_xy p, bin_xy b GROUP BY 1)""",
    "within_250m_pct within_500m_pct median_nearest_m p95_nearest_m",
    digits=3,
)
def _(w):
    near = cut_lineage(sp.nearest(w.pois_xy, w.bins_xy, "bin_id").select("poi_id", "nearest_m"))
    shares = sp.coverage_kpis(near).withColumn("__one", F.lit(1))
    quants = exact_quantiles(near, [], "nearest_m", {"median_nearest_m": 0.5, "p95_nearest_m": 0.95})
    return shares.join(quants.withColumn("__one", F.lit(1)), "__one").drop("__one")


@query(
    "J11_asymmetry",
    """SELECT count(*) AS asymmetric_pairs FROM
         (SELECT l_suppkey AS i, l_partkey % 100 AS j, sum(l_quantity) AS d FROM lineitem GROUP BY 1, 2) a
       JOIN (SELECT l_suppkey AS i, l_partkey % 100 AS j, sum(l_quantity) AS d FROM lineitem GROUP BY 1, 2) b
       ON a.i = b.j AND a.j = b.i WHERE abs(a.d - b.d) > 1""",
)
def _(w):
    """Supplier-to-part-group quantities read as a directed matrix."""
    matrix = w.table("lineitem").groupBy(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 100).alias("j")).agg(
        F.sum("l_quantity").alias("distance_m")
    )
    return sp.asymmetric_pairs(matrix)


@query(
    "J12",
    "SELECT zone_id, (min_lon + max_lon) / 2 AS longitude, (min_lat + max_lat) / 2 AS latitude FROM zone_dim",
    "longitude latitude",
)
def _(w):
    point = sp.representative_point(F.col("rings")[0])
    return w.zone_rings.select("zone_id", point.alias("p")).select(
        "zone_id", F.col("p.lon").alias("longitude"), F.col("p.lat").alias("latitude")
    )


@query(
    "J13",
    """SELECT hotspot, count(*) AS bins FROM (SELECT bin_id, CASE WHEN n >= 200 THEN 'high' WHEN n >= 100 THEN 'medium'
                                                                   ELSE 'low' END AS hotspot
         FROM (SELECT bin_id, count(*) FILTER (WHERE overflow_l_simulated > 0) AS n FROM binday GROUP BY 1)) GROUP BY 1""",
)
def _(w):
    days = w.bin_day.groupBy("bin_id").agg(F.count_if(F.col("overflow_l_simulated") > 0).alias("n"))
    return days.groupBy(sp.hotspot_class("n").alias("hotspot")).agg(F.count(F.lit(1)).alias("bins"))


@query(
    "C12",
    """SELECT zone_id, count(*) AS pois, avg(d) AS mean_nearest_m FROM (
         SELECT poi_id, min(sqrt(pow(b.x - p.x, 2) + pow(b.y - p.y, 2))) AS d, min(p.longitude) AS longitude, min(p.latitude) AS latitude
         FROM poi_xy p, bin_xy b GROUP BY 1)
       JOIN zone_dim ON longitude BETWEEN min_lon AND max_lon AND latitude BETWEEN min_lat AND max_lat GROUP BY 1""",
    "mean_nearest_m",
    digits=3,
)
def _(w):
    """Spatial joins together: containing zone and nearest bin of every point of interest."""
    near = sp.nearest(w.pois_xy, w.bins_xy, "bin_id")
    placed = sp.assign_zone(near, w.zone_rings).where(F.col("match_count") > 0)
    return placed.groupBy(F.col("assigned_zone_id").alias("zone_id")).agg(
        F.count(F.lit(1)).alias("pois"), F.avg("nearest_m").alias("mean_nearest_m")
    )
