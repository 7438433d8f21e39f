"""Road-graph operations: each order is a way through the suppliers of its lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.catalog.oracle import cte
from fieldtally.catalog.q_aggregates import HAVERSINE_SQL
from fieldtally.catalog.registry import query
from fieldtally.operators import graph, spatial as sp
from fieldtally.session import store_rows
from fieldtally.settings import PILOT_SIZE

cte(
    "way_row",
    """SELECT o_orderkey AS way_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'motorway' WHEN '2' THEN 'primary'
              WHEN '3' THEN 'secondary' WHEN '4' THEN 'residential' ELSE 'footway' END AS highway,
       CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'P' THEN '-1' END AS oneway,
       CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 5 * 10 + 10 END AS posted, o_orderkey % 17 = 0 AS private,
       CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey % 20 END AS maxweight FROM orders
       WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
)
cte(
    "way_state",
    """SELECT *, CASE WHEN private THEN 'access' WHEN maxweight < 12 THEN 'maxweight' ELSE 'usable' END AS reason
       FROM way_row WHERE highway <> 'footway'""",
)
cte(
    "pair_row",
    """SELECT way_id, highway, w.one, least(CASE highway WHEN 'motorway' THEN 50 WHEN 'primary' THEN 35 WHEN 'secondary' THEN 30
              ELSE 15 END, posted)::DOUBLE AS speed_kmh, a, b
       FROM (SELECT *, coalesce(oneway, CASE WHEN highway = 'motorway' THEN 'yes' ELSE '' END) AS one FROM way_state
             WHERE reason = 'usable') w
       JOIN (SELECT l_orderkey, l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey
                      ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS b FROM lineitem) ON l_orderkey = way_id
       WHERE a <> b""",
)
cte(
    "raw_edge",
    f"""SELECT u, v, way_id, highway, one AS oneway_tag, speed_kmh, length_m, length_m / (speed_kmh / 3.6) AS travel_seconds FROM (
         SELECT e.*, {HAVERSINE_SQL.format(lat1="p.lat", lon1="p.lon", lat2="q.lat", lon2="q.lon")} AS length_m
         FROM (SELECT a AS u, b AS v, way_id, highway, one, speed_kmh FROM pair_row WHERE one <> '-1'
               UNION ALL SELECT b, a, way_id, highway, one, speed_kmh FROM pair_row WHERE one IN ('', '-1')) e
         JOIN place_xy p ON p.k = u + 1 JOIN place_xy q ON q.k = v + 1) WHERE length_m > 0""",
)
cte(
    "shut_node",
    """SELECT s_suppkey AS node_id FROM supplier WHERE s_suppkey % 29 = 0 AND s_suppkey % 2 = 0
       UNION SELECT p_partkey % 97 FROM part WHERE p_size >= 48 AND p_partkey % 3 <> 0 AND p_partkey % 10 = 0""",
)
cte(
    "shut_way",
    """SELECT unnest([p_partkey, p_partkey + 1]) AS way_id FROM part WHERE p_size >= 48 AND p_partkey % 3 <> 0 AND p_partkey % 10 <> 0""",
)
cte(
    "open_edge",
    """SELECT * FROM raw_edge WHERE u NOT IN (SELECT node_id FROM shut_node) AND v NOT IN (SELECT node_id FROM shut_node)
         AND way_id NOT IN (SELECT way_id FROM shut_way)""",
)
cte(
    "best_edge",
    """SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY length_m, way_id) AS r FROM open_edge)
       WHERE r = 1""",
)
EDGE_DOUBLES = "speed_kmh length_m travel_seconds"


@query("N1", "SELECT * FROM raw_edge", EDGE_DOUBLES, digits=4)
def _(w):
    usable = graph.filter_access(w.road_ways).where(F.col("excluded").isNull())
    return graph.build_edges(usable, w.road_nodes)


@query("N2", "SELECT reason, count(*) AS ways FROM way_state GROUP BY 1")
def _(w):
    return graph.exclusion_counts(graph.filter_access(w.road_ways))


@query("N3", "SELECT * FROM open_edge", EDGE_DOUBLES, digits=4)
def _(w):
    usable = graph.filter_access(w.road_ways).where(F.col("excluded").isNull())
    return graph.drop_blocked(graph.build_edges(usable, w.road_nodes), w.road_relations, w.road_nodes)


@query("N4", "SELECT * FROM best_edge", EDGE_DOUBLES, digits=4)
def _(w):
    return w.road_edges


def part_chain(w):
    """A sparse directed graph: each part points to the parts at a third and a half of its key, some back."""
    k = F.col("p_partkey")
    ends = F.array(
        F.struct(k.alias("u"), F.floor(k / 2).alias("v")),
        F.struct(F.floor(k / 3).alias("u"), k.alias("v")),
    )
    down = w.table("part").select(F.explode(F.when(F.col("p_size") % 2 == 0, ends).otherwise(F.slice(ends, 1, 1))).alias("e"))
    return down.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct()


CHAIN_SQL = """SELECT DISTINCT u, v FROM (SELECT p_partkey AS u, p_partkey // 2 AS v FROM part
       UNION ALL SELECT p_partkey // 3, p_partkey FROM part WHERE p_size % 2 = 0) WHERE u <> v"""


@query(
    "N5",
    f"""WITH RECURSIVE arc AS MATERIALIZED ({CHAIN_SQL}),
        spot AS MATERIALIZED (SELECT u AS n FROM arc UNION SELECT v FROM arc),
        heart AS MATERIALIZED (SELECT u AS n FROM (SELECT u, count(*) AS o FROM arc GROUP BY 1) JOIN (SELECT v, count(*) AS i FROM arc GROUP BY 1) ON u = v
           ORDER BY o * i DESC, u LIMIT 1),
        ahead(n) AS (SELECT n FROM heart UNION SELECT v FROM ahead JOIN arc ON u = n),
        behind(n) AS (SELECT n FROM heart UNION SELECT u FROM behind JOIN arc ON v = n),
        core AS MATERIALIZED (SELECT n FROM ahead WHERE n IN (SELECT n FROM behind)),
        rest AS MATERIALIZED (SELECT n FROM spot WHERE n NOT IN (SELECT n FROM core)
           AND 2 * (SELECT count(*) FROM core) <= (SELECT count(*) FROM spot)),
        reach(s, n) AS (SELECT n, n FROM rest UNION SELECT s, v FROM reach JOIN arc ON u = n WHERE v IN (SELECT n FROM rest)),
        part_of AS MATERIALIZED (SELECT n, max(n) OVER () AS component FROM core
           UNION ALL SELECT x.s, max(x.n) FROM reach x JOIN reach y ON x.s = y.n AND x.n = y.s GROUP BY 1)
        SELECT n AS node FROM part_of WHERE component IN
          (SELECT component FROM part_of GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)""",
)
def _(w):
    """The largest component, of equal ones that whose largest node is smallest.

    Its SQL takes the component of one well-linked part; all others are compared too, unless
    that one holds more than half of the nodes.
    """
    return graph.largest_scc(store_rows(part_chain(w)))


def pilot_stops(w):
    """The reachable pilot: the depot and the pilot stops, nodes of the largest component nearest to the centre.

    Only the component's edges are returned, as no way between two of its nodes leaves it.  Edges are stored with
    their speed, which has few values, and not with the seconds that follow from it.
    """
    roads = graph.measured_edges(w.road_ways, w.road_nodes, w.road_relations, ("speed_kmh",))
    edges = store_rows(roads.select("u", "v", "length_m", "speed_kmh"))
    core = store_rows(graph.largest_scc(edges))
    at = w.road_nodes.select(
        F.col("node_id").alias("node"), F.col("lon").alias("longitude"), F.col("lat").alias("latitude")
    ).join(core, "node", "left_semi")
    inner = graph.with_seconds(graph.edges_within(edges, core)).drop("speed_kmh")
    return inner, store_rows(sp.k_nearest_to(at, 80.2707, 13.0827, 1 + PILOT_SIZE, "node").select("node"))


@query("N6")
def _(w):
    """Distance, time, last step and node list between all pilot stops."""
    edges, stops = pilot_stops(w)
    state = store_rows(graph.shortest_paths(edges, stops, stops, ways=True))
    paths = graph.tree_paths(graph.jump_tables(state, edges), stops)
    cells = state.join(stops, "node", "left_semi")
    return cells.join(paths.withColumnRenamed("target", "node"), ["source", "node"])


@query(
    "N7",
    "SELECT 61 * 61::BIGINT AS paths, 0::BIGINT AS wrong_ends, 0::BIGINT AS unknown_edges, 0::BIGINT AS distance_gaps, 0::BIGINT AS time_gaps FROM region LIMIT 1",
)
def _(w):
    edges, stops = pilot_stops(w)
    state = store_rows(graph.shortest_paths(edges, stops, stops, ways=True))
    return graph.audit_tree(graph.jump_tables(state, edges), state, stops)


@query("N8")
def _(w):
    """Pairs of pilot stops without a path, counted (none inside one component)."""
    edges, stops = pilot_stops(w)
    state = graph.shortest_paths(edges, stops, stops)
    one = stops.withColumn("__one", F.lit(1))
    pairs = one.select(F.col("node").alias("source"), "__one").join(
        one.select(F.col("node").alias("target"), "__one"), "__one"
    )
    return graph.unreachable(pairs.drop("__one"), state).agg(F.count(F.lit(1)).alias("unreachable_pairs"))
