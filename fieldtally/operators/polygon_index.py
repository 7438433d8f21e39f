"""Cell index of polygons: cells marked inside or edge; a missing cell is outside.

An edge of a polygon is listed under the cells that it passes, and nowhere else, so
a polygon of many vertices is spread over its cells, never copied into each.  Beside
its own edges an edge cell holds a parity seed: whether an odd number of the polygon's other
edges cross the vertical line through the cell's right border above it.  With the seed, the
even-odd rule at a point needs the cell's edges alone:

* the ray from the point to the right crosses, inside the cell, edges of the cell only;
* what it crosses beyond the border has the same parity as the crossings of the border
  line above the ray, since a closed ring that enters the quadrant right of the border
  and above the ray also leaves it.

Each edge enters the quadrant by the same computed crossing, whichever of its two borders
it is asked for, so rounding cannot make the two disagree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PAD = 1e-6  # of a cell: edges this close to a border are listed on both sides
TOUCH = 1e-12  # twice the area between point and edge that still counts as touching


def crossing(e, y) -> Column:
    """Where the edge's line meets height ``y`` (null for a level edge)."""
    return (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]


def touches(e, x, y) -> Column:
    turn = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    return (
        (F.abs(turn) <= TOUCH)
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )


def cell_contains(edges: Column, seed: Column, right: Column, x: Column, y: Column) -> Column:
    """Even-odd test in an edge cell; a point on an edge counts as inside."""

    def flips(e):
        level = (e["y1"] > y) != (e["y2"] > y)
        upright = (e["x1"] >= right) != (e["x2"] >= right)
        at = crossing(e, y)
        rising = (e["x2"] > e["x1"]) == (e["y2"] > e["y1"])
        above = F.when(level, rising != (at >= right)).otherwise(e["y1"] > y)
        to_border = level & ((x < at) != (at >= right))
        return F.coalesce(to_border, F.lit(False)) != F.coalesce(upright & above, F.lit(False))

    return F.aggregate(edges, seed, lambda acc, e: acc != flips(e)) | F.exists(edges, lambda e: touches(e, x, y))


def cell_side(shapes: DataFrame) -> float:
    """Side at which the cells of all bounding boxes are about as many as the edges.

    The index is then linear in its input.  One row of three totals comes to the driver.
    """
    e = lambda f, g: g(F.transform("edges", lambda s: g(F.array(s[f + "1"], s[f + "2"]))))
    wide = e("x", F.array_max) - e("x", F.array_min)
    high = e("y", F.array_max) - e("y", F.array_min)
    t = shapes.agg(
        F.sum(wide * high).alias("area"), F.max(F.greatest(wide, high)).alias("span"), F.sum(F.size("edges")).alias("n")
    ).first()
    if not t["n"] or not t["span"]:
        return 1.0  # nothing, or single points
    return max((t["area"] / t["n"]) ** 0.5, t["span"] / t["n"])


def _columns(edges: DataFrame, side: float) -> DataFrame:
    """Each edge once per grid column it passes, with its rows there."""
    lo_x, hi_x = F.least("e.x1", "e.x2"), F.greatest("e.x1", "e.x2")
    lo_y, hi_y = F.least("e.y1", "e.y2"), F.greatest("e.y1", "e.y2")
    cut = edges.select(
        "*", F.explode(F.sequence(F.floor(lo_x / side - PAD), F.floor(hi_x / side + PAD))).alias("gx")
    )
    dx, dy = F.col("e.x2") - F.col("e.x1"), F.col("e.y2") - F.col("e.y1")
    slope = dy / F.nullif(dx, F.lit(0.0))
    # the line's height at both ends of the edge's part in this column, widened by what
    # touching and rounding allow; a nearly upright edge takes all its rows
    left = F.greatest(lo_x, (F.col("gx") - PAD) * side)
    right = F.least(hi_x, (F.col("gx") + 1 + PAD) * side)
    slack = (
        F.lit(TOUCH) / F.abs(dx)
        + F.abs(slope) * (F.abs("e.x1") + F.abs("e.x2")) * 1e-15
        + (F.abs("e.y1") + F.abs("e.y2")) * 1e-15
    )
    ya, yb = (F.col("e.y1") + (x - F.col("e.x1")) * slope for x in (left, right))
    upright = F.abs(dx) < PAD * side
    low = F.when(upright, lo_y).otherwise(F.greatest(lo_y, F.least(ya, yb) - slack))
    high = F.when(upright, hi_y).otherwise(F.least(hi_y, F.greatest(ya, yb) + slack))
    border = (F.col("gx") + 1) * F.lit(side)
    return cut.select(
        *edges.columns,
        "gx",
        F.floor(low / side - PAD).alias("bottom"),
        F.floor(high / side + PAD).alias("top"),
        ((F.col("e.x1") >= border) != (F.col("e.x2") >= border)).alias("spans"),
    )


def build_index(shapes: DataFrame, keys: list[str], side: float) -> DataFrame:
    """Cells of shapes (``keys`` and ``edges``, closed): gx, gy, keys, edges (null inside), seed.

    One shuffle, by shape and grid column; a column's cells are ordered from top to
    bottom, and the cells between two edge cells are inside where the seed is odd.
    """
    columns = _columns(shapes.select(*keys, F.explode("edges").alias("e")), side)
    cells = (
        columns.repartition(*keys, "gx")
        .select("*", F.explode(F.sequence("bottom", "top")).alias("gy"))
        .groupBy(*keys, "gx", "gy")
        .agg(F.collect_list("e").alias("own"), F.count_if(F.col("spans") & (F.col("gy") == F.col("bottom"))).alias("c"))
    )
    down = Window.partitionBy(*keys, "gx").orderBy(F.col("gy").desc())
    above = F.coalesce(F.sum("c").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seeded = cells.select("*", above.alias("above"), F.lead("gy").over(down).alias("below"))
    odd = lambda c: c % 2 == 1
    gap = odd(F.col("above") + F.col("c")) & (F.col("below") < F.col("gy") - 1)
    none = F.lit(None).cast(cells.schema["own"].dataType)
    cell = lambda gy, own, seed: F.struct(gy.alias("gy"), own.alias("edges"), seed.alias("seed"))
    inner = F.when(
        gap, F.transform(F.sequence(F.col("below") + 1, F.col("gy") - 1), lambda g: cell(g, none, F.lit(True)))
    )
    edge = F.array(cell(F.col("gy"), F.col("own"), odd(F.col("above"))))
    listed = F.concat(edge, F.coalesce(inner, F.slice(edge, 1, 0)))
    return seeded.select(*keys, "gx", F.explode(listed).alias("__cell")).select(*keys, "gx", "__cell.*")


def containing(places: DataFrame, index: DataFrame, side: float, x: str = "px", y: str = "py") -> DataFrame:
    """Pairs of a place and a shape that holds it: one equi-join by cell, then the cell's own test."""
    placed = places.withColumns(
        {"gx": F.floor(F.col(x) / F.lit(side)), "gy": F.floor(F.col(y) / F.lit(side))}
    )
    border = (F.col("gx") + 1) * F.lit(side)
    inside = F.col("edges").isNull() | cell_contains(F.col("edges"), F.col("seed"), border, F.col(x), F.col(y))
    return placed.join(index, ["gx", "gy"]).where(inside).drop("gx", "gy", "edges", "seed")
