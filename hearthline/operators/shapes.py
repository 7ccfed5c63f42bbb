"""Polygons by their edges: covering cells, containment, nearness and visible parts, all in column expressions.

A shape is a set of closed rings, even-odd filled. It is covered by square cells about 1/64 of its size. Cells that an edge
crosses are boundary cells and keep those edges, together with whether their reference point is inside; cells between the
boundary cells of a row are inside as a whole. A point finds its cell by key: an inside cell answers at once, a boundary
cell moves from its reference point to the point in two straight steps and counts the edges passed. No key holds more
points than one cell, and edges travel with boundary cells only.

Visible parts of shapes come from Green's theorem: the area of a shape in a box is the signed sum, over its edges, of the
area between edge and box bottom with the height held inside the box. Edges are dealt to vertical strips, so a box meets
the edges of the strips that it covers, rings are never put together, and strips add up.

Generated arrays are never empty; `explode_outer` keeps Spark from adding a filter that repeats the whole expression.

Points on an edge belong to the shape on its upper or right side. Empty rings and edges without length are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geo

M_PER_DEG = math.pi * K.EARTH_RADIUS_M / 180
PER_SIDE = 64
REFERENCE = 0.5136718931  # place of a cell's reference point, away from round fractions
TRIALS = (0.5, 0.1327, 0.8413, 0.3129, 0.6791, 0.0411, 0.9583)  # where in a strip a point inside is looked for


def edges_of(shapes: DataFrame) -> DataFrame:
    """One row per edge of every ring."""
    rings = shapes.select("shape_id", F.explode_outer("rings").alias("r"))
    edge = F.transform("r", lambda p, i: F.struct(
        p["x"].alias("x1"), p["y"].alias("y1"), F.get("r", (i + 1) % F.size("r"))["x"].alias("x2"), F.get("r", (i + 1) % F.size("r"))["y"].alias("y2")))
    return rings.select("shape_id", F.explode(edge).alias("e")).select("shape_id", "e.*").where("x1 <> x2 OR y1 <> y2")


def shape_facts(shapes: DataFrame) -> DataFrame:
    """Area and bounding box per shape; rings of opposite direction cut holes."""
    area = F.abs(F.aggregate("rings", F.lit(0.0), lambda s, r: s + geo.ring_area2(r))) / 2
    xs, ys = (F.flatten("rings")[c] for c in ("x", "y"))
    return shapes.select("shape_id", area.alias("shape_area"), F.array_min(xs).alias("w"), F.array_min(ys).alias("s"),
                         F.array_max(xs).alias("e"), F.array_max(ys).alias("n"))


def crossed_cells(edge_deg: Column) -> Column:
    """Cells (x, y) that an edge (x1, y1, x2, y2) crosses: for each row the columns between where it enters and leaves."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")

    def at(y):
        return F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))

    def row(r):
        a, b = at(F.greatest(low, r * edge_deg)), at(F.least(high, (r + 1) * edge_deg))
        level = F.col("y1") == F.col("y2")
        left = F.when(level, F.least("x1", "x2")).otherwise(F.greatest(F.least(a, b), F.least("x1", "x2")))
        right = F.when(level, F.greatest("x1", "x2")).otherwise(F.least(F.greatest(a, b), F.greatest("x1", "x2")))
        slack = edge_deg * 1e-9  # a cell more never harms
        return F.transform(F.sequence(F.floor((left - slack) / edge_deg), F.floor((right + slack) / edge_deg)), lambda c: F.struct(c.alias("x"), r.alias("y")))
    return F.flatten(F.transform(F.sequence(F.floor(low / edge_deg), F.floor(high / edge_deg)), row))


def covering(shapes: DataFrame) -> DataFrame:
    """Cells of each shape: shape_id, shape_area, level, x, y, and for boundary cells `edges` and `inside`, that of the reference point."""
    size = F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s"), F.lit(1e-6))
    facts = shape_facts(shapes).select("shape_id", "shape_area", F.ceil(F.log2(size / PER_SIDE)).cast("int").alias("level"))
    width = F.pow(F.lit(2.0), F.col("level"))
    edges = edges_of(shapes).join(facts, "shape_id").withColumn("width", width)
    keys = ["shape_id", "shape_area", "level"]
    boundary = edges.withColumn("c", F.explode_outer(crossed_cells(F.col("width")))).groupBy(*keys, F.col("c.x").alias("x"), F.col("c.y").alias("y")).agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    # where the reference line of each row is crossed, in order
    line = (F.col("row") + REFERENCE) * F.col("width")
    rows = edges.withColumn("row", F.explode(F.sequence(F.floor(F.least("y1", "y2") / F.col("width")), F.floor(F.greatest("y1", "y2") / F.col("width"))))).where(
        (F.col("y1") > line) != (F.col("y2") > line))
    passed = rows.groupBy(*keys, F.col("row").alias("y")).agg(F.array_sort(F.collect_list(
        F.col("x1") + (line - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))).alias("xs"))
    width = F.pow(F.lit(2.0), F.col("level"))
    right = F.size(F.filter("xs", lambda x: x > (F.col("x") + REFERENCE) * width))
    marked = boundary.join(passed, [*keys, "y"], "left").select(*keys, "x", "y", "edges", (F.coalesce(right, F.lit(0)) % 2 == 1).alias("inside"))
    # spans between crossings, without the cells that the crossings themselves lie in
    spans = F.transform(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)), lambda i: F.sequence(
        F.floor(F.get("xs", i) / width) + 1, F.greatest(F.floor(F.get("xs", i + 1) / width) - 1, F.floor(F.get("xs", i) / width) + 1)))
    between = passed.where(F.size("xs") >= 2).withColumn("x", F.explode_outer(F.array_distinct(F.flatten(spans))))
    center = (F.col("x") + REFERENCE) * width
    whole = between.where(F.size(F.filter("xs", lambda x: x > center)) % 2 == 1).select(*keys, "x", "y").join(marked.select("shape_id", "x", "y"), ["shape_id", "x", "y"], "left_anti")
    return marked.unionByName(whole.select(*keys, "x", "y", F.lit(None).cast("array<struct<x1:double,y1:double,x2:double,y2:double>>").alias("edges"), F.lit(True).alias("inside")))


def _passed(edges: Column, lat: Column, lon: Column, x: Column, y: Column) -> Column:
    """Edges passed on the way from (x, y) up or down to (x, lat) and then sideways to (lon, lat)."""
    def sideways(e):
        at = e["x1"] + (lat - e["y1"]) / (e["y2"] - e["y1"]) * (e["x2"] - e["x1"])
        return ((e["y1"] > lat) != (e["y2"] > lat)) & ((lon < at) != (x < at))

    def upright(e):
        at = e["y1"] + (x - e["x1"]) / (e["x2"] - e["x1"]) * (e["y2"] - e["y1"])
        return ((e["x1"] > x) != (e["x2"] > x)) & ((lat < at) != (y < at))
    return F.size(F.filter(edges, sideways)) + F.size(F.filter(edges, upright))


def containing(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """Every (point_id, shape_id, shape_area) where the shape contains the point."""
    cells = covering(shapes)
    levels = shape_facts(shapes).select(F.ceil(F.log2(F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s"), F.lit(1e-6)) / PER_SIDE)).cast("int").alias("l"))
    levels = levels.agg(F.collect_set("l")).scalar()  # sizes from 1e-6 to 360 degrees have 30 levels at most
    width = F.pow(F.lit(2.0), F.col("level"))
    placed = points.select("point_id", "lat", "lon", F.explode(levels).alias("level")).withColumns({"x": F.floor(F.col("lon") / width), "y": F.floor(F.col("lat") / width)})
    met = placed.join(cells, ["level", "x", "y"])
    odd = _passed(F.col("edges"), F.col("lat"), F.col("lon"), (F.col("x") + REFERENCE) * width, (F.col("y") + REFERENCE) * width) % 2 == 1
    return met.where(F.col("edges").isNull() | (F.col("inside") != odd)).select("point_id", "shape_id", "shape_area")


def point_in_polygon(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """Point -> smallest shape that contains it (point_id, shape_id); no row for open water."""
    return containing(points, shapes).groupBy("point_id").agg(F.min_by("shape_id", F.struct("shape_area", "shape_id")).alias("shape_id"))


# --- nearness ----------------------------------------------------------------

def with_segment_distance(rows: DataFrame) -> DataFrame:
    """rows (lat, lon and an edge) with distance_m: metres from the point to the edge, on a plane touching the point.

    Longitudes are taken the short way round. The distance is made in steps, so that no expression repeats another.
    """
    scale = F.cos(F.radians("lat")) * M_PER_DEG
    ax, ay = (F.pmod(F.col("x1") - F.col("lon") + 180.0, F.lit(360.0)) - 180.0) * scale, (F.col("y1") - F.col("lat")) * M_PER_DEG
    rows = rows.withColumns({"ax": ax, "ay": ay, "dx": (F.col("x2") - F.col("x1")) * scale, "dy": (F.col("y2") - F.col("y1")) * M_PER_DEG})
    rows = rows.withColumn("t", -(F.col("ax") * F.col("dx") + F.col("ay") * F.col("dy")) / (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    rows = rows.withColumn("t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("t"))))
    d = F.sqrt(F.pow(F.col("ax") + F.col("t") * F.col("dx"), 2) + F.pow(F.col("ay") + F.col("t") * F.col("dy"), 2))
    return rows.withColumn("distance_m", F.round(d, 6)).drop("ax", "ay", "dx", "dy", "t")


def nearest_polygon(points: DataFrame, shapes: DataFrame, limit_m: float = K.COASTAL_TOLERANCE_M) -> DataFrame:
    """Point -> nearest shape within the limit, with the distance.

    Edges lie in the cells that they cross, of a grid whose columns run around the globe; points look into the cells that
    their circle touches.
    """
    bits = geo.bits_for(limit_m)
    width = F.lit(180.0 / (1 << bits))
    cell = F.transform(crossed_cells(width), lambda c: geo.wrapped_cell(c["y"] + F.lit(1 << (bits - 1)), c["x"] + F.lit(1 << bits), bits))
    placed = edges_of(shapes).withColumn("cell", F.explode_outer(F.array_distinct(cell)))
    looking = points.select("point_id", "lat", "lon", F.explode_outer(geo.touched_cells(F.col("lat"), F.col("lon"), limit_m, bits)).alias("cell"))
    near = with_segment_distance(looking.join(placed, "cell"))
    # the limit is kept inside the aggregate: as a filter it would be moved below the steps and written out again
    best = near.groupBy("point_id").agg(F.min(F.when(F.col("distance_m") <= limit_m, F.struct("distance_m", "shape_id"))).alias("v"))
    return best.where("v IS NOT NULL").select("point_id", "v.shape_id", "v.distance_m")


# --- visible parts -----------------------------------------------------------

def _strip_edges(shapes: DataFrame) -> DataFrame:
    """Edges in the vertical strips of their shape that they cross; strips are about 1/64 of the shape wide."""
    facts = shape_facts(shapes).select("shape_id", F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("e") - F.col("w"), F.lit(1e-6)) / PER_SIDE))).alias("step"))
    edges = edges_of(shapes).where("x1 <> x2").join(facts, "shape_id")
    strips = F.sequence(F.floor(F.least("x1", "x2") / F.col("step")), F.floor(F.greatest("x1", "x2") / F.col("step")))
    return edges.withColumn("strip", F.explode(strips))


def box_strips(boxes: DataFrame, shapes: DataFrame) -> DataFrame:
    """Boxes (box_id, w, s, e, n) with the strips of each shape that they may show part of, as left and right bounds."""
    facts = shape_facts(shapes).select("shape_id", *[F.col(c).alias(f"shape_{c}") for c in "wsen"],
                                       F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("e") - F.col("w"), F.lit(1e-6)) / PER_SIDE))).alias("step"))
    coarse = 4.0

    def cells(w, s, e, n):
        return F.explode(F.flatten(F.transform(F.sequence(F.floor(F.col(w) / coarse), F.floor(F.col(e) / coarse)), lambda x: F.transform(
            F.sequence(F.floor(F.col(s) / coarse), F.floor(F.col(n) / coarse)), lambda y: F.struct(x.alias("x"), y.alias("y"))))))
    left = boxes.withColumn("c", cells("w", "s", "e", "n"))
    right = facts.withColumn("c", cells("shape_w", "shape_s", "shape_e", "shape_n"))
    meets = (F.col("shape_w") < F.col("e")) & (F.col("shape_e") > F.col("w")) & (F.col("shape_s") < F.col("n")) & (F.col("shape_n") > F.col("s"))
    # a pair that shares several cells is kept in the first of them only
    first = (F.col("c.x") == F.greatest(F.floor(F.col("w") / coarse), F.floor(F.col("shape_w") / coarse))) & (
        F.col("c.y") == F.greatest(F.floor(F.col("s") / coarse), F.floor(F.col("shape_s") / coarse)))
    pairs = left.join(right, "c").where(meets & first)
    a, b = F.greatest("w", "shape_w"), F.least("e", "shape_e")
    strips = pairs.withColumn("strip", F.explode(F.sequence(F.floor(a / F.col("step")), F.floor(b / F.col("step")))))
    return strips.select("box_id", "w", "s", "e", "n", "shape_id", "strip", F.greatest("w", F.col("strip") * F.col("step")).alias("left"),
                         F.least("e", (F.col("strip") + 1) * F.col("step")).alias("right")).where("left < right")


def _under(ya: Column, yb: Column, low: Column, high: Column) -> Column:
    """Mean of y - low, with y held between low and high, along a straight line from ya to yb."""
    def held(y):
        return F.greatest(F.lit(0.0), F.least(y, high) - low)

    def summed(y):
        return F.when(y <= low, F.lit(0.0)).when(y <= high, F.pow(y - low, 2) / 2).otherwise(F.pow(high - low, 2) / 2 + (high - low) * (y - high))
    return F.when(F.abs(yb - ya) < 1e-12, held((ya + yb) / 2)).otherwise((summed(yb) - summed(ya)) / (yb - ya))


def visible_strips(boxes: DataFrame, shapes: DataFrame) -> DataFrame:
    """Signed visible area by box, shape and strip."""
    met = box_strips(boxes, shapes).join(_strip_edges(shapes), ["shape_id", "strip"])
    slope = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    xa, xb = F.greatest("left", F.least("x1", "x2")), F.least("right", F.greatest("x1", "x2"))
    met = met.withColumns({"xa": xa, "xb": xb}).where("xa < xb")
    ya, yb = F.col("y1") + (F.col("xa") - F.col("x1")) * slope, F.col("y1") + (F.col("xb") - F.col("x1")) * slope
    part = F.signum(F.col("x1") - F.col("x2")) * (F.col("xb") - F.col("xa")) * _under(ya, yb, F.col("s"), F.col("n"))
    return met.groupBy("box_id", "w", "s", "e", "n", "shape_id", "strip", "left", "right").agg(F.sum(part).alias("area"))


def visible_area(boxes: DataFrame, shapes: DataFrame) -> DataFrame:
    """box_id, shape_id and the visible area in square degrees, where there is any. Boxes are plain envelopes."""
    parts = visible_strips(boxes, shapes).groupBy("box_id", "shape_id").agg(F.round(F.abs(F.sum("area")), 12).alias("visible_area"))
    return parts.where("visible_area > 0")


def polygon_in_view(boxes: DataFrame, shapes: DataFrame) -> DataFrame:
    """Shapes that meet a box: visible area and a point inside the visible part.

    The point lies in the strip that shows most, in the middle of the longest upright span found on a few lines there.
    """
    strips = visible_strips(boxes, shapes)
    best = F.max_by(F.struct("s", "n", "strip", "left", "right"), F.struct(F.round(F.abs("area"), 12), -F.col("strip"), "left"))
    seen = strips.groupBy("box_id", "shape_id").agg(F.round(F.abs(F.sum("area")), 12).alias("visible_area"), best.alias("b")).where("visible_area > 0")
    lines = seen.select("box_id", "shape_id", "visible_area", "b.*").withColumn("x", F.explode(F.transform(
        F.array(*map(F.lit, TRIALS)), lambda t: F.col("left") + t * (F.col("right") - F.col("left")))))
    met = lines.join(_strip_edges(shapes), ["shape_id", "strip"]).where((F.col("x1") > F.col("x")) != (F.col("x2") > F.col("x")))
    y = F.col("y1") + (F.col("x") - F.col("x1")) / (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    keys = ["box_id", "shape_id", "visible_area", "s", "n", "x"]
    met = met.groupBy(*keys).agg(F.array_sort(F.collect_list(y)).alias("ys"))
    spans = F.transform(F.sequence(F.lit(0), F.size("ys") - 2, F.lit(2)), lambda i: F.struct(
        (F.least(F.get("ys", i + 1), F.col("n")) - F.greatest(F.get("ys", i), F.col("s"))).alias("length"),
        ((F.least(F.get("ys", i + 1), F.col("n")) + F.greatest(F.get("ys", i), F.col("s"))) / 2).alias("lat"), F.col("x").alias("lon")))
    found = met.where(F.size("ys") >= 2).withColumn("longest", F.array_max(spans)).groupBy("box_id", "shape_id").agg(F.max(F.when(F.col("longest.length") > 0, F.col("longest"))).alias("p"))
    return seen.select("box_id", "shape_id", "visible_area").join(found, ["box_id", "shape_id"], "left").select("box_id", "shape_id", "visible_area", "p.lat", "p.lon")
