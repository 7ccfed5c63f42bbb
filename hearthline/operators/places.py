"""Points, boxes and polygons: containment, nearness and visible parts, on plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geo
from ..session import cut_lineage
from . import search_tree as ST
from . import shapes as SH
from .shapes import M_PER_DEG, nearest_polygon, point_in_polygon  # noqa: F401


# --- points in boxes ---------------------------------------------------------

def plain_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes as plain envelopes w, s, e, n; one across the antimeridian becomes two."""
    parts = geo.box_parts(F.col("west"), F.col("south"), F.col("east"), F.col("north"))
    return boxes.withColumn("_p", F.explode(parts)).select(*boxes.columns, "_p.w", "_p.s", "_p.e", "_p.n")


def box_join(points: DataFrame, boxes: DataFrame, keys: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Pairs of a point and a box (w, s, e, n) that holds it, with equal `keys`.

    Every box is cut into a few cells of about its own size; a point gets one cell per size that
    occurs, so neither side is compared with everything.
    """
    size = F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s"), F.lit(1e-6))
    level = F.least(F.lit(9), F.ceil(F.log2(size))).cast("int")
    edge = F.pow(F.lit(2.0), F.col("_level"))
    cells = F.flatten(F.transform(
        F.sequence(F.floor(F.col("w") / edge), F.floor(F.col("e") / edge)), lambda x: F.transform(
            F.sequence(F.floor(F.col("s") / edge), F.floor(F.col("n") / edge)), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    placed = boxes.withColumn("_level", level)
    levels = placed.agg(F.collect_set("_level")).scalar()  # at most a few dozen sizes
    placed = placed.withColumn("_cell", F.explode(cells))
    spread = points.withColumn("_level", F.explode(levels)).withColumn(
        "_cell", F.struct(F.floor(F.col(lon) / edge).alias("x"), F.floor(F.col(lat) / edge).alias("y")))
    inside = F.col(lon).between(F.col("w"), F.col("e")) & F.col(lat).between(F.col("s"), F.col("n"))
    return spread.join(placed, [*keys, "_level", "_cell"]).where(inside).drop("_level", "_cell")


# --- shapes (see `shapes.py`) ---------------------------------------------------

def polygon_in_view(boxes: DataFrame, shapes: DataFrame) -> DataFrame:
    """Shapes that meet a box: visible area (square degrees) and a point inside the visible part."""
    seen = SH.polygon_in_view(_numbered(boxes), shapes)
    # the two parts of a box across the antimeridian are one view
    point = F.max_by(F.struct("lat", "lon"), F.when(F.col("lat").isNotNull(), F.struct("visible_area", "lon")))
    out = seen.groupBy("box_id.box_id", "shape_id").agg(F.round(F.sum("visible_area"), 12).alias("visible_area"), point.alias("p"))
    return out.select("box_id", "shape_id", "visible_area", "p.lat", "p.lon")


def box_country(boxes: DataFrame, shapes: DataFrame) -> DataFrame:
    """Shape with the largest share of each box."""
    area = SH.visible_area(_numbered(boxes), shapes).groupBy("box_id.box_id", "shape_id").agg(F.round(F.sum("visible_area"), 12).alias("a"))
    return area.groupBy("box_id").agg(F.max(F.struct("a", "shape_id")).alias("b")).select("box_id", "b.shape_id", F.col("b.a").alias("overlap"))


def _numbered(boxes: DataFrame) -> DataFrame:
    """Plain envelopes, their id made of the box and the part's left side."""
    plain = plain_boxes(boxes.select("box_id", "west", "south", "east", "north"))
    return plain.select(F.struct("box_id", F.col("w").alias("part")).alias("box_id"), "w", "s", "e", "n")


# --- nearest postcode --------------------------------------------------------

def knn_postcode(points: DataFrame, gazetteer: DataFrame, limit_m: float = K.REGION_MATCH_M) -> DataFrame:
    """Point -> nearest live postcode within the limit: one descent in a tree of the positions, then one join.

    Of several postcodes at one distance the first by name is taken. Points without a position have no postcode.
    """
    day = F.lit("2000-01-01").cast("date")
    everywhere = F.lit("any").alias("country")
    # one postcode per distinct position is enough
    live = gazetteer.where("status = 'live' AND uk_country IS NOT NULL").groupBy("lat", "lon").agg(F.min(F.struct("postcode", "uk_country")).alias("p"))
    none = F.lit(None).cast("double")
    tree = ST.build(live.select(everywhere, "lat", "lon", F.col("p.postcode").alias("sale_key"), F.lit(None).cast("long").alias("property_id"), none.alias("price"),
                                day.alias("transaction_date"), F.lit("postcode").alias("property_type"), none.alias("floor_area"), F.col("p.uk_country").alias("district")), 1)
    places = points.where("lat IS NOT NULL AND lon IS NOT NULL").select(
        F.col("point_id").alias("place"), everywhere, F.lit(ST.ANY).alias("want"), "lat", "lon",
        F.array(F.struct(day.alias("date_from"), day.alias("date_to"))).alias("spans"), F.lit(0).cast("long").alias("own_sales"))
    leaves = ST.leaves_in_reach(places, tree, limit_m, 1, (limit_m,), 1)
    d = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("sale_lat"), F.col("sale_lon"))
    near = leaves.select("place", "country", "node", "lat", "lon").join(tree.sites, ["country", "node"]).select("place", d.alias("d"), F.get("sales", F.lit(0)).alias("s"))
    best = near.groupBy("place").agg(F.min(F.when(F.col("d") <= limit_m, F.struct("d", "s.sale_key", "s.sale_district"))).alias("v"))
    return best.where("v IS NOT NULL").select(F.col("place").alias("point_id"), F.col("v.sale_key").alias("postcode"), F.col("v.sale_district").alias("uk_country"), F.col("v.d").alias("distance_m"))


def on_island() -> Column:
    """Whether a position is inside the island's envelope."""
    w, s, e, n = K.NI_ENVELOPE
    return F.col("lon").between(w, e) & F.col("lat").between(s, n)


def knn_postcode_apart(points: DataFrame, gazetteer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`knn_postcode` of all points and of those off the island, from one search that is stored."""
    apart = points.withColumn("point_id", F.struct("point_id", on_island().alias("island")))
    found = cut_lineage(knn_postcode(apart, gazetteer)).select("point_id.*", "postcode", "uk_country", "distance_m")
    # rows that share an id may lie on both sides
    best = found.groupBy("point_id").agg(F.min(F.struct("distance_m", "postcode", "uk_country")).alias("v"))
    return best.select("point_id", "v.postcode", "v.uk_country", "v.distance_m"), found.where("NOT island").drop("island")


def uk_region(points: DataFrame, gazetteer: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Region code and name of a point: the island by its envelope, else by the nearest postcode.

    `near` may hold the nearest postcodes of the points off the island where they are known already.
    """
    island = on_island()
    near = knn_postcode(points.where(~island), gazetteer) if near is None else near
    code = F.create_map(*[F.lit(x) for kv in K.UK_REGION_CODES.items() for x in kv])
    unknown = F.lit("GB-UNKNOWN")
    by_name = F.when(F.col("uk_country").isin(K.UK_COVERED), F.lit(None).cast("string")).otherwise(F.coalesce(F.try_element_at(code, "uk_country"), unknown))
    rows = points.select("point_id", "lat", "lon").join(near, "point_id", "left")
    return rows.select("point_id", F.when(island, "GB-NIR").when(F.col("uk_country").isNull(), unknown).otherwise(by_name).alias("region_code"),
                       F.when(island, "Northern Ireland").otherwise(F.coalesce("uk_country", F.lit("an area with no postcode coverage"))).alias("region_name"))


def jurisdiction(points: DataFrame, countries: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Point -> country (containing, else nearest within the coast tolerance) and sub-national region."""
    inside = point_in_polygon(points, countries)
    outside = points.join(inside, "point_id", "left_anti")
    near = nearest_polygon(outside, countries).select("point_id", "shape_id")
    out = inside.unionByName(near).withColumnRenamed("shape_id", "country")
    if regions is None:
        return out
    part = point_in_polygon(points, regions).withColumnRenamed("shape_id", "region_code")
    return out.join(part, "point_id", "left")


def area_contains(points: DataFrame, stats: DataFrame) -> DataFrame:
    """Point -> most local area whose extent holds it, within the point's country.

    Segments and years share extents, of which the latest year stands for all; the finest level wins, then the latest year, then the code.
    """
    rank = F.array_position(F.array(*map(F.lit, ("sector", "outcode", "district", "county", "country"))), F.col("area_level"))
    boxes = stats.where("west IS NOT NULL").groupBy("country", "area_level", "area_code", F.col("west").alias("w"), F.col("south").alias("s"),
                                                    F.col("east").alias("e"), F.col("north").alias("n")).agg(F.max("year").alias("year"))
    hits = box_join(points.select("point_id", "country", "lat", "lon"), boxes, ["country"])
    best = F.min_by(F.struct("area_level", "area_code"), F.struct(rank, -F.col("year"), "area_code"))
    return hits.groupBy("point_id", "country").agg(best.alias("a")).select("point_id", "country", "a.*")
