"""An adaptive quadtree over evidence sites, and nearest-first descent in it for whole tables of places.

Evidence is stored once, whatever dates are asked later: a site is one point, type and pair of years with its sales sorted
by day. Cells are a dyadic grid of longitude and latitude; the columns of a level run around the globe, so cells wrap at 180
degrees. Five levels, each cell cut into 16, from about 5 km to 20 m; a cell is cut only while it holds more than `MOST`
sites. Every cell knows its sales by day (all types together and each type), as a sorted array of days with running
counts, so the sales of any window are two binary searches.

Places go down the tree together. At every level a place knows for each of its cells the least and the greatest distance
and a count that holds for all its windows at once; the distance within which these counts promise enough sales bounds its
reach, and cells beyond it are dropped. A place in an empty cell beside a town thus opens only the town's nearest cells.
Each step is an equi join with at most sixteen rows on the tree's side of a key, so no key of it is hot, and the crowd of
places on the other side can be split at will.

Sales without a position or country are no sites. Of one day at one point and type, sales beyond those that can be among
the nearest `nearest` of anyone (2 x nearest, at most `nearest` of one dwelling) are left out, which also bounds a site.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geo
from ..functions.sorted_arrays import count_up_to
from ..session import cut_lineage

ROOT_BITS, STEP_BITS, LAST = 12, 2, 4  # rows of the first level as bits, bits of a step, the last level
FINEST = ROOT_BITS + STEP_BITS * LAST
MOST = 64
BLOCK_YEARS = 2
CROWD = 500  # sales of one day at one point and type, halved, beyond which a site that keeps all is split
ANY = "*"
SALE = ("sold_date", "sale_key", "sale_property_id", "price", "sale_type", "sale_area", "sale_district")
SLACK_M = 0.001


@dataclass(frozen=True)
class SearchTree:
    """`sites`: node, country, sale_lat, sale_lon, sale_type, block, sales. `cells`: what stands below each node."""
    sites: DataFrame
    cells: DataFrame


def node_id(row: Column, col: Column, level: Column | int) -> Column:
    """One number for a cell of a level."""
    return (row * F.lit(1 << 24) + col) * F.lit(8) + (F.lit(level) if isinstance(level, int) else level)


def _finest(lat: Column, lon: Column) -> tuple[Column, Column]:
    rows, cols = 1 << FINEST, 1 << (FINEST + 1)
    row = F.floor((lat + 90.0) * (rows / 180.0))
    col = F.floor((lon + 180.0) * (cols / 360.0))
    return F.least(F.greatest(row, F.lit(0)), F.lit(rows - 1)).cast("long"), F.pmod(col, F.lit(cols)).cast("long")


def _up(finest: str) -> Column:
    """The finest row or column number seen at column `level`."""
    return F.expr(f"shiftright({finest}, cast({STEP_BITS} * ({LAST} - level) as int))")


def evidence_sites(evidence: DataFrame, nearest: int | None, fields: tuple[str, ...] = SALE) -> DataFrame:
    """One row for each point, type and block of years, its sales sorted by day and key.

    Without `nearest` every sale stays, and points with very many sales of one day get several rows.
    """
    row, col = _finest(F.col("lat"), F.col("lon"))
    sales = evidence.where("lat IS NOT NULL AND lon IS NOT NULL AND country IS NOT NULL AND transaction_date IS NOT NULL").select(
        "country", F.col("lat").alias("sale_lat"), F.col("lon").alias("sale_lon"), row.alias("row"), col.alias("col"), "sale_key",
        F.col("property_id").alias("sale_property_id"), "price", F.col("transaction_date").alias("sold_date"), F.col("property_type").alias("sale_type"),
        F.col("floor_area").alias("sale_area"), F.col("district").alias("sale_district"))
    day = ["country", "sale_lat", "sale_lon", "sale_type", "sold_date"]
    own = F.coalesce(F.col("sale_property_id").cast("string"), F.col("sale_key"))
    # only days with too many sales at one point go through the windows; rank limits apply before their shuffle
    crowded = sales.groupBy(*day).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * (nearest or CROWD)).select(*[F.col(c).alias(f"d_{c}") for c in day])
    same = [F.col(c).eqNullSafe(F.col(f"d_{c}")) for c in day]
    block = F.floor(F.year("sold_date") / BLOCK_YEARS).alias("block")
    site = ["country", "row", "col", "sale_lat", "sale_lon", "sale_type", block]
    rows = F.sort_array(F.collect_list(F.struct(*fields))).alias("sales")
    if nearest is None:
        salt = F.when(F.col("d_country").isNotNull(), F.pmod(F.xxhash64("sale_key"), F.lit(256))).otherwise(F.lit(0)).alias("salt")
        return sales.join(crowded, same, "left").groupBy(*site, salt).agg(rows).drop("salt")
    some = (sales.join(crowded, same, "left_semi").withColumn("own", own)
            .withColumn("r", F.row_number().over(Window.partitionBy(*day, "own").orderBy("sale_key"))).where(F.col("r") <= nearest)
            .withColumn("r", F.row_number().over(Window.partitionBy(*day).orderBy("sale_key"))).where(F.col("r") <= 2 * nearest))
    kept = sales.join(crowded, same, "left_anti").unionByName(some.select(*sales.columns))
    return kept.groupBy(*site).agg(rows)


def build(evidence: DataFrame, nearest: int) -> SearchTree:
    sites = cut_lineage(evidence_sites(evidence, nearest))
    # a finest cell's leaf level: the first at which the cell around it holds few enough sites
    fine = ["country", "row", "col"]
    counted = sites.groupBy(*fine).agg(F.count(F.lit(1)).alias("n"))
    levels = counted.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LAST))))
    around = F.sum("n").over(Window.partitionBy("country", "level", _up("row"), _up("col")))
    shape = cut_lineage(levels.withColumn("around", around).groupBy(*fine).agg(
        F.coalesce(F.min(F.when(F.col("around") <= MOST, F.col("level"))), F.lit(LAST)).alias("leaf")))
    # sales by finest cell, type and day are counted first; levels and the row of all types are made from counts
    by_day = sites.select(*fine, "sale_type", F.explode("sales.sold_date").alias("day")).groupBy(*fine, "sale_type", "day").agg(F.count(F.lit(1)).alias("n"))
    kept = (by_day.join(shape, fine).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("leaf"))))
            .withColumn("want", F.explode(F.array_distinct(F.array(F.lit(ANY), "sale_type")))))
    cell = ["country", "level", "r", "c", "want"]
    days = kept.groupBy("country", "level", _up("row").alias("r"), _up("col").alias("c"), "want", "day").agg(
        F.sum("n").alias("n"), F.max(F.col("level") == F.col("leaf")).alias("is_leaf"))
    running = days.withColumn("upto", F.sum("n").over(Window.partitionBy(*cell).orderBy("day")))
    cells = running.groupBy(*cell).agg(F.max("is_leaf").alias("is_leaf"), F.sort_array(F.collect_list(F.struct("day", "upto"))).alias("days"))
    kid = node_id(F.col("r"), F.col("c"), F.col("level"))
    parent = node_id(F.shiftright("r", STEP_BITS), F.shiftright("c", STEP_BITS), F.col("level") - 1)
    # a cell stands below its parent; a leaf also below itself, so that finished branches pass the later steps
    below = F.array_compact(F.array(F.when(F.col("level") > 0, parent), F.when(F.col("is_leaf"), kid)))
    cells = cells.select("country", "want", F.explode(below).alias("node"), kid.alias("kid"), "level", "r", "c", "days")
    placed = sites.join(shape, fine).withColumnRenamed("leaf", "level")
    placed = placed.select(node_id(_up("row"), _up("col"), F.col("level")).alias("node"), "country", "sale_lat", "sale_lon", "sale_type", "block", "sales")
    return SearchTree(cut_lineage(placed), cut_lineage(cells))


# --- descent -----------------------------------------------------------------

def _bounds_m() -> tuple[Column, Column]:
    """Least and greatest distance from (lat, lon) to the cell (level, r, c), on the safe side."""
    high = F.lit(180.0) / F.pow(F.lit(2.0), F.lit(ROOT_BITS) + STEP_BITS * F.col("level"))
    south = F.col("r") * high - 90.0
    north = south + high
    lat = F.col("lat")
    off = F.abs(F.pmod(F.col("lon") - (F.col("c") * high - 180.0 + high / 2) + 180.0, F.lit(360.0)) - 180.0)
    equator = F.when(south * north <= 0, F.lit(0.0)).otherwise(F.least(F.abs(south), F.abs(north)))
    pole = F.least(F.greatest(F.abs(south), F.abs(north)), F.lit(90.0))

    def metres(dlat, dlon, other):
        a = F.pow(F.sin(F.radians(dlat) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(other)) * F.pow(F.sin(F.radians(dlon) / 2), 2)
        return F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(a, F.lit(0.0))))) * (2 * K.EARTH_RADIUS_M)
    near = metres(F.greatest(south - lat, lat - north, F.lit(0.0)), F.greatest(off - high / 2, F.lit(0.0)), pole)
    far = metres(F.greatest(F.abs(lat - south), F.abs(lat - north)), F.least(off + high / 2, F.lit(180.0)), equator)
    return near - SLACK_M, far + SLACK_M


def sales_in(days: Column, first: Column, last: Column) -> Column:
    """Sales of a cell from the first to the last day, from its running counts."""
    def upto(day):
        at = count_up_to(days, day, lambda d: d["day"])
        return F.coalesce(F.get(days, at - 1)["upto"], F.lit(0).cast("long"))
    return F.greatest(upto(last) - upto(F.date_sub(first, 1)), F.lit(0).cast("long"))


def leaves_in_reach(places: DataFrame, tree: SearchTree, reach_m: float, enough: int, steps: tuple[float, ...], step_enough: int) -> DataFrame:
    """For each place the leaves that may hold sales it needs, and its `reach_m`.

    places: place, country, want (a type or ANY), lat, lon, spans (date_from, date_to of each question) and own_sales.
    A place needs its nearest `enough` sales of others, and everything within the smallest of `steps` that holds
    `step_enough` of them.
    """
    front = places.select("place", "country", "want", "lat", "lon", "spans", "own_sales", F.lit(float(reach_m)).alias("reach_m"),
                          F.explode_outer(geo.touched_cells(F.col("lat"), F.col("lon"), reach_m, ROOT_BITS)).alias("cell")).withColumn("node", F.col("cell") * F.lit(8)).drop("cell")
    keep = ["place", "country", "want", "lat", "lon", "spans", "own_sales"]
    for _ in range(LAST):
        near, far = _bounds_m()
        counts = F.transform("spans", lambda s: sales_in(F.col("days"), s["date_from"], s["date_to"]))
        met = front.join(tree.cells, ["country", "node", "want"]).select(*keep, "reach_m", F.col("kid").alias("node"), near.alias("near"), far.alias("far"), "days")
        met = met.where(F.col("near") <= F.col("reach_m")).select(*keep, "reach_m", "node", "near", "far", counts.alias("counts"))
        met = met.where(F.array_max("counts") > 0)
        whole = Window.partitionBy("place")
        sure = F.sum(F.array_min("counts")).over(whole.orderBy("far", "node").rowsBetween(Window.unboundedPreceding, 0))
        met = met.withColumn("sure", sure - F.col("own_sales"))
        most = F.min(F.when(F.col("sure") >= max(enough, step_enough), F.col("far"))).over(whole)
        some = F.min(F.when(F.col("sure") >= step_enough, F.col("far"))).over(whole)
        step = F.lit(None).cast("double")
        for s in reversed(steps):
            step = F.when(F.col("some") <= float(s), F.lit(float(s))).otherwise(step)
        met = met.withColumns({"most": most, "some": some}).withColumn("reach_m", F.least("reach_m", "most", step))
        front = met.where(F.col("near") <= F.col("reach_m")).select(*keep, "reach_m", "node")
    return front


def fixed_grid(places: DataFrame, evidence: DataFrame, reach_m: float) -> tuple[DataFrame, DataFrame]:
    """For a radius known beforehand no tree is needed: (places by touched cell, sites by cell) on the level of half that width.

    Of the sales only day and dwelling are kept, all of them.
    """
    bits = geo.bits_for(reach_m / 2)
    looking = places.withColumns({"reach_m": F.lit(float(reach_m)), "node": F.explode_outer(geo.touched_cells(F.col("lat"), F.col("lon"), reach_m, bits))})
    return looking, evidence_sites(evidence, None, ("sold_date", "sale_property_id")).withColumn("node", geo.dyadic_cell(F.col("sale_lat"), F.col("sale_lon"), bits))


def sales_near(leaves: DataFrame, sites: DataFrame, questions: DataFrame, distance: Column, typed: bool, nearest: int | None) -> DataFrame:
    """Sites within reach of each place with, for each of its questions, the sales that answer it.

    questions: place, asked (an array of targets). Of a site a question takes its window's sales of other dwellings, the
    latest `nearest` of them and their day's others, cut out of the sorted array.
    """
    keys = ["country", "node", *(["sale_type"] if typed else [])]
    looking = leaves.withColumn("sale_type", F.col("want")) if typed else leaves
    near = looking.drop("spans", "own_sales", "want").join(sites, keys).withColumn("distance_m", distance).where(F.col("distance_m") <= F.col("reach_m"))

    def answer(t):
        first = count_up_to(F.col("sales"), F.date_sub(t["date_from"], 1), lambda s: s["sold_date"])
        last = count_up_to(F.col("sales"), t["date_to"], lambda s: s["sold_date"])
        inside = F.slice("sales", first + 1, F.greatest(last - first, F.lit(0)))
        others = F.filter(inside, lambda s: ~s["sale_property_id"].eqNullSafe(t["property_id"]) | t["property_id"].isNull())
        return F.struct(t.alias("target"), others.alias("sales"))
    hits = near.join(questions, "place").select("reach_m", "distance_m", "sale_lat", "sale_lon", F.explode_outer(F.transform("asked", answer)).alias("hit"))
    hits = hits.where(F.size("hit.sales") > 0).select("reach_m", "distance_m", "sale_lat", "sale_lon", "hit.*")
    if nearest is None:
        return hits
    edge = F.get("sales", F.size("sales") - nearest)["sold_date"]  # null where all are wanted
    return hits.withColumn("edge", edge).withColumn("sales", F.filter("sales", lambda s: F.col("edge").isNull() | (s["sold_date"] >= F.col("edge")))).drop("edge")
