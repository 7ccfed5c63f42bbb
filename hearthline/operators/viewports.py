"""Answering whole tables of map viewports."""

from __future__ import annotations

import functools
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geo
from ..functions.quantiles import quantiles_of_counts, same_keys, value_bin
from ..session import cut_lineage
from . import area_stats as A
from . import coverage as COV
from . import places as P


def tier_of(zoom: Column) -> Column:
    out = None
    for low, tier, _, _ in K.ZOOM_LADDER:
        out = F.when(zoom >= low, tier) if out is None else out.when(zoom >= low, tier)
    return out.otherwise("WORLD")


def level_of(tier: Column, country: Column) -> Column:
    """Area level that serves a tier, by the country's own ladder where it has one."""
    out = None
    for iso, table in K.LEVEL_OVERRIDES.items():
        for t, level in table.items():
            met = (country == iso) & (tier == t)
            out = F.when(met, level) if out is None else out.when(met, level)
    for _, t, level, _ in K.ZOOM_LADDER:
        if level:
            out = out.when(tier == t, level)
    return out


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _order(values: list[str], col: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, values)), col)


def limit_of(tier: Column) -> Column:
    return F.element_at(_map({t: n for _, t, _, n in K.ZOOM_LADDER}), tier)


def honest_precision(level: Column, tier: Column) -> Column:
    """The coarser of what the level and the tier can claim."""
    by_tier = F.element_at(_map(K.TIER_PRECISION), tier)
    by_level = F.coalesce(F.try_element_at(_map(K.LEVEL_PRECISION), level), by_tier)
    return F.when(_order(K.PRECISIONS, by_level) >= _order(K.PRECISIONS, by_tier), by_level).otherwise(by_tier)


def honest_tier(level: Column, tier: Column) -> Column:
    """The tier that the served level amounts to, never finer than asked."""
    served = F.coalesce(F.try_element_at(_map(K.LEVEL_TIER), level), tier)
    return F.when(_order(K.TIERS, served) <= _order(K.TIERS, tier), served).otherwise(tier)


def map_gate(viewports: DataFrame, countries: DataFrame, regions: DataFrame, coverage: DataFrame) -> DataFrame:
    """What each viewport gets: dwellings, areas, a spanning world view, or a refusal with the reason.

    A sub-national absence always refuses; a country-wide one may still show its neighbours.
    """
    vp = viewports.withColumns({"lat": (F.col("south") + F.col("north")) / 2, "lon": geo.box_centre_lon(F.col("west"), F.col("east")), "tier": tier_of(F.col("zoom"))})
    points = vp.select(F.col("viewport_id").alias("point_id"), "lat", "lon")
    at = P.jurisdiction(points, countries, regions).withColumnRenamed("point_id", "viewport_id")
    lost = viewports.join(at, "viewport_id", "left_anti").withColumnRenamed("viewport_id", "box_id")
    largest = P.box_country(lost, countries).select(F.col("box_id").alias("viewport_id"), F.col("shape_id").alias("country"), F.lit(None).cast("string").alias("region_code"))
    where = at.select("viewport_id", "country", "region_code").unionByName(largest)
    facts = COV.lookup(where, coverage)
    rows = vp.drop("lat", "lon").join(facts, "viewport_id", "left")
    usable, dwelling = COV.usable(), COV.dwelling_level()
    spans = (F.col("tier") != "PROPERTY") & F.col("country").isNotNull() & ~F.coalesce("entry_is_region", F.lit(False))
    branch = (F.when(usable & (F.col("tier") == "PROPERTY") & dwelling, "properties").when(usable, "areas").when(spans, "world").otherwise("refused"))
    served = F.when((branch == "areas") & (F.col("tier") == "PROPERTY"), "NEIGHBOURHOOD").otherwise(F.col("tier"))
    message = F.when(branch == "refused", F.coalesce("notes", F.lit(K.NO_DATA_TEXT)))
    return rows.select(*viewports.columns, "country", "region_code", served.alias("tier"), branch.alias("branch"), message.alias("message"))


def year_snap(viewports: DataFrame, stats: DataFrame, today: date) -> DataFrame:
    """Nearest year with figures for the country and segment, the later one on a tie; a future year
    starts from the country's latest."""
    years = stats.select("country", "segment", F.col("year").alias("y")).distinct()
    past = viewports.where(F.col("year") <= today.year)
    asked = past.select("country", "segment", "year").distinct()
    near = asked.join(years, ["country", "segment"]).groupBy("country", "segment", "year").agg(
        F.min_by("y", F.struct(F.abs(F.col("y") - F.col("year")), -F.col("y"))).alias("stats_year"))
    last = stats.groupBy("country").agg(F.max("year").alias("stats_year"))
    now = past.join(near, ["country", "segment", "year"], "left").withColumn("stats_year", F.coalesce("stats_year", "year"))
    later = viewports.where(F.col("year") > today.year).join(last, "country", "left").withColumn("stats_year", F.coalesce("stats_year", F.lit(today.year)))
    return now.unionByName(later)


def with_levels_to_try(viewports: DataFrame) -> DataFrame:
    """The tier's own level and every coarser one, ranked from fine to coarse."""
    every = F.array(*[F.struct(F.lit(level).alias("area_level"), F.lit(i).alias("rank")) for i, level in enumerate(K.LEVELS_FINE_TO_COARSE)])
    own = _order(K.LEVELS_FINE_TO_COARSE, level_of(F.col("tier"), F.col("country"))) - 1
    return viewports.withColumn("_o", F.explode(F.filter(every, lambda e: e["rank"] >= own))).select(*viewports.columns, "_o.*")


FIGURES = ["median_price", "p25_price", "p75_price", "median_price_per_sqm", "transaction_count"]
AREA = ["viewport_id", "rank", "area_level", "area_code", "lat", "lon", *FIGURES, "growth_1y_pct", "basis", "market_district", "visible_area"]


def _as_area(rows: DataFrame, **given: Column) -> DataFrame:
    """Rows with all columns of an area answer; what is not given is null."""
    kinds = {"growth_1y_pct": "double", "basis": "string", "market_district": "string", "visible_area": "double"}
    values = {c: F.lit(None).cast(t) for c, t in kinds.items() if c not in rows.columns} | given
    return rows.withColumns(values).select(*AREA)


def _published(stats: DataFrame) -> DataFrame:
    """Statistics that have a price, with growth and with what they rest on (recorded sales where nothing is said)."""
    rows = stats if "basis" in stats.columns else stats.withColumn("basis", F.lit("TRANSACTIONS"))
    rows = rows.where("median_price IS NOT NULL")
    # one row for each area: recorded sales before a published figure, then most sales
    order = F.struct(F.col("basis") != "TRANSACTIONS", -F.coalesce("transaction_count", F.lit(0)), "basis")
    keys = ["country", "area_level", "area_code", "segment", "year"]
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("v")).select(*keys, "v.*")
    return A.with_growth(picked).withColumnRenamed("year", "stats_year")


def stored_areas(tries: DataFrame, published: DataFrame) -> DataFrame:
    """Stored rows whose centre is in view."""
    rows = published.where("area_level <> 'country'").select("country", "area_level", "area_code", "segment", "stats_year", F.col("centre_lat").alias("lat"),
                                                             F.col("centre_lon").alias("lon"), *FIGURES, "growth_1y_pct", "basis")
    boxes = P.plain_boxes(tries.where(~F.col("area_level").isin(*K.LIVE_LEVELS, "country"))).select(
        "viewport_id", "rank", "country", "area_level", "segment", "stats_year", "w", "s", "e", "n")
    return _as_area(P.box_join(rows, boxes, ["country", "area_level", "segment", "stats_year"]))


def shaped_areas(tries: DataFrame, published: DataFrame, shapes: DataFrame) -> DataFrame:
    """Rows of areas that have a shape (shape_id, rings, country, area_level, area_code), placed inside its visible part."""
    levels = [r.area_level for r in shapes.select("area_level").distinct().collect()]  # names of levels, a handful
    boxes = tries.where(F.col("area_level").isin(levels))
    seen = P.polygon_in_view(boxes.select(F.col("viewport_id").alias("box_id"), "west", "south", "east", "north").distinct(), shapes.select("shape_id", "rings")).join(
        shapes.select("shape_id", "country", "area_level", "area_code"), "shape_id").withColumnRenamed("box_id", "viewport_id")
    wanted = boxes.select("viewport_id", "rank", "country", "area_level", "segment", "stats_year").join(seen.drop("shape_id"), ["viewport_id", "country", "area_level"])
    rows = published.select("country", "area_level", "area_code", "segment", "stats_year", *FIGURES, "growth_1y_pct", "basis")
    return _as_area(wanted.join(rows, ["country", "area_level", "area_code", "segment", "stats_year"]))


LIVE_BITS = 12  # tiles of about 5 km


def live_tiles(sales: DataFrame, level: str, key: Column) -> DataFrame:
    """Evidence sales counted by tile, position, area, year, type, price and price per square metre: what live answers read.

    Made once for all viewports; a tile is a cell of the grid that wraps around the globe.
    """
    rows = A.evidence(sales).withColumn("area_code", key).where("area_code IS NOT NULL")
    return rows.groupBy("country", geo.dyadic_cell(F.col("lat"), F.col("lon"), LIVE_BITS).alias("tile"), F.lit(level).alias("area_level"), "area_code", "lat", "lon", "year",
                        "property_type", "district", "price", "price_per_sqm").agg(F.count(F.lit(1)).alias("sales"))


def agg_live(tiles: DataFrame, boxes: DataFrame, minimum: int = K.LIVE_MIN_SALES) -> DataFrame:
    """Quartiles, price per square metre and commonest district per postcode or street from the tiles in view, pooled over three years."""
    step = 180.0 / (1 << LIVE_BITS)

    def numbers(low, high, offset):
        return F.sequence(F.floor((F.col(low) + offset) / step), F.floor((F.col(high) + offset) / step))
    cells = F.flatten(F.transform(numbers("s", "n", 90.0), lambda r: F.transform(numbers("w", "e", 180.0), lambda c: geo.wrapped_cell(r, c, LIVE_BITS))))
    looking = boxes.withColumn("tile", F.explode_outer(F.array_distinct(cells)))
    inside = F.col("lon").between(F.col("w"), F.col("e")) & F.col("lat").between(F.col("s"), F.col("n"))
    pooled = F.col("year").between(F.col("stats_year") - (K.LIVE_WINDOW_YEARS - 1), F.col("stats_year"))
    seen = looking.join(tiles, ["country", "area_level", "tile"]).where(inside & pooled & ((F.col("segment") == "all") | (F.col("property_type") == F.col("segment"))))
    keys = ["viewport_id", "rank", "area_level", "area_code"]
    values = [F.struct(F.lit(i).alias("_m"), F.col(v).cast("double").alias("_v")) for i, v in enumerate(("price", "price_per_sqm"))]
    counts = (seen.select(*keys, "sales", F.explode(F.array(*values)).alias("v")).select(*keys, "v.*", "sales").where("_v IS NOT NULL")
              .groupBy(*keys, "_m", value_bin(F.col("_v")).alias("_bin"), "_v").agg(F.sum("sales").alias("_n")))
    found = quantiles_of_counts(counts, keys, [{"p25_price": 0.25, "median_price": 0.5, "p75_price": 0.75}, {"median_price_per_sqm": 0.5}])

    def mean(c):
        return F.sum(F.col(c).cast("decimal(18,7)") * F.col("sales").cast("decimal(12,0)")).cast("double") / F.sum("sales")
    district = seen.groupBy(*keys, "district").agg(F.sum("sales").alias("d")).groupBy(*keys).agg(
        F.min_by("district", F.when(F.col("district").isNotNull(), F.struct(-F.col("d"), "district"))).alias("market_district"))
    groups = seen.groupBy(*keys).agg(F.sum("sales").alias("transaction_count"), mean("lat").alias("lat"), mean("lon").alias("lon")).where(F.col("transaction_count") >= minimum)
    return _as_area(groups.join(found, keys).join(district, keys), basis=F.lit("TRANSACTIONS"))


def country_areas(tries: DataFrame, published: DataFrame, countries: DataFrame) -> DataFrame:
    """One row for every country in view, placed inside its visible part, largest first."""
    boxes = tries.where("area_level = 'country'").select("viewport_id", "rank", "segment", "stats_year", "west", "south", "east", "north")
    seen = P.polygon_in_view(boxes.select(F.col("viewport_id").alias("box_id"), "west", "south", "east", "north"), countries).select(
        F.col("box_id").alias("viewport_id"), F.col("shape_id").alias("country"), "visible_area", "lat", "lon")
    rows = published.where("area_level = 'country'").select("country", "segment", "stats_year", "area_code", "basis", *FIGURES)
    return _as_area(boxes.select("viewport_id", "rank", "segment", "stats_year").join(seen, "viewport_id").join(rows, ["country", "segment", "stats_year"]),
                    area_level=F.lit("country"))


def coarsen(found: DataFrame) -> DataFrame:
    """Only the finest level that has rows in view."""
    best = found.groupBy("viewport_id").agg(F.min("rank").alias("rank"))
    return found.join(best, ["viewport_id", "rank"], "left_semi")


def top_rows(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows with most sales (countries: largest visible part) up to the tier's limit."""
    w = Window.partitionBy("viewport_id").orderBy(F.col("visible_area").desc_nulls_last(), F.col("transaction_count").desc_nulls_last(), "area_code")
    return rows.join(limits, "viewport_id").withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.col("row_limit")).drop("row_limit")


def map_areas(gated: DataFrame, stats: DataFrame, tiles: DataFrame, countries: DataFrame, today: date, market: DataFrame | None = None,
              shaped: DataFrame | None = None, currencies: DataFrame | None = None) -> DataFrame:
    """Area rows per viewport: coarsened, snapped to a year with figures, ranked and labelled.

    `tiles` are the live tiles of postcodes and streets. Where areas of a level have shapes (`shaped`) and one is in view,
    they answer instead of the level's stored centres. `market` holds (country, area_level, area_code, segment, year,
    ratio, confidence); a future year shows only areas that it can project. `currencies` holds (country, currency).
    """
    asked = year_snap(gated.where("branch = 'areas'"), stats, today)
    tries = with_levels_to_try(asked)
    published = cut_lineage(_published(stats))
    found = stored_areas(tries, published)
    if shaped is not None:
        outlined = cut_lineage(shaped_areas(tries, published, shaped))
        found = found.join(outlined.select("viewport_id", "rank").distinct(), ["viewport_id", "rank"], "left_anti").select(*AREA).unionByName(outlined)
    boxes = P.plain_boxes(tries.where(F.col("area_level").isin(*K.LIVE_LEVELS))).select("viewport_id", "rank", "area_level", "country", "segment", "stats_year", "w", "s", "e", "n")
    found = found.unionByName(agg_live(tiles, boxes)).unionByName(country_areas(tries, published, countries))
    limits = asked.select("viewport_id", limit_of(F.col("tier")).alias("row_limit"))
    rows = top_rows(coarsen(found), limits).join(asked.select("viewport_id", "country", "tier", "segment", "year", "stats_year"), "viewport_id")
    live = F.col("area_level").isin(*K.LIVE_LEVELS)
    rows = rows.withColumns({
        "precision": honest_precision(F.col("area_level"), F.col("tier")), "served_tier": honest_tier(F.col("area_level"), F.col("tier")), "is_forecast": F.col("year") > today.year,
        "price_statistic": F.lit("MEDIAN"), "window_from_year": F.when(live, F.col("stats_year") - (K.LIVE_WINDOW_YEARS - 1)).otherwise(F.col("year")),
        "window_to_year": F.when(live, F.col("stats_year")).otherwise(F.col("year")), "confidence": F.lit(None).cast("string")})
    if currencies is not None:
        # a country row may be another country than the one under the centre
        money = currencies.select(F.col("country").alias("_of"), "currency")
        rows = rows.withColumn("_of", F.when(F.col("area_level") == "country", F.col("area_code")).otherwise(F.col("country"))).join(money, "_of", "left").drop("_of")
    if market is None:
        return rows.where(~F.col("is_forecast"))
    moved = rows.where("is_forecast").drop("confidence").join(market, ["country", "area_level", "area_code", "segment", "year"]).withColumn(
        "median_price", F.col("median_price") * F.col("ratio")).drop("ratio")
    return rows.where(~F.col("is_forecast")).unionByName(moved)


def map_world(gated: DataFrame, stats: DataFrame, countries: DataFrame, today: date) -> DataFrame:
    """Country rows for viewports whose centre is not covered; nothing for future years."""
    asked = gated.where((F.col("branch") == "world") & (F.col("year") <= today.year))
    years = stats.where("area_level = 'country'").select("segment", F.col("year").alias("y")).distinct()
    snapped = asked.select("segment", "year").distinct().join(years, "segment").where("y <= year").groupBy("segment", "year").agg(F.max("y").alias("stats_year"))
    tries = asked.join(snapped, ["segment", "year"], "left").withColumns({"stats_year": F.coalesce("stats_year", "year"), "area_level": F.lit("country"), "rank": F.lit(7)})
    return top_rows(country_areas(tries, _published(stats), countries), asked.select("viewport_id", limit_of(F.col("tier")).alias("row_limit")))


def thinned_dwellings(gated: DataFrame, dwellings: DataFrame, sale_counts: DataFrame) -> DataFrame:
    """One sold dwelling per marker cell: most sales, latest sale, lowest id; with ring positions."""
    boxes = P.plain_boxes(gated.where("branch = 'properties'")).select("viewport_id", "country", "segment", "zoom", "year", "tier", "south", "north", "w", "s", "e", "n")
    homes = dwellings.where("is_residential").select("property_id", "country", "lat", "lon", "property_type", "postcode").join(sale_counts, "property_id")
    seen = P.box_join(homes, boxes, ["country"]).where((F.col("segment") == "all") | (F.col("property_type") == F.col("segment")))
    cx, cy = geo.marker_cell_deg(F.col("zoom"), (F.col("south") + F.col("north")) / 2)
    cells = seen.withColumns({"gx": F.round(F.col("lon") / cx).cast("long"), "gy": F.round(F.col("lat") / cy).cast("long")})
    best = F.min_by(F.struct("property_id", "lat", "lon", "property_type", "postcode", "sale_count", "last_sold"),
                    F.struct(-F.col("sale_count"), F.datediff(F.lit(date(1900, 1, 1)), "last_sold"), "property_id"))
    thin = cells.groupBy("viewport_id", "year", "tier", "gx", "gy").agg(best.alias("b"), F.count(F.lit(1)).alias("in_cell")).select("viewport_id", "year", "tier", "b.*", "in_cell")
    w = Window.partitionBy("viewport_id", "postcode")
    ranked = thin.withColumns({"slot": F.row_number().over(w.orderBy("property_id")) - 1, "in_postcode": F.count(F.lit(1)).over(w)})
    ring, lat, lon = geo.ring_position(F.col("lat"), F.col("lon"), F.col("slot"), F.col("in_postcode"))
    totals = thin.groupBy("viewport_id").agg(F.sum("in_cell").alias("total_in_view"))
    order = Window.partitionBy("viewport_id").orderBy(F.col("sale_count").desc(), "property_id")
    return (ranked.withColumns({"ring_deg": ring, "marker_lat": lat, "marker_lon": lon, "place": F.row_number().over(order)})
            .where(F.col("place") <= limit_of(F.col("tier"))).join(totals, "viewport_id").drop("in_cell", "tier"))


def map_properties(thin: DataFrame, figures: DataFrame) -> DataFrame:
    """Markers that have a figure for the year; a dwelling without one has no marker."""
    return thin.join(figures.where("status = 'OK'").drop("status"), ["property_id", "year"])


def _upto(starts: list[tuple[int, int, int]], rank: int) -> int | None:
    """Place of the row of a rank (from 0) in a table numbered by partition and row, None behind the last one."""
    return next((first + rank - before for first, before, n in starts if before <= rank < before + n), None)


def txn_window(viewports: DataFrame, sales: DataFrame, first: date, last: date, limit: int = 500) -> DataFrame:
    """Newest residential sales in each box and date range, and whether the box holds more than the limit.

    Sales are put in order once and met from the newest on, in layers that grow fourfold: a view that has its rows takes
    no part in older layers. So a view is paired with a few times the limit, however many sales it holds.
    """
    order = [F.col("transaction_date").desc(), F.col("sale_key")]
    rows = sales.where(F.col("is_residential") & F.col("transaction_date").between(first, last))
    rows = cut_lineage(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    # one row for each partition of the sorted table
    parts = rows.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for p in parts:
        starts.append((p.first, total, p.n))
        total += p.n
    boxes = cut_lineage(P.plain_boxes(viewports).select("viewport_id", "w", "s", "e", "n"))
    w = Window.partitionBy("viewport_id").orderBy("_at")
    found, before, rank, size = [], None, 0, 2 * (limit + 1)
    while rank < max(total, 1):
        here = F.col("_at") >= (_upto(starts, rank) or 0)
        end = _upto(starts, rank + size)
        open_boxes = boxes.withColumn("_held", F.lit(0).cast("long")) if before is None else (
            same_keys(boxes, before, ["viewport_id"], "left").withColumn("_held", F.coalesce("_held", F.lit(0).cast("long"))).where(F.col("_held") <= limit))
        pairs = P.box_join(rows.where(here if end is None else here & (F.col("_at") < end)), open_boxes, [])
        nearest = pairs.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= limit + 1)
        found.append(cut_lineage(nearest.withColumn("place", (F.col("_held") + F.col("_place")).cast("int")).drop("_held", "_place").where(F.col("place") <= limit + 1)))
        held = found[-1].groupBy("viewport_id").agg(F.max("place").cast("long").alias("_held"))
        before = held if before is None else before.unionByName(held).groupBy("viewport_id").agg(F.max("_held").alias("_held"))
        rank, size = rank + size, size * 4
    placed = functools.reduce(DataFrame.unionByName, found).drop("_at")
    more = F.max("place").over(Window.partitionBy("viewport_id")) > limit
    return placed.withColumn("truncated", more).where(F.col("place") <= limit)
