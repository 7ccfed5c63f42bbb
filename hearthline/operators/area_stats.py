"""Order statistics of evidence-grade sales per area, segment and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.quantiles import same_keys, spread_quantiles
from ..session import cut_lineage

AREA_KEYS = ["area_code", "year", "segment", "area_level", "country"]  # most selective first: it leads the sort


def evidence(sales: DataFrame) -> DataFrame:
    """Sales that may support a published figure: standard basis, residential, located."""
    return sales.where((F.col("market_value_basis") == "STANDARD") & F.col("is_residential")
                       & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def price_per_sqm(price: Column, area: Column) -> Column:
    return F.when(area > 0, price / area)


def with_segments(sales: DataFrame) -> DataFrame:
    """Every sale once under `all` and once under its own type."""
    own = F.when(F.col("property_type").isin(K.AREA_SEGMENTS), F.col("property_type"))
    both = F.array_compact(F.array(F.lit("all"), own))
    return sales.withColumn("segment", F.explode(both))


def with_levels(sales: DataFrame, levels: list[str]) -> DataFrame:
    """One row per area level; a level that a country's ladder skips is left out."""
    entries = []
    for level in levels:
        skipped = [c for c, o in K.LEVEL_OVERRIDES.items()
                   if level not in {*o.values(), "country"}]
        code = F.col(level)
        if skipped:
            code = F.when(~F.col("country").isin(skipped), code)
        entries.append(F.struct(F.lit(level).alias("area_level"), code.alias("area_code")))
    return (sales.withColumn("_area", F.explode(F.array(*entries)))
            .where(F.col("_area.area_code").isNotNull())
            .withColumns({"area_level": F.col("_area.area_level"), "area_code": F.col("_area.area_code")})
            .drop("_area"))


def with_own_district(rows: DataFrame) -> DataFrame:
    """Rows of the levels at which an area can take its series from a district."""
    return rows.where("area_level <> 'country'").select("country", "area_level", "area_code", "district")


def exact_mean(col: str, scale: int = 2) -> Column:
    """Mean through an exact decimal sum, so that it does not depend on row order."""
    return F.sum(F.col(col).cast(f"decimal(18,{scale})")).cast("double") / F.count(col)


def extent(lat: str = "lat", lon: str = "lon") -> list[Column]:
    """Mean point and bounding box of a group; no box when it has no width or height."""
    w, e, s, n = F.min(lon), F.max(lon), F.min(lat), F.max(lat)
    real = (w < e) & (s < n)
    return [exact_mean(lat, 7).alias("centre_lat"), exact_mean(lon, 7).alias("centre_lon"),
            F.when(real, w).alias("west"), F.when(real, s).alias("south"),
            F.when(real, e).alias("east"), F.when(real, n).alias("north")]


def level_minimum(level: Column, minimum: dict[str, int]) -> Column:
    out = None
    for name, n in minimum.items():
        out = F.when(level == name, n) if out is None else out.when(level == name, n)
    return out


MEASURES = ["price", "price_per_sqm", "lat", "lon"]
WANTED = {"price": {"p25_price": 0.25, "median_price": 0.5, "p75_price": 0.75}, "price_per_sqm": {"median_price_per_sqm": 0.5}}


def finest_rows(sales: DataFrame, levels: list[str]) -> DataFrame:
    """Evidence sales as all their area codes together, type, year and values, each counted once (`_n`): what every area and segment is made of."""
    keys = [*dict.fromkeys(["country", "property_type", "year", *levels])]
    return evidence(sales).select(*keys, *[F.col(m).cast("double").alias(m) for m in MEASURES], F.lit(1).cast("long").alias("_n"))


def stats_of_rows(stored: DataFrame, levels: list[str], minimum: dict[str, int] | None = None, touched: DataFrame | None = None) -> DataFrame:
    """Statistics of every level and segment from stored rows that count `_n` times; `touched` (country, area_level, area_code, year) limits the groups.

    Counts, sums and extents are taken by all area codes together and spread over levels and segments.
    """
    finest, names = [*dict.fromkeys(["country", "property_type", "year", *levels])], [name for group in WANTED.values() for name in group]

    def spread(groups: DataFrame) -> DataFrame:
        rows = with_levels(with_segments(groups), levels)
        return rows if touched is None else rows.join(touched, ["country", "area_level", "area_code", "year"], "left_semi")

    def total(col: str, scale: int) -> Column:
        exact = F.col(col).cast(f"decimal(18,{scale})").cast("decimal(25,7)")
        return F.sum(exact * F.col("_n").cast("decimal(12,0)")).alias(f"_{col}")
    parts = cut_lineage(stored.groupBy(*finest).agg(
        F.sum(F.when(F.col("lat").isNotNull(), F.col("_n"))).alias("_n"), F.sum(F.when(F.col("price").isNotNull(), F.col("_n"))).alias("_priced"),
        total("price", 2), total("lat", 7), total("lon", 7), *[f(c).alias(f"_{f.__name__}_{c}") for f in (F.min, F.max) for c in ("lat", "lon")]))

    def mean(col: str, count: str) -> Column:
        return F.sum(f"_{col}").cast("double") / F.sum(count)
    w, e, s, n = F.min("_min_lon"), F.max("_max_lon"), F.min("_min_lat"), F.max("_max_lat")
    real = (w < e) & (s < n)
    facts = spread(parts).groupBy(*AREA_KEYS).agg(
        F.sum("_n").alias("transaction_count"), mean("price", "_priced").alias("mean_price"), mean("lat", "_n").alias("centre_lat"), mean("lon", "_n").alias("centre_lon"),
        *[F.when(real, x).alias(name) for x, name in ((w, "west"), (s, "south"), (e, "east"), (n, "north"))])
    held = facts.where(F.col("transaction_count") >= level_minimum(F.col("area_level"), minimum or K.LEVEL_MIN_SALES))
    found = spread_quantiles(stored, finest, AREA_KEYS, spread, WANTED, {}, kept=True, times="_n")
    return same_keys(held, found.hint("merge"), AREA_KEYS, "left").select(*AREA_KEYS, "transaction_count", "mean_price", "centre_lat", "centre_lon", "west", "south", "east", "north", *names)


def agg_area_stats(sales: DataFrame, levels: list[str] | None = None,
                   minimum: dict[str, int] | None = None) -> DataFrame:
    """All levels, segments and years; groups below their minimum are not published. Sales are read once, and stored."""
    minimum = minimum or K.LEVEL_MIN_SALES
    levels = levels or list(minimum)
    return stats_of_rows(cut_lineage(finest_rows(sales, levels)), levels, minimum)


def priced_only(stats: DataFrame) -> DataFrame:
    """Rows that can be shown: a change without a price level is not a price."""
    return stats.where("median_price IS NOT NULL")


def with_growth(stats: DataFrame, value: str = "median_price",
                keys: list[str] | None = None) -> DataFrame:
    """Change on the calendar year before; null where that year was not published."""
    keys = keys or ["country", "area_level", "area_code", "segment"]
    series = Window.partitionBy(*keys).orderBy("year")
    before = F.when(F.lag("year").over(series) == F.col("year") - 1, F.lag(value).over(series))
    return (stats.withColumn("previous", before)
            .withColumn("growth_1y_pct", F.when(F.col("previous") > 0, (F.col(value) / F.col("previous") - 1) * 100)))
