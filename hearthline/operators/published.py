"""Area statistics built from published or pooled figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.quantiles import exact_quantiles, spread_quantiles
from .area_stats import with_growth


def yearly_medians(rows: DataFrame, keys: list[str], with_area: bool = False,
                   minimum: int = K.YEAR_MIN_SALES) -> DataFrame:
    """Median and exclusive quartiles per key and year; growth only on the calendar year before."""
    wanted = {"price": {"p25_price": 0.25, "median_price": 0.5, "p75_price": 0.75}}
    if with_area:
        wanted["price_per_sqm"] = {"median_price_per_sqm": 0.5}
    stats = exact_quantiles(rows, [*keys, "year"], wanted, "exclusive",
                            also=[F.count(F.lit(1)).alias("transaction_count")])
    stats = stats.where(F.col("transaction_count") >= minimum)
    grown = with_growth(stats, "median_price", keys).drop("previous")
    return grown.withColumn("growth_1y_pct", F.round("growth_1y_pct", 3))


def county_and_national(rows: DataFrame, country: str) -> DataFrame:
    """Counties and the pooled nation; a median of medians would not be a median."""
    place = F.array(
        F.struct(F.lit("county").alias("area_level"), F.col("county").alias("area_name")),
        F.struct(F.lit("country").alias("area_level"), F.lit(country).alias("area_name")))
    return rows.select("year", "price", F.explode(place).alias("p")).select("p.*", "year", "price")


def weighted_annual_mean(quarters: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of quarterly means, each weighted by its sales; quarters without a weight do not count."""
    used = quarters.where(F.col("weight") > 0)
    return used.groupBy(*keys, "year").agg(
        (F.sum(F.col("price") * F.col("weight")) / F.sum("weight")).alias("price"),
        F.sum("weight").cast("long").alias("transaction_count"))


def last_period_of_year(rows: DataFrame, keys: list[str], values: list[str], period: str = "period") -> DataFrame:
    """A year's figure is that of its last published period."""
    year = F.year(period) if dict(rows.dtypes)[period] == "date" else F.substring(period, 1, 4).cast("int")
    return (rows.withColumn("year", year).groupBy(*keys, "year")
            .agg(*[F.max_by(F.col(v), F.col(period)).alias(v) for v in values]))


def published_with_growth(rows: DataFrame, keys: list[str], value: str = "price") -> DataFrame:
    grown = with_growth(rows, value, keys).drop("previous")
    return grown.withColumn("growth_1y_pct", F.round("growth_1y_pct", 3))


def link_regions_by_name(stats: DataFrame, shapes: DataFrame, names: dict[str, list[str]] | None = None) -> DataFrame:
    """Attach the lowest region id whose name matches; some places are made of several shapes."""
    aliases = names or {}
    mapped = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if aliases else None
    wanted = F.coalesce(F.try_element_at(mapped, F.col("area_name")), F.array("area_name")) if aliases else F.array("area_name")
    places = stats.select("area_name").distinct().select("area_name", F.explode(wanted).alias("name"))
    ids = places.join(shapes.select("name", "region_id"), "name").groupBy("area_name").agg(
        F.min("region_id").alias("region_id"), F.count(F.lit(1)).alias("shape_parts"))
    return stats.join(ids, "area_name", "left")


def link_regions_by_code(stats: DataFrame, shapes: DataFrame) -> DataFrame:
    """State rows without a region get the one whose postal code is the tail of the area code."""
    wanted = stats.withColumn("_code", F.split_part(F.col("area_code"), F.lit("-"), F.lit(2)))
    codes = shapes.select(F.col("country").alias("_country"), F.col("postal_code").alias("_code"),
                          F.col("region_id").alias("_found")).distinct()
    found = (wanted.join(codes, (F.col("country") == F.col("_country")) & (wanted["_code"] == codes["_code"])
                         & (F.col("area_level") == "state"), "left").drop(codes["_code"]))
    return found.withColumn("region_id", F.coalesce("region_id", "_found")).drop("_code", "_country", "_found")


def quarterly_index(sales: DataFrame, minimum: int = K.QUARTER_MIN_SALES) -> DataFrame:
    """Median price per m2 by county, segment and quarter, 100 at the first published quarter."""
    from .area_stats import evidence, with_segments
    from .index_series import rebase
    rows = evidence(sales).where("price_per_sqm IS NOT NULL AND county IS NOT NULL").withColumn("period", F.trunc("transaction_date", "quarter"))
    keys = ["country", "county", "segment"]
    stats = spread_quantiles(rows, ["country", "county", "property_type", "period"], [*keys, "period"], with_segments,
                             {"price_per_sqm": {"median_ppsm": 0.5}, "price": {"average_price": 0.5}}, {"price_per_sqm": "sales_volume"}).where(F.col("sales_volume") >= minimum)
    return rebase(stats, keys, "median_ppsm")


def quarters_to_months(quarters: DataFrame) -> DataFrame:
    """Each quarterly value stands for its three months."""
    months = F.sequence("period", F.add_months("period", 2), F.expr("interval 1 month"))
    return quarters.withColumn("period", F.explode(months))


def link_districts_to_county(sales: DataFrame, series: DataFrame) -> DataFrame:
    """District -> its county's derived series, where that series exists."""
    have = series.select("county").distinct()
    pairs = sales.where("district IS NOT NULL AND county IS NOT NULL").select("district", "county").distinct()
    return (pairs.join(have, "county", "left_semi").groupBy("district")
            .agg(F.min("county").alias("county")).select("district", F.concat(F.lit("IX-"), "county").alias("area_code")))
