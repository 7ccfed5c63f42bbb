"""Index series: building, as-of lookup and restating prices across time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.parse import month_no
from ..functions.quantiles import spread_quantiles


def rebase(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Index value = 100 x value / first value of the series."""
    w = Window.partitionBy(*keys).orderBy("period")
    return (series.withColumn("_base", F.first(value).over(w))
            .withColumn("index_value", F.when(F.col("_base") > 0, F.col(value) * 100.0 / F.col("_base")))
            .where(F.col("_base") > 0).drop("_base"))


def monthly_index(sales: DataFrame) -> DataFrame:
    """Monthly median price per m2 by county and by country, per segment, 100 at the start."""
    from .area_stats import evidence, with_segments
    rows = evidence(sales).where("price_per_sqm IS NOT NULL").withColumn("period", F.trunc("transaction_date", "month"))
    keys = ["country", "area_code", "area_level", "segment"]

    def areas(groups: DataFrame) -> DataFrame:
        both = F.array(F.struct(F.concat(F.lit("IX-"), "county").alias("area_code"), F.lit("local_authority").alias("area_level")),
                       F.struct(F.concat(F.lit("NAT-"), "country").alias("area_code"), F.lit("country").alias("area_level")))
        return with_segments(groups).withColumn("_a", F.explode(both)).select("*", "_a.area_code", "_a.area_level").drop("_a")
    stats = spread_quantiles(rows, ["country", "county", "property_type", "period"], [*keys, "period"], areas,
                             {"price_per_sqm": {"median_ppsm": 0.5}, "price": {"average_price": 0.5}}, {"price_per_sqm": "sales_volume"})
    return rebase(stats, keys, "median_ppsm")


def usable_series(indices: DataFrame, minimum: int = K.MIN_SERIES_POINTS) -> DataFrame:
    """Points of series long enough to be trusted."""
    points = indices.where("index_value IS NOT NULL")
    long = points.groupBy("area_code", "segment").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum)
    return points.join(long.select("area_code", "segment"), ["area_code", "segment"], "left_semi")


def month_grid(series: DataFrame, gap: int = K.MAX_MONTH_GAP) -> DataFrame:
    """Value in force at every month near a published one: the exact month, else the closest
    within the gap, the earlier one on a tie. Turns as-of lookups into plain equi joins."""
    near = series.select("area_code", "area_level", "segment", month_no(F.col("period")).alias("_m"), "index_value",
                         F.explode(F.sequence(F.lit(-gap), F.lit(gap))).alias("_off"))
    return (near.groupBy("area_code", "area_level", "segment", (F.col("_m") + F.col("_off")).alias("month"))
            .agg(F.min_by(F.struct(F.col("_m").alias("found_month"), F.col("index_value").alias("value")),
                          F.struct(F.abs("_off"), F.col("_m"))).alias("v"))
            .select("area_code", "area_level", "segment", "month", "v.*"))


def asof_month(requests: DataFrame, series: DataFrame, gap: int = K.MAX_MONTH_GAP) -> DataFrame:
    """Requests (area_code, segment, month) with the index value in force, if any."""
    grid = month_grid(series, gap).drop("area_level")
    return requests.join(grid, ["area_code", "segment", "month"], "left")


def index_candidates(requests: DataFrame, links: DataFrame, nations: DataFrame) -> DataFrame:
    """Series to try per request, most local first: (area, type), (area, all), (nation, type),
    (nation, all); only series of the request's own country."""
    local = requests.join(links.select("country", "district", F.col("area_code").alias("_local")), ["country", "district"], "left")
    both = local.join(nations.select("country", F.col("area_code").alias("_nation")), "country", "left")
    typed = F.when(F.col("property_type") != "other", F.col("property_type"))
    options = F.array(*[
        F.struct(F.lit(i).alias("priority"), area.alias("area_code"), seg.alias("segment"))
        for i, (area, seg) in enumerate([(F.col("_local"), typed), (F.col("_local"), F.lit("all")),
                                         (F.col("_nation"), typed), (F.col("_nation"), F.lit("all"))])])
    out = both.withColumn("_o", F.explode(options)).drop("_local", "_nation")
    return out.where("_o.area_code IS NOT NULL AND _o.segment IS NOT NULL").select(*requests.columns, "_o.*")


def restate_ratios(requests: DataFrame, indices: DataFrame, links: DataFrame,
                   minimum: int = K.MIN_SERIES_POINTS) -> DataFrame:
    """Factor from `from_month` to `to_month` per distinct request; no row when no series covers
    both dates. Requests are de-duplicated first: there are far fewer of them than prices."""
    keys = ["country", "district", "property_type", "from_month", "to_month"]
    distinct = requests.select(*keys).distinct()
    series = usable_series(indices, minimum)
    nations = series.where("area_level = 'country'").select("country", "area_code").distinct()
    options = index_candidates(distinct, links, nations)
    grid = month_grid(series)

    def at(prefix: str) -> DataFrame:
        return grid.select("area_code", "segment", F.col("month").alias(f"{prefix}_month"),
                           F.col("found_month").alias(f"{prefix}_found"), F.col("value").alias(f"{prefix}_value"),
                           *([F.col("area_level")] if prefix == "from" else []))
    priced = (options.join(at("from"), ["area_code", "segment", "from_month"])
              .join(at("to"), ["area_code", "segment", "to_month"]).where("from_value > 0"))
    pick = F.min_by(F.struct("area_code", "area_level", "segment", "from_value", "to_value", "from_found", "to_found"), "priority")
    return (priced.groupBy(*keys).agg(pick.alias("v")).select(*keys, "v.*")
            .withColumn("ratio", F.col("to_value") / F.col("from_value")))
