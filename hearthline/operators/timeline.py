"""One figure per dwelling and year: a recorded sale, a projection, an estimate or a back-cast."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..policies import ForecastPolicy, SearchPolicy
from ..session import cut_lineage
from . import forecast as FC
from . import valuation as V

COLUMNS = ["property_id", "year", "price_type", "value", "lower_bound", "upper_bound", "confidence", "status"]


def recorded(wanted: DataFrame, sales: DataFrame) -> DataFrame:
    """Latest sale of the dwelling in the year, whatever its basis."""
    order = F.struct("transaction_date", "price", "sale_key")
    last = sales.groupBy("property_id", "year").agg(F.max_by("price", order).alias("value"), F.max_by("market_value_basis", order).alias("basis"))
    return wanted.select("property_id", "year").join(last, ["property_id", "year"])


def forecast_property(current: DataFrame, wanted: DataFrame, market: DataFrame) -> DataFrame:
    """Current estimate x market movement, both uncertainties compounded."""
    now = current.where("status = 'OK'").select("property_id", "country", "district", "property_type", "estimated_price", "low_estimate", "high_estimate")
    rows = wanted.join(now, "property_id").join(market, ["country", "district", "property_type", "year"])
    return rows.select(
        "property_id", "year", F.lit("FORECAST").alias("price_type"), F.bround(F.col("estimated_price") * F.col("ratio")).alias("value"),
        F.bround(F.col("low_estimate") * F.col("ratio_low")).alias("lower_bound"), F.bround(F.col("high_estimate") * F.col("ratio_high")).alias("upper_bound"),
        F.col("forecast_confidence").alias("confidence"), F.lit("OK").alias("status"))


def val_price_year(wanted: DataFrame, dwellings: DataFrame, sales: DataFrame, evidence: DataFrame, indices: DataFrame, links: DataFrame,
                   search: SearchPolicy, outlook: ForecastPolicy, sigma: DataFrame | None, today: date, current: DataFrame | None = None) -> DataFrame:
    """The single figure for each wanted (property_id, year), by a fixed order of preference.

    `current` may hold today's estimates of all dwellings where they are stored already; only earlier days are valued then.
    """
    wanted = cut_lineage(wanted.select("property_id", "year").distinct())
    sold = recorded(wanted, sales)
    none = F.lit(None).cast("double")
    facts = sold.select("property_id", "year", F.lit("TRANSACTION").alias("price_type"), "value", none.alias("lower_bound"), none.alias("upper_bound"),
                        F.lit("HIGH").alias("confidence"), F.lit("OK").alias("status"))
    open_years = wanted.join(sold.select("property_id", "year"), ["property_id", "year"], "left_anti")
    past = open_years.where(F.col("year") <= today.year)
    future = open_years.where(F.col("year") > today.year)
    day = F.least(F.make_date("year", F.lit(12), F.lit(31)), F.lit(today))
    homes = dwellings
    # every dwelling that needs one gets a current estimate: projections and back-casts start from it
    asked = past.select("property_id", day.alias("_day")).union(open_years.select("property_id", F.lit(today).alias("_day"))).distinct()

    def values_on(asked: DataFrame) -> DataFrame:
        targets = V.targets_for(homes.join(asked, "property_id"), F.col("_day"), today, search)
        return cut_lineage(V.val_avm(targets, evidence, indices, links, search, today))
    if current is None:
        valued = values_on(asked)
        current = valued.where(F.col("as_of") == F.lit(today))
    else:
        earlier = asked.where(F.col("_day") < F.lit(today))
        valued = current if earlier.isEmpty() else current.unionByName(values_on(earlier))
    modelled = past.withColumn("as_of", day).join(valued.drop("country"), ["property_id", "as_of"], "left")
    is_now = F.col("year") >= today.year
    kind = F.when(is_now, "CURRENT_ESTIMATE").otherwise("HISTORICAL_ESTIMATE")
    fallback = V.val_backcast(modelled.where(F.coalesce(F.col("status") != "OK", F.lit(True)) & ~is_now).select("property_id", "as_of"),
                              current, indices, links, today)
    both = modelled.select("property_id", "year", "as_of", kind.alias("price_type"), *[F.col(c).alias("_" + c) for c in ("status", "estimated_price", "low_estimate", "high_estimate", "confidence")])
    merged = both.join(fallback.select("property_id", "as_of", "status", "estimated_price", "low_estimate", "high_estimate", "confidence"), ["property_id", "as_of"], "left")
    direct = F.coalesce(F.col("_status") == "OK", F.lit(False))

    def pick(column):
        return F.when(direct, F.col("_" + column)).otherwise(F.col(column))
    ok = F.coalesce(pick("status") == "OK", F.lit(False))
    estimates = merged.select(
        "property_id", "year", F.when(ok, F.col("price_type")).alias("price_type"), F.when(ok, pick("estimated_price")).alias("value"),
        F.when(ok, pick("low_estimate")).alias("lower_bound"), F.when(ok, pick("high_estimate")).alias("upper_bound"),
        F.when(ok, pick("confidence")).alias("confidence"), F.when(ok, "OK").otherwise("INSUFFICIENT_EVIDENCE").alias("status"))
    places = homes.select("country", "district", "property_type").distinct()
    years = future.select("year").distinct()
    market = FC.fc_market(places, years, indices, links, sigma, outlook)
    ahead = forecast_property(current, future, market)
    missing = (future.join(ahead.select("property_id", "year"), ["property_id", "year"], "left_anti")
               .join(current.where("status = 'OK'").select("property_id", F.lit(True).alias("_valued")), "property_id", "left"))
    refused = missing.select("property_id", "year", F.lit(None).cast("string").alias("price_type"), none.alias("value"), none.alias("lower_bound"),
                             none.alias("upper_bound"), F.lit(None).cast("string").alias("confidence"),
                             F.when(F.col("_valued"), "OUT_OF_RANGE").otherwise("INSUFFICIENT_EVIDENCE").alias("status"))
    return facts.unionByName(estimates).unionByName(ahead).unionByName(refused).select(*COLUMNS)


def wanted_years(dwellings: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Dwelling x year, from the first to the last one."""
    return dwellings.select("property_id", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))).alias("year"))


def val_detail(dwellings: DataFrame, sales: DataFrame, figures: DataFrame, current: DataFrame) -> DataFrame:
    """Per dwelling: its sales in total and the last one, the chosen year's figure, and the current
    estimate kept apart from it. The sale list itself stays a table keyed by dwelling."""
    order = F.struct("transaction_date", "price", "sale_key")
    totals = sales.groupBy("property_id").agg(
        F.count(F.lit(1)).alias("sale_count"), F.max("transaction_date").alias("last_sold"), F.max_by("price", order).alias("last_price"))
    now = current.select("property_id", F.col("estimated_price").alias("current_estimate"), F.col("confidence").alias("current_confidence"))
    return (dwellings.select("property_id", "property_type", "country").join(totals, "property_id", "left")
            .join(figures.drop("year"), "property_id", "left").join(now, "property_id", "left"))


def sale_list(dwellings: DataFrame, sales: DataFrame) -> DataFrame:
    """Every recorded sale of the dwellings, newest first, numbered per dwelling, with the change on the sale before."""
    own = Window.partitionBy("property_id").orderBy(F.col("transaction_date").desc(), F.col("price").desc(), "sale_key")
    before = F.lead("price").over(own)
    rows = sales.join(dwellings.select("property_id"), "property_id", "left_semi")
    return rows.select("property_id", F.row_number().over(own).alias("place"), "transaction_date", "price", "market_value_basis", "sale_key",
                       F.when(before > 0, (F.col("price") / before - 1) * 100).alias("change_pct"))
