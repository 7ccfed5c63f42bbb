"""What is covered, from declarations intersected with the rows actually held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def measure(sales: DataFrame) -> DataFrame:
    """Per country: first and last sale, count, and how many carry a floor area."""
    return sales.groupBy("country").agg(
        F.min("transaction_date").alias("first_txn"), F.max("transaction_date").alias("last_txn"),
        F.count(F.lit(1)).alias("txn_count"), F.count("floor_area").alias("with_area"))


def usable() -> Column:
    return F.coalesce(F.col("max_precision") != "NONE", F.lit(False))


def dwelling_level() -> Column:
    return F.coalesce(F.col("transaction_level") & F.col("max_precision").isin("EXACT_TRANSACTION", "PROPERTY_ESTIMATE"), F.lit(False))


def register(declared: DataFrame, measured: DataFrame, index_rows: DataFrame) -> DataFrame:
    """A declaration holds only as far as rows back it; absences are kept as declared."""
    facts = declared.join(measured, "country", "left").join(index_rows, "country", "left")
    sales, index = F.coalesce("txn_count", F.lit(0)) > 0, F.coalesce("index_rows", F.lit(0)) > 0
    area = F.coalesce("with_area", F.lit(0)) > 0
    absent = F.col("max_precision") == "NONE"
    return facts.withColumns({
        "transaction_level": F.col("transaction_level") & sales, "market_index": F.col("market_index") & index,
        "forecast_supported": F.col("forecast_supported") & index, "characteristics": F.col("characteristics") & area,
        "historical_from": F.when(~absent, F.col("first_txn")), "historical_to": F.when(~absent, F.col("last_txn"))}).select(
        *declared.columns, "historical_from", "historical_to")


def area_evidence(stats: DataFrame) -> DataFrame:
    """What kind of priced rows each country has at area level."""
    priced = F.col("median_price").isNotNull()

    def of(fn, column):
        return fn(F.when(priced, F.col(column)))
    return stats.groupBy("country").agg(
        F.bool_or(priced).alias("has_price"), of(F.max, "area_level").alias("price_level"), of(F.countDistinct, "area_code").alias("price_areas"),
        of(F.min, "year").alias("price_from"), of(F.max, "year").alias("price_to"), of(F.max, "source_key").alias("price_source"),
        of(F.max, "price_statistic").alias("price_statistic"), of(F.max, "basis").alias("price_basis"), of(F.sum, "transaction_count").alias("sale_count"))


def without_sales(countries: DataFrame, sales: DataFrame) -> DataFrame:
    return countries.join(sales.select("country").distinct(), "country", "left_anti")


def statistics_only(stats: DataFrame, indices: DataFrame, sales: DataFrame) -> DataFrame:
    """Countries with priced areas or an index but no sales; an index alone is not a price."""
    evidence = area_evidence(stats)
    candidates = evidence.where("has_price").select("country").union(indices.select("country").distinct()).distinct()
    held = indices.groupBy("country").agg(F.min("period").alias("index_from"), F.max("period").alias("index_to"),
                                          F.countDistinct("area_code").alias("index_areas"), F.max("area_level").alias("index_level"))
    rows = without_sales(candidates, sales).join(evidence, "country", "left").join(held, "country", "left")
    priced = F.coalesce("has_price", F.lit(False))
    plural = F.when(F.col("price_areas") == 1, "area, ").otherwise("areas, ")
    word = F.when(F.col("price_statistic") == "MEAN", "Mean prices").otherwise("Median prices")
    origin = F.when(F.col("price_basis") == "OFFICIAL_STATISTIC", "from official statistics").otherwise("from registered sales")
    count = F.when(F.col("sale_count") > 0, F.concat(F.lit(" ("), F.format_number("sale_count", 0), F.lit(" sales)"))).otherwise("")
    price_note = F.concat(word, F.lit(" for "), F.col("price_areas").cast("string"), F.lit(" "), "price_level", F.lit("-level "), plural, origin, count)
    grain = F.when(F.col("index_areas") == 1, "national level only").otherwise(
        F.concat(F.col("index_areas").cast("string"), F.lit(" "), F.coalesce("index_level", F.lit("national")), F.lit("-level areas")))
    index_note = F.concat(F.lit("Only an index exists, at "), grain, F.lit("; it gives no price."))
    return rows.select(
        "country", F.lit("official_statistics").alias("provider_key"), F.lit(False).alias("transaction_level"),
        F.when(priced, "CITY_REGIONAL").otherwise("NONE").alias("max_precision"), F.when(priced, "REGION").alias("coordinate_precision"),
        F.when(priced, F.make_date("price_from", F.lit(1), F.lit(1))).otherwise(F.col("index_from")).alias("historical_from"),
        F.when(priced, F.make_date("price_to", F.lit(12), F.lit(31))).otherwise(F.col("index_to")).alias("historical_to"),
        F.when(priced, price_note).otherwise(index_note).alias("notes"))


def drop_unbacked(coverage: DataFrame, sales: DataFrame, indices: DataFrame, stats: DataFrame) -> DataFrame:
    """Claims without sales, index or priced area are removed; registered absences stay."""
    claims = coverage.where(usable())
    for held in (sales, indices, stats.where("median_price IS NOT NULL")):
        claims = claims.join(held.select("country").distinct().withColumn(f"_has", F.lit(True)), "country", "left")
        claims = claims.withColumn("_ok", F.coalesce("_has", F.lit(False)) | (F.col("_ok") if "_ok" in claims.columns else F.lit(False))).drop("_has")
    return claims.where("_ok").drop("_ok").unionByName(coverage.where(~usable()))


def lookup(places: DataFrame, coverage: DataFrame) -> DataFrame:
    """Coverage of (country, region_code): the region's own row wins over the country's."""
    facts = [c for c in coverage.columns if c not in ("country", "region_code")]
    row = F.struct(*facts)
    region = coverage.where("region_code IS NOT NULL").groupBy("country", "region_code").agg(F.min_by(row, "provider_key").alias("_region"))
    country = coverage.where("region_code IS NULL").groupBy("country").agg(F.min_by(row, "provider_key").alias("_country"))
    out = places.join(region, ["country", "region_code"], "left").join(country, "country", "left")
    return (out.withColumn("entry", F.coalesce("_region", "_country")).withColumn("entry_is_region", F.col("_region").isNotNull())
            .select(*places.columns, "entry.*", "entry_is_region"))


def year_bounds(sales: DataFrame, indices: DataFrame, stats: DataFrame) -> DataFrame:
    """First and last year with evidence per country; an index extends only the end."""
    none = F.lit(None).cast("int")
    parts = [sales.groupBy("country").agg(F.min("year").alias("lo"), F.max("year").alias("hi")),
             indices.groupBy("country").agg(none.alias("lo"), F.max(F.year("period")).alias("hi")),
             stats.where("median_price IS NOT NULL").groupBy("country").agg(F.min("year").alias("lo"), F.max("year").alias("hi"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("country").agg(F.min("lo").alias("min_year"), F.max("hi").alias("max_year"))


def describe(places: DataFrame, coverage: DataFrame, bounds: DataFrame, current_year: int, forecast_years: int) -> DataFrame:
    """Status, message and timeline range per place."""
    rows = lookup(places, coverage).join(bounds, "country", "left")
    last = F.least(F.coalesce("max_year", F.lit(current_year)), F.lit(current_year))
    return rows.select(
        *places.columns, F.when(usable(), "OK").otherwise("UNSUPPORTED_LOCATION").alias("status"),
        F.when(~usable(), F.coalesce("notes", F.lit(K.NO_DATA_TEXT))).alias("message"),
        F.when(usable(), F.coalesce("min_year", F.lit(current_year))).alias("min_year"), F.when(usable(), last).alias("max_data_year"),
        F.when(usable(), last + forecast_years).alias("max_forecast_year"))
