"""Answering postcode and outcode queries from the gazetteer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .area_stats import extent

# --- fixed values: shapes of a full postcode and of an outcode ---
FULL = r"^([A-Z]{1,2}\d[A-Z\d]?)\s*(\d[A-Z]{2})$"
OUTCODE = r"^[A-Z]{1,2}\d[A-Z\d]?$"


def outcodes(gazetteer: DataFrame) -> DataFrame:
    """Centre, extent, size and most frequent country of each outcode's live postcodes."""
    live = gazetteer.where("status = 'live'")
    votes = live.groupBy("outcode", "uk_country").agg(F.count(F.lit(1)).alias("_n"))
    modal = votes.groupBy("outcode").agg(F.min(F.struct((-F.col("_n")).alias("n"), "uk_country")).alias("m")).select("outcode", "m.uk_country")
    return live.groupBy("outcode").agg(*extent(), F.count(F.lit(1)).alias("postcodes")).join(modal, "outcode")


def geo_lookup(texts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Query texts -> point, extent and suggested zoom; no row for what the gazetteer lacks."""
    clean = F.upper(F.trim("query"))
    asked = texts.select("query", F.regexp_replace(clean, FULL, "$1$2").alias("code"), clean.rlike(FULL).alias("full"),
                         clean.rlike(OUTCODE).alias("short")).distinct()
    live_first = (F.col("status") != "live").cast("int")
    units = gazetteer.groupBy(F.col("postcode").alias("code")).agg(
        F.min_by(F.struct("postcode_pretty", "lat", "lon", "uk_country"), F.struct(live_first, "postcode_pretty")).alias("g"))
    none = F.lit(None).cast("double")
    exact = asked.where("full").join(units, "code").select(
        "query", F.concat(F.lit("postcode/"), "code").alias("id"), F.col("g.postcode_pretty").alias("name"), F.col("g.lat").alias("lat"),
        F.col("g.lon").alias("lon"), *[none.alias(c) for c in ("west", "south", "east", "north")], F.lit(16.5).alias("suggested_zoom"),
        F.col("g.uk_country").alias("uk_country"))
    whole = asked.where("short AND NOT full").join(outcodes(gazetteer), F.col("code") == F.col("outcode")).select(
        "query", F.concat(F.lit("outcode/"), "code").alias("id"), F.col("code").alias("name"), F.col("centre_lat").alias("lat"),
        F.col("centre_lon").alias("lon"), "west", "south", "east", "north", F.lit(13.0).alias("suggested_zoom"), "uk_country")
    return exact.unionByName(whole)
