"""Linking area names and districts to the series that describe them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import name_key, trigrams

LINK_COLUMNS = ["district", "area_code", "area_name", "match_method", "match_score"]


def _lowest_code(pairs: DataFrame, method: str) -> DataFrame:
    best = pairs.groupBy("district").agg(F.min(F.struct("area_code", "area_name")).alias("a"))
    return best.select("district", "a.area_code", "a.area_name", F.lit(method).alias("match_method"), F.lit(1.0).alias("match_score"))


def link_exact(districts: DataFrame, areas: DataFrame) -> DataFrame:
    """Names that agree once case and punctuation are ignored."""
    left = districts.select("district", name_key(F.col("district")).alias("_k")).distinct()
    right = areas.select("area_code", "area_name", name_key(F.col("area_name")).alias("_k"))
    return _lowest_code(left.join(right, "_k"), "normalised")


def successor_table(spark) -> DataFrame:
    return spark.createDataFrame(list(K.DISTRICT_SUCCESSORS.items()), "district string, successor string")


def link_manual(successors: DataFrame, areas: DataFrame) -> DataFrame:
    """Abolished districts through their published successor."""
    left = successors.select("district", name_key(F.col("successor")).alias("_k"))
    right = areas.select("area_code", "area_name", name_key(F.col("area_name")).alias("_k"))
    return _lowest_code(left.join(right, "_k"), "manual")


def _prefix(grams: Column, floor: float) -> Column:
    """Rarest pieces of a sorted set: two sets at least `floor` similar share one of these."""
    size = F.size(grams)
    return F.slice(grams, 1, size - F.ceil(size * F.lit(floor) - 1e-9).cast("int") + 1)


def link_fuzzy(districts: DataFrame, areas: DataFrame, floor: float = K.FUZZY_FLOOR) -> DataFrame:
    """Best area by share of common trigrams, if the share reaches the floor.

    Pieces are ordered from rare to common and only the rare head of each name is joined on, so a
    piece that every name has never becomes a join key; the result is still exact.
    """
    names = (districts.select(F.col("district").alias("name")).union(areas.select(F.col("area_name").alias("name")))
             .distinct().select("name", F.explode(trigrams(F.col("name"))).alias("g")))
    seen = names.groupBy("g").agg(F.count(F.lit(1)).alias("_n"))
    sets = (names.join(seen, "g").groupBy("name")
            .agg(F.sort_array(F.collect_list(F.struct("_n", "g"))).alias("s"))
            .select("name", F.transform("s", lambda x: x["g"]).alias("grams")))
    left = (districts.select("district").distinct().join(sets, F.col("district") == F.col("name"))
            .select("district", F.col("grams").alias("lg")))
    right = (areas.select("area_code", "area_name").distinct().join(sets, F.col("area_name") == F.col("name"))
             .select("area_code", "area_name", F.col("grams").alias("rg")))
    keys = ["district", "area_code", "area_name"]
    pairs = (left.withColumn("g", F.explode(_prefix(F.col("lg"), floor)))
             .join(right.withColumn("g", F.explode(_prefix(F.col("rg"), floor))), "g").drop("g").dropDuplicates(keys))
    common = F.size(F.array_intersect("lg", "rg"))
    scored = pairs.withColumn("score", common / (F.size("lg") + F.size("rg") - common)).where(F.col("score") >= floor)
    best = scored.groupBy("district").agg(F.min(F.struct((-F.col("score")).alias("s"), "area_code", "area_name")).alias("b"))
    return best.select("district", "b.area_code", "b.area_name", F.lit("trigram").alias("match_method"), (-F.col("b.s")).alias("match_score"))


def link_districts(districts: DataFrame, areas: DataFrame, successors: DataFrame) -> DataFrame:
    """Exact name first, then the published successor, then the closest name."""
    exact = link_exact(districts, areas)
    manual = link_manual(successors, areas).join(exact, "district", "left_anti")
    done = exact.unionByName(manual)
    rest = districts.select("district").distinct().join(done, "district", "left_anti")
    return done.unionByName(link_fuzzy(rest, areas)).select(*LINK_COLUMNS)


def modal_district(rows: DataFrame) -> DataFrame:
    """Most frequent district per area of every level; the lower name wins a tie."""
    counts = rows.where("district IS NOT NULL").groupBy("country", "area_level", "area_code", "district").agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy("country", "area_level", "area_code").agg(F.min(F.struct((-F.col("_n")).alias("n"), "district")).alias("b"))
    return best.select("country", "area_level", "area_code", F.col("b.district").alias("district"))
