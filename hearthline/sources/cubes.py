"""Published statistical cubes, decoded with array and map functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import parse as P

CATEGORY = "struct<category: struct<index: map<string,int>, label: map<string,string>>>"


def read_cube_2d(spark: SparkSession, path: str) -> DataFrame:
    """Place x period cube: value at place position x number of periods + period position."""
    schema = f"dimension struct<geo: {CATEGORY}, time: {CATEGORY}>, value map<string,double>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    geo, time = F.col("dimension.geo.category"), F.col("dimension.time.category")
    cells = (doc.select(F.explode(geo["index"]).alias("geo", "g"), time["index"].alias("times"),
                        geo["label"].alias("labels"), "value", F.size(time["index"]).alias("width"))
             .where(~F.col("geo").isin(K.CUBE_AGGREGATES))
             .select("geo", "g", "labels", "value", "width", F.explode("times").alias("period_text", "t")))
    fixes = F.create_map(*[F.lit(x) for kv in K.CUBE_ISO_FIXES.items() for x in kv])
    iso = F.coalesce(F.try_element_at(fixes, F.col("geo")), F.col("geo"))
    position = (F.col("g") * F.col("width") + F.col("t")).cast("string")
    return (cells.select(iso.alias("country"), F.coalesce(F.try_element_at("labels", F.col("geo")), iso).alias("area_name"),
                         P.quarter_date(F.col("period_text")).alias("period"),
                         F.try_element_at("value", position).alias("index_value"))
            .where((F.length("country") == 2) & F.col("index_value").isNotNull() & F.col("period").isNotNull()))


def _by_position(index: Column) -> Column:
    return F.map_from_entries(F.transform(F.map_entries(index), lambda e: F.struct(e["value"], e["key"])))


def read_cube_nd(spark: SparkSession, path: str, axes: list[str]) -> DataFrame:
    """Row-major cube with dense or sparse values: code and label per wanted axis, and the value."""
    schema = f"id array<string>, size array<int>, dimension map<string, {CATEGORY}>, value string"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    dense = F.from_json("value", "array<double>")
    sparse = F.from_json("value", "map<string,double>")
    entries = F.when(F.col("value").startswith("["), F.transform(
        dense, lambda v, i: F.struct(i.cast("long").alias("pos"), v.alias("v")))).otherwise(
        F.transform(F.map_entries(sparse), lambda e: F.struct(
            e["key"].cast("long").alias("pos"), e["value"].alias("v"))))
    cells = (doc.select("id", "size", "dimension", F.explode(entries).alias("c"))
             .where(F.col("c.v").isNotNull()))
    out = []
    for axis in axes:
        at = F.array_position("id", axis).cast("int")
        stride = F.aggregate(F.slice("size", at + 1, F.size("size")), F.lit(1).cast("long"), lambda a, s: a * s)
        place = (F.floor(F.col("c.pos") / stride) % F.get("size", at - 1)).cast("int")
        category = F.try_element_at("dimension", F.lit(axis))["category"]
        code = F.try_element_at(_by_position(category["index"]), place)
        out += [code.alias(f"{axis}_code"), F.coalesce(F.try_element_at(category["label"], code), code).alias(f"{axis}_label")]
    return cells.select(*out, F.col("c.v").alias("value"))


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Series keyed `i:j:k`: region id, period and value of each observation."""
    dims = "array<struct<id: string, values: array<struct<id: string, name: string>>>>"
    shape = f"struct<dimensions: struct<series: {dims}, observation: {dims}>>"
    schema = (f"data struct<dataSets: array<struct<series: map<string, struct<observations: "
              f"map<string, array<double>>>>>>, structure: {shape}, structures: array<{shape}>>")
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    shape_col = F.coalesce(F.get("data.structures", F.lit(0)), F.col("data.structure"))
    rows = doc.select(shape_col["dimensions"]["series"].alias("axes"),
                      F.get(shape_col["dimensions"]["observation"], F.lit(0))["values"].alias("periods"),
                      F.explode(F.get("data.dataSets", F.lit(0))["series"]).alias("key", "series"))
    axis = F.array_position(F.transform("axes", lambda a: a["id"]), "REGION").cast("int") - 1
    rows = (rows.withColumn("axis", axis)
            .select("periods", F.get(F.get("axes", F.col("axis"))["values"],
                                     F.get(F.split("key", ":"), F.col("axis")).cast("int"))["id"].alias("region"),
                    F.explode("series.observations").alias("at", "obs")))
    return rows.select("region", F.get("periods", F.col("at").cast("int"))["id"].alias("period_text"),
                       F.get("obs", F.lit(0)).alias("value")).where(F.col("value").isNotNull())


def read_annual_prices(spark: SparkSession, path: str, titles_path: str) -> DataFrame:
    """Annual rows of the national area and the provinces, named through a title table."""
    rows = spark.read.schema("value array<struct<RegioS: string, Perioden: string, GemiddeldeVerkoopprijs_1: double>>"
                             ).option("multiLine", True).json(path).select(F.explode("value").alias("r"))
    titles = spark.read.schema("value array<struct<Key: string, Title: string>>").option("multiLine", True).json(
        titles_path).select(F.explode("value").alias("t")).select(
        F.trim("t.Key").alias("code"), F.trim("t.Title").alias("title"))
    code, period = F.trim("r.RegioS"), F.trim("r.Perioden")
    kept = rows.select(code.alias("code"), F.substring(period, 1, 4).try_cast("int").alias("year"),
                       period.alias("period"), F.col("r.GemiddeldeVerkoopprijs_1").alias("price")).where(
        F.col("price").isNotNull() & F.col("period").endswith("JJ00")
        & ((F.col("code") == "NL01") | F.col("code").startswith("PV")))
    plain = F.trim(F.replace(F.coalesce("title", "code"), F.lit("(PV)"), F.lit("")))
    alias = F.create_map(*[F.lit(x) for kv in K.PROVINCE_ALIASES.items() for x in kv])
    return kept.join(titles, "code", "left").select(
        "code", "year", "price", F.when(F.col("code") == "NL01", "country").otherwise("county").alias("area_level"),
        F.when(F.col("code") == "NL01", "Netherlands").otherwise(
            F.coalesce(F.try_element_at(alias, plain), plain)).alias("area_name"))


def read_census(spark: SparkSession, path: str) -> DataFrame:
    """Array-of-arrays with a header row: FIPS code, name, value and margin as text."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("a"))
    rows = doc.select(F.get("a", F.lit(0)).alias("head"), F.explode(F.slice("a", 2, F.size("a"))).alias("row"))

    def field(name):
        return F.get("row", F.array_position("head", name).cast("int") - 1)
    return rows.select(F.concat(field("state"), field("county")).alias("fips"),
                       F.trim(F.split(field("NAME"), ",")[0]).alias("area_name"),
                       field(K.CENSUS_VALUE).alias("value_text"), field(K.CENSUS_MARGIN).alias("margin_text"))


def sound_estimates(rows: DataFrame) -> DataFrame:
    """Positive estimates whose margin is at most a third of the value."""
    value = F.when(~F.col("value_text").isin(K.CENSUS_NULLS), P.number(F.col("value_text")))
    margin = F.coalesce(P.number(F.col("margin_text")), F.lit(0.0))
    return (rows.withColumns({"value": value, "margin": margin})
            .where((F.col("value") > 0) & ~((F.col("margin") > 0) & (F.col("margin") / F.col("value") > K.CENSUS_MAX_MARGIN))))
