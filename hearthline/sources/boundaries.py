"""Published boundary files as tables of shapes and rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K


def _features(spark: SparkSession, path: str) -> DataFrame:
    schema = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))


def _prop(name: str) -> Column:
    return F.trim(F.try_element_at("f.properties", F.lit(name)))


def _clean(name: str) -> Column:
    value = _prop(name)
    return F.when((value != "") & ~value.isin(K.SHAPE_NULLS), value)


def rings_of(geometry: Column) -> Column:
    """Every ring of a polygon or multi-polygon as an array of (x, y)."""
    one = F.from_json(geometry["coordinates"], "array<array<array<double>>>")
    many = F.flatten(F.from_json(geometry["coordinates"], "array<array<array<array<double>>>>"))
    rings = F.when(geometry["type"] == "Polygon", one).when(geometry["type"] == "MultiPolygon", many)
    return F.transform(rings, lambda ring: F.transform(
        ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """One row per ISO code with all rings of its features (parts are listed, not dissolved)."""
    def code(names, size, bad):
        picks = [F.when((F.length(F.upper(_prop(n))) == size) & (F.upper(_prop(n)) != bad), F.upper(_prop(n)))
                 for n in names]
        return F.coalesce(*picks)
    iso2 = code(["ISO_A2_EH", "ISO_A2", "ADM0_ISO"], 2, "-9")
    iso3 = code(["ISO_A3_EH", "ISO_A3", "ADM0_A3"], 3, "-99")
    name = F.coalesce(_prop("NAME_LONG"), _prop("NAME"), iso2)
    rows = _features(spark, path).select(iso2.alias("iso2"), iso3.alias("iso3"), name.alias("name"),
                                         rings_of(F.col("f.geometry")).alias("rings")).where("iso2 IS NOT NULL")
    return union_shapes(rows, ["iso2"], {"iso3": "min", "name": "min"})


def union_shapes(rows: DataFrame, keys: list[str], keep: dict[str, str]) -> DataFrame:
    """Multi-part shape per key; the number of parts is bounded by the published file."""
    return rows.groupBy(*keys).agg(*[F.expr(f"{fn}({c})").alias(c) for c, fn in keep.items()],
                                   F.flatten(F.collect_list("rings")).alias("rings"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """First-level areas with sentinel values cleaned."""
    return _features(spark, path).select(
        _clean("iso_a2").alias("country"), _clean("iso_3166_2").alias("iso_3166_2"), _clean("postal").alias("postal_code"),
        F.coalesce(_clean("name"), _clean("woe_name")).alias("name"), _clean("type_en").alias("region_type"),
        rings_of(F.col("f.geometry")).alias("rings")).where(
        (F.length("country") == 2) & F.col("name").isNotNull() & F.col("rings").isNotNull())


def read_us_counties(spark: SparkSession, path: str) -> DataFrame:
    """Counties identified by their FIPS code, as names repeat."""
    fips = _clean("CODE_LOCAL")
    return _features(spark, path).select(
        F.lit("US").alias("country"), F.concat(F.lit("US-"), fips).alias("iso_3166_2"), fips.alias("postal_code"),
        _clean("NAME").alias("name"), F.lit("County").alias("region_type"),
        rings_of(F.col("f.geometry")).alias("rings")).where(
        F.col("postal_code").isNotNull() & F.col("name").isNotNull() & F.col("rings").isNotNull())
