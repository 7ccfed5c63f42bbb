"""Published index files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import parse as P


def area_level_of(code: Column) -> Column:
    clean = F.upper(F.trim(code))
    prefix = F.substring(clean, 1, 3)
    return (F.when(clean.startswith("K") | prefix.isin(K.COUNTRY_CODE_PREFIXES), "country")
            .when(prefix == K.REGION_CODE_PREFIX, "region")
            .when(prefix.isin(K.AUTHORITY_CODE_PREFIXES), "local_authority").otherwise("other"))


def read_wide_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per area, segment and month from the wide monthly file."""
    raw = spark.read.csv(path, header=True)
    have = set(raw.columns)

    def num(name):
        return P.num_sentinel(F.col(f"`{name}`")) if name in have else F.lit(None).cast("double")
    parts = [F.struct(F.lit(seg).alias("segment"), num(price).alias("average_price"), num(index).alias("index_value"),
                      (num(volume) if volume else F.lit(None)).cast("int").alias("sales_volume"),
                      num(m1).alias("pct_change_1m"), num(m12).alias("pct_change_12m"))
             for seg, (price, index, m1, m12, volume) in K.WIDE_INDEX_COLUMNS.items()]
    rows = raw.select(F.trim("AreaCode").alias("area_code"), F.trim("RegionName").alias("area_name"),
                      P.date_multi(F.col("Date")).alias("period"), F.explode(F.array(*parts)).alias("v"))
    return (rows.where((F.col("area_code") != "") & (F.col("area_name") != "") & F.col("period").isNotNull())
            .select("area_code", "area_name", area_level_of(F.col("area_code")).alias("area_level"), "period", "v.*")
            .where(F.col("average_price").isNotNull() | F.col("index_value").isNotNull()))


def read_master_index(spark: SparkSession, path: str) -> DataFrame:
    """State rows and the national row of the master file, every flavour still present."""
    raw = spark.read.csv(path, header=True)
    num = F.trim("period").try_cast("int")
    month = (F.when(F.col("frequency") == "monthly", num)
             .when(F.col("frequency") == "quarterly", (num - 1) * 3 + 1))
    level = (F.when(F.col("level") == "State", "state")
             .when((F.col("level") == "USA or Census Division") & (F.trim("place_id") == "USA"), "country"))
    value = F.coalesce(P.number(F.col("index_nsa")), P.number(F.col("index_sa")))
    return (raw.where(F.col("hpi_flavor").isin(K.INDEX_FLAVOURS))
            .select(F.trim("place_id").alias("place_id"), F.trim("place_name").alias("place_name"),
                    level.alias("area_level"), F.col("hpi_flavor").alias("flavour"), "frequency",
                    F.trim("yr").try_cast("int").alias("_year"), month.alias("_month"), value.alias("index_value"))
            .where(F.col("area_level").isNotNull() & (F.col("place_id") != "") & (F.col("place_name") != "")
                   & F.col("index_value").isNotNull() & F.col("_month").between(1, 12) & F.col("_year").isNotNull())
            .withColumn("period", F.make_date("_year", "_month", F.lit(1))).drop("_year", "_month"))


def best_flavour(rows: DataFrame) -> DataFrame:
    """One flavour per place, best rank first; a monthly point wins over a quarterly one."""
    rank = F.array_position(F.array(*[F.lit(f) for f in K.INDEX_FLAVOURS]), F.col("flavour"))
    best = rows.groupBy("place_id").agg(F.min_by("flavour", rank).alias("flavour"))
    kept = rows.join(best, ["place_id", "flavour"], "left_semi")
    w = Window.partitionBy("place_id", "period").orderBy(F.col("frequency") != "monthly", "index_value")
    return kept.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def with_yoy(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Change on the same period one year before, null where that period is absent."""
    before = rows.select(*keys, F.add_months("period", 12).alias("period"), F.col("index_value").alias("_before"))
    return (rows.join(before, [*keys, "period"], "left")
            .withColumn("pct_change_12m", F.when(F.col("_before") > 0, F.round(
                (F.col("index_value") / F.col("_before") - 1) * 100, 3))).drop("_before"))
