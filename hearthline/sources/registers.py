"""Row-level sources: sale registers, transfer files, the postcode gazetteer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import parse as P
from ..functions import text as X

BOM = "﻿"


REGISTER_SCHEMA = ", ".join(f"{c} string" for c in [*K.REGISTER_COLUMNS, "_short"])
REGISTER_OPTIONS = {"columnNameOfCorruptRecord": "_short", "emptyValue": ""}


def read_register(spark: SparkSession, paths: list[str] | str) -> tuple[DataFrame, DataFrame]:
    """Headerless 16-column register, plain or gzip: (raw rows, rows with too few fields)."""
    return split_short(spark.read.schema(REGISTER_SCHEMA).options(**REGISTER_OPTIONS).csv(paths, header=False))


def split_short(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as read, batch or stream: (rows, rows with too few fields)."""
    raw = raw.withColumn("record_id", F.regexp_replace("record_id", "^" + BOM, ""))
    short = F.col("_short").isNotNull() & F.col("status").isNull()
    return raw.where(~short).drop("_short"), raw.where(short)


def register_problem() -> F.Column:
    """Why a register row cannot be loaded; null when it can."""
    price = P.number(F.col("price"))
    return (F.when(F.upper(F.trim("status")) == "D", "deleted")
            .when(price.isNull(), "price not a number")
            .when(price < K.MIN_REGISTER_PRICE, "price too low")
            .when(P.iso_date(F.col("date")).isNull(), "bad date"))


def register_sales(raw: DataFrame) -> DataFrame:
    """Normalised sales of a register; rows with a problem are left out. Every part is normalised once, in the inner projection."""
    def upper(c):
        return F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    titles = ("locality", "district", "county")
    parts = raw.where(register_problem().isNull()).select(
        F.trim("record_id").alias("source_record_id"), P.number(F.col("price")).alias("price"), P.iso_date(F.col("date")).alias("transaction_date"),
        X.norm_postcode(F.col("postcode")).alias("pc"), X.blank_to_null(X.norm_token(F.col("paon"))).alias("paon"), X.blank_to_null(X.norm_token(F.col("saon"))).alias("saon"),
        X.blank_to_null(X.norm_street(F.col("street"))).alias("street"), X.blank_to_null(X.norm_token(F.col("town"))).alias("town"),
        *[F.initcap(X.blank_to_null(X.norm_token(F.col(c)))).alias(c) for c in titles],
        F.coalesce(X.lookup(upper("type"), K.SALE_TYPE_CODES), F.lit("other")).alias("property_type"),
        F.coalesce(X.lookup(upper("duration"), K.TENURE_CODES), F.lit("unknown")).alias("tenure"), (upper("new_build") == "Y").alias("new_build"),
        F.coalesce(X.lookup(upper("category"), K.BASIS_CODES), F.lit("UNKNOWN")).alias("market_value_basis"))
    pc, paon, saon, street, town = (F.col(c) for c in ("pc", "paon", "saon", "street", "town"))
    code = X.postcode_parts(pc)
    return parts.select(
        "source_record_id", X.key_of_parts(pc, paon, saon, street, town).alias("property_key"), "price", "transaction_date",
        X.blank_to_null(pc).alias("postcode_norm"), X.blank_to_null(X.pretty_postcode(pc)).alias("postcode_pretty"),
        X.blank_to_null(code["outcode"]).alias("outcode"), X.blank_to_null(code["sector"]).alias("sector"), "property_type", "tenure", "new_build",
        "paon", "saon", F.initcap(street).alias("street"), X.display_address(saon, paon, street).alias("address_line"),
        "locality", F.initcap(town).alias("town"), "district", "county", "market_value_basis", (F.col("property_type") != "other").alias("is_residential"))


def read_transfers(spark: SparkSession, path: str, departments: list[str] | None = None, observed: Callable[[DataFrame], DataFrame] = lambda raw: raw) -> DataFrame:
    """Headed transfer file: sales only, valid date, chosen departments, typed columns. `observed` may count the raw rows."""
    raw = observed(spark.read.option("inferSchema", "false").csv(path, header=True))
    dept = F.trim("code_departement")
    kind = X.lookup(F.trim("type_local"), K.TRANSFER_TYPES)
    rows = raw.where((F.trim("nature_mutation") == K.TRANSFER_SALE_NATURE)
                     & P.iso_date(F.col("date_mutation")).isNotNull())
    if departments:
        rows = rows.where(dept.isin(departments))
    return rows.select(
        "id_mutation", "id_parcelle", P.iso_date(F.col("date_mutation")).alias("transaction_date"),
        P.number(F.col("valeur_fonciere")).alias("price"), kind.alias("property_type"),
        P.number(F.col("surface_reelle_bati")).alias("floor_area"),
        P.number(F.col("nombre_pieces_principales")).cast("int").alias("rooms"),
        P.number(F.col("surface_terrain")).alias("lot_area"),
        X.blank_to_null(X.norm_token(F.col("adresse_numero"))).alias("paon"),
        F.initcap(X.blank_to_null(X.norm_street(F.col("adresse_nom_voie")))).alias("street"),
        X.blank_to_null(F.trim("code_postal")).alias("postcode_norm"),
        F.initcap(X.blank_to_null(X.norm_token(F.col("nom_commune")))).alias("district"),
        X.blank_to_null(dept).alias("county"),
        P.number(F.col("longitude")).alias("lon"), P.number(F.col("latitude")).alias("lat"),
        F.coalesce(F.trim("type_local").isin(K.TRANSFER_COMMERCIAL), F.lit(False)).alias("is_commercial"))


def clean_transfers(rows: DataFrame) -> DataFrame:
    """Transfers of exactly one dwelling and no commercial part, within plausible bounds."""
    per = (rows.groupBy("id_mutation")
           .agg(F.count("property_type").alias("dwellings"), F.bool_or("is_commercial").alias("commercial"))
           .where((F.col("dwellings") == 1) & ~F.col("commercial")).select("id_mutation"))
    lo, hi = K.TRANSFER_PPSM
    sound = rows.where(
        F.col("property_type").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
        & (F.col("price") >= K.TRANSFER_MIN_PRICE) & (F.col("floor_area") >= K.TRANSFER_MIN_AREA)
        & (F.col("price") / F.col("floor_area")).between(lo, hi))
    return sound.join(per, "id_mutation", "left_semi")


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Headerless postcode gazetteer; rows without usable position or quality are dropped."""
    raw = spark.read.schema(", ".join(f"c{i} string" for i in range(15))).csv(path, header=False)
    quality = F.when(F.coalesce(F.col("c5"), F.lit("")) == "", 9).otherwise(F.trim("c5").try_cast("int"))
    rows = raw.where(F.col("c9").isNotNull()).select(
        F.upper(F.trim("c9")).alias("postcode"), F.upper(F.trim("c0")).alias("postcode_pretty"),
        F.col("c1").alias("status"), quality.alias("quality"), P.number(F.col("c7")).alias("lat"),
        P.number(F.col("c8")).alias("lon"), F.col("c12").alias("area"), F.col("c13").alias("outcode"),
        F.col("c14").alias("sector"))
    return rows.where(F.col("quality").isNotNull() & F.col("lat").between(-90, 90)
                      & F.col("lon").between(-180, 180) & (F.col("postcode") != ""))


def position_precision(quality: F.Column) -> F.Column:
    return F.when(quality <= 6, "POSTCODE").otherwise("NEIGHBOURHOOD")


def uk_country(area: F.Column) -> F.Column:
    return (F.when(area.isin(K.NORTHERN_IRISH_AREAS), "Northern Ireland")
            .when(area.isin(K.SCOTTISH_AREAS), "Scotland").when(area.isin(K.WELSH_AREAS), "Wales")
            .otherwise("England"))


def read_irish_register(spark: SparkSession, path: str) -> DataFrame:
    """Windows-1252 register: full market prices without VAT only; the price column by its prefix."""
    raw = spark.read.option("encoding", "iso-8859-1").csv(path, header=True)
    price = next(c for c in raw.columns if c.startswith("Price"))
    sold = next(c for c in raw.columns if c.startswith("Date of Sale"))
    return raw.select(
        X.from_latin1(F.trim("County")).alias("county"), P.sale_year(F.col(sold)).alias("year"),
        P.price_text(F.col(price)).alias("price"), F.trim("Not Full Market Price").alias("_partial"),
        F.trim("VAT Exclusive").alias("_vat")).where(
        (F.col("county") != "") & F.col("year").isNotNull() & F.col("price").isNotNull()
        & (F.col("_partial") == "No") & (F.col("_vat") == "No")).drop("_partial", "_vat")


def read_resale_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON pages of resale records."""
    schema = "result struct<records: array<struct<month: string, resale_price: string, floor_area_sqm: string>>>"
    rows = spark.read.schema(schema).json(path).select(F.explode("result.records").alias("r"))
    area = P.number(F.col("r.floor_area_sqm"))
    out = rows.select(
        F.split(F.trim("r.month"), "-")[0].try_cast("int").alias("year"), P.number(F.col("r.resale_price")).alias("price"),
        F.when(area > 0, P.number(F.col("r.resale_price")) / area).alias("price_per_sqm"))
    return out.where((F.col("price") > 0) & (F.col("year") >= 1990))
