"""Property tables derived from the supplied star schema.

Every column comes from integer arithmetic on keys, so another engine can derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import cut_lineage


TYPE_BY_CLASS = {"STANDARD": "detached", "PROMO": "semi_detached", "ECONOMY": "terraced",
                 "MEDIUM": "flat", "LARGE": "house", "SMALL": "other"}
PC_AREAS = ["MK", "SW", "EH", "CF", "BT", "G", "LL", "N"]
PC_LETTERS = "ABDEFGHJLNPQRSTUWXYZ"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _tag(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), n.cast("string"))


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("long")


def _postcode(k: Column) -> dict[str, Column]:
    n = k % 1000
    area = F.element_at(F.array(*[F.lit(a) for a in PC_AREAS]), (n % 8 + 1).cast("int"))
    outcode = F.concat(area, (_div(n, 8) % 9 + 1).cast("string"))
    letters = F.lit(PC_LETTERS)
    unit = F.concat((_div(n, 72) % 10).cast("string"), F.substring(letters, (n % 20 + 1).cast("int"), F.lit(1)),
                    F.substring(letters, (_div(n, 20) % 20 + 1).cast("int"), F.lit(1)))
    return {"pc_area": area, "pc_outcode": outcode, "postcode": F.concat(outcode, unit)}


def _place(k: Column) -> dict[str, Column]:
    return {
        "sector": _tag("S", k % 1000), "outcode": _tag("O", k % 500), "district": _tag("D", k % 100),
        "county": _tag("C", k % 25),
        "lat": F.lit(50.0) + _div(k % 100, 10) * 0.2 + ((k * 7919) % 1000) / 10000.0,
        "lon": F.lit(-2.0) + (k % 10) * 0.2 + ((k * 104729) % 1000) / 10000.0,
    }


def dwellings(spark: SparkSession, sf: str) -> DataFrame:
    """One row per dwelling."""
    k = F.col("p_partkey")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_BY_CLASS.items() for x in kv]), F.col("p_type"))
    nation = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("r_name").alias("country"))
    part = table(spark, sf, "part").select(
        k.alias("property_id"), "p_name", F.col("p_size").cast("double").alias("floor_area"),
        kind.alias("property_type"), F.lit(None).cast("string").alias("_"),
        *[c.alias(n) for n, c in _place(k).items()], *[c.alias(n) for n, c in _postcode(k).items()]).drop("_")
    joined = part.join(nation, (part["property_id"] % 25) == nation["n_nationkey"]).drop("n_nationkey")
    return joined.withColumn("is_residential", F.col("property_type") != "other")


ROWS_PER_TASK = 500_000


def sales(spark: SparkSession, sf: str, by_home: bool = False) -> DataFrame:
    """One row per sale; record ids repeat, `sale_key` does not.

    `by_home` deals the sales out by dwelling, to as many tasks as their number needs: what one task holds does not grow.
    """
    li = table(spark, sf, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("source_record_id"),
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.col("l_quantity").cast("long")).alias("sale_key"),
        F.col("l_partkey").alias("property_id"), F.col("l_suppkey").alias("supplier_id"),
        F.to_date("l_shipdate").alias("transaction_date"), F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("sale_area"),
        F.when(F.col("l_returnflag") == "R", "ADDITIONAL").otherwise("STANDARD").alias("market_value_basis"),
        F.when(F.col("l_quantity") > 0, F.col("l_extendedprice") / F.col("l_quantity")).alias("price_per_sqm"))
    if by_home:
        rows = table(spark, sf, "lineitem").count()  # from file footers
        li = li.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_TASK)), "property_id")
    homes = dwellings(spark, sf).drop("p_name")
    return li.join(homes, "property_id").withColumn("year", F.year("transaction_date"))


def names(spark: SparkSession, sf: str) -> DataFrame:
    """Two spellings of area names: the published one and a hand-typed one."""
    k, name = F.col("p_partkey"), F.col("p_name")
    typed = (F.when(k % 5 == 0, F.upper(name)).when(k % 5 == 1, F.replace(name, F.lit(" "), F.lit("-")))
             .when(k % 5 == 2, F.concat(name, F.lit("s"))).when(k % 5 == 3, F.substring(name, 1, 7))
             .otherwise(F.concat(name, F.lit(", City Of"))))
    return table(spark, sf, "part").select(k.alias("k"), name.alias("published"), typed.alias("typed"))


def register_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Sale rows as the 16 text fields of a published register, with faulty ones among them."""
    li = table(spark, sf, "lineitem")
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    q, k, ln = F.col("l_quantity"), F.col("l_partkey"), F.col("l_linenumber")
    day = F.to_date("l_shipdate")
    pc = _postcode(k)["postcode"]
    code = F.element_at(F.create_map(*[F.lit(x) for x in (
        "STANDARD", "D", "PROMO", "S", "ECONOMY", "t", "MEDIUM", "F", "LARGE", "H", "SMALL", "O")]), F.col("p_type"))
    accented = F.translate(F.col("p_name"), "aeo", "áéö")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("record_id"),
        F.when(q == 13, "abc").when(q == 17, "99").when(q == 19, "NaN")
        .otherwise(F.col("l_extendedprice").cast("decimal(14,2)").cast("string")).alias("price"),
        F.when(q == 23, "not a date").when(q == 29, F.date_format(day, "dd/MM/yyyy"))
        .otherwise(F.concat(day.cast("string"), F.lit(" 00:00"))).alias("date"),
        F.when(ln % 3 == 0, F.lower(pc)).when(ln % 3 == 1, F.concat(
            F.substring(pc, F.lit(1), F.length(pc) - 3), F.lit(" "), F.substring(pc, -3, 3)))
        .otherwise(pc).alias("postcode"),
        code.alias("type"), F.when(F.col("l_tax") > 0.05, "Y").otherwise("N").alias("new_build"),
        F.element_at(F.array(F.lit("F"), F.lit("L"), F.lit("U"), F.lit("?")),
                     (F.col("l_suppkey") % 4 + 1).cast("int")).alias("duration"),
        (k % 120 + 1).cast("string").alias("paon"),
        F.when(F.col("p_type") == "MEDIUM", F.concat(
            F.when(ln % 2 == 0, "Flat ").otherwise("APARTMENT "), (k % 9 + 1).cast("string")))
        .otherwise("").alias("saon"),
        F.concat(F.when(ln % 4 == 1, accented).otherwise(F.col("p_name")),
                 F.when(ln % 2 == 0, " St.").otherwise(" Street")).alias("street"),
        F.lit("").alias("locality"), F.concat(F.lit("Town "), (k % 50).cast("string")).alias("town"),
        F.concat(F.lit("DISTRICT "), (k % 100).cast("string")).alias("district"),
        F.concat(F.lit("county "), (k % 25).cast("string")).alias("county"),
        F.when(F.col("l_returnflag") == "R", "B").when(F.col("l_returnflag") == "A", "A").otherwise(
            F.when(ln == 1, "").otherwise("a")).alias("category"),
        F.when((ln == 7) & (F.col("l_tax") == 0), "D").when(ln == 6, "C").otherwise("A").alias("status"))


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """One row per country, one of them a registered absence, and a few sub-national absences."""
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    gap = F.col("r_regionkey") == 4

    def row(region_code, region_name, absent, note):
        return [F.lit("register").alias("provider_key"), F.col("r_name").alias("country"), region_code.alias("region_code"),
                region_name.alias("region_name"), (~absent).alias("transaction_level"), (~absent).alias("characteristics"),
                (~absent).alias("market_index"), (~absent).alias("forecast_supported"),
                F.when(absent, "NONE").otherwise("EXACT_TRANSACTION").alias("max_precision"),
                F.when(~absent, "POSTCODE").alias("coordinate_precision"), F.lit("GBP").alias("currency"),
                F.when(absent, note).alias("notes"), F.array(F.lit("register"), F.lit("index")).alias("source_keys")]
    countries = r.select(*row(F.lit(None).cast("string"), F.col("r_name"), gap, F.concat(F.lit("No prices for "), "r_name")))
    absent = n.where("n_nationkey % 6 = 0").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    regions = absent.select(*row(F.col("n_name"), F.col("n_name"), F.lit(True), F.concat(F.lit("No prices for "), "n_name")))
    return countries.unionByName(regions)


def _ring(points: list[tuple[Column, Column]]) -> Column:
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in points])


def _patch(d: Column, ell: Column) -> Column:
    """Outline of one district patch: a square, or an L-shape."""
    x, y = F.lit(-2.0) + (d % 10) * 0.2, F.lit(50.0) + _div(d, 10) * 0.2
    square = _ring([(x, y), (x + 0.1, y), (x + 0.1, y + 0.1), (x, y + 0.1)])
    el = _ring([(x, y), (x + 0.15, y), (x + 0.15, y + 0.05), (x + 0.05, y + 0.05), (x + 0.05, y + 0.15), (x, y + 0.15)])
    return F.when(ell, el).otherwise(square)


def region_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Four patches per nation."""
    n = F.col("n_nationkey").cast("long")
    rings = F.array(*[_patch(n + 25 * j, n % 5 == 0) for j in range(4)])
    # stored, as outlines are: an expression of this size would be repeated in every filter on it
    return cut_lineage(table(spark, sf, "nation").select(F.col("n_name").alias("shape_id"), "n_regionkey", rings.alias("rings")))


def country_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """All patches of a country, and a large shape around half of them that no country owns."""
    parts = region_shapes(spark, sf).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own = parts.groupBy(F.col("r_name").alias("shape_id")).agg(F.flatten(F.collect_list("rings")).alias("rings"))
    w, e, s, n = map(F.lit, (-2.05, -1.02, 49.95, 51.02))
    outer = table(spark, sf, "region").where("r_regionkey = 0").select(F.lit("OUTER").alias("shape_id"), F.array(_ring([(w, s), (e, s), (e, n), (w, n)])).alias("rings"))
    return own.unionByName(outer)


def points(spark: SparkSession, sf: str) -> DataFrame:
    """One place per customer, some of them at sea."""
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        c.alias("point_id"), (F.lit(49.8) + (c * 37 % 2600) / 1000.0 + 0.0005).alias("lat"), (F.lit(-2.3) + (c * 91 % 2600) / 1000.0 + 0.0005).alias("lon"))


def viewports(spark: SparkSession, sf: str) -> DataFrame:
    """One map view per supplier, over all zooms, years and segments."""
    s = F.col("s_suppkey")
    zoom = F.element_at(F.array(*map(F.lit, (3.0, 5.0, 8.0, 9.5, 11.0, 12.5, 13.5, 15.0))), (s % 8 + 1).cast("int"))
    lat = F.lit(50.0) + (s * 7 % 10) * 0.2 + 0.03
    lon = F.lit(-2.0) + (s * 3 % 10) * 0.2 + F.when(s % 11 == 0, -0.08).otherwise(0.03)
    half = F.lit(360.0) / F.pow(F.lit(2.0), zoom) * F.when(zoom >= 12, 6.0).otherwise(1.0)
    return table(spark, sf, "supplier").select(
        s.alias("viewport_id"), (lon - half).alias("west"), (lat - half / 2).alias("south"), (lon + half).alias("east"), (lat + half / 2).alias("north"),
        zoom.alias("zoom"), (s % 9 + 1995).cast("int").alias("year"), F.when(s % 3 == 0, "flat").otherwise("all").alias("segment"))
