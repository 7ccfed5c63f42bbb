"""Queries on published figures: index files, statistical cubes, boundary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bridge
from .. import constants as K
from ..functions import parse as P
from ..functions import text as X
from ..operators import published as B
from ..session import fresh_path
from ..sources import boundaries, cubes, indices, registers
from .book import book, rounded
from .oracle import cte

QUERIES, ORACLE, query = book()


def land(df: DataFrame, name: str) -> str:
    """Write one text column as a landed document."""
    path = fresh_path(df.sparkSession, name)
    df.coalesce(1).write.text(path)
    return path


def cents() -> F.Column:
    return F.round(F.col("price") * 100).cast("long")


def whole_mean(cond: F.Column | None = None) -> F.Column:
    """Mean price in whole units, by integer arithmetic."""
    c = cents() if cond is None else F.when(cond, cents())
    return F.floor(F.sum(c) / F.count(c) / 100).cast("long")


MEAN_SQL = "CAST(floor(sum(CAST(round(price*100) AS BIGINT))/count(*)/100) AS BIGINT)"

# --- wide monthly index file -------------------------------------------------
cte("wide_raw", """
SELECT property_id%25 AS c, date_trunc('month',transaction_date)::DATE AS period, count(*) AS n,
  CAST(floor(sum(CAST(round(price*100) AS BIGINT))/count(*)/100) AS BIGINT) AS p_all,
  CAST(floor(sum(CASE WHEN property_type='detached' THEN CAST(round(price*100) AS BIGINT) END)
    /count(CASE WHEN property_type='detached' THEN 1 END)/100) AS BIGINT) AS p_det
FROM sales GROUP BY 1,2""")
cte("wide_index", """
SELECT CASE c WHEN 0 THEN 'K02' WHEN 1 THEN 'E92' WHEN 2 THEN 'E12' WHEN 3 THEN 'X99' ELSE 'E06' END||lpad(CAST(c AS VARCHAR),6,'0') AS area_code,
  'Area '||c AS area_name, CASE c WHEN 0 THEN 'country' WHEN 1 THEN 'country' WHEN 2 THEN 'region' WHEN 3 THEN 'other' ELSE 'local_authority' END AS area_level,
  period, seg.s AS segment,
  CAST(CASE seg.s WHEN 'all' THEN p_all ELSE p_det END AS DOUBLE) AS average_price,
  CASE WHEN seg.s='all' AND n%5<>0 THEN CAST(p_all//100 AS DOUBLE) END AS index_value,
  CASE WHEN seg.s='all' THEN CAST(n AS INTEGER) END AS sales_volume,
  CASE WHEN seg.s='all' AND n%7<>0 THEN n/10.0::DOUBLE END AS pct_change_12m
FROM wide_raw, (SELECT unnest(['all','detached']) AS s) seg
WHERE CASE seg.s WHEN 'all' THEN p_all ELSE p_det END IS NOT NULL""")


def wide_file(spark: SparkSession, sf: str) -> str:
    rows = bridge.sales(spark, sf).groupBy((F.col("property_id") % 25).alias("c"), F.trunc("transaction_date", "month").alias("m")).agg(
        F.count(F.lit(1)).alias("n"), whole_mean().alias("a"), whole_mean(F.col("property_type") == "detached").alias("d"))
    prefix = F.when(F.col("c") == 0, "K02").when(F.col("c") == 1, "E92").when(F.col("c") == 2, "E12").when(F.col("c") == 3, "X99").otherwise("E06")
    out = rows.select(
        F.when(F.col("n") % 2 == 0, F.date_format("m", "dd/MM/yyyy")).otherwise(F.date_format("m", "yyyy-MM-dd")).alias("Date"),
        F.concat(F.lit("Area "), F.col("c").cast("string")).alias("RegionName"),
        F.concat(prefix, F.lpad(F.col("c").cast("string"), 6, "0")).alias("AreaCode"), F.col("a").alias("AveragePrice"),
        F.when(F.col("n") % 5 == 0, "NA").otherwise(F.floor(F.col("a") / 100).cast("string")).alias("Index"),
        F.lit(":").alias("1m%Change"), F.when(F.col("n") % 7 == 0, "-").otherwise((F.col("n") / 10).cast("string")).alias("12m%Change"),
        F.col("n").alias("SalesVolume"), F.coalesce(F.col("d").cast("string"), F.lit("N/A")).alias("DetachedPrice"))
    path = fresh_path(spark, "wide-index")
    out.write.csv(path, header=True)
    return path


@query("src_hpi", "SELECT area_code, area_name, period, segment, average_price, index_value, sales_volume, pct_change_12m FROM wide_index")
def src_hpi(spark: SparkSession, sf: str) -> DataFrame:
    return indices.read_wide_index(spark, wide_file(spark, sf)).drop("area_level", "pct_change_1m")


@query("hpi_level", "SELECT area_code, area_level, count(*) AS points FROM wide_index GROUP BY ALL")
def hpi_level(spark: SparkSession, sf: str) -> DataFrame:
    return indices.read_wide_index(spark, wide_file(spark, sf)).groupBy("area_code", "area_level").agg(F.count(F.lit(1)).alias("points"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """Published-looking texts made from sale lines."""
    li = bridge.table(spark, sf, "lineitem")
    q, d, price = F.col("l_quantity"), F.to_date("l_shipdate"), F.col("l_extendedprice").cast("decimal(14,2)")
    return li.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q.cast("long")).alias("id"),
        F.when(q == 1, "NA").when(q == 2, ":").when(q == 3, "-").when(q == 4, "").when(q == 5, "nan")
        .when(q == 6, "12abc").otherwise(F.concat(F.lit(" "), price.cast("string"))).alias("num"),
        F.when(q == 7, "31/02/1999").when(q % 2 == 0, F.date_format(d, "dd/MM/yyyy")).when(q == 9, "1999-13-01")
        .otherwise(d.cast("string")).alias("day"),
        F.when(q == 8, "1999-X1").otherwise(F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))).alias("quarter"),
        F.when(q == 10, "€").when(q == 11, "€0.00").otherwise(F.concat(F.lit("€"), F.format_number("l_extendedprice", 2))).alias("money"),
        F.date_format(d, "dd/MM/yyyy").alias("dmy"), (F.col("l_tax") * 100).cast("long").alias("t"))


_TEXT_ID = "l_orderkey||':'||l_linenumber||':'||l_partkey||':'||l_suppkey||':'||CAST(l_quantity AS BIGINT) AS id"


@query("num_sentinel", f"SELECT {_TEXT_ID}, CASE WHEN l_quantity>6 THEN CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS DOUBLE) END AS value FROM lineitem")
def num_sentinel(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("id", P.num_sentinel(F.col("num")).alias("value"))


@query("date_multi", f"SELECT {_TEXT_ID}, CASE WHEN l_quantity NOT IN (7,9) THEN CAST(l_shipdate AS DATE) END AS day FROM lineitem")
def date_multi(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("id", P.date_multi(F.col("day")).alias("day"))


@query("quarter_date", f"SELECT {_TEXT_ID}, CASE WHEN l_quantity<>8 THEN CAST(date_trunc('quarter',l_shipdate) AS DATE) END AS period FROM lineitem")
def quarter_date(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("id", P.quarter_date(F.col("quarter")).alias("period"))


@query("price_text", f"SELECT {_TEXT_ID}, CASE WHEN l_quantity NOT IN (10,11) THEN CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS DOUBLE) END AS price FROM lineitem")
def price_text(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("id", P.price_text(F.col("money")).alias("price"))


@query("sale_year", f"SELECT {_TEXT_ID}, CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem")
def sale_year(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("id", P.sale_year(F.col("dmy")).alias("year"))


# --- Irish-style register ----------------------------------------------------
cte("irish", """
SELECT CASE property_id%25 WHEN 0 THEN 'Dublin' WHEN 1 THEN 'Dún – 1' ELSE 'County '||(property_id%25) END AS county, year, price
FROM sales WHERE market_value_basis='STANDARD' AND supplier_id%10<>3 AND sale_area NOT IN (13,17)""")
cte("irish_places", "SELECT 'county' AS area_level, county AS area_name, year, price FROM irish UNION ALL SELECT 'country','Ireland',year,price FROM irish")


def _exclusive(p: float, col: str = "l") -> str:
    h = f"((len({col})+1)*{p})"
    lo = f"list_extract({col},CAST(floor({h}) AS BIGINT))"
    hi = f"list_extract({col},CAST(floor({h}) AS BIGINT)+1)"
    return f"({lo}+coalesce(({hi}-{lo})*({h}-floor({h})),0))"


cte("irish_stats", f"""
SELECT area_level, area_name, year, len(l) AS transaction_count, {_exclusive(0.25)} AS p25_price,
  {_exclusive(0.5)} AS median_price, {_exclusive(0.75)} AS p75_price
FROM (SELECT area_level, area_name, year, list_sort(list(price)) AS l FROM irish_places GROUP BY 1,2,3) WHERE len(l)>=30""")


def irish_file(spark: SparkSession, sf: str) -> str:
    c = F.col("property_id") % 25
    county = F.when(c == 0, "Dublin").when(c == 1, "Dún – 1").otherwise(F.concat(F.lit("County "), c.cast("string")))
    area = F.col("sale_area")
    rows = bridge.sales(spark, sf).select(
        F.date_format("transaction_date", "dd/MM/yyyy").alias("Date of Sale (dd/mm/yyyy)"), F.lit("Dún Street").alias("Address"),
        X.to_latin1(F.when(area == 13, "").otherwise(county)).alias("County"),
        X.to_latin1(F.when(area == 17, "€0.00").otherwise(F.concat(F.lit("€"), F.format_number("price", 2)))).alias("Price (\x80)"),
        F.when(F.col("market_value_basis") == "STANDARD", "No").otherwise("Yes").alias("Not Full Market Price"),
        F.when(F.col("supplier_id") % 10 == 3, "Yes").otherwise("No").alias("VAT Exclusive"))
    path = fresh_path(spark, "irish")
    rows.write.option("encoding", "iso-8859-1").option("emptyValue", "").csv(path, header=True)
    return path


@query("src_ie", "SELECT county, year, count(*) AS records, sum(CAST(round(price*100) AS BIGINT))::BIGINT AS total_cents FROM irish GROUP BY ALL")
def src_ie(spark: SparkSession, sf: str) -> DataFrame:
    return registers.read_irish_register(spark, irish_file(spark, sf)).groupBy("county", "year").agg(
        F.count(F.lit(1)).alias("records"), F.sum(cents()).alias("total_cents"))


@query("ie_filter", "SELECT county, year, price FROM irish")
def ie_filter(spark: SparkSession, sf: str) -> DataFrame:
    return registers.read_irish_register(spark, irish_file(spark, sf)).select("county", "year", "price")


@query("agg_ie", """
SELECT a.area_level, a.area_name, a.year, a.transaction_count, round(a.p25_price,6) AS p25_price, round(a.median_price,6) AS median_price,
  round(a.p75_price,6) AS p75_price, round((a.median_price/p.median_price-1)*100,3) AS growth_1y_pct
FROM irish_stats a LEFT JOIN irish_stats p ON p.area_level=a.area_level AND p.area_name=a.area_name AND p.year=a.year-1""")
def agg_ie(spark: SparkSession, sf: str) -> DataFrame:
    rows = registers.read_irish_register(spark, irish_file(spark, sf))
    return rounded(B.yearly_medians(B.county_and_national(rows, "Ireland"), ["area_level", "area_name"]), 6)


# --- resale pages ------------------------------------------------------------
cte("resale", """
SELECT year, price, CASE WHEN sale_area<>5 THEN price/sale_area END AS price_per_sqm FROM sales WHERE sale_area<>7""")


def resale_pages(spark: SparkSession, sf: str) -> str:
    area = F.col("sale_area")
    rec = F.struct(F.date_format("transaction_date", "yyyy-MM").alias("month"),
                   F.when(area == 7, "0").otherwise(F.col("price").cast("decimal(14,2)").cast("string")).alias("resale_price"),
                   F.when(area == 5, "").otherwise(area.cast("string")).alias("floor_area_sqm"))
    # one record per page keeps the landing free of grouping; the reader takes pages of any length
    rows = bridge.sales(spark, sf).select(F.array(rec).alias("records"))
    path = fresh_path(spark, "resale")
    rows.select(F.to_json(F.struct(F.struct("records").alias("result"))).alias("value")).write.text(path)
    return path


@query("src_hdb", "SELECT year, count(*) AS records, count(price_per_sqm) AS with_area, sum(CAST(round(price*100) AS BIGINT))::BIGINT AS total_cents FROM resale GROUP BY 1")
def src_hdb(spark: SparkSession, sf: str) -> DataFrame:
    return registers.read_resale_pages(spark, resale_pages(spark, sf)).groupBy("year").agg(
        F.count(F.lit(1)).alias("records"), F.count("price_per_sqm").alias("with_area"), F.sum(cents()).alias("total_cents"))


cte("resale_stats", f"""
SELECT year, len(l) AS transaction_count, {_exclusive(0.25)} AS p25_price, {_exclusive(0.5)} AS median_price,
  {_exclusive(0.75)} AS p75_price, {_exclusive(0.5, 'm')} AS median_price_per_sqm
FROM (SELECT year, list_sort(list(price)) AS l, list_sort(list(price_per_sqm) FILTER (price_per_sqm IS NOT NULL)) AS m FROM resale GROUP BY 1)
WHERE len(l)>=30""")


@query("agg_sg", """
SELECT 'SG' AS area_code, a.year, a.transaction_count, round(a.p25_price,6) AS p25_price, round(a.median_price,6) AS median_price,
  round(a.p75_price,6) AS p75_price, round(a.median_price_per_sqm,6) AS median_price_per_sqm,
  round((a.median_price/p.median_price-1)*100,3) AS growth_1y_pct
FROM resale_stats a LEFT JOIN resale_stats p ON p.year=a.year-1""")
def agg_sg(spark: SparkSession, sf: str) -> DataFrame:
    rows = registers.read_resale_pages(spark, resale_pages(spark, sf)).withColumn("area_code", F.lit("SG"))
    return rounded(B.yearly_medians(rows, ["area_code"], with_area=True), 6)


# --- cubes -------------------------------------------------------------------
_GEO = "CASE c WHEN 0 THEN 'EL' WHEN 1 THEN 'UK' WHEN 2 THEN 'EA19' WHEN 3 THEN 'XYZ' ELSE chr(CAST(65+c AS INTEGER))||'Q' END"
cte("quarter_counts", """
SELECT property_id%25 AS c, CAST(date_trunc('quarter',transaction_date) AS DATE) AS period, count(*) AS n FROM sales GROUP BY 1,2""")
cte("cube2d", f"""
SELECT CASE g WHEN 'EL' THEN 'GR' WHEN 'UK' THEN 'GB' ELSE g END AS country, 'Label '||c AS area_name, period, n*1.5::DOUBLE AS index_value
FROM (SELECT *, {_GEO} AS g FROM quarter_counts) WHERE g NOT IN ('EA19','XYZ')""")


def quarter_position(d: F.Column) -> F.Column:
    return ((F.year(d) - 1995) * 4 + F.quarter(d) - 1).cast("int")


def quarter_text(d: F.Column) -> F.Column:
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def as_map(key: F.Column, value: F.Column) -> F.Column:
    """Map of a bounded set of pairs (cube axes and cells)."""
    return F.map_from_entries(F.collect_set(F.struct(key.alias("k"), value.alias("v"))))


def category(index: F.Column, label: F.Column | None = None) -> F.Column:
    parts = [index.alias("index")] + ([label.alias("label")] if label is not None else [])
    return F.struct(F.struct(*parts).alias("category"))


def cube2d_file(spark: SparkSession, sf: str) -> str:
    cells = bridge.sales(spark, sf).groupBy((F.col("property_id") % 25).cast("int").alias("c"), F.trunc("transaction_date", "quarter").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    c = F.col("c")
    geo = F.when(c == 0, "EL").when(c == 1, "UK").when(c == 2, "EA19").when(c == 3, "XYZ").otherwise(F.concat(F.char(c + 65), F.lit("Q")))
    pos = (c * 28 + quarter_position(F.col("p"))).cast("string")
    doc = cells.withColumn("g", geo).agg(
        F.struct(category(as_map(F.col("g"), c), as_map(F.col("g"), F.concat(F.lit("Label "), c.cast("string")))).alias("geo"),
                 category(as_map(quarter_text(F.col("p")), quarter_position(F.col("p")))).alias("time")).alias("dimension"),
        as_map(pos, F.col("n") * 1.5).alias("value"))
    return land(doc.select(F.to_json(F.struct("dimension", "value")).alias("value")), "cube2d")


@query("src_jsonstat_2d", "SELECT * FROM cube2d")
def src_jsonstat_2d(spark: SparkSession, sf: str) -> DataFrame:
    return cubes.read_cube_2d(spark, cube2d_file(spark, sf))


@query("agg_yoy_index", """
SELECT a.country, a.period, a.index_value, round((a.index_value/b.index_value-1)*100,3) AS pct_change_12m
FROM cube2d a LEFT JOIN cube2d b ON b.country=a.country AND b.period=a.period - INTERVAL 1 YEAR""")
def agg_yoy_index(spark: SparkSession, sf: str) -> DataFrame:
    return indices.with_yoy(cubes.read_cube_2d(spark, cube2d_file(spark, sf)).drop("area_name"), ["country"])


@query("country_currency", """
SELECT DISTINCT country, CASE WHEN country IN ('GB') THEN 'GBP' WHEN country='GR' THEN 'EUR' END AS currency FROM cube2d""")
def country_currency(spark: SparkSession, sf: str) -> DataFrame:
    return cubes.read_cube_2d(spark, cube2d_file(spark, sf)).select("country").distinct().withColumn(
        "currency", X.lookup(F.col("country"), K.COUNTRY_CURRENCY))


_TYPES = ["detached", "flat", "house", "other", "semi_detached", "terraced"]
cte("nd_cells", f"""
SELECT country, property_type AS kind, CAST(date_trunc('quarter',transaction_date) AS DATE) AS period, count(*) AS n,
  {MEAN_SQL}//1000 AS k FROM sales GROUP BY 1,2,3""")


def nd_files(spark: SparkSession, sf: str) -> tuple[str, str]:
    """A sparse cube of mean prices (thousands) and a dense cube of sale counts."""
    regions = bridge.table(spark, sf, "region").select(F.col("r_name").alias("country"), F.col("r_regionkey").alias("r"))
    kinds = F.create_map(*[F.lit(x) for i, t in enumerate(_TYPES) for x in (t, i)])
    cells = bridge.sales(spark, sf).groupBy("country", "property_type", F.trunc("transaction_date", "quarter").alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.floor(whole_mean() / 1000).alias("k")).join(regions, "country")
    cells = cells.withColumn("kind", F.element_at(kinds, F.col("property_type")))
    width = 5 * len(_TYPES) * 28
    cells = cells.withColumn("pos", (F.col("r") * len(_TYPES) + F.col("kind")) * 28 + quarter_position(F.col("p")))
    axes = F.create_map(
        F.lit("REGION"), category(as_map(F.col("country"), F.col("r").cast("int")), as_map(F.col("country"), F.initcap("country"))),
        F.lit("KIND"), category(as_map(F.col("property_type"), F.col("kind").cast("int")), as_map(F.col("property_type"), F.col("property_type"))),
        F.lit("TID"), category(as_map(quarter_text(F.col("p")), quarter_position(F.col("p"))), as_map(quarter_text(F.col("p")), quarter_text(F.col("p")))))
    head = [F.array(*map(F.lit, ("REGION", "KIND", "TID"))).alias("id"), F.array(F.lit(5), F.lit(len(_TYPES)), F.lit(28)).alias("size")]
    built = cells.agg(axes.alias("dimension"), as_map(F.col("pos").cast("string"), F.col("k").cast("double")).alias("prices"),
                      as_map(F.col("pos").cast("int"), F.col("n").cast("double")).alias("counts"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.try_element_at("counts", i))
    price = land(built.select(F.to_json(F.struct(*head, "dimension", F.col("prices").alias("value"))).alias("value")), "cube-prices")
    count = land(built.select(F.to_json(F.struct(*head, "dimension", dense.alias("value")), {"ignoreNullFields": "false"}).alias("value")), "cube-counts")
    return price, count


@query("src_jsonstat_nd", """SELECT country AS region_code, upper(left(country,1))||lower(substr(country,2)) AS region_label, kind, period,
  CAST(n AS DOUBLE) AS sales_count, CAST(k AS DOUBLE) AS price_thousands FROM nd_cells WHERE country<>'MIDDLE EAST'""")
def src_jsonstat_nd(spark: SparkSession, sf: str) -> DataFrame:
    price, count = nd_files(spark, sf)
    axes = ["REGION", "KIND", "TID"]
    a = cubes.read_cube_nd(spark, price, axes).withColumnRenamed("value", "price_thousands")
    b = cubes.read_cube_nd(spark, count, axes).withColumnRenamed("value", "sales_count").drop("REGION_label", "KIND_label", "TID_label")
    return a.join(b, ["REGION_code", "KIND_code", "TID_code"]).where("REGION_code <> 'MIDDLE EAST'").select(
        F.col("REGION_code").alias("region_code"), F.col("REGION_label").alias("region_label"), F.col("KIND_code").alias("kind"),
        P.quarter_date(F.col("TID_code")).alias("period"), "sales_count", "price_thousands")


@query("agg_weighted_mean", """
SELECT country AS region, CAST(year(period) AS INTEGER) AS year, round(sum(k*1000.0::DOUBLE*n)/sum(n),4) AS price, sum(n)::BIGINT AS transaction_count
FROM nd_cells GROUP BY 1,2""")
def agg_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    price, count = nd_files(spark, sf)
    axes = ["REGION", "KIND", "TID"]
    on = ["REGION_code", "KIND_code", "TID_code"]
    a = cubes.read_cube_nd(spark, price, axes).select(*on, (F.col("value") * 1000).alias("price"))
    b = cubes.read_cube_nd(spark, count, axes).select(*on, F.col("value").alias("weight"))
    quarters = a.join(b, on).select(F.col("REGION_code").alias("region"), F.substring("TID_code", 1, 4).cast("int").alias("year"), "price", "weight")
    return rounded(B.weighted_annual_mean(quarters, ["region"]), 4)


# --- series keyed by position ------------------------------------------------
cte("state_quarters", f"""
SELECT property_id%9 AS s, CAST(date_trunc('quarter',transaction_date) AS DATE) AS period, {MEAN_SQL}//1000 AS k
FROM sales GROUP BY 1,2""")
_STATE = "CASE s " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(K.AUSTRALIAN_STATES.values())) + " END"
cte("state_years", f"""
SELECT {_STATE} AS area_name, CAST(year(period) AS INTEGER) AS year, arg_max(k,period)*1000.0::DOUBLE AS price FROM state_quarters GROUP BY 1,2""")


def observations_file(spark: SparkSession, sf: str) -> str:
    codes = list(K.AUSTRALIAN_STATES)
    cells = bridge.sales(spark, sf).groupBy((F.col("property_id") % 9).cast("int").alias("s"), F.trunc("transaction_date", "quarter").alias("p")).agg(
        F.floor(whole_mean() / 1000).cast("double").alias("k"))
    per = cells.groupBy("s").agg(as_map(quarter_position(F.col("p")).cast("string"), F.array("k")).alias("observations"))
    times = F.transform(F.sequence(F.lit(0), F.lit(27)), lambda i: F.struct(F.concat(
        (F.floor(i / 4) + 1995).cast("string"), F.lit("-Q"), (i % 4 + 1).cast("string")).alias("id")))
    regions = F.array(*[F.struct(F.lit(c).alias("id")) for c in codes])
    series = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("0:"), F.col("s").cast("string"), F.lit(":0")).alias("k"),
                                                        F.struct("observations").alias("v"))))
    one = F.array(F.struct(F.lit("5").alias("id")))
    shape = F.struct(F.struct(F.array(F.struct(F.lit("MEASURE").alias("id"), one.alias("values")), F.struct(F.lit("REGION").alias("id"), regions.alias("values")),
                                      F.struct(F.lit("FREQ").alias("id"), one.alias("values"))).alias("series"),
                              F.array(F.struct(F.lit("TIME").alias("id"), times.alias("values"))).alias("observation")).alias("dimensions"))
    doc = per.agg(series.alias("series")).select(F.to_json(F.struct(F.struct(
        F.array(F.struct("series")).alias("dataSets"), F.array(shape).alias("structures")).alias("data"))).alias("value"))
    return land(doc, "observations")


def state_rows(spark: SparkSession, sf: str) -> DataFrame:
    obs = cubes.read_observations(spark, observations_file(spark, sf))
    return obs.select(X.lookup(F.col("region"), K.AUSTRALIAN_STATES).alias("area_name"), "period_text", "value")


@query("src_sdmx", f"SELECT {_STATE} AS area_name, year(period)||'-Q'||quarter(period) AS period_text, CAST(k AS DOUBLE) AS value FROM state_quarters")
def src_sdmx(spark: SparkSession, sf: str) -> DataFrame:
    return state_rows(spark, sf)


@query("unit_scale", f"SELECT {_STATE} AS area_name, period, k*1000.0::DOUBLE AS price FROM state_quarters")
def unit_scale(spark: SparkSession, sf: str) -> DataFrame:
    return state_rows(spark, sf).select("area_name", P.quarter_date(F.col("period_text")).alias("period"), (F.col("value") * 1000).alias("price"))


@query("agg_last_period", """
SELECT a.area_name, a.year, a.price, round((a.price/b.price-1)*100,3) AS growth_1y_pct
FROM state_years a LEFT JOIN state_years b ON b.area_name=a.area_name AND b.year=a.year-1""")
def agg_last_period(spark: SparkSession, sf: str) -> DataFrame:
    rows = state_rows(spark, sf).select("area_name", "period_text", (F.col("value") * 1000).alias("price"))
    return B.published_with_growth(B.last_period_of_year(rows, ["area_name"], ["price"], "period_text"), ["area_name"])


# --- annual rows with titles -------------------------------------------------
cte("annual", f"""
SELECT property_id%25 AS c, year, {MEAN_SQL} AS p FROM sales GROUP BY 1,2""")
cte("provinces", """
SELECT CASE c WHEN 0 THEN 'NL01' ELSE 'PV'||(19+c) END AS code, year, CAST(p AS DOUBLE) AS price,
  CASE c WHEN 0 THEN 'country' ELSE 'county' END AS area_level,
  CASE c WHEN 0 THEN 'Netherlands' WHEN 1 THEN 'Friesland' WHEN 12 THEN 'PV31' ELSE 'Province '||c END AS area_name
FROM annual WHERE c<=12 AND NOT (c=5 AND year=1997)""")


def annual_files(spark: SparkSession, sf: str) -> tuple[str, str]:
    c = F.col("c")
    rows = bridge.sales(spark, sf).groupBy((F.col("property_id") % 25).alias("c"), "year").agg(whole_mean().alias("p"))
    code = F.when(c == 0, "NL01").when(c <= 12, F.concat(F.lit("PV"), (c + 19).cast("string"))).otherwise(F.concat(F.lit("GM"), c.cast("string")))
    price = F.when(~((c == 5) & (F.col("year") == 1997)), F.col("p").cast("double"))
    recs = rows.select(code.alias("RegioS"), price.alias("GemiddeldeVerkoopprijs_1"), F.explode(F.array(
        F.concat(F.col("year").cast("string"), F.lit("JJ00")), F.concat(F.col("year").cast("string"), F.lit("KW01")))).alias("Perioden"))
    data = land(recs.agg(F.collect_list(F.struct("RegioS", "Perioden", "GemiddeldeVerkoopprijs_1")).alias("value")).select(F.to_json(F.struct("value")).alias("value")), "annual")
    name = F.when(c == 1, "Fryslân (PV)").otherwise(F.concat(F.lit("Province "), c.cast("string"), F.lit(" (PV)")))
    titles = rows.where((c > 0) & (c < 12)).select(F.concat(code, F.lit("  ")).alias("Key"), name.alias("Title")).distinct()
    return data, land(titles.agg(F.collect_list(F.struct("Key", "Title")).alias("value")).select(F.to_json(F.struct("value")).alias("value")), "titles")


@query("src_odata", "SELECT * FROM provinces")
def src_odata(spark: SparkSession, sf: str) -> DataFrame:
    return cubes.read_annual_prices(spark, *annual_files(spark, sf))


@query("agg_published", """
SELECT a.area_level, a.area_name, a.code, a.year, a.price, round((a.price/b.price-1)*100,3) AS growth_1y_pct,
  CASE WHEN a.area_level='county' THEN CAST(n.n_nationkey AS BIGINT) END AS region_id
FROM provinces a LEFT JOIN provinces b ON b.area_level=a.area_level AND b.area_name=a.area_name AND b.year=a.year-1
LEFT JOIN nation n ON a.area_name='Province '||n.n_nationkey AND n.n_nationkey<11""")
def agg_published(spark: SparkSession, sf: str) -> DataFrame:
    rows = cubes.read_annual_prices(spark, *annual_files(spark, sf))
    shapes = bridge.table(spark, sf, "nation").where("n_nationkey < 11").select(
        F.concat(F.lit("Province "), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_nationkey").cast("long").alias("region_id"))
    grown = B.published_with_growth(rows, ["area_level", "area_name"])
    return B.link_regions_by_name(grown, shapes).drop("shape_parts")


# --- census arrays -----------------------------------------------------------
cte("census_raw", f"""
SELECT lpad(CAST(s//25 AS VARCHAR),2,'0')||lpad(CAST(s%25 AS VARCHAR),3,'0') AS fips, 'Place '||s||' County' AS area_name, s, p, n
FROM (SELECT property_id%1000 AS s, {MEAN_SQL} AS p, count(*) AS n FROM sales GROUP BY 1)""")


def census_file(spark: SparkSession, sf: str) -> str:
    rows = bridge.sales(spark, sf).groupBy((F.col("property_id") % 1000).alias("s"), ).agg(whole_mean().alias("p"), F.count(F.lit(1)).alias("n"))
    s = F.col("s")
    value = F.when(s % 17 == 0, "-666666666").when(s % 19 == 0, "").otherwise(F.col("p").cast("string"))
    margin = F.when(s % 5 == 0, F.floor(F.col("p") / 2).cast("string")).when(s % 7 == 0, F.lit(None)).otherwise(F.floor(F.col("p") / 10).cast("string"))
    row = F.array(F.concat(F.lit("Place "), s.cast("string"), F.lit(" County, State")), value, margin,
                  F.lpad(F.floor(s / 25).cast("string"), 2, "0"), F.lpad((s % 25).cast("string"), 3, "0"))
    head = F.array(*map(F.lit, ("NAME", K.CENSUS_VALUE, K.CENSUS_MARGIN, "state", "county")))
    doc = rows.agg(F.concat(F.array(head), F.collect_list(row)).alias("a")).select(F.to_json("a", {"ignoreNullFields": "false"}).alias("value"))
    return land(doc, "census")


@query("src_census", """SELECT fips, area_name, CASE WHEN s%17=0 THEN '-666666666' WHEN s%19=0 THEN '' ELSE CAST(p AS VARCHAR) END AS value_text,
  CASE WHEN s%5=0 THEN CAST(p//2 AS VARCHAR) WHEN s%7=0 THEN NULL ELSE CAST(p//10 AS VARCHAR) END AS margin_text FROM census_raw""")
def src_census(spark: SparkSession, sf: str) -> DataFrame:
    return cubes.read_census(spark, census_file(spark, sf))


@query("census_filter", """SELECT fips, area_name, CAST(p AS DOUBLE) AS value FROM census_raw WHERE s%17<>0 AND s%19<>0 AND s%5<>0""")
def census_filter(spark: SparkSession, sf: str) -> DataFrame:
    return cubes.sound_estimates(cubes.read_census(spark, census_file(spark, sf))).select("fips", "area_name", "value")


# --- master index file -------------------------------------------------------
cte("master_raw", """
SELECT property_id%25 AS c, CAST(date_trunc('month',transaction_date) AS DATE) AS period, count(*) AS n FROM sales GROUP BY 1,2""")
cte("master", """
SELECT CASE c WHEN 0 THEN 'USA' ELSE 'T'||c END AS place_id, CASE c WHEN 0 THEN 'country' ELSE 'state' END AS area_level,
  'purchase-only' AS flavour, 'monthly' AS frequency, period, CAST(n AS DOUBLE) AS index_value FROM master_raw WHERE c%3<>1
UNION ALL
SELECT CASE c WHEN 0 THEN 'USA' ELSE 'T'||c END, CASE c WHEN 0 THEN 'country' ELSE 'state' END, 'all-transactions', 'quarterly',
  CAST(date_trunc('quarter',period) AS DATE), sum(n)*2.0::DOUBLE FROM master_raw GROUP BY c, date_trunc('quarter',period)""")
cte("master_best", "SELECT place_id, area_level, flavour, period, index_value FROM master WHERE flavour='purchase-only' OR CAST(coalesce(nullif(substr(place_id,2),'SA'),'0') AS INTEGER)%3=1")


def master_file(spark: SparkSession, sf: str) -> str:
    c = F.col("c")
    month = bridge.sales(spark, sf).groupBy((F.col("property_id") % 25).alias("c"), F.trunc("transaction_date", "month").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    quarter = month.groupBy("c", F.trunc("p", "quarter").alias("p")).agg((F.sum("n") * 2).alias("n"))

    def rows(df, flavour, frequency, number):
        return df.select(F.when(c == 0, "USA or Census Division").otherwise("State").alias("level"), F.lit(flavour).alias("hpi_flavor"),
                         F.lit(frequency).alias("frequency"), F.when(c == 0, "USA").otherwise(F.concat(F.lit("T"), c.cast("string"))).alias("place_id"),
                         F.concat(F.lit("State "), c.cast("string")).alias("place_name"), F.year("p").alias("yr"), number.alias("period"),
                         F.when(c % 2 == 0, F.col("n").cast("string")).otherwise("").alias("index_nsa"), F.col("n").cast("string").alias("index_sa"))
    out = (rows(month.where(c % 3 != 1), "purchase-only", "monthly", F.month("p"))
           .union(rows(quarter, "all-transactions", "quarterly", F.quarter("p")))
           .union(rows(quarter, "expanded-data", "quarterly", F.quarter("p"))))
    path = fresh_path(spark, "master-index")
    out.write.option("emptyValue", "").csv(path, header=True)
    return path


@query("src_fhfa", "SELECT place_id, area_level, flavour, frequency, period, index_value FROM master")
def src_fhfa(spark: SparkSession, sf: str) -> DataFrame:
    return indices.read_master_index(spark, master_file(spark, sf)).drop("place_name")


@query("agg_flavour", "SELECT * FROM master_best")
def agg_flavour(spark: SparkSession, sf: str) -> DataFrame:
    return indices.best_flavour(indices.read_master_index(spark, master_file(spark, sf))).drop("place_name", "frequency")


@query("link_region", """
SELECT 'FHFA-'||place_id AS area_code, area_level, CAST(year(period) AS INTEGER) AS year, arg_max(index_value,period) AS index_value,
  CASE WHEN area_level='state' AND CAST(substr(place_id,2) AS INTEGER)<20 THEN CAST(substr(place_id,2) AS BIGINT) END AS region_id
FROM master_best GROUP BY place_id, area_level, year(period)""")
def link_region(spark: SparkSession, sf: str) -> DataFrame:
    best = indices.best_flavour(indices.read_master_index(spark, master_file(spark, sf)))
    yearly = B.last_period_of_year(best, ["place_id", "area_level"], ["index_value"]).select(
        F.concat(F.lit("FHFA-"), "place_id").alias("area_code"), "area_level", "year", "index_value",
        F.lit("US").alias("country"), F.lit(None).cast("long").alias("region_id"))
    shapes = bridge.table(spark, sf, "nation").where("n_nationkey < 20").select(
        F.lit("US").alias("country"), F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("postal_code"),
        F.col("n_nationkey").cast("long").alias("region_id"))
    return B.link_regions_by_code(yearly, shapes).drop("country")


# --- boundary files ----------------------------------------------------------
def square(n: F.Column) -> F.Column:
    x, y = (n % 5).cast("double"), F.floor(n / 5).cast("double")
    return F.array(F.array(*[F.array(x + dx, y + dy) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]))


def boundary_file(spark: SparkSession, sf: str) -> str:
    n = F.col("n_nationkey")
    two = F.concat(F.char((n % 5 + 65).cast("int")), F.lit("Z"))
    props = F.struct(
        F.when(n % 4 == 0, "-99").otherwise(two).alias("ISO_A2_EH"), F.when(n == 8, "-9").otherwise(two).alias("ISO_A2"), two.alias("ADM0_ISO"),
        F.concat(two, F.lit("C")).alias("ISO_A3_EH"), F.concat(F.lit("Land "), (n % 5).cast("string")).alias("NAME_LONG"),
        two.alias("iso_a2"), F.when(n == 3, "-1").otherwise(F.concat(two, F.lit("-"), n.cast("string"))).alias("iso_3166_2"),
        F.when(n % 6 == 0, "-99").otherwise(F.concat(F.lit("T"), n.cast("string"))).alias("postal"),
        F.when(n == 4, "None").otherwise(F.col("n_name")).alias("name"), F.lit("Woe Name").alias("woe_name"), F.lit("Province").alias("type_en"),
        F.when(n != 7, F.lpad(n.cast("string"), 5, "0")).alias("CODE_LOCAL"), F.concat(F.lit("County of "), "n_name").alias("NAME"))
    single = F.to_json(F.struct(F.lit("Polygon").alias("type"), square(n).alias("coordinates")))
    double = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(square(n), square(n + 10)).alias("coordinates")))
    geometry = F.when(n % 2 == 0, single).otherwise(double)
    feature = F.concat(F.lit('{"properties":'), F.to_json(props), F.lit(',"geometry":'), geometry, F.lit("}"))
    doc = bridge.table(spark, sf, "nation").agg(F.concat(F.lit('{"features":['), F.concat_ws(",", F.collect_list(feature)), F.lit("]}")).alias("value"))
    return land(doc, "boundaries")


@query("src_geojson_country", """
SELECT chr(CAST(65+n_nationkey%5 AS INTEGER))||'Z' AS iso2, chr(CAST(65+n_nationkey%5 AS INTEGER))||'ZC' AS iso3, 'Land '||(n_nationkey%5) AS name,
  sum(CASE WHEN n_nationkey%2=0 THEN 1 ELSE 2 END)::BIGINT AS ring_count FROM nation GROUP BY 1,2,3""")
def src_geojson_country(spark: SparkSession, sf: str) -> DataFrame:
    return boundaries.read_countries(spark, boundary_file(spark, sf)).select("iso2", "iso3", "name", F.size("rings").cast("long").alias("ring_count"))


@query("src_geojson_region", """
SELECT chr(CAST(65+n_nationkey%5 AS INTEGER))||'Z' AS country, CASE WHEN n_nationkey<>3 THEN chr(CAST(65+n_nationkey%5 AS INTEGER))||'Z-'||n_nationkey END AS iso_3166_2,
  CASE WHEN n_nationkey%6<>0 THEN 'T'||n_nationkey END AS postal_code, CASE WHEN n_nationkey=4 THEN 'Woe Name' ELSE n_name END AS name, 'Province' AS region_type
FROM nation UNION ALL
SELECT 'US', 'US-'||lpad(CAST(n_nationkey AS VARCHAR),5,'0'), lpad(CAST(n_nationkey AS VARCHAR),5,'0'), 'County of '||n_name, 'County' FROM nation WHERE n_nationkey<>7""")
def src_geojson_region(spark: SparkSession, sf: str) -> DataFrame:
    path = boundary_file(spark, sf)
    return boundaries.read_regions(spark, path).drop("rings").unionByName(boundaries.read_us_counties(spark, path).drop("rings"))


@query("agg_shape_union", """
SELECT chr(CAST(65+n_nationkey%5 AS INTEGER))||'Z' AS iso2, sum(CASE WHEN n_nationkey%2=0 THEN 5 ELSE 10 END)::BIGINT AS points,
  sum(CASE WHEN n_nationkey%2=0 THEN 1.0 ELSE 2.0 END)::DOUBLE AS area FROM nation GROUP BY 1""")
def agg_shape_union(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.geo import ring_area2
    shapes = boundaries.read_countries(spark, boundary_file(spark, sf))
    rings = shapes.select("iso2", F.explode("rings").alias("ring"))
    return rings.groupBy("iso2").agg(F.sum(F.size("ring")).alias("points"), F.sum(F.abs(ring_area2(F.col("ring"))) / 2).alias("area"))


# --- derived quarterly index -------------------------------------------------
cte("ppsm_quarters", """
SELECT country, county, segment, CAST(date_trunc('quarter',transaction_date) AS DATE) AS period, count(*) AS sales_volume,
  quantile_cont(price_per_sqm,0.5) AS median_ppsm, quantile_cont(price,0.5) AS average_price
FROM seg_sales GROUP BY 1,2,3,4 HAVING count(*)>=30""")
cte("ppsm_index", """
SELECT *, median_ppsm*100.0/first_value(median_ppsm) OVER (PARTITION BY country,county,segment ORDER BY period) AS index_value FROM ppsm_quarters""")


@query("agg_ppsm_index", "SELECT country, county, segment, period, sales_volume, round(average_price,6) AS average_price, round(index_value,6) AS index_value FROM ppsm_index")
def agg_ppsm_index(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.quarterly_index(bridge.sales(spark, sf)).drop("median_ppsm"), 6)


@query("cross_months", """
SELECT country, county, segment, CAST(period + to_months(CAST(o AS INTEGER)) AS DATE) AS period, round(index_value,6) AS index_value
FROM ppsm_index, (SELECT unnest([0,1,2]) AS o)""")
def cross_months(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.quarters_to_months(B.quarterly_index(bridge.sales(spark, sf))).select("country", "county", "segment", "period", "index_value"), 6)


@query("win_base", "SELECT country, county, segment, period, round(first_value(median_ppsm) OVER (PARTITION BY country,county,segment ORDER BY period),6) AS base FROM ppsm_quarters")
def win_base(spark: SparkSession, sf: str) -> DataFrame:
    q = B.quarterly_index(bridge.sales(spark, sf))
    return rounded(q.select("country", "county", "segment", "period", (F.col("median_ppsm") * 100 / F.col("index_value")).alias("base")), 6)


@query("link_dept", """
SELECT district, 'IX-'||min(county) AS area_code FROM sales WHERE county IN (SELECT county FROM ppsm_index) GROUP BY 1""")
def link_dept(spark: SparkSession, sf: str) -> DataFrame:
    s = bridge.sales(spark, sf)
    return B.link_districts_to_county(s, B.quarterly_index(s))
