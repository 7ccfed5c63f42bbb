"""Queries on name links, index lookups and simple reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bridge
from ..functions.parse import month_no
from ..operators import area_stats as A
from ..operators import index_series as I
from ..operators import links as L
from .book import book, rounded
from .oracle import cte

QUERIES, ORACLE, query = book()

# --- names -------------------------------------------------------------------
cte("typed_names", """
SELECT p_partkey AS k, p_name AS published, CASE p_partkey%5 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name,' ','-') WHEN 2 THEN p_name||'s'
  WHEN 3 THEN left(p_name,7) ELSE p_name||', City Of' END AS typed FROM part""")
cte("area_names", "SELECT published AS area_name, 'A'||lpad(CAST(min(k) AS VARCHAR),6,'0') AS area_code FROM typed_names GROUP BY 1")
cte("district_names", "SELECT DISTINCT typed AS district FROM typed_names")
cte("successor_names", "SELECT typed AS district, min(published) AS successor FROM typed_names WHERE k%5=3 AND k%3=0 GROUP BY 1")


def key_sql(x: str) -> str:
    return f"lower(regexp_replace({x},'[^a-zA-Z0-9]','','g'))"


def grams_sql(x: str) -> str:
    return (f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}),'[^a-z0-9]+'), lambda w: w<>''), "
            "lambda w: list_transform(range(1,length(w)+2), lambda i: substr('  '||w||' ',i,3)))))")


cte("exact_links", f"""
SELECT district, min(area_code) AS area_code FROM district_names JOIN area_names ON {key_sql('district')}={key_sql('area_name')} GROUP BY 1""")
cte("manual_links", f"""
SELECT district, min(area_code) AS area_code FROM successor_names JOIN area_names ON {key_sql('successor')}={key_sql('area_name')} GROUP BY 1""")
cte("scored_names", f"""
SELECT district, area_code, len(list_intersect(dg,ag))/CAST(len(dg)+len(ag)-len(list_intersect(dg,ag)) AS DOUBLE) AS score
FROM (SELECT district, {grams_sql('district')} AS dg FROM district_names), (SELECT area_code, {grams_sql('area_name')} AS ag FROM area_names)""")
cte("fuzzy_links", """
SELECT district, area_code, score FROM scored_names WHERE score>=0.55
QUALIFY row_number() OVER (PARTITION BY district ORDER BY score DESC, area_code)=1""")
_NAMED = "JOIN area_names USING (area_code)"


def _names(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = bridge.names(spark, sf)
    areas = n.groupBy(F.col("published").alias("area_name")).agg(F.concat(F.lit("A"), F.lpad(F.min("k").cast("string"), 6, "0")).alias("area_code"))
    successors = n.where("k % 5 = 3 AND k % 3 = 0").groupBy(F.col("typed").alias("district")).agg(F.min("published").alias("successor"))
    return n.select(F.col("typed").alias("district")).distinct(), areas, successors


@query("link_exact", f"SELECT district, area_code, area_name, 'normalised' AS match_method, 1.0::DOUBLE AS match_score FROM exact_links {_NAMED}")
def link_exact(spark: SparkSession, sf: str) -> DataFrame:
    districts, areas, _ = _names(spark, sf)
    return L.link_exact(districts, areas)


@query("link_manual", f"SELECT district, area_code, area_name, 'manual' AS match_method, 1.0::DOUBLE AS match_score FROM manual_links {_NAMED}")
def link_manual(spark: SparkSession, sf: str) -> DataFrame:
    _, areas, successors = _names(spark, sf)
    return L.link_manual(successors, areas)


@query("link_fuzzy", f"""
SELECT district, area_code, area_name, match_method, round(match_score,6) AS match_score FROM (
  SELECT district, area_code, 'normalised' AS match_method, 1.0::DOUBLE AS match_score FROM exact_links
  UNION ALL SELECT district, area_code, 'manual', 1.0 FROM manual_links WHERE district NOT IN (SELECT district FROM exact_links)
  UNION ALL SELECT district, area_code, 'trigram', score FROM fuzzy_links WHERE district NOT IN (SELECT district FROM exact_links)
    AND district NOT IN (SELECT district FROM manual_links)) {_NAMED}""")
def link_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.link_districts(*_names(spark, sf)), 6)


# --- index series ------------------------------------------------------------
cte("idx_raw", """
SELECT country, area_code, area_level, segment, period, count(*) AS sales_volume, quantile_cont(price_per_sqm,0.5) AS median_ppsm,
  quantile_cont(price,0.5) AS average_price
FROM (SELECT country, 'IX-'||county AS area_code, 'local_authority' AS area_level, segment, CAST(date_trunc('month',transaction_date) AS DATE) AS period, price, price_per_sqm FROM seg_sales
  UNION ALL SELECT country, 'NAT-'||country, 'country', segment, CAST(date_trunc('month',transaction_date) AS DATE), price, price_per_sqm FROM seg_sales)
GROUP BY 1,2,3,4,5""")
cte("idx", """
SELECT *, median_ppsm*100.0/first_value(median_ppsm) OVER (PARTITION BY country,area_code,area_level,segment ORDER BY period) AS index_value,
  CAST(year(period)*12+month(period) AS INTEGER) AS m FROM idx_raw""")
cte("district_links", "SELECT country, district, 'IX-'||min(county) AS area_code FROM sales GROUP BY 1,2")
cte("usable_idx", "SELECT * FROM idx WHERE (area_code,segment) IN (SELECT (area_code,segment) FROM idx GROUP BY area_code,segment HAVING count(*)>=24)")
cte("idx_grid", """
SELECT area_code, area_level, segment, CAST(m+o AS INTEGER) AS month, m AS found_month, index_value AS value
FROM usable_idx, (SELECT unnest(range(-6,7)) AS o) QUALIFY row_number() OVER (PARTITION BY area_code,segment,m+o ORDER BY abs(o),m)=1""")
RESTATE = """
SELECT country, district, property_type, from_month, to_month, area_code, area_level, segment, from_value, to_value FROM (
  SELECT r.*, o.p, o.area_code, f.area_level, o.segment, f.value AS from_value, t.value AS to_value
  FROM restate_requests r JOIN (
    SELECT country, district, ty AS property_type, 0 AS p, area_code, ty AS segment FROM district_links, (SELECT DISTINCT property_type AS ty FROM homes WHERE property_type<>'other')
    UNION ALL SELECT country, district, ty, 1, area_code, 'all' FROM district_links, (SELECT DISTINCT property_type AS ty FROM homes)
    UNION ALL SELECT country, district, ty, 2, 'NAT-'||country, ty FROM district_links, (SELECT DISTINCT property_type AS ty FROM homes WHERE property_type<>'other')
    UNION ALL SELECT country, district, ty, 3, 'NAT-'||country, 'all' FROM district_links, (SELECT DISTINCT property_type AS ty FROM homes)
  ) o ON o.country=r.country AND o.district=r.district AND o.property_type=r.property_type
  JOIN idx_grid f ON f.area_code=o.area_code AND f.segment=o.segment AND f.month=r.from_month
  JOIN idx_grid t ON t.area_code=o.area_code AND t.segment=o.segment AND t.month=r.to_month WHERE f.value>0)
QUALIFY row_number() OVER (PARTITION BY country,district,property_type,from_month,to_month ORDER BY p)=1"""
AS_OF_MONTH = 2001 * 12 + 12


def market_indices(spark: SparkSession, sf: str) -> DataFrame:
    return I.monthly_index(bridge.sales(spark, sf))


def district_links(spark: SparkSession, sf: str) -> DataFrame:
    homes = bridge.dwellings(spark, sf)
    return homes.groupBy("country", "district").agg(F.concat(F.lit("IX-"), F.min("county")).alias("area_code"))


@query("asof_month", """
SELECT DISTINCT 'IX-'||s.county AS area_code, s.property_type AS segment, CAST(year(transaction_date)*12+month(transaction_date)+4 AS INTEGER) AS month,
  g.found_month, round(g.value,6) AS value
FROM sales s LEFT JOIN idx_grid g ON g.area_code='IX-'||s.county AND g.segment=s.property_type AND g.month=year(transaction_date)*12+month(transaction_date)+4""")
def asof_month(spark: SparkSession, sf: str) -> DataFrame:
    sales = bridge.sales(spark, sf)
    requests = sales.select(F.concat(F.lit("IX-"), "county").alias("area_code"), F.col("property_type").alias("segment"),
                            (month_no(F.col("transaction_date")) + 4).alias("month")).distinct()
    return rounded(I.asof_month(requests, I.usable_series(I.monthly_index(sales))), 6)


@query("index_restate", f"""
WITH restate_requests AS (SELECT DISTINCT country, district, property_type, CAST(year(transaction_date)*12+month(transaction_date) AS INTEGER) AS from_month,
  {AS_OF_MONTH} AS to_month FROM sales), restate AS ({RESTATE})
SELECT country, district, property_type, from_month, area_code, area_level, segment, round(to_value/from_value,6) AS ratio FROM restate""")
def index_restate(spark: SparkSession, sf: str) -> DataFrame:
    sales = bridge.sales(spark, sf)
    requests = sales.select("country", "district", "property_type", month_no(F.col("transaction_date")).alias("from_month"), F.lit(AS_OF_MONTH).alias("to_month"))
    out = I.restate_ratios(requests, I.monthly_index(sales), district_links(spark, sf))
    return rounded(out.select("country", "district", "property_type", "from_month", "area_code", "area_level", "segment", "ratio"), 6)


@query("market_stats", """SELECT area_code, segment, period, round(average_price,6) AS average_price, round(index_value,6) AS index_value, sales_volume
FROM idx WHERE area_code LIKE 'IX-%' AND period BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'""")
def market_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = market_indices(spark, sf).where(F.col("area_code").startswith("IX-") & F.col("period").between("1997-01-01", "1999-12-31"))
    return rounded(rows.select("area_code", "segment", "period", "average_price", "index_value", "sales_volume"), 6).orderBy("area_code", "period", "segment")


@query("agg_series", """
SELECT area_code, segment, count(*) AS points, min(period) AS first_period, max(period) AS last_period, round(arg_max(index_value,period),6) AS last_value
FROM idx GROUP BY 1,2 HAVING count(*)>=60""")
def agg_series(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered arrays per series; a series has at most one point per month, so arrays stay small."""
    arrays = market_indices(spark, sf).groupBy("area_code", "segment").agg(F.array_sort(F.collect_list(F.struct("period", "index_value"))).alias("s")).where(F.size("s") >= 60)
    return rounded(arrays.select("area_code", "segment", F.size("s").cast("long").alias("points"), F.col("s")[0]["period"].alias("first_period"),
                                 F.element_at("s", -1)["period"].alias("last_period"), F.element_at("s", -1)["index_value"].alias("last_value")), 6)


# --- area pieces -------------------------------------------------------------
cte("modal", """
SELECT country, area_level, area_code, district FROM (
  SELECT country, area_level, area_code, district, count(*) AS n FROM level_sales WHERE segment='all' AND area_level<>'country' GROUP BY 1,2,3,4)
QUALIFY row_number() OVER (PARTITION BY country,area_level,area_code ORDER BY n DESC, district)=1""")


@query("agg_modal_district", "SELECT m.*, l.area_code AS index_area_code FROM modal m JOIN district_links l USING (country, district)")
def agg_modal_district(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.with_levels(A.evidence(bridge.sales(spark, sf)), ["county", "district", "outcode", "sector"])
    links = district_links(spark, sf).withColumnRenamed("area_code", "index_area_code")
    return L.modal_district(A.with_own_district(rows)).join(links, ["country", "district"])


@query("agg_centroid", """SELECT country, area_level, area_code, year, centre_lat, centre_lon FROM area_stats WHERE segment='all'""")
def agg_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return A.agg_area_stats(bridge.sales(spark, sf)).where("segment = 'all'").select("country", "area_level", "area_code", "year", "centre_lat", "centre_lon")


@query("agg_extent", """
SELECT country, area_level, area_code, year, west, south, east, north FROM area_stats WHERE segment='all'""")
def agg_extent(spark: SparkSession, sf: str) -> DataFrame:
    return A.agg_area_stats(bridge.sales(spark, sf)).where("segment = 'all'").select("country", "area_level", "area_code", "year", "west", "south", "east", "north")


@query("evidence_pred", "SELECT sale_key, property_id, price FROM evid")
def evidence_pred(spark: SparkSession, sf: str) -> DataFrame:
    return A.evidence(bridge.sales(spark, sf)).select("sale_key", "property_id", "price")


@query("price_per_sqm", "SELECT sale_key, round(price/sale_area,8) AS price_per_sqm FROM sales")
def price_per_sqm(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bridge.sales(spark, sf).select("sale_key", A.price_per_sqm(F.col("price"), F.col("sale_area")).alias("price_per_sqm")), 8)


@query("cross_segment", "SELECT segment, year, count(*) AS sales, count(DISTINCT property_id) AS dwellings FROM seg_sales GROUP BY 1,2")
def cross_segment(spark: SparkSession, sf: str) -> DataFrame:
    return A.with_segments(A.evidence(bridge.sales(spark, sf))).groupBy("segment", "year").agg(
        F.count(F.lit(1)).alias("sales"), F.countDistinct("property_id").alias("dwellings"))


@query("agg_sale_counts", "SELECT property_id, count(*) AS sale_count, max(transaction_date) AS last_sold FROM sales GROUP BY 1")
def agg_sale_counts(spark: SparkSession, sf: str) -> DataFrame:
    return bridge.sales(spark, sf).groupBy("property_id").agg(F.count(F.lit(1)).alias("sale_count"), F.max("transaction_date").alias("last_sold"))


@query("semi_exists", "SELECT property_id, property_type, country FROM homes WHERE property_id IN (SELECT property_id FROM evid)")
def semi_exists(spark: SparkSession, sf: str) -> DataFrame:
    sold = A.evidence(bridge.sales(spark, sf)).select("property_id")
    return bridge.dwellings(spark, sf).join(sold, "property_id", "left_semi").select("property_id", "property_type", "country")


@query("agg_measure", """SELECT country, min(transaction_date) AS first_txn, max(transaction_date) AS last_txn, count(*) AS txn_count,
  count_if(sale_area>25)::BIGINT AS with_area FROM sales GROUP BY 1""")
def agg_measure(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.coverage import measure
    return measure(bridge.sales(spark, sf).withColumn("floor_area", F.when(F.col("sale_area") > 25, F.col("sale_area"))))


@query("agg_outcode", """
SELECT outcode, CAST(sum(CAST(lat AS DECIMAL(18,7))) AS DOUBLE)/count(*) AS centre_lat, CAST(sum(CAST(lon AS DECIMAL(18,7))) AS DOUBLE)/count(*) AS centre_lon,
  CASE WHEN min(lon)<max(lon) AND min(lat)<max(lat) THEN min(lon) END AS west, CASE WHEN min(lon)<max(lon) AND min(lat)<max(lat) THEN min(lat) END AS south,
  CASE WHEN min(lon)<max(lon) AND min(lat)<max(lat) THEN max(lon) END AS east, CASE WHEN min(lon)<max(lon) AND min(lat)<max(lat) THEN max(lat) END AS north,
  count(*) AS postcodes, min(uk_country) AS uk_country FROM gazetteer WHERE status='live' GROUP BY 1""")
def agg_outcode(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.lookup import outcodes
    from .q_register import gazetteer
    return outcodes(gazetteer(spark, sf))
