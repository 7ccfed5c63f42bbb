"""Queries on coverage, location answers and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bridge
from .. import constants as K
from ..operators import area_stats as A
from ..operators import coverage as C
from ..operators import places as P
from ..operators import quality as Q
from ..session import cut_lineage
from ..sources import registers
from .book import book, rounded
from .oracle import cte
from .q_forecast import _GRADE, market
from .q_links import district_links, market_indices
from .q_map import pip_ctes
from .q_valuation import TODAY

QUERIES, ORACLE, query = book()
_YEAR = TODAY.year

# one country has its sales withheld, another has only an index
cte("held_sales", "SELECT * FROM sales WHERE country NOT IN ('AFRICA','ASIA')")
cte("held_index", "SELECT * FROM idx WHERE country NOT IN ('AMERICA')")
cte("held_stats", "SELECT * FROM area_stats WHERE country NOT IN ('ASIA','EUROPE')")


def held(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sales = bridge.sales(spark, sf)
    return (sales.where(~F.col("country").isin("AFRICA", "ASIA")), market_indices(spark, sf).where("country <> 'AMERICA'"),
            A.agg_area_stats(sales).where(~F.col("country").isin("ASIA", "EUROPE")))


@query("cov_register", """
SELECT c.country, c.region_code, c.transaction_level AND coalesce(m.n,0)>0 AS transaction_level, c.market_index AND coalesce(i.n,0)>0 AS market_index, c.forecast_supported AND coalesce(i.n,0)>0 AS forecast_supported,
  c.characteristics AND coalesce(m.a,0)>0 AS characteristics, CASE WHEN c.max_precision<>'NONE' THEN m.f END AS historical_from, CASE WHEN c.max_precision<>'NONE' THEN m.l END AS historical_to
FROM coverage c LEFT JOIN (SELECT country, count(*) AS n, count(floor_area) AS a, min(transaction_date) AS f, max(transaction_date) AS l FROM held_sales GROUP BY 1) m ON m.country=c.country
LEFT JOIN (SELECT country, count(*) AS n FROM held_index GROUP BY 1) i ON i.country=c.country""")
def cov_register(spark: SparkSession, sf: str) -> DataFrame:
    sales, idx, _ = held(spark, sf)
    index_rows = idx.groupBy("country").agg(F.count(F.lit(1)).alias("index_rows"))
    return C.register(bridge.coverage(spark, sf), C.measure(sales), index_rows).select(
        "country", "region_code", "transaction_level", "market_index", "forecast_supported", "characteristics", "historical_from", "historical_to")


_EVID = """SELECT country, bool_or(median_price IS NOT NULL) AS has_price, max(area_level) AS price_level, count(DISTINCT area_code) AS price_areas, min(year) AS price_from, max(year) AS price_to, sum(transaction_count)::BIGINT AS sale_count FROM held_stats GROUP BY 1"""


def labelled(stats: DataFrame) -> DataFrame:
    return stats.withColumns({"source_key": F.lit("register"), "price_statistic": F.lit("MEDIAN"), "basis": F.lit("TRANSACTIONS")})


@query("agg_area_evidence", _EVID)
def agg_area_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return C.area_evidence(labelled(held(spark, sf)[2])).select("country", "has_price", "price_level", "price_areas", "price_from", "price_to", "sale_count")


@query("anti_txn_country", "SELECT DISTINCT country FROM held_index WHERE country NOT IN (SELECT country FROM held_sales)")
def anti_txn_country(spark: SparkSession, sf: str) -> DataFrame:
    sales, idx, _ = held(spark, sf)
    return C.without_sales(idx.select("country").distinct(), sales)


@query("cov_stats_only", f"""
WITH ev AS ({_EVID}), cand AS (SELECT country FROM ev WHERE has_price UNION SELECT country FROM held_index), ix AS (SELECT country, min(period) AS f, max(period) AS l, count(DISTINCT area_code) AS n, max(area_level) AS lv FROM held_index GROUP BY 1)
SELECT k.country, CASE WHEN has_price THEN 'CITY_REGIONAL' ELSE 'NONE' END AS max_precision, CASE WHEN has_price THEN 'REGION' END AS coordinate_precision,
  CASE WHEN has_price THEN make_date(CAST(price_from AS INTEGER),1,1) ELSE f END AS historical_from, CASE WHEN has_price THEN make_date(CAST(price_to AS INTEGER),12,31) ELSE l END AS historical_to,
  CASE WHEN has_price THEN 'Median prices for '||price_areas||' '||price_level||'-level areas, from registered sales ('||format('{{:,}}',sale_count)||' sales)'
    ELSE 'Only an index exists, at '||CASE WHEN ix.n=1 THEN 'national level only' ELSE ix.n||' '||lv||'-level areas' END||'; it gives no price.' END AS notes
FROM cand k LEFT JOIN ev USING (country) LEFT JOIN ix USING (country) WHERE k.country NOT IN (SELECT country FROM held_sales)""")
def cov_stats_only(spark: SparkSession, sf: str) -> DataFrame:
    sales, idx, stats = held(spark, sf)
    return C.statistics_only(labelled(cut_lineage(stats)), cut_lineage(idx), sales).select(
        "country", "max_precision", "coordinate_precision", "historical_from", "historical_to", "notes")


_PURGED = """SELECT country, region_code, max_precision FROM coverage c WHERE max_precision='NONE' OR country IN (SELECT country FROM held_sales WHERE country<>'EUROPE')
  OR country IN (SELECT country FROM held_stats WHERE country<>'AFRICA')"""


def _purged(spark, sf):
    sales, idx, stats = held(spark, sf)
    return C.drop_unbacked(bridge.coverage(spark, sf), sales.where("country <> 'EUROPE'"), idx.where("1 = 0"), cut_lineage(stats).where("country <> 'AFRICA'"))


@query("cov_purge", _PURGED)
def cov_purge(spark: SparkSession, sf: str) -> DataFrame:
    return _purged(spark, sf).select("country", "region_code", "max_precision")


@query("anti_unbacked", f"SELECT country, region_code FROM coverage EXCEPT SELECT country, region_code FROM ({_PURGED})")
def anti_unbacked(spark: SparkSession, sf: str) -> DataFrame:
    """The claims that the purge removes."""
    kept = _purged(spark, sf).select("country", "region_code")
    return bridge.coverage(spark, sf).select("country", "region_code").exceptAll(kept)


@query("usable_pred", "SELECT country, region_code, max_precision<>'NONE' AS usable, transaction_level AND max_precision IN ('EXACT_TRANSACTION','PROPERTY_ESTIMATE') AS dwelling_level FROM coverage")
def usable_pred(spark: SparkSession, sf: str) -> DataFrame:
    return bridge.coverage(spark, sf).select("country", "region_code", C.usable().alias("usable"), C.dwelling_level().alias("dwelling_level"))


@query("dwelling_pred", "SELECT country, region_code FROM coverage WHERE transaction_level AND max_precision IN ('EXACT_TRANSACTION','PROPERTY_ESTIMATE')")
def dwelling_pred(spark: SparkSession, sf: str) -> DataFrame:
    return bridge.coverage(spark, sf).where(C.dwelling_level()).select("country", "region_code")


@query("cov_index", "SELECT country, region_code, CASE WHEN max_precision<>'NONE' THEN 'supported' ELSE 'known absence' END AS listing FROM coverage")
def cov_index(spark: SparkSession, sf: str) -> DataFrame:
    return bridge.coverage(spark, sf).select("country", "region_code", F.when(C.usable(), "supported").otherwise("known absence").alias("listing"))


cte("nations", "SELECT n_name AS region_code, r_name AS country FROM nation JOIN region ON n_regionkey=r_regionkey")
_LOOK = """SELECT n.country, n.region_code, coalesce(r.max_precision,c.max_precision) AS max_precision, CASE WHEN r.country IS NOT NULL THEN r.notes ELSE c.notes END AS notes, r.country IS NOT NULL AS entry_is_region
FROM nations n LEFT JOIN coverage r ON r.country=n.country AND r.region_code=n.region_code LEFT JOIN coverage c ON c.country=n.country AND c.region_code IS NULL"""


def nations(spark: SparkSession, sf: str) -> DataFrame:
    n, r = bridge.table(spark, sf, "nation"), bridge.table(spark, sf, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("region_code"), F.col("r_name").alias("country"))


@query("coverage_lookup", _LOOK)
def coverage_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return C.lookup(nations(spark, sf), bridge.coverage(spark, sf)).select("country", "region_code", "max_precision", "notes", "entry_is_region")


_BOUNDS = """SELECT country, CAST(min(lo) AS INTEGER) AS min_year, CAST(max(hi) AS INTEGER) AS max_year FROM (SELECT country, min(year) AS lo, max(year) AS hi FROM held_sales GROUP BY 1
  UNION ALL SELECT country, NULL, max(year(period)) FROM held_index GROUP BY 1 UNION ALL SELECT country, min(year), max(year) FROM held_stats GROUP BY 1) GROUP BY 1"""


@query("agg_bounds", _BOUNDS)
def agg_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return C.year_bounds(*held(spark, sf))


@query("cov_describe", f"""
WITH look AS ({_LOOK}), b AS ({_BOUNDS}) SELECT l.country, l.region_code, CASE WHEN ok THEN 'OK' ELSE 'UNSUPPORTED_LOCATION' END AS status,
  CASE WHEN NOT ok THEN coalesce(notes,'{K.NO_DATA_TEXT}') END AS message, CASE WHEN ok THEN coalesce(min_year,{_YEAR}) END AS min_year,
  CASE WHEN ok THEN least(coalesce(max_year,{_YEAR}),{_YEAR}) END AS max_data_year, CASE WHEN ok THEN least(coalesce(max_year,{_YEAR}),{_YEAR})+10 END AS max_forecast_year
FROM (SELECT *, max_precision<>'NONE' AS ok FROM look) l LEFT JOIN b USING (country)""")
def cov_describe(spark: SparkSession, sf: str) -> DataFrame:
    return C.describe(nations(spark, sf), bridge.coverage(spark, sf), C.year_bounds(*held(spark, sf)), _YEAR, 10)


_PTS = pip_ctes("SELECT * FROM cpoints")


@query("cov_annotate", f"""WITH {_PTS} SELECT p.point_id, j.country, j.region_code, coalesce(coalesce(r.max_precision,c.max_precision)<>'NONE',false) AS covered,
  CASE WHEN NOT coalesce(coalesce(r.max_precision,c.max_precision)<>'NONE',false) THEN coalesce(CASE WHEN r.country IS NOT NULL THEN r.notes ELSE c.notes END,'{K.NO_DATA_TEXT}') END AS note
FROM pt p LEFT JOIN pfull j USING (point_id) LEFT JOIN coverage r ON r.country=j.country AND r.region_code=j.region_code LEFT JOIN coverage c ON c.country=j.country AND c.region_code IS NULL""")
def cov_annotate(spark: SparkSession, sf: str) -> DataFrame:
    points = bridge.points(spark, sf)
    at = P.jurisdiction(points, bridge.country_shapes(spark, sf), bridge.region_shapes(spark, sf))
    rows = C.lookup(points.select("point_id").join(at, "point_id", "left"), bridge.coverage(spark, sf))
    return rows.select("point_id", "country", "region_code", C.usable().alias("covered"), F.when(~C.usable(), F.coalesce("notes", F.lit(K.NO_DATA_TEXT))).alias("note"))


_HOLD = "hold AS (SELECT p.point_id, j.country, arg_min(struct_pack(l:=area_level,c:=area_code),(list_position(['sector','outcode','district','county','country'],area_level),-year,area_code)) AS a FROM pt p JOIN pfull j USING (point_id) JOIN area_stats s ON s.country=j.country AND p.lon BETWEEN west AND east AND p.lat BETWEEN south AND north GROUP BY 1,2)"


def located(spark: SparkSession, sf: str) -> DataFrame:
    points = bridge.points(spark, sf)
    return points.join(P.jurisdiction(points, bridge.country_shapes(spark, sf)), "point_id")


def stored_stats(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(A.agg_area_stats(bridge.sales(spark, sf)))


@query("area_contains", f"WITH {_PTS}, {_HOLD} SELECT point_id, country, a.l AS area_level, a.c AS area_code FROM hold")
def area_contains(spark: SparkSession, sf: str) -> DataFrame:
    return P.area_contains(located(spark, sf), stored_stats(spark, sf))


_DIST = "dist AS (SELECT p.point_id, j.country, arg_min(area_code,(-year,area_code)) AS district FROM pt p JOIN pfull j USING (point_id) JOIN area_stats s ON s.country=j.country AND area_level='district' AND p.lon BETWEEN west AND east AND p.lat BETWEEN south AND north GROUP BY 1,2)"


def point_districts(spark: SparkSession, sf: str) -> DataFrame:
    found = P.area_contains(located(spark, sf), stored_stats(spark, sf).where("area_level = 'district'"))
    return found.select("point_id", "country", F.col("area_code").alias("district"))


@query("loc_history", f"WITH {_PTS}, {_DIST} SELECT d.point_id, l.area_code, i.period, round(i.index_value,6) AS index_value, i.sales_volume FROM dist d JOIN district_links l USING (country, district) JOIN idx i ON i.area_code=l.area_code AND i.segment='all' AND i.period>=DATE '2000-01-01'")
def loc_history(spark: SparkSession, sf: str) -> DataFrame:
    series = market_indices(spark, sf).where("segment = 'all' AND period >= DATE '2000-01-01'").select("area_code", "period", "index_value", "sales_volume")
    rows = point_districts(spark, sf).join(district_links(spark, sf), ["country", "district"]).join(series, "area_code")
    return rounded(rows.select("point_id", "area_code", "period", "index_value", "sales_volume"), 6)


@query("loc_forecast", f"""WITH {_PTS}, {_DIST} SELECT d.point_id, m.year, m.property_type, m.area_code, round((m.ratio-1)*100,6) AS movement_pct, {_GRADE} AS confidence
FROM dist d JOIN markets m USING (country, district) WHERE m.year=2003""")
def loc_forecast(spark: SparkSession, sf: str) -> DataFrame:
    rows = point_districts(spark, sf).join(market(spark, sf).where("year = 2003"), ["country", "district"])
    return rounded(rows.select("point_id", "year", "property_type", "area_code", ((F.col("ratio") - 1) * 100).alias("movement_pct"), F.col("forecast_confidence").alias("confidence")), 6)


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """Registered sources; one of the cited ones lacks a licence."""
    r = bridge.table(spark, sf, "region")
    return r.where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "register").otherwise("index").alias("source_key"),
                                             F.when(F.col("r_regionkey") == 0, "open").alias("licence"), F.concat(F.lit("Source "), "r_name").alias("attribution"))


@query("source_join", "SELECT r_name AS country, (SELECT string_agg('Source '||r_name,'; ' ORDER BY r_name) FROM region WHERE r_regionkey<2) AS attributions FROM region")
def source_join(spark: SparkSession, sf: str) -> DataFrame:
    return Q.attributions(bridge.coverage(spark, sf), sources(spark, sf))


@query("priced_only", "SELECT country, area_level, area_code, segment, year FROM area_stats WHERE area_level<>'sector'")
def priced_only(spark: SparkSession, sf: str) -> DataFrame:
    stats = A.agg_area_stats(bridge.sales(spark, sf))
    index_only = F.col("area_level") == "sector"
    rows = stats.withColumn("median_price", F.when(~index_only, F.col("median_price")))
    return A.priced_only(rows).select(*A.AREA_KEYS)


# --- data quality ------------------------------------------------------------
@query("dq_unique", """SELECT 'sale' AS rule, source_record_id AS key, count(*) AS copies FROM sales GROUP BY 2 HAVING count(*)>1
UNION ALL SELECT 'dwelling', 'GB/'||property_key, count(*) FROM clean GROUP BY 2 HAVING count(*)>1""")
def dq_unique(spark: SparkSession, sf: str) -> DataFrame:
    """Both unique keys, over rows as they are before merging: the record of a sale, and the country and key of a dwelling."""
    sale = Q.dq_unique(bridge.sales(spark, sf), ["source_record_id"]).select(F.lit("sale").alias("rule"), F.col("source_record_id").alias("key"), "copies")
    homes = registers.register_sales(bridge.register_rows(spark, sf)).withColumn("country", F.lit("GB"))
    home = Q.dq_unique(homes, ["country", "property_key"]).select(F.lit("dwelling").alias("rule"), F.concat_ws("/", "country", "property_key").alias("key"), "copies")
    return sale.unionByName(home)


@query("dq_price", "SELECT 'price and currency present' AS rule, count(*) AS checked, count_if(sale_area=13)::BIGINT AS broken FROM sales")
def dq_price(spark: SparkSession, sf: str) -> DataFrame:
    rows = bridge.sales(spark, sf).withColumn("currency", F.when(F.col("sale_area") != 13, "GBP"))
    return Q.dq_price(rows)


@query("dq_precision", "SELECT 'precision stated and honest' AS rule, count(*) AS checked, count_if(property_id%11=0)::BIGINT AS broken FROM sales")
def dq_precision(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("property_id") % 11
    return Q.dq_precision(bridge.sales(spark, sf).withColumn("precision", F.when(k == 0, F.when(F.col("sale_area") > 25, "PARCEL")).otherwise("POSTCODE")))


@query("dq_min_sample", "SELECT area_level, count(*) AS checked, 0::BIGINT AS broken, min(transaction_count) AS smallest FROM area_stats GROUP BY 1")
def dq_min_sample(spark: SparkSession, sf: str) -> DataFrame:
    return Q.dq_min_sample(A.agg_area_stats(bridge.sales(spark, sf)))


@query("dq_evidence_only", "SELECT 'count backed by evidence' AS rule, count(*) AS checked, 0::BIGINT AS broken FROM area_stats")
def dq_evidence_only(spark: SparkSession, sf: str) -> DataFrame:
    sales = bridge.sales(spark, sf)
    return Q.dq_evidence_only(A.agg_area_stats(sales), sales)


@query("dq_has_figure", "SELECT 'figure present and labelled' AS rule, count(*) AS checked, count_if(area_level='outcode')::BIGINT AS broken FROM area_stats")
def dq_has_figure(spark: SparkSession, sf: str) -> DataFrame:
    stats = labelled(A.agg_area_stats(bridge.sales(spark, sf))).withColumn("index_value", F.lit(None).cast("double"))
    return Q.dq_has_figure(stats.withColumn("median_price", F.when(F.col("area_level") != "outcode", F.col("median_price"))))


@query("dq_null_count", "SELECT 'undisclosed sample is null' AS rule, count(*) AS checked, count_if(area_level='county')::BIGINT AS broken FROM area_stats")
def dq_null_count(spark: SparkSession, sf: str) -> DataFrame:
    stats = A.agg_area_stats(bridge.sales(spark, sf))
    return Q.dq_null_count(stats.withColumn("transaction_count", F.when(F.col("area_level") == "county", 0).when(F.col("area_level") != "country", F.col("transaction_count"))))


@query("dq_coverage_backed", """SELECT 'claims have rows' AS rule, count(*) AS checked, count_if((country NOT IN (SELECT country FROM held_sales) AND country NOT IN (SELECT country FROM held_stats))
  OR (transaction_level AND country NOT IN (SELECT country FROM held_sales)) OR (market_index AND country NOT IN (SELECT country FROM held_index)))::BIGINT AS broken FROM coverage WHERE max_precision<>'NONE'""")
def dq_coverage_backed(spark: SparkSession, sf: str) -> DataFrame:
    sales, idx, stats = held(spark, sf)
    return Q.dq_coverage_backed(bridge.coverage(spark, sf), sales, idx, stats)


@query("dq_source_known", "SELECT 'index' AS source_key FROM region WHERE r_regionkey=1")
def dq_source_known(spark: SparkSession, sf: str) -> DataFrame:
    return Q.dq_source_known(bridge.coverage(spark, sf), sources(spark, sf))
