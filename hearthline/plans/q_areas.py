"""Queries on area statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import bridge
from ..operators import area_stats as A
from .book import book, rounded
from .oracle import cte

QUERIES, ORACLE, query = book()

cte("seg_sales", """
SELECT e.*, seg.segment FROM evid e, LATERAL (SELECT unnest(['all', e.property_type]) AS segment) seg""")
cte("level_sales", """
SELECT country, 'country' AS area_level, country AS area_code, segment, year, price, price_per_sqm, lat, lon, district FROM seg_sales
UNION ALL SELECT country, 'county', county, segment, year, price, price_per_sqm, lat, lon, district FROM seg_sales
UNION ALL SELECT country, 'district', district, segment, year, price, price_per_sqm, lat, lon, district FROM seg_sales
UNION ALL SELECT country, 'outcode', outcode, segment, year, price, price_per_sqm, lat, lon, district FROM seg_sales
UNION ALL SELECT country, 'sector', sector, segment, year, price, price_per_sqm, lat, lon, district FROM seg_sales""")
cte("area_stats", """
SELECT country, area_level, area_code, segment, year, count(*) AS transaction_count,
  CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE)/count(*) AS mean_price, quantile_cont(price,0.25) AS p25_price, quantile_cont(price,0.5) AS median_price,
  quantile_cont(price,0.75) AS p75_price, quantile_cont(price_per_sqm,0.5) AS median_price_per_sqm,
  CAST(sum(CAST(lat AS DECIMAL(18,7))) AS DOUBLE)/count(*) AS centre_lat, CAST(sum(CAST(lon AS DECIMAL(18,7))) AS DOUBLE)/count(*) AS centre_lon,
  CASE WHEN min(lon)<max(lon) AND min(lat)<max(lat) THEN min(lon) END AS west,
  CASE WHEN min(lon)<max(lon) AND min(lat)<max(lat) THEN min(lat) END AS south,
  CASE WHEN min(lon)<max(lon) AND min(lat)<max(lat) THEN max(lon) END AS east,
  CASE WHEN min(lon)<max(lon) AND min(lat)<max(lat) THEN max(lat) END AS north
FROM level_sales GROUP BY ALL
HAVING count(*) >= CASE area_level WHEN 'country' THEN 50 WHEN 'county' THEN 25 WHEN 'district' THEN 15
  WHEN 'outcode' THEN 8 ELSE 5 END""")


@query("agg_area_stats", """
SELECT country, area_level, area_code, segment, year, transaction_count, mean_price,
  round(p25_price,8) AS p25_price, round(median_price,8) AS median_price, round(p75_price,8) AS p75_price,
  round(median_price_per_sqm,8) AS median_price_per_sqm FROM area_stats""")
def agg_area_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.agg_area_stats(bridge.sales(spark, sf)).drop(
        "centre_lat", "centre_lon", "west", "south", "east", "north"), 8, ["mean_price"])


@query("join_prev_year", """
SELECT a.country, a.area_level, a.area_code, a.segment, a.year, a.transaction_count,
  round(a.median_price,8) AS median_price, round(p.median_price,8) AS previous,
  round((a.median_price/p.median_price-1)*100,8) AS growth_1y_pct
FROM area_stats a LEFT JOIN area_stats p ON p.country=a.country AND p.area_level=a.area_level
  AND p.area_code=a.area_code AND p.segment=a.segment AND p.year=a.year-1""")
def join_prev_year(spark: SparkSession, sf: str) -> DataFrame:
    stats = A.agg_area_stats(bridge.sales(spark, sf))
    return rounded(A.with_growth(stats).select(
        *A.AREA_KEYS, "transaction_count", "median_price", "previous", "growth_1y_pct"), 8)
