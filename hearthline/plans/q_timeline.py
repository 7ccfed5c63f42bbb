"""Queries on dwelling timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bridge
from ..operators import timeline as TL
from ..policies import GB_POLICY
from ..session import cut_lineage
from .book import book
from .q_forecast import _GRADE, SHORT, _sigma
from .q_links import district_links
from .q_valuation import TODAY, T, avm_ctes, backcast_ctes, current_values, evidence, stored_indices, targets_sql

QUERIES, ORACLE, query = book()
FIRST, LAST = 1999, 2003


def timeline_ctes(wanted: str) -> str:
    """`figures`: one row per wanted (property_id, year), by the same order of preference."""
    days = f"""SELECT h.*, d.day FROM homes h JOIN (SELECT property_id, least(make_date(CAST(year AS INTEGER),12,31),{T}) AS day FROM open_years WHERE year<={TODAY.year}
    UNION SELECT property_id, {T} FROM open_years) d USING (property_id)"""
    asked = f"SELECT property_id, as_of FROM est WHERE NOT ok AND year(as_of)<{TODAY.year} AND as_of<{T}"
    return f"""wanted AS ({wanted}),
sold AS (SELECT w.property_id, w.year, arg_max(s.price,(s.transaction_date,s.price,s.sale_key)) AS value FROM wanted w JOIN sales s ON s.property_id=w.property_id AND s.year=w.year GROUP BY 1,2),
open_years AS (SELECT * FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM sold s WHERE s.property_id=w.property_id AND s.year=w.year)),
{avm_ctes(targets_sql('day', f'({days})'))},
{backcast_ctes(asked)},
past AS (SELECT o.property_id, o.year, e.ok AS direct, e.estimated_price AS a, e.low_estimate AS b, e.high_estimate AS c, e.confidence AS d,
    x.status AS bs, x.estimated_price AS ba, x.low_estimate AS bb, x.high_estimate AS bcc, x.confidence AS bd
  FROM open_years o JOIN est e ON e.property_id=o.property_id AND e.as_of=least(make_date(CAST(o.year AS INTEGER),12,31),{T})
  LEFT JOIN bc x ON x.property_id=o.property_id AND x.as_of=e.as_of WHERE o.year<={TODAY.year}),
figures AS (SELECT property_id, year, 'TRANSACTION' AS price_type, value, NULL::DOUBLE AS lower_bound, NULL::DOUBLE AS upper_bound, 'HIGH' AS confidence, 'OK' AS status FROM sold
  UNION ALL SELECT property_id, year, CASE WHEN direct OR bs='OK' THEN CASE WHEN year>={TODAY.year} THEN 'CURRENT_ESTIMATE' ELSE 'HISTORICAL_ESTIMATE' END END,
    CASE WHEN direct THEN a WHEN bs='OK' THEN ba END, CASE WHEN direct THEN b WHEN bs='OK' THEN bb END, CASE WHEN direct THEN c WHEN bs='OK' THEN bcc END,
    CASE WHEN direct THEN d WHEN bs='OK' THEN bd END, CASE WHEN direct OR bs='OK' THEN 'OK' ELSE 'INSUFFICIENT_EVIDENCE' END FROM past
  UNION ALL SELECT o.property_id, o.year, CASE WHEN m.ratio IS NOT NULL AND n.property_id IS NOT NULL THEN 'FORECAST' END, round_even(n.estimated_price*m.ratio,0), round_even(n.low_estimate*m.ratio_low,0),
    round_even(n.high_estimate*m.ratio_high,0), CASE WHEN n.property_id IS NOT NULL THEN {_GRADE} END,
    CASE WHEN n.property_id IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN m.ratio IS NULL THEN 'OUT_OF_RANGE' ELSE 'OK' END
  FROM open_years o LEFT JOIN bc_now n ON n.property_id=o.property_id
  LEFT JOIN markets m ON m.country=n.country AND m.district=n.district AND m.property_type=n.property_type AND m.year=o.year WHERE o.year>{TODAY.year})"""


_ALL = f"SELECT property_id, CAST(y AS INTEGER) AS year FROM homes, (SELECT unnest(range({FIRST},{LAST + 1})) AS y)"
_COLS = "property_id, year, price_type, value, lower_bound, upper_bound, confidence, status"


def figures(spark: SparkSession, sf: str, wanted: DataFrame, indices: DataFrame | None = None, current: DataFrame | None = None) -> DataFrame:
    indices = stored_indices(spark, sf) if indices is None else indices
    return TL.val_price_year(wanted, bridge.dwellings(spark, sf), bridge.sales(spark, sf), evidence(spark, sf), indices, district_links(spark, sf),
                             GB_POLICY, SHORT, _sigma(indices), TODAY, current)


@query("val_price_year", f"WITH {timeline_ctes(_ALL)} SELECT {_COLS} FROM figures")
def val_price_year(spark: SparkSession, sf: str) -> DataFrame:
    return figures(spark, sf, TL.wanted_years(bridge.dwellings(spark, sf), FIRST, LAST))


@query("val_history", f"""WITH {timeline_ctes(_ALL)} SELECT property_id, count(*) AS points, min(year) AS first_year, max(year) AS last_year,
  string_agg(year||':'||price_type,',' ORDER BY year) AS series FROM figures WHERE status='OK' GROUP BY 1""")
def val_history(spark: SparkSession, sf: str) -> DataFrame:
    rows = figures(spark, sf, TL.wanted_years(bridge.dwellings(spark, sf), FIRST, LAST)).where("status = 'OK'")
    # at most 40 years per dwelling
    return rows.groupBy("property_id").agg(
        F.count(F.lit(1)).alias("points"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("year", "price_type"))), lambda p: F.concat_ws(":", p["year"], p["price_type"])), ",").alias("series"))


_2003 = "SELECT property_id, CAST(2003 AS INTEGER) AS year FROM homes"
_2000 = "SELECT property_id, CAST(2000 AS INTEGER) AS year FROM homes"


@query("fc_property", f"WITH {timeline_ctes(_2003)} SELECT {_COLS} FROM figures WHERE price_type='FORECAST'")
def fc_property(spark: SparkSession, sf: str) -> DataFrame:
    wanted = bridge.dwellings(spark, sf).select("property_id", F.lit(2003).alias("year"))
    return figures(spark, sf, wanted).where("price_type = 'FORECAST'")


@query("val_detail", f"""WITH {timeline_ctes(_2003)},
detail AS (SELECT property_id, count(*) AS sale_count, max(transaction_date) AS last_sold, arg_max(price,(transaction_date,price,sale_key)) AS last_price FROM sales GROUP BY 1)
SELECT h.property_id, h.property_type, h.country, d.sale_count, d.last_sold, d.last_price, f.price_type, f.value, f.lower_bound, f.upper_bound, f.confidence, f.status,
  e.estimated_price AS current_estimate, e.confidence AS current_confidence
FROM homes h LEFT JOIN detail d USING (property_id) LEFT JOIN figures f USING (property_id) LEFT JOIN est e ON e.property_id=h.property_id AND e.as_of={T}""")
def val_detail(spark: SparkSession, sf: str) -> DataFrame:
    homes, indices = bridge.dwellings(spark, sf), stored_indices(spark, sf)
    current = cut_lineage(current_values(spark, sf, indices))
    chosen = cut_lineage(figures(spark, sf, homes.select("property_id", F.lit(2003).alias("year")), indices, current))
    return TL.val_detail(homes, bridge.sales(spark, sf), chosen, current)


@query("val_detail_sales", """SELECT property_id, CAST(row_number() OVER w AS INTEGER) AS place, transaction_date, price, market_value_basis, sale_key,
  round(CASE WHEN lead(price) OVER w>0 THEN (price/lead(price) OVER w-1)*100 END,6) AS change_pct FROM sales WINDOW w AS (PARTITION BY property_id ORDER BY transaction_date DESC, price DESC, sale_key)""")
def val_detail_sales(spark: SparkSession, sf: str) -> DataFrame:
    """The sale list of every dwelling's detail."""
    return TL.sale_list(bridge.dwellings(spark, sf), bridge.sales(spark, sf)).withColumn("change_pct", F.round("change_pct", 6))
