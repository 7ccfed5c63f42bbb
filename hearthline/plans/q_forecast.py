"""Queries on market projections and their rolling evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bridge
from ..operators import area_stats as A
from ..operators import forecast as FC
from ..operators import links as L
from ..policies import ForecastPolicy
from ..session import cut_lineage, fresh_path
from .book import book, rounded
from .oracle import cte
from .q_links import district_links
from .q_valuation import stored_indices

QUERIES, ORACLE, query = book()

# the supplied tables span 83 months, less than the default windows need
SHORT = ForecastPolicy(long_months=60, short_months=24, min_months=36, horizons=(6, 12, 18, 24), min_origin_year=1997, max_horizon=60)
H = "[6,12,18,24]"
SER = "country, area_code, area_level, segment"

cte("pts", f"SELECT {SER}, period, index_value, ln(index_value) AS y, row_number() OVER (PARTITION BY {SER} ORDER BY period) AS x FROM idx")
_L = f"OVER (PARTITION BY {SER} ORDER BY x ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
_S = f"OVER (PARTITION BY {SER} ORDER BY x ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
cte("tails", f"""
SELECT *, CASE WHEN x>=3 THEN regr_slope(y,x) {_L} ELSE 0 END AS g_long, CASE WHEN x>=3 THEN regr_slope(y,x) {_S} ELSE 0 END AS g_short,
  CASE WHEN least(x,60)>3 THEN sqrt(greatest(regr_syy(y,x) {_L}-pow(regr_sxy(y,x) {_L},2)/regr_sxx(y,x) {_L},0)/(least(x,60)-2)) ELSE 0 END AS residual_sigma FROM pts""")
cte("last_tails", f"SELECT * FROM tails QUALIFY row_number() OVER (PARTITION BY {SER} ORDER BY x DESC)=1")
cte("fits", """
SELECT t.country, t.area_code, t.area_level, t.segment, t.period AS origin_period, t.index_value AS origin_index, t.x AS months, t.g_long, t.g_short,
  CASE WHEN n.g IS NULL THEN t.g_long ELSE t.x/(t.x+120.0)*t.g_long+(1-t.x/(t.x+120.0))*n.g END AS g_used,
  CASE WHEN n.g IS NULL THEN 0 ELSE 1-t.x/(t.x+120.0) END::DOUBLE AS shrinkage, t.residual_sigma
FROM last_tails t LEFT JOIN (SELECT country, arg_min(g_long,area_code) AS g FROM last_tails WHERE area_level='country' AND segment='all' AND x>=36 GROUP BY 1) n ON n.country=t.country
WHERE t.x>=36""")
cte("origin_rows", f"""
SELECT a.*, h.h AS horizon, CAST(lead_y-a.y AS DOUBLE) AS actual, CASE WHEN n.g IS NULL THEN a.g_long ELSE a.x/(a.x+120.0)*a.g_long+(1-a.x/(a.x+120.0))*n.g END AS g_used
FROM (SELECT t.* FROM tails t JOIN (SELECT {SER} FROM tails GROUP BY {SER} HAVING count(*)>=60) USING ({SER}) WHERE segment='all' AND month(period)=1 AND year(period)>=1997 AND x>=36) a
CROSS JOIN (SELECT unnest({H}) AS h) h
JOIN (SELECT {SER}, x, y AS lead_y FROM pts) f ON f.country=a.country AND f.area_code=a.area_code AND f.segment=a.segment AND f.x=a.x+h.h
LEFT JOIN (SELECT country, period, arg_min(g_long,area_code) AS g FROM tails t JOIN (SELECT {SER} FROM tails GROUP BY {SER} HAVING count(*)>=60) USING ({SER})
  WHERE area_level='country' AND segment='all' AND x>=36 GROUP BY 1,2) n ON n.country=a.country AND n.period=a.period""")
cte("errs", "SELECT *, 0.35*g_used*horizon-actual AS error, -actual AS error_flat, g_short*horizon-actual AS error_linear, g_short-g_used AS momentum FROM origin_rows")
cte("bt", """
SELECT CAST(horizon AS INTEGER) AS horizon, count(*) AS n, avg(abs(exp(error)-1)*100) AS mae_pp, quantile_cont(abs(exp(error)-1)*100,0.5) AS median_ae_pp, sqrt(avg(error*error)) AS rmse, avg(error) AS bias,
  stddev_pop(error) AS sigma, 1-sqrt(avg(error*error))/sqrt(avg(error_flat*error_flat)) AS skill_flat, 1-sqrt(avg(error*error))/sqrt(avg(error_linear*error_linear)) AS skill_linear
FROM errs GROUP BY 1 HAVING count(*)>=20""")
cte("sig", "SELECT horizon, round(sigma,5) AS s FROM bt")


def sigma_sql(h: str) -> str:
    lo, hi = f"(SELECT max(horizon) FROM sig WHERE horizon<={h})", f"(SELECT min(horizon) FROM sig WHERE horizon>={h})"
    at = "(SELECT s FROM sig WHERE horizon={0})"
    return (f"CASE WHEN {lo} IS NULL THEN {at.format(hi)}*sqrt({h}/CAST({hi} AS DOUBLE)) WHEN {hi} IS NULL THEN {at.format(lo)}*sqrt({h}/CAST({lo} AS DOUBLE)) "
            f"WHEN {lo}={hi} THEN {at.format(lo)} ELSE {at.format(lo)}+({h}-{lo})/CAST({hi}-{lo} AS DOUBLE)*({at.format(hi)}-{at.format(lo)}) END")


cte("sigma_grid", f"SELECT CAST(h AS INTEGER) AS horizon, {sigma_sql('h')} AS sigma FROM (SELECT unnest(range(1,61)) AS h)")


def _indices(spark, sf):
    return stored_indices(spark, sf)


def _sigma(indices: DataFrame) -> DataFrame:
    return cut_lineage(FC.sigma_table(FC.agg_backtest(cut_lineage(FC.origin_errors(indices, SHORT)), SHORT)))


@query("win_tail_slope", f"SELECT {SER}, x AS months, round(g_long,8) AS g_long, round(g_short,8) AS g_short, round(residual_sigma,8) AS residual_sigma FROM last_tails")
def win_tail_slope(spark: SparkSession, sf: str) -> DataFrame:
    fits = FC.tail_fits(FC.positions(_indices(spark, sf)), SHORT)
    last = fits.join(fits.groupBy(*FC.SERIES).agg(F.max("x").alias("x")), [*FC.SERIES, "x"], "left_semi")
    return rounded(last.select(*FC.SERIES, F.col("months").cast("long").alias("months"), "g_long", "g_short", "residual_sigma"), 8)


@query("fc_fit", f"SELECT {SER}, origin_period, months, round(origin_index,6) AS origin_index, round(g_used,8) AS g_used, round(shrinkage,8) AS shrinkage FROM fits")
def fc_fit(spark: SparkSession, sf: str) -> DataFrame:
    f = FC.fc_fit(_indices(spark, sf), SHORT)
    return f.select(*FC.SERIES, "origin_period", F.col("months").cast("long").alias("months"), F.round("origin_index", 6).alias("origin_index"),
                    F.round("g_used", 8).alias("g_used"), F.round("shrinkage", 8).alias("shrinkage"))


@query("win_origin", "SELECT area_code, period, horizon, round(actual,8) AS actual, round(error,8) AS error FROM (SELECT area_code, period, CAST(horizon AS INTEGER) AS horizon, actual, error FROM errs)")
def win_origin(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(FC.origin_errors(_indices(spark, sf), SHORT).select("area_code", "period", "horizon", "actual", "error"), 8)


_BT = "SELECT horizon, n, round(mae_pp,6) AS mae_pp, round(median_ae_pp,6) AS median_ae_pp, round(rmse,8) AS rmse, round(bias,8) AS bias, round(sigma,8) AS sigma, round(skill_flat,6) AS skill_flat, round(skill_linear,6) AS skill_linear FROM bt"


def _backtest(spark, sf):
    b = FC.agg_backtest(cut_lineage(FC.origin_errors(_indices(spark, sf), SHORT)), SHORT)
    six = ("mae_pp", "median_ae_pp", "skill_flat", "skill_linear")
    return b.select("horizon", "n", *[F.round(c, 6).alias(c) for c in six], *[F.round(c, 8).alias(c) for c in ("rmse", "bias", "sigma")])


@query("agg_backtest", _BT)
def agg_backtest(spark: SparkSession, sf: str) -> DataFrame:
    return _backtest(spark, sf)


@query("fc_backtest", "SELECT horizon, s AS sigma FROM sig")
def fc_backtest(spark: SparkSession, sf: str) -> DataFrame:
    return _sigma(_indices(spark, sf))


_GRID = "(SELECT unnest([0.0,0.15,0.25,0.35,0.5,0.7,1.0])::DOUBLE AS drift), (SELECT unnest([0.0,0.25,0.55,0.8,1.0])::DOUBLE AS momentum)"
_CAL = f"""SELECT drift, g.momentum, count(*) AS n, sqrt(avg(pow(drift*g_used*horizon+g.momentum*e.momentum*(0.945*(1-pow(0.945,horizon))/(1-0.945))-actual,2))) AS rmse,
  sqrt(avg(actual*actual)) AS flat FROM errs e, (SELECT * FROM {_GRID}) g GROUP BY 1,2"""


@query("fc_calibrate", f"SELECT drift, momentum, n, round(rmse,8) AS pooled_rmse, round(1-rmse/flat,6) AS skill_flat FROM ({_CAL})")
def fc_calibrate(spark: SparkSession, sf: str) -> DataFrame:
    c = FC.fc_calibrate(FC.origin_errors(_indices(spark, sf), SHORT), SHORT)
    return c.select("drift", "momentum", "n", F.round("pooled_rmse", 8).alias("pooled_rmse"), F.round("skill_flat", 6).alias("skill_flat"))


@query("agg_calibrate", f"SELECT drift, momentum, round(rmse,8) AS pooled_rmse FROM ({_CAL}) ORDER BY rmse, drift, momentum LIMIT 1")
def agg_calibrate(spark: SparkSession, sf: str) -> DataFrame:
    c = FC.fc_calibrate(FC.origin_errors(_indices(spark, sf), SHORT), SHORT)
    return c.limit(1).select("drift", "momentum", F.round("pooled_rmse", 8).alias("pooled_rmse"))


@query("fc_project", f"""
SELECT area_code, segment, CAST(h AS INTEGER) AS horizon, CAST(origin_period+to_months(CAST(greatest(h,0) AS INTEGER)) AS DATE) AS target_period,
  round(CASE WHEN h>0 THEN exp(0.35*g_used*h) ELSE 1 END::DOUBLE,8) AS ratio, round(CASE WHEN h>0 THEN exp(0.35*g_used*h-1.2816*0.075*sqrt(h/12.0)) ELSE 1 END::DOUBLE,8) AS ratio_low,
  round(CASE WHEN h>0 THEN exp(0.35*g_used*h+1.2816*0.075*sqrt(h/12.0)) ELSE 1 END::DOUBLE,8) AS ratio_high FROM fits, (SELECT unnest([0,6,12,24,60]) AS h)""")
def fc_project(spark: SparkSession, sf: str) -> DataFrame:
    rows = FC.fc_fit(_indices(spark, sf), SHORT).withColumn("horizon", F.explode(F.array(*map(F.lit, (0, 6, 12, 24, 60)))))
    return rounded(FC.fc_project(rows, SHORT, None).select("area_code", "segment", "horizon", "target_period", "ratio", "ratio_low", "ratio_high"), 8)


@query("fc_sigma", """SELECT area_code, segment, horizon, round(sigma,8) AS sigma FROM fits, sigma_grid WHERE horizon IN (3,6,9,12,20,24,30,60)""")
def fc_sigma(spark: SparkSession, sf: str) -> DataFrame:
    indices = _indices(spark, sf)
    rows = FC.fc_fit(indices, SHORT).withColumn("horizon", F.explode(F.array(*map(F.lit, (3, 6, 9, 12, 20, 24, 30, 60)))))
    return rounded(FC.with_sigma(rows, _sigma(indices)).select("area_code", "segment", "horizon", "sigma"), 8)


cte("fit_requests", "SELECT DISTINCT h.country, 'IX-'||h.county AS requested_area, h.property_type AS requested_segment FROM homes h")
cte("fallback", """
SELECT r.*, f.area_code, f.area_level, f.segment, f.origin_period, f.months, f.g_used, f.g_short, f.shrinkage, f.residual_sigma FROM fit_requests r JOIN (
  SELECT country, 0 AS p, area_code AS ra, segment AS rs, * EXCLUDE (country) FROM fits
  UNION ALL SELECT f.country, 1, f.area_code, ty, f.* EXCLUDE (country) FROM fits f, (SELECT DISTINCT property_type AS ty FROM homes) WHERE f.segment='all'
  UNION ALL SELECT f.country, 2, q.requested_area, q.requested_segment, f.* EXCLUDE (country) FROM fits f JOIN fit_requests q ON q.country=f.country WHERE f.segment='all' AND f.area_level='country') f
ON f.country=r.country AND f.ra=r.requested_area AND f.rs=r.requested_segment QUALIFY row_number() OVER (PARTITION BY r.country,r.requested_area,r.requested_segment ORDER BY p)=1""")


@query("fc_fallback", "SELECT country, requested_area, requested_segment, area_code, segment FROM fallback")
def fc_fallback(spark: SparkSession, sf: str) -> DataFrame:
    requests = bridge.dwellings(spark, sf).select("country", F.concat(F.lit("IX-"), "county").alias("requested_area"), F.col("property_type").alias("requested_segment")).distinct()
    return FC.fc_fallback(requests, FC.fc_fit(_indices(spark, sf), SHORT)).select("country", "requested_area", "requested_segment", "area_code", "segment")


cte("markets", """
SELECT DISTINCT h.country, h.district, h.property_type, CAST(y AS INTEGER) AS year, f.area_code, f.area_level, f.segment, f.origin_period, g.horizon, exp(0.35*f.g_used*g.horizon) AS ratio,
  exp(0.35*f.g_used*g.horizon-1.2816*g.sigma) AS ratio_low, exp(0.35*f.g_used*g.horizon+1.2816*g.sigma) AS ratio_high, g.sigma, f.months, f.residual_sigma,
  round(3.0-0.42*g.horizon/12.0+CASE WHEN f.area_level='local_authority' THEN 0.5 ELSE -0.3 END+CASE WHEN f.months>=240 THEN 0.3 ELSE 0 END-CASE WHEN f.residual_sigma>0.05 THEN 0.4 ELSE 0 END,9)::DOUBLE AS sc
FROM homes h CROSS JOIN (SELECT unnest([2002,2003,2005,2030]) AS y) JOIN fallback f ON f.country=h.country AND f.requested_area='IX-'||h.county AND f.requested_segment=h.property_type
JOIN sigma_grid g ON g.horizon=y*12+6-(year(f.origin_period)*12+month(f.origin_period))""")
_GRADE = "CASE WHEN sc>=2.6 THEN 'HIGH' WHEN sc>=1.4 THEN 'MEDIUM' WHEN sc>=0.3 THEN 'LOW' ELSE 'VERY_LOW' END"


def market(spark: SparkSession, sf: str, indices: DataFrame | None = None) -> DataFrame:
    indices = _indices(spark, sf) if indices is None else indices
    places = bridge.dwellings(spark, sf).select("country", "district", "property_type").distinct()
    years = places.select(F.explode(F.array(*map(F.lit, (2002, 2003, 2005, 2030)))).alias("year"))
    return FC.fc_market(places, years, indices, district_links(spark, sf), _sigma(indices), SHORT)


@query("fc_market", "SELECT country, district, property_type, year, area_code, segment, horizon, round(ratio,8) AS ratio, round(ratio_low,8) AS ratio_low, round(ratio_high,8) AS ratio_high FROM markets")
def fc_market(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(market(spark, sf).select("country", "district", "property_type", "year", "area_code", "segment", "horizon", "ratio", "ratio_low", "ratio_high"), 8)


@query("fc_grade", f"SELECT country, district, property_type, year, {_GRADE} AS confidence FROM markets")
def fc_grade(spark: SparkSession, sf: str) -> DataFrame:
    return market(spark, sf).select("country", "district", "property_type", "year", F.col("forecast_confidence").alias("confidence"))


@query("fc_describe", """SELECT area_code, segment, round((exp(g_used*12)-1)*100,2) AS fitted_annual_pct, round((exp(g_used*0.35*12)-1)*100,2) AS applied_annual_pct,
  round((exp(g_short*12)-1)*100,2) AS recent_annual_pct, round(shrinkage,3) AS national_weight, round(residual_sigma,4) AS residual_sd, 12.3::DOUBLE AS momentum_half_life,
  CASE WHEN months<60 THEN 'history shorter than the long window' ELSE '' END AS note FROM fits""")
def fc_describe(spark: SparkSession, sf: str) -> DataFrame:
    return FC.fc_fit(_indices(spark, sf), SHORT).select("area_code", "segment", *FC.fc_describe(SHORT))


@query("sink_forecast", """SELECT country, area_code, segment, year, max(horizon)::INTEGER AS horizon, round(max(ratio),8) AS ratio FROM markets GROUP BY 1,2,3,4""")
def sink_forecast(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.upsert import read_table, upsert_into
    path, keys = fresh_path(spark, "forecasts"), ["country", "area_code", "segment", "year"]
    rows = cut_lineage(market(spark, sf).select(*keys, "horizon", "ratio").distinct())
    for _ in range(2):
        upsert_into(path, rows, keys, kept=True)
    return rounded(read_table(spark, path), 8)


cte("area_links", "SELECT m.country, m.area_level, m.area_code, l.area_code AS index_area_code FROM modal m JOIN district_links l USING (country, district)")
cte("fit_area", """SELECT s.country, s.area_level, s.area_code, s.segment, s.year AS data_year, s.median_price, l.index_area_code FROM area_stats s JOIN area_links l USING (country, area_level, area_code)
WHERE s.year=(SELECT max(year) FROM area_stats z WHERE z.country=s.country)""")


AREA_FIT = """SELECT a.*, f.area_code AS market, f.origin_period, f.g_used, f.area_level AS market_level, f.months, f.residual_sigma FROM fit_area a JOIN (
    SELECT *, area_code AS ra, segment AS rs, 0 AS p FROM fits UNION ALL SELECT f.*, f.area_code, t.s, 1 FROM fits f, (SELECT DISTINCT segment AS s FROM fits) t WHERE f.segment='all'
    UNION ALL SELECT n.*, d.area_code, t.s, 2 FROM fits n JOIN (SELECT DISTINCT country, area_code FROM district_links) d USING (country), (SELECT DISTINCT segment AS s FROM area_stats) t WHERE n.area_level='country' AND n.segment='all') f
  ON f.country=a.country AND f.ra=a.index_area_code AND f.rs=a.segment QUALIFY row_number() OVER (PARTITION BY a.country,a.area_level,a.area_code,a.segment ORDER BY p)=1"""


def area_links(spark: SparkSession, sf: str) -> DataFrame:
    """Index series of each area, through its most frequent district."""
    rows = A.with_levels(A.evidence(bridge.sales(spark, sf)), ["county", "district", "outcode", "sector"])
    links = district_links(spark, sf).withColumnRenamed("area_code", "index_area_code")
    return L.modal_district(A.with_own_district(rows)).join(links, ["country", "district"]).drop("district")


@query("fc_area", f"""
WITH moved AS ({AREA_FIT})
SELECT country, area_level, area_code, segment, data_year, market AS forecast_market, round(median_price*exp(0.35*g_used*(2003*12+6-(year(origin_period)*12+month(origin_period)))),4) AS median_price FROM moved
WHERE 2003*12+6-(year(origin_period)*12+month(origin_period)) BETWEEN 1 AND 60""")
def fc_area(spark: SparkSession, sf: str) -> DataFrame:
    stats = cut_lineage(A.agg_area_stats(bridge.sales(spark, sf)))
    out = FC.fc_area(stats, area_links(spark, sf), _indices(spark, sf), None, SHORT, 2003)
    return rounded(out.select("country", "area_level", "area_code", "segment", "data_year", "forecast_market", "median_price"), 4)
