"""Queries on valuation: comparables, estimates, back-casts, evaluation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bridge
from .. import constants as K
from ..functions.geo import haversine_m
from ..functions.parse import month_no
from ..operators import area_stats as A
from ..operators import comparables as C
from ..operators import evaluation as E
from ..operators import index_series as I
from ..operators import search_tree as ST
from ..operators import valuation as V
from ..policies import FR_POLICY, GB_POLICY, Clock, SearchPolicy
from ..session import cut_lineage
from .book import book, rounded
from .oracle import distance_sql
from .q_links import RESTATE, district_links

QUERIES, ORACLE, query = book()
TODAY = Clock().today
T = f"DATE '{TODAY.isoformat()}'"
TM = TODAY.year * 12 + TODAY.month

AFFINITY_SQL = ("CASE WHEN {a}={b} THEN 1.0 " + " ".join(
    f"WHEN ({{a}}='{p}' AND {{b}}='{q}') OR ({{a}}='{q}' AND {{b}}='{p}') THEN {w}" for p, q, w in K.TYPE_AFFINITY) + " ELSE 0.18 END")


def affinity_sql(a: str, b: str) -> str:
    return AFFINITY_SQL.format(a=a, b=b)


def similarity_sql(d: str, months: str, ta: str, sa: str, tt: str, st: str) -> str:
    return (f"(CAST({affinity_sql(tt, st)} AS DOUBLE)*(0.58*exp(-{d}/900.0)+0.25*exp(-{months}/30.0)+0.17*exp(-2.0*abs(ln({sa}/{ta})))))")


def targets_sql(as_of: str, source: str = "homes", years: int = 5) -> str:
    back = f"make_date(CAST(year(as_of)-{years} AS INTEGER),CAST(month(as_of) AS INTEGER),1)"
    fwd = f"make_date(CAST(year(as_of)+{years} AS INTEGER),CAST(month(as_of) AS INTEGER),28)"
    return f"""SELECT *, {back} AS date_from, least(CASE WHEN is_historical THEN {fwd} ELSE as_of END,{T}) AS date_to FROM (
  SELECT property_id||'@'||as_of AS tid, property_id, country, lat, lon, property_type, floor_area, district, as_of,
    year(as_of)<{TODAY.year} AS is_historical FROM (SELECT *, {as_of} AS as_of FROM {source}))"""


def comps_ctes(targets: str, causal: bool = False, policy: SearchPolicy = GB_POLICY) -> str:
    """Named sub-queries for the whole comparable search by brute force."""
    end = "e.transaction_date<t.as_of" if causal else "e.transaction_date<=t.date_to"
    d = distance_sql("t.lat", "t.lon", "e.lat", "e.lon")

    def one(name, src):
        counts = ", ".join(f"count(*) FILTER (d<={int(r)}) OVER (PARTITION BY tid) AS c{int(r)}" for r in policy.radius_steps_m)
        used = " ".join(f"WHEN c{int(r)}>=15 THEN {r}" for r in policy.radius_steps_m)
        return f"""{name}_all AS (SELECT *, CASE {used} ELSE {policy.radius_steps_m[-1]} END::DOUBLE AS radius_m FROM (SELECT *, {counts} FROM {src})),
{name}_near AS (SELECT * FROM {name}_all WHERE d<=radius_m QUALIFY row_number() OVER (PARTITION BY tid ORDER BY d, sold_date DESC, sale_key)<=160),
{name} AS (SELECT *, {similarity_sql('d', 'months_apart', 'floor_area', 'sale_area', 'property_type', 'sale_type')} AS similarity FROM {name}_near)"""
    return f"""t AS ({targets}),
pairs AS (SELECT * FROM (SELECT t.*, e.sale_key, e.property_id AS sale_property_id, e.price, e.transaction_date AS sold_date, e.property_type AS sale_type,
    e.floor_area AS sale_area, e.district AS sale_district, e.lat AS sale_lat, e.lon AS sale_lon,
    CAST(abs((year(e.transaction_date)-year(t.as_of))*12+month(e.transaction_date)-month(t.as_of)) AS INTEGER) AS months_apart, {d} AS d
  FROM t JOIN evid e ON e.country=t.country AND e.transaction_date>=t.date_from AND {end} AND e.property_id<>t.property_id
    AND abs(e.lat-t.lat)<0.058 AND abs(e.lon-t.lon)<0.096) WHERE d<={policy.radius_steps_m[-1]}),
typed AS (SELECT * FROM pairs WHERE sale_type=property_type AND property_type<>'other'),
{one('s1', 'typed')},
enough AS (SELECT tid FROM s1 WHERE similarity>=0.35 GROUP BY 1 HAVING count(*)>=3),
loose AS (SELECT * FROM pairs WHERE tid NOT IN (SELECT tid FROM enough)),
{one('s2', 'loose')},
comps AS (SELECT *, true AS type_restricted FROM s1 WHERE similarity>=0.35 AND tid IN (SELECT tid FROM enough)
  UNION ALL SELECT *, false FROM s2 WHERE similarity>=0.35)"""


OWN = """own_pick AS (SELECT t.tid, t.country, t.as_of, e.price AS own_price, e.transaction_date AS own_date, e.property_type AS own_type, e.district AS own_district
  FROM t JOIN evid e ON e.property_id=t.property_id {cond}
  QUALIFY row_number() OVER (PARTITION BY t.tid ORDER BY CASE WHEN e.transaction_date>t.as_of THEN 1 ELSE 0 END, abs(date_diff('day',t.as_of,e.transaction_date)), e.price DESC, e.sale_key)=1)"""


def avm_ctes(targets: str, causal: bool = False) -> str:
    own = OWN.format(cond="AND e.transaction_date<t.as_of" if causal else "")
    return f"""{comps_ctes(targets, causal)},
{own},
restate_requests AS (SELECT DISTINCT country, sale_district AS district, sale_type AS property_type, CAST(year(sold_date)*12+month(sold_date) AS INTEGER) AS from_month,
    CAST(year(as_of)*12+month(as_of) AS INTEGER) AS to_month FROM comps
  UNION SELECT DISTINCT country, own_district, own_type, CAST(year(own_date)*12+month(own_date) AS INTEGER), CAST(year(as_of)*12+month(as_of) AS INTEGER) FROM own_pick),
restate AS MATERIALIZED ({RESTATE}),
adj AS (SELECT c.*, c.price*(r.to_value/r.from_value) AS adjusted_price, r.area_level AS adjustment_level, ln(c.price*(r.to_value/r.from_value)) AS v, greatest(similarity,1e-4) AS w
  FROM comps c JOIN restate r ON r.country=c.country AND r.district=c.sale_district AND r.property_type=c.sale_type
    AND r.from_month=year(sold_date)*12+month(sold_date) AND r.to_month=year(as_of)*12+month(as_of)),
own AS (SELECT o.tid, own_price, own_date, own_price*(r.to_value/r.from_value) AS own_value, abs(date_diff('day',own_date,as_of))/365.25 AS own_years
  FROM own_pick o JOIN restate r ON r.country=o.country AND r.district=o.own_district AND r.property_type=o.own_type
    AND r.from_month=year(own_date)*12+month(own_date) AND r.to_month=year(as_of)*12+month(as_of)),
run AS (SELECT *, sum(w) OVER (PARTITION BY tid ORDER BY v,w,sale_key ROWS UNBOUNDED PRECEDING) AS acc, sum(w) OVER (PARTITION BY tid) AS total,
  count(*) OVER (PARTITION BY tid) AS n, row_number() OVER (PARTITION BY tid ORDER BY d,sale_key) AS rd FROM adj),
mid AS (SELECT *, min(CASE WHEN acc>=0.5*total-1e-12 THEN v END) OVER (PARTITION BY tid) AS centre FROM run),
devs AS (SELECT *, sum(w) OVER (PARTITION BY tid ORDER BY abs(v-centre),w,sale_key ROWS UNBOUNDED PRECEDING) AS dacc FROM mid),
summ0 AS (SELECT tid, count(*) AS comparable_count, sum(w) AS effective_weight, max(centre) AS centre_log, min(CASE WHEN acc>=0.25*total-1e-12 THEN v END) AS p25_log,
  min(CASE WHEN acc>=0.75*total-1e-12 THEN v END) AS p75_log, min(CASE WHEN dacc>=0.5*total-1e-12 THEN abs(v-centre) END) AS mad,
  max(CASE WHEN rd=n//2+1 THEN d END) AS median_distance_m, min(months_apart) AS months_to_nearest, max(similarity) AS top_similarity, max(radius_m) AS radius_m,
  bool_and(type_restricted) AS type_restricted, count_if(adjustment_level='local_authority') AS la, count_if(adjustment_level='country') AS na FROM devs GROUP BY 1),
summ AS (SELECT *, CASE WHEN comparable_count<4 THEN mad*1.4826 ELSE greatest(0.0,(p75_log-p25_log)/1.349) END AS dispersion,
  CASE WHEN la>=na THEN 'local_authority' ELSE 'country' END AS adjustment_level FROM summ0),
est0 AS (SELECT t.*, s.* EXCLUDE (tid), o.own_price, o.own_date, o.own_value, o.own_years, coalesce(comparable_count,0) AS nc,
  CASE WHEN own_value IS NULL THEN 0.0 ELSE least(0.55*exp(-own_years/7.0), 0.65*effective_weight/(effective_weight+4.0)) END AS own_share,
  coalesce(comparable_count,0)<3 OR coalesce(effective_weight<1.6,true) AS thin
  FROM t LEFT JOIN summ s USING (tid) LEFT JOIN own o USING (tid)),
est1 AS (SELECT *, round(CASE WHEN effective_weight>=12 THEN 2.0 WHEN effective_weight>=6 THEN 1.2 WHEN effective_weight>=3 THEN 0.5 ELSE -1.0 END
  +CASE WHEN median_distance_m<=400 THEN 1.5 WHEN median_distance_m<=1000 THEN 0.8 WHEN median_distance_m<=2500 THEN 0.1 ELSE -0.8 END
  +CASE WHEN dispersion<=0.14 THEN 1.3 WHEN dispersion<=0.24 THEN 0.5 WHEN dispersion<=0.38 THEN -0.4 ELSE -1.3 END
  +CASE WHEN top_similarity>=0.8 THEN 0.5 WHEN top_similarity<0.5 THEN -0.5 ELSE 0 END
  +CASE WHEN months_to_nearest>36 THEN -0.9 WHEN months_to_nearest>18 THEN -0.3 ELSE 0 END
  +CASE adjustment_level WHEN 'local_authority' THEN 0.6 WHEN 'region' THEN 0.1 WHEN 'country' THEN -0.5 ELSE -1.2 END
  +CASE WHEN own_years IS NULL THEN 0 WHEN own_years<=4 THEN 1.4 WHEN own_years<=10 THEN 0.7 ELSE 0.2 END, 9)::DOUBLE AS score FROM est0),
est2 AS (SELECT *, CASE WHEN thin THEN NULL WHEN score>=4.2 THEN 'HIGH' WHEN score>=2.2 THEN 'MEDIUM' WHEN score>=0.6 THEN 'LOW' ELSE 'VERY_LOW' END AS confidence FROM est1),
est3 AS (SELECT *, NOT thin AND confidence<>'VERY_LOW' AS ok,
  exp((1-own_share)*centre_log+CASE WHEN own_value IS NULL THEN 0.0 ELSE own_share*ln(own_value) END) AS raw_estimate,
  least(greatest(CASE confidence WHEN 'HIGH' THEN 0.075 WHEN 'MEDIUM' THEN 0.125 WHEN 'LOW' THEN 0.2 ELSE 0.3 END::DOUBLE,dispersion*0.73)
    +CASE WHEN is_historical THEN least(0.06,0.004*abs({TODAY.year}-year(as_of))) ELSE 0 END,0.32) AS hw FROM est2),
est AS (SELECT *, CASE WHEN ok THEN 'OK' ELSE 'INSUFFICIENT_EVIDENCE' END AS status, CASE WHEN ok THEN hw END AS half_width,
  CASE WHEN ok THEN round_even(raw_estimate,0) END AS estimated_price, CASE WHEN ok THEN round_even(raw_estimate*exp(-hw),0) END AS low_estimate,
  CASE WHEN ok THEN round_even(raw_estimate*exp(hw),0) END AS high_estimate FROM est3)"""


NOW = targets_sql(T)


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    return A.evidence(bridge.sales(spark, sf))


def current_targets(spark: SparkSession, sf: str) -> DataFrame:
    return V.targets_for(bridge.dwellings(spark, sf), F.lit(TODAY), TODAY, GB_POLICY)


def stored_indices(spark: SparkSession, sf: str) -> DataFrame:
    """The index series as a written table, the way a valuation job finds them."""
    return cut_lineage(I.monthly_index(bridge.sales(spark, sf)))


def current_comparables(spark: SparkSession, sf: str) -> DataFrame:
    return C.val_comparables(current_targets(spark, sf), evidence(spark, sf), GB_POLICY)


def current_restated(spark: SparkSession, sf: str) -> DataFrame:
    return V.restated_comparables(current_comparables(spark, sf), stored_indices(spark, sf), district_links(spark, sf))


def current_values(spark: SparkSession, sf: str, indices: DataFrame | None = None) -> DataFrame:
    indices = stored_indices(spark, sf) if indices is None else indices
    return V.val_avm(current_targets(spark, sf), evidence(spark, sf), indices, district_links(spark, sf), GB_POLICY, TODAY)


# --- similarity --------------------------------------------------------------
@query("val_type_affinity", f"""
SELECT a.ty AS target_type, b.ty AS sale_type, CAST({affinity_sql('a.ty', 'b.ty')} AS DOUBLE) AS affinity
FROM (SELECT DISTINCT property_type AS ty FROM homes) a, (SELECT DISTINCT property_type AS ty FROM sales) b""")
def val_type_affinity(spark: SparkSession, sf: str) -> DataFrame:
    a = bridge.dwellings(spark, sf).select(F.col("property_type").alias("target_type")).distinct()
    b = bridge.sales(spark, sf).agg(F.collect_set("property_type").alias("t")).scalar()  # a handful of types
    pairs = a.withColumn("sale_type", F.explode(b))
    return pairs.withColumn("affinity", C.type_affinity(F.col("target_type"), F.col("sale_type")))


@query("val_similarity", f"""
SELECT sale_key, round({similarity_sql('d', 'm', 'ta', 'sa', 'tt', 'st')},8) AS similarity FROM (
  SELECT s.sale_key, {distance_sql('h.lat', 'h.lon', 's.lat', 's.lon')} AS d, {TM}-(year(s.transaction_date)*12+month(s.transaction_date)) AS m,
    h.floor_area AS ta, s.floor_area AS sa, h.property_type AS tt, s.property_type AS st FROM sales s JOIN homes h ON h.property_id=s.supplier_id)""")
def val_similarity(spark: SparkSession, sf: str) -> DataFrame:
    homes = bridge.dwellings(spark, sf).select(F.col("property_id").alias("supplier_id"), *[F.col(c).alias("h_" + c) for c in ("lat", "lon", "floor_area", "property_type")])
    rows = bridge.sales(spark, sf).join(homes, "supplier_id").withColumn("d", haversine_m(F.col("h_lat"), F.col("h_lon"), F.col("lat"), F.col("lon")))
    score = C.similarity(F.col("d"), F.lit(TM) - month_no(F.col("transaction_date")), F.col("h_property_type"), F.col("property_type"), F.col("h_floor_area"), F.col("floor_area"))
    return rows.select("sale_key", F.round(score, 8).alias("similarity"))


@query("val_window", f"""
SELECT DISTINCT as_of, both_ways, make_date(CAST(year(as_of)-5 AS INTEGER),CAST(month(as_of) AS INTEGER),1) AS date_from,
  least(CASE WHEN both_ways THEN make_date(CAST(year(as_of)+5 AS INTEGER),CAST(month(as_of) AS INTEGER),28) ELSE as_of END,{T}) AS date_to
FROM (SELECT transaction_date AS as_of, sale_area>25 AS both_ways FROM sales)""")
def val_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = bridge.sales(spark, sf).select(F.col("transaction_date").alias("as_of"), (F.col("sale_area") > 25).alias("both_ways")).distinct()
    start, end = C.search_window(F.col("as_of"), GB_POLICY.months, F.col("both_ways"), F.lit(TODAY))
    return rows.withColumns({"date_from": start, "date_to": end})


# --- spatial search ----------------------------------------------------------
@query("radius_join", f"""
WITH t AS ({NOW}) SELECT tid AS target_id, count(*) AS sales_within, round(min(d),3) AS nearest_m FROM (
  SELECT t.tid, {distance_sql('t.lat', 't.lon', 'e.lat', 'e.lon')} AS d FROM t JOIN evid e ON e.country=t.country AND e.property_id<>t.property_id
    AND e.transaction_date BETWEEN t.date_from AND t.date_to AND abs(e.lat-t.lat)<0.03 AND abs(e.lon-t.lon)<0.05) WHERE d<=3200 GROUP BY 1""")
def radius_join(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.radius_counts(current_targets(spark, sf), evidence(spark, sf), 3200.0), 3)


def typed_nearest(spark: SparkSession, sf: str) -> DataFrame:
    targets, ev = current_targets(spark, sf), evidence(spark, sf)
    tree = ST.build(ev, GB_POLICY.nearest)
    return C.expand_radius(C.radius_candidates(targets.where("property_type <> 'other'"), ev, tree, GB_POLICY, True), GB_POLICY)


@query("expand_radius", f"WITH {comps_ctes(NOW)} SELECT tid AS target_id, max(radius_m) AS radius_m, count(*) AS sales_kept FROM s1_near GROUP BY 1")
def expand_radius(spark: SparkSession, sf: str) -> DataFrame:
    return typed_nearest(spark, sf).groupBy("target_id").agg(F.max("radius_m").alias("radius_m"), F.count(F.lit(1)).alias("sales_kept"))


@query("top_nearest", f"""WITH {comps_ctes(NOW)} SELECT tid AS target_id, sale_key, round(d,3) AS distance_m,
  CAST(row_number() OVER (PARTITION BY tid ORDER BY d, sold_date DESC, sale_key) AS INTEGER) AS nearness FROM s1_near""")
def top_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(typed_nearest(spark, sf).select("target_id", "sale_key", "distance_m", "nearness"), 3)


@query("val_comparables", f"WITH {comps_ctes(NOW)} SELECT tid AS target_id, sale_key, type_restricted, radius_m, round(d,3) AS distance_m, round(similarity,8) AS similarity FROM comps")
def val_comparables(spark: SparkSession, sf: str) -> DataFrame:
    c = current_comparables(spark, sf).select("target_id", "sale_key", "type_restricted", "radius_m", "distance_m", "similarity")
    return c.withColumns({"distance_m": F.round("distance_m", 3), "similarity": F.round("similarity", 8)})


_POLICIES = {"EUROPE": FR_POLICY, "ASIA": FR_POLICY}
_COMPS = "SELECT tid AS target_id, sale_key, type_restricted, radius_m, round(d,3) AS distance_m, round(similarity,8) AS similarity FROM comps"


@query("val_policy", f"""SELECT * FROM (WITH {comps_ctes(NOW)} {_COMPS} WHERE country NOT IN ('EUROPE','ASIA'))
UNION ALL SELECT * FROM (WITH {comps_ctes(targets_sql(T, years=4), policy=FR_POLICY)} {_COMPS} WHERE country IN ('EUROPE','ASIA'))""")
def val_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Two countries search by the second policy: smaller steps, a shorter window; the others by the first."""
    homes = bridge.dwellings(spark, sf)
    targets = [V.targets_for(homes.where(F.col("country").isin(list(_POLICIES)) == own), F.lit(TODAY), TODAY, p) for own, p in ((True, FR_POLICY), (False, GB_POLICY))]
    c = C.val_comparables_by_policy(targets[0].unionByName(targets[1]), evidence(spark, sf), _POLICIES, GB_POLICY)
    return c.select("target_id", "sale_key", "type_restricted", "radius_m", F.round("distance_m", 3).alias("distance_m"), F.round("similarity", 8).alias("similarity"))


_TOP = """CAST(row_number() OVER (PARTITION BY tid ORDER BY similarity DESC, sale_key) AS INTEGER)"""


@query("top_similar", f"WITH {comps_ctes(NOW)} SELECT tid AS target_id, sale_key, {_TOP} AS place FROM comps QUALIFY {_TOP}<=10")
def top_similar(spark: SparkSession, sf: str) -> DataFrame:
    return E.top_similar(current_comparables(spark, sf), 10).select("target_id", "sale_key", "place")


@query("val_comps_list", f"""
WITH {avm_ctes(NOW)} SELECT tid AS target_id, sale_key, price AS sold_price, sold_date, sale_type, round_even(d/1000.0,3) AS distance_km, round_even(d/1609.344,2) AS distance_miles,
  round(similarity,3) AS similarity, round_even(adjusted_price,0) AS adjusted_price, {_TOP} AS place FROM adj QUALIFY {_TOP}<=20""")
def val_comps_list(spark: SparkSession, sf: str) -> DataFrame:
    return E.comparable_list(current_restated(spark, sf), 20)


# --- estimates ---------------------------------------------------------------
@query("agg_wquantile", f"""WITH {avm_ctes(NOW)} SELECT tid AS target_id, round(p25_log,8) AS p25_log, round(centre_log,8) AS median_log, round(p75_log,8) AS p75_log FROM summ""")
def agg_wquantile(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.quantiles import weighted_lower_quantile
    rows = current_restated(spark, sf).withColumns({"v": F.log("adjusted_price"), "w": F.greatest("similarity", F.lit(1e-4))})
    return rounded(weighted_lower_quantile(rows, ["target_id"], "v", "w", {"p25_log": 0.25, "median_log": 0.5, "p75_log": 0.75}), 8)


@query("agg_wdispersion", f"WITH {avm_ctes(NOW)} SELECT tid AS target_id, comparable_count, round(dispersion,8) AS dispersion FROM summ")
def agg_wdispersion(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.summarise(current_restated(spark, sf)).select("target_id", "comparable_count", "dispersion"), 8)


@query("win_cumweight", f"WITH {avm_ctes(NOW)} SELECT tid AS target_id, sale_key, round(acc,6) AS running_weight, round(total,6) AS total_weight FROM run")
def win_cumweight(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window
    rows = current_restated(spark, sf).withColumns({"v": F.log("adjusted_price"), "w": F.greatest("similarity", F.lit(1e-4))})
    w = Window.partitionBy("target_id")
    running = F.sum("w").over(w.orderBy("v", "w", "sale_key").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("target_id", "sale_key", F.round(running, 6).alias("running_weight"), F.round(F.sum("w").over(w), 6).alias("total_weight"))


@query("agg_dominant", f"WITH {avm_ctes(NOW)} SELECT tid AS target_id, adjustment_level FROM summ")
def agg_dominant(spark: SparkSession, sf: str) -> DataFrame:
    return V.summarise(current_restated(spark, sf)).select("target_id", "adjustment_level")


@query("latest_before", f"WITH t AS ({targets_sql(chr(68) + 'ATE ' + chr(39) + '1997-06-30' + chr(39))}), {OWN.format(cond='')} SELECT tid AS target_id, own_price, own_date FROM own_pick")
def latest_before(spark: SparkSession, sf: str) -> DataFrame:
    t = V.targets_for(bridge.dwellings(spark, sf), F.lit(date(1997, 6, 30)), TODAY, GB_POLICY)
    return E.own_choice(t, evidence(spark, sf))


@query("val_own_sale", f"WITH {avm_ctes(NOW)} SELECT tid AS target_id, own_price, own_date, round(own_value,4) AS own_value, round(own_years,6) AS own_years FROM own")
def val_own_sale(spark: SparkSession, sf: str) -> DataFrame:
    own = V.own_sales(current_targets(spark, sf), evidence(spark, sf), stored_indices(spark, sf), district_links(spark, sf))
    return own.withColumns({"own_value": F.round("own_value", 4), "own_years": F.round("own_years", 6)})


@query("val_avm", f"WITH {avm_ctes(NOW)} SELECT property_id, as_of, status, estimated_price, low_estimate, high_estimate, confidence, nc AS comparable_count FROM est")
def val_avm(spark: SparkSession, sf: str) -> DataFrame:
    return current_values(spark, sf).select("property_id", "as_of", "status", "estimated_price", "low_estimate", "high_estimate", "confidence", "comparable_count")


_REASONS = """array_to_string(list_filter([
  CASE WHEN effective_weight>=6 THEN comparable_count||' sales close by' WHEN effective_weight>=3 THEN 'no more than '||comparable_count||' sales close by' ELSE 'hardly any sales to compare ('||comparable_count||')' END,
  CASE WHEN median_distance_m<=400 THEN 'compared sales lie a few doors away' WHEN median_distance_m<=1000 THEN 'compared sales lie in the neighbourhood' WHEN median_distance_m>2500 THEN 'compared sales lie far apart' END,
  CASE WHEN dispersion<=0.14 THEN 'their prices are close together' WHEN dispersion>0.38 THEN 'their prices differ a great deal' WHEN dispersion>0.24 THEN 'their prices differ noticeably' END,
  CASE WHEN top_similarity<0.5 THEN 'none of them resembles the dwelling well' END,
  CASE WHEN months_to_nearest>36 THEN 'the latest of them is over three years old' END,
  CASE WHEN adjustment_level='country' THEN 'prices were moved with a national index' END,
  CASE WHEN own_years<=4 THEN 'own sale '||CAST(round_even(own_years,0) AS INTEGER)||' year(s) ago' WHEN own_years<=10 THEN 'own sale within ten years' END], lambda x: x IS NOT NULL),'; ')"""


@query("val_confidence", f"WITH {avm_ctes(NOW)} SELECT property_id, confidence, round(score,6) AS score, {_REASONS} AS reasons FROM est WHERE NOT thin")
def val_confidence(spark: SparkSession, sf: str) -> DataFrame:
    v = current_values(spark, sf).where("confidence IS NOT NULL")
    return v.select("property_id", "confidence", F.round("score", 6).alias("score"), F.array_join("reasons", "; ").alias("reasons"))


@query("val_interval", f"WITH {avm_ctes(NOW)} SELECT property_id, confidence, round(half_width,8) AS half_width, low_estimate, high_estimate FROM est WHERE ok")
def val_interval(spark: SparkSession, sf: str) -> DataFrame:
    return current_values(spark, sf).where("status = 'OK'").select("property_id", "confidence", F.round("half_width", 8).alias("half_width"), "low_estimate", "high_estimate")


@query("val_evidence", f"""WITH {avm_ctes(NOW)} SELECT property_id, comparable_count, round(effective_weight,2) AS effective_weight, radius_m, round_even(median_distance_m,0) AS median_distance_m,
  round_even(exp(centre_log),0) AS median_comparable, round(dispersion,4) AS dispersion, type_restricted, adjustment_level, round(own_share,3)::DOUBLE AS own_share, round_even(own_value,0) AS own_value FROM est WHERE ok""")
def val_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return current_values(spark, sf).where("status = 'OK'").select("property_id", V.evidence_struct().alias("e")).select("property_id", "e.*").drop("price_low", "price_high", "reasons")


# --- back-casts --------------------------------------------------------------
BACKCAST_ASKED = "SELECT property_id, DATE '1998-12-31' AS as_of FROM homes UNION ALL SELECT property_id, DATE '1996-12-31' FROM homes"


def backcast_ctes(asked: str) -> str:
    return f"""bc_now AS (SELECT property_id, country, district, property_type, estimated_price, low_estimate, high_estimate, confidence FROM est WHERE ok AND as_of={T}),
bc_req AS (SELECT n.*, b.as_of AS bc_of, CAST(year(b.as_of)*12+month(b.as_of) AS INTEGER) AS to_m FROM ({asked}) b JOIN bc_now n USING (property_id) WHERE b.as_of<make_date({TODAY.year},{TODAY.month},1)),
bc_opt AS (SELECT r.*, o.p, o.area_code, o.segment FROM bc_req r JOIN (
    SELECT country, district, ty AS property_type, 0 AS p, area_code, ty AS segment FROM district_links, (SELECT DISTINCT property_type AS ty FROM homes WHERE property_type<>'other')
    UNION ALL SELECT country, district, ty, 1, area_code, 'all' FROM district_links, (SELECT DISTINCT property_type AS ty FROM homes)
    UNION ALL SELECT country, district, ty, 2, 'NAT-'||country, ty FROM district_links, (SELECT DISTINCT property_type AS ty FROM homes WHERE property_type<>'other')
    UNION ALL SELECT country, district, ty, 3, 'NAT-'||country, 'all' FROM district_links, (SELECT DISTINCT property_type AS ty FROM homes)) o
  ON o.country=r.country AND o.district=r.district AND o.property_type=r.property_type),
bc_pick AS (SELECT o.*, f.area_level, t2.value/f.value AS ratio FROM bc_opt o JOIN idx_grid f ON f.area_code=o.area_code AND f.segment=o.segment AND f.month={TM}
  JOIN idx_grid t2 ON t2.area_code=o.area_code AND t2.segment=o.segment AND t2.month=o.to_m QUALIFY row_number() OVER (PARTITION BY property_id,bc_of ORDER BY p)=1),
bc0 AS (SELECT *, CASE WHEN area_level='country' THEN CASE confidence WHEN 'HIGH' THEN 'LOW' ELSE 'VERY_LOW' END
    ELSE CASE confidence WHEN 'HIGH' THEN 'MEDIUM' WHEN 'MEDIUM' THEN 'LOW' ELSE 'VERY_LOW' END END AS bc_grade,
  ln(high_estimate/low_estimate)/2+least(0.22,0.012*greatest(0.0,date_diff('day',bc_of,{T})/365.25))+CASE WHEN area_level<>'local_authority' THEN 0.04 ELSE 0 END AS bc_half FROM bc_pick),
bc AS (SELECT property_id, bc_of AS as_of, CASE WHEN bc_grade='VERY_LOW' THEN 'INSUFFICIENT_EVIDENCE' ELSE 'OK' END AS status, bc_grade AS confidence,
  CASE WHEN bc_grade<>'VERY_LOW' THEN round_even(estimated_price*ratio,0) END AS estimated_price, CASE WHEN bc_grade<>'VERY_LOW' THEN round_even(estimated_price*ratio*exp(-bc_half),0) END AS low_estimate,
  CASE WHEN bc_grade<>'VERY_LOW' THEN round_even(estimated_price*ratio*exp(bc_half),0) END AS high_estimate FROM bc0)"""


@query("val_backcast", f"WITH {avm_ctes(NOW)}, {backcast_ctes(BACKCAST_ASKED)} SELECT * FROM bc")
def val_backcast(spark: SparkSession, sf: str) -> DataFrame:
    homes = bridge.dwellings(spark, sf)
    asked = homes.select("property_id", F.explode(F.array(F.lit(date(1998, 12, 31)), F.lit(date(1996, 12, 31)))).alias("as_of"))
    indices, links = stored_indices(spark, sf), district_links(spark, sf)
    now = cut_lineage(V.val_avm(current_targets(spark, sf), evidence(spark, sf), indices, links, GB_POLICY, TODAY))
    return V.val_backcast(asked, now, indices, links, TODAY).select("property_id", "as_of", "status", "confidence", "estimated_price", "low_estimate", "high_estimate")


# --- evaluation --------------------------------------------------------------
SAMPLE = 400
SAMPLE_SQL = f"SELECT * FROM evid WHERE transaction_date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' AND price BETWEEN 20000 AND 5000000 ORDER BY md5(sale_key), sale_key LIMIT {SAMPLE}"
EVAL_T = f"""SELECT sale_key AS tid, sale_key AS held_key, price AS actual, property_id, country, lat, lon, property_type, floor_area, district, transaction_date AS as_of,
  make_date(CAST(year(transaction_date)-5 AS INTEGER),CAST(month(transaction_date) AS INTEGER),1) AS date_from, transaction_date AS date_to, true AS is_historical FROM ({SAMPLE_SQL})"""


@query("sample_hash", f"SELECT sale_key, property_id, price, transaction_date FROM ({SAMPLE_SQL})")
def sample_hash(spark: SparkSession, sf: str) -> DataFrame:
    return E.sample_hash(evidence(spark, sf), date(1999, 1, 1), date(2000, 12, 31), SAMPLE).select("sale_key", "property_id", "price", "transaction_date")


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    ev = evidence(spark, sf)
    held = E.sample_hash(ev, date(1999, 1, 1), date(2000, 12, 31), SAMPLE)
    return cut_lineage(E.val_eval(held, ev, stored_indices(spark, sf), district_links(spark, sf), GB_POLICY, TODAY))


_EVAL = avm_ctes(EVAL_T, causal=True)


@query("val_eval", f"WITH {_EVAL} SELECT tid AS sale_key, actual, status, confidence, estimated_price, low_estimate, high_estimate FROM est")
def val_eval(spark: SparkSession, sf: str) -> DataFrame:
    return evaluated(spark, sf).select("sale_key", "actual", "status", "confidence", "estimated_price", "low_estimate", "high_estimate")


_METRICS = """count(*) AS n, round(avg(abs(estimated_price-actual)),2) AS mae, round(quantile_cont(abs(estimated_price-actual),0.5),4) AS median_ae,
  round(100*avg(abs(estimated_price-actual)/actual),4) AS mape_pct, round(100*quantile_cont(abs(estimated_price-actual)/actual,0.5),4) AS median_ape_pct,
  round(sqrt(avg(pow(estimated_price-actual,2))),2) AS rmse, round(100.0*count_if(abs(estimated_price-actual)/actual<=0.1)/count(*),4) AS within_10_pct,
  round(100.0*count_if(abs(estimated_price-actual)/actual<=0.2)/count(*),4) AS within_20_pct,
  round(100*quantile_cont((estimated_price-actual)/actual,0.5),4) AS median_signed_pct"""


@query("eval_report", f"""WITH {_EVAL} SELECT CAST(count(*) AS BIGINT) AS sampled, CAST(count_if(ok) AS BIGINT) AS usable, round(100.0*count_if(ok)/count(*),1) AS coverage_of_sample_pct,
  coalesce((SELECT string_agg(status||':'||n, ',' ORDER BY status) FROM (SELECT status, count(*) AS n FROM est WHERE NOT ok GROUP BY status)),'') AS skipped, count_if(ok)>=30 AS reported FROM est""")
def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    return E.eval_report(evaluated(spark, sf))


@query("agg_eval", f"""WITH {_EVAL}, usable AS (SELECT * FROM est WHERE ok AND (SELECT count(*) FROM est WHERE ok)>=30) SELECT 'all' AS grade, {_METRICS} FROM usable HAVING count(*)>0
UNION ALL SELECT confidence, {_METRICS} FROM usable GROUP BY confidence""")
def agg_eval(spark: SparkSession, sf: str) -> DataFrame:
    return E.agg_eval(evaluated(spark, sf))


@query("agg_interval_cov", f"""WITH {_EVAL} SELECT count(*) AS n, round(100.0*count_if(actual BETWEEN low_estimate AND high_estimate)/count(*),4) AS coverage_pct,
  round(quantile_cont(ln(high_estimate/low_estimate)/2,0.5),6) AS median_half_width FROM est WHERE ok""")
def agg_interval_cov(spark: SparkSession, sf: str) -> DataFrame:
    return E.agg_interval_cov(evaluated(spark, sf))


@query("sink_eval", f"""WITH {_EVAL} SELECT 'avm' AS model, 'holdout' AS evaluation_kind, n AS sample_size, mae, median_ape_pct FROM (SELECT {_METRICS} FROM est WHERE ok)""")
def sink_eval(spark: SparkSession, sf: str) -> DataFrame:
    from ..session import fresh_path
    path = fresh_path(spark, "evaluations")
    E.store_metrics(E.agg_eval(evaluated(spark, sf)).where("grade = 'all'"), "avm", "holdout", path)
    return spark.read.parquet(path).select("model", "evaluation_kind", "sample_size", "metrics.mae", "metrics.median_ape_pct")
