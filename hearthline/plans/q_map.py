"""Queries on places, viewports and maps."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bridge
from .. import constants as K
from ..functions import geo
from ..operators import area_stats as A
from ..operators import forecast as FC
from ..operators import places as P
from ..operators import quality as Q
from ..operators import viewports as M
from ..operators.lookup import geo_lookup as lookup_texts
from ..session import cut_lineage
from .book import book, rounded
from .oracle import cte, distance_sql
from .q_forecast import AREA_FIT, SHORT, area_links
from .q_register import gazetteer
from .q_timeline import figures, timeline_ctes
from .q_valuation import TODAY, stored_indices

QUERIES, ORACLE, query = book()

cte("rects", """
SELECT n_name, r_name, x0+dx AS x0, y0+dy AS y0, x0+dx+w AS x1, y0+dy+h AS y1 FROM (
  SELECT n_name, r_name, n_nationkey%5=0 AS ell, -2.0::DOUBLE+((n_nationkey+25*j)%10)*0.2::DOUBLE AS x0, 50.0::DOUBLE+((n_nationkey+25*j)//10)*0.2::DOUBLE AS y0
  FROM nation JOIN region ON n_regionkey=r_regionkey, (SELECT unnest([0,1,2,3]) AS j)) p,
  (SELECT unnest([{'l':false,'dx':0.0,'dy':0.0,'w':0.1,'h':0.1},{'l':true,'dx':0.0,'dy':0.0,'w':0.15,'h':0.05},{'l':true,'dx':0.0,'dy':0.05,'w':0.05,'h':0.1}], recursive := true)) q
WHERE q.l=p.ell""")
cte("crects", "SELECT r_name AS shape, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM rects UNION ALL SELECT 'OUTER', -2.05, 49.95, -1.02, 51.02")
cte("cshape_area", "SELECT shape, round(sum((x1-x0)*(y1-y0)),9) AS area FROM crects GROUP BY 1")
cte("cpoints", "SELECT c_custkey AS point_id, 49.8::DOUBLE+(c_custkey*37%2600)/1000.0::DOUBLE+0.0005::DOUBLE AS lat, -2.3::DOUBLE+(c_custkey*91%2600)/1000.0::DOUBLE+0.0005::DOUBLE AS lon FROM customer")
_M = repr(P.M_PER_DEG)
_LIMIT_OF_ZOOM = "CASE " + " ".join(f"WHEN zoom>={low} THEN {n}" for low, _, _, n in K.ZOOM_LADDER) + " ELSE 120 END"


def pip_ctes(points: str) -> str:
    d = f"round(sqrt(pow(greatest(x0-lon,0,lon-x1)*cos(radians(lat))*{_M},2)+pow(greatest(y0-lat,0,lat-y1)*{_M},2)),6)"
    return f"""pt AS ({points}),
pin AS (SELECT point_id, arg_min(shape,(area,shape)) AS shape FROM pt JOIN crects ON lon>x0 AND lon<x1 AND lat>y0 AND lat<y1 JOIN cshape_area USING (shape) GROUP BY 1),
pnear AS (SELECT point_id, arg_min(shape,(d,shape)) AS shape, min(d) AS distance_m FROM (SELECT point_id, shape, {d} AS d FROM pt, crects WHERE point_id NOT IN (SELECT point_id FROM pin)) WHERE d<=15000 GROUP BY 1),
pjur AS (SELECT point_id, shape FROM pin UNION ALL SELECT point_id, shape FROM pnear),
preg AS (SELECT point_id, min(n_name) AS region_code FROM pt JOIN rects ON lon>x0 AND lon<x1 AND lat>y0 AND lat<y1 GROUP BY 1),
pfull AS (SELECT j.point_id, j.shape AS country, r.region_code FROM pjur j LEFT JOIN preg r USING (point_id))"""


@query("point_in_polygon", f"WITH {pip_ctes('SELECT * FROM cpoints')} SELECT point_id, shape AS shape_id FROM pin")
def point_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    return P.point_in_polygon(bridge.points(spark, sf), bridge.country_shapes(spark, sf))


@query("nearest_polygon", f"WITH {pip_ctes('SELECT * FROM cpoints')} SELECT point_id, shape AS shape_id, round(distance_m,2) AS distance_m FROM pnear")
def nearest_polygon(spark: SparkSession, sf: str) -> DataFrame:
    points, shapes = bridge.points(spark, sf), bridge.country_shapes(spark, sf)
    outside = points.join(P.point_in_polygon(points, shapes), "point_id", "left_anti")
    return rounded(P.nearest_polygon(outside, shapes), 2)


cte("vps", f"""
SELECT v_id AS viewport_id, lon-half AS west, lat-half/2 AS south, lon+half AS east, lat+half/2 AS north, zoom, year, segment,
  CASE WHEN zoom>=14.5 THEN 'PROPERTY' WHEN zoom>=13.2 THEN 'STREET' WHEN zoom>=12 THEN 'POSTCODE' WHEN zoom>=10.5 THEN 'NEIGHBOURHOOD' WHEN zoom>=9 THEN 'CITY' WHEN zoom>=7 THEN 'REGION' WHEN zoom>=4.5 THEN 'COUNTRY' ELSE 'WORLD' END AS tier
FROM (SELECT *, 360.0::DOUBLE/pow(2,zoom)*CASE WHEN zoom>=12 THEN 6.0 ELSE 1.0 END::DOUBLE AS half FROM (SELECT s_suppkey AS v_id, list_extract([3.0,5.0,8.0,9.5,11.0,12.5,13.5,15.0],s_suppkey%8+1)::DOUBLE AS zoom,
  50.0::DOUBLE+(s_suppkey*7%10)*0.2::DOUBLE+0.03::DOUBLE AS lat, -2.0::DOUBLE+(s_suppkey*3%10)*0.2::DOUBLE+CASE WHEN s_suppkey%11=0 THEN -0.08 ELSE 0.03 END::DOUBLE AS lon,
  CAST(s_suppkey%9+1995 AS INTEGER) AS year, CASE WHEN s_suppkey%3=0 THEN 'flat' ELSE 'all' END AS segment FROM supplier))""")
cte("seen_regions", """
SELECT viewport_id, r_name, n_name, round(sum((least(x1,east)-greatest(x0,west))*(least(y1,north)-greatest(y0,south))),12) AS visible_area FROM vps JOIN rects ON x0<east AND x1>west AND y0<north AND y1>south GROUP BY 1,2,3""")
cte("seen_shapes", """
SELECT viewport_id, shape, round(sum((least(x1,east)-greatest(x0,west))*(least(y1,north)-greatest(y0,south))),12) AS visible_area FROM vps JOIN crects ON x0<east AND x1>west AND y0<north AND y1>south GROUP BY 1,2""")


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    return bridge.viewports(spark, sf).withColumnRenamed("viewport_id", "box_id")


@query("box_country", "SELECT viewport_id, arg_max(shape,(visible_area,shape)) AS shape, max(visible_area) AS overlap FROM seen_shapes GROUP BY 1")
def box_country(spark: SparkSession, sf: str) -> DataFrame:
    out = P.box_country(boxes(spark, sf), bridge.country_shapes(spark, sf))
    return out.select(F.col("box_id").alias("viewport_id"), F.col("shape_id").alias("shape"), "overlap")


@query("polygon_in_view", "SELECT viewport_id, shape, visible_area, true AS point_in_box FROM seen_shapes")
def polygon_in_view(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf)
    out = P.polygon_in_view(b, bridge.country_shapes(spark, sf)).join(b, "box_id")
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    return out.select(F.col("box_id").alias("viewport_id"), F.col("shape_id").alias("shape"), "visible_area", inside.alias("point_in_box"))


@query("top_visible", f"SELECT viewport_id, shape, CAST(row_number() OVER (PARTITION BY viewport_id ORDER BY visible_area DESC, shape) AS INTEGER) AS place FROM seen_shapes JOIN vps USING (viewport_id) QUALIFY place<={_LIMIT_OF_ZOOM}")
def top_visible(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window
    out = P.polygon_in_view(boxes(spark, sf), bridge.country_shapes(spark, sf)).join(boxes(spark, sf).select("box_id", "zoom"), "box_id")
    w = Window.partitionBy("box_id").orderBy(F.col("visible_area").desc(), "shape_id")
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= M.limit_of(M.tier_of(F.col("zoom")))).select(F.col("box_id").alias("viewport_id"), F.col("shape_id").alias("shape"), "place")


# --- nearest postcode --------------------------------------------------------
_D = distance_sql("p.lat", "p.lon", "g.lat", "g.lon")
cte("knn", f"""
SELECT point_id, arg_min(struct_pack(postcode:=postcode,uk_country:=uk_country),(d,postcode)) AS v, min(d) AS d FROM (
  SELECT p.point_id, g.postcode, g.uk_country, {_D} AS d FROM cpoints p JOIN gazetteer g ON g.status='live' AND abs(p.lat-g.lat)<0.23) WHERE d<=25000 GROUP BY 1""")


@query("knn_postcode", """SELECT p.point_id, v.postcode AS postcode, round(d,2) AS distance_m, CASE WHEN v IS NULL THEN 'GB-UNKNOWN' WHEN v.uk_country='Scotland' THEN 'GB-SCT' WHEN v.uk_country='Northern Ireland' THEN 'GB-NIR' END AS region_code
FROM cpoints p LEFT JOIN knn k USING (point_id)""")
def knn_postcode(spark: SparkSession, sf: str) -> DataFrame:
    points, g = bridge.points(spark, sf), cut_lineage(gazetteer(spark, sf))
    every, off = P.knn_postcode_apart(points, g)
    codes = P.uk_region(points, g, off).select("point_id", "region_code")
    near = every.select("point_id", "postcode", F.round("distance_m", 2).alias("distance_m"))
    return codes.join(near, "point_id", "left")


@query("geo_lookup", """
WITH asked AS (SELECT DISTINCT lower(postcode) AS query, postcode AS code, true AS whole FROM homes UNION SELECT DISTINCT pc_outcode, pc_outcode, false FROM homes),
oc AS (SELECT outcode, CAST(sum(CAST(lat AS DECIMAL(18,7))) AS DOUBLE)/count(*) AS lat, CAST(sum(CAST(lon AS DECIMAL(18,7))) AS DOUBLE)/count(*) AS lon, min(uk_country) AS uk FROM gazetteer WHERE status='live' GROUP BY 1)
SELECT query, 'postcode/'||code AS id, round(g.lat,6) AS lat, round(g.lon,6) AS lon, 16.5::DOUBLE AS suggested_zoom, uk_country FROM asked JOIN gazetteer g ON g.postcode=code WHERE whole
UNION ALL SELECT query, 'outcode/'||code, round(o.lat,6), round(o.lon,6), 13.0, uk FROM asked JOIN oc o ON o.outcode=code WHERE NOT whole""")
def geo_lookup(spark: SparkSession, sf: str) -> DataFrame:
    homes = bridge.dwellings(spark, sf)
    texts = homes.select(F.lower("postcode").alias("query")).union(homes.select("pc_outcode")).distinct()
    out = lookup_texts(texts, gazetteer(spark, sf))
    return rounded(out.select("query", "id", "lat", "lon", F.col("suggested_zoom").cast("double").alias("suggested_zoom"), "uk_country"), 6)


# --- viewports ---------------------------------------------------------------
@query("bbox_rules", """
SELECT c_custkey AS id, CASE WHEN c_custkey%7=0 THEN 'not four numbers' WHEN abs(w)>180 OR abs(e)>180 THEN 'longitude out of range' WHEN abs(s)>90 OR abs(n)>90 THEN 'latitude out of range'
  WHEN s>n THEN 'south above north' WHEN w=e THEN 'no width' END AS problem,
  round(CASE WHEN c_custkey%7=0 THEN NULL WHEN w<=e THEN (w+e)/2 WHEN w+(360.0-w+e)/2>180 THEN w+(360.0-w+e)/2-360 ELSE w+(360.0-w+e)/2 END,6) AS centre_lon,
  round(CASE WHEN c_custkey%7<>0 THEN greatest(-85.05,least(85.05,n)) END,6)::DOUBLE AS clamped_north
FROM (SELECT c_custkey, CAST(c_custkey*17%380-190 AS DOUBLE) AS w, CAST(c_custkey*5%180-90 AS DOUBLE) AS s, CAST(c_custkey*29%370-185 AS DOUBLE) AS e, CAST(c_custkey*11%190-95 AS DOUBLE) AS n FROM customer)""")
def bbox_rules(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    known = c % 7 != 0
    rows = bridge.table(spark, sf, "customer").select(c.alias("id"), *[
        F.when(known, (c * m % mod - off).cast("double")).alias(name) for name, m, mod, off in (("w", 17, 380, 190), ("s", 5, 180, 90), ("e", 29, 370, 185), ("n", 11, 190, 95))])
    return rows.select("id", geo.box_problem(*map(F.col, "wsen")).alias("problem"), F.round(F.when(F.col("w").isNotNull(), geo.box_centre_lon(F.col("w"), F.col("e"))), 6).alias("centre_lon"),
                       F.when(F.col("n").isNotNull(), F.round(geo.clamp_lat(F.col("n")), 6)).alias("clamped_north"))


_LEVEL_GB = "CASE tier WHEN 'STREET' THEN 'street' WHEN 'POSTCODE' THEN 'postcode' WHEN 'NEIGHBOURHOOD' THEN 'sector' WHEN 'CITY' THEN 'outcode' WHEN 'REGION' THEN 'district' WHEN 'COUNTRY' THEN 'county' WHEN 'WORLD' THEN 'country' END"
_LIMIT = "CASE tier WHEN 'PROPERTY' THEN 400 WHEN 'STREET' THEN 350 WHEN 'POSTCODE' THEN 300 WHEN 'NEIGHBOURHOOD' THEN 250 WHEN 'COUNTRY' THEN 150 WHEN 'WORLD' THEN 120 ELSE 200 END"
cte("zooms", """SELECT c_custkey AS id, CAST(c_custkey%221 AS DOUBLE)/10 AS zoom, CASE WHEN c_custkey%2=0 THEN 'FR' ELSE 'GB' END AS country,
  CASE WHEN c_custkey%221>=145 THEN 'PROPERTY' WHEN c_custkey%221>=132 THEN 'STREET' WHEN c_custkey%221>=120 THEN 'POSTCODE' WHEN c_custkey%221>=105 THEN 'NEIGHBOURHOOD' WHEN c_custkey%221>=90 THEN 'CITY' WHEN c_custkey%221>=70 THEN 'REGION' WHEN c_custkey%221>=45 THEN 'COUNTRY' ELSE 'WORLD' END AS tier FROM customer""")


def zoom_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    return bridge.table(spark, sf, "customer").select(c.alias("id"), ((c % 221).cast("double") / 10).alias("zoom"), F.when(c % 2 == 0, "FR").otherwise("GB").alias("country")).withColumn("tier", M.tier_of(F.col("zoom")))


@query("zoom_tier", f"SELECT id, tier, CASE WHEN country='FR' AND tier='REGION' THEN 'county' WHEN country='FR' AND tier='CITY' THEN 'district' ELSE {_LEVEL_GB} END AS area_level, CAST({_LIMIT} AS INTEGER) AS row_limit FROM zooms")
def zoom_tier(spark: SparkSession, sf: str) -> DataFrame:
    return zoom_rows(spark, sf).select("id", "tier", M.level_of(F.col("tier"), F.col("country")).alias("area_level"), M.limit_of(F.col("tier")).alias("row_limit"))


_TP = "CASE tier WHEN 'PROPERTY' THEN 2 WHEN 'STREET' THEN 3 WHEN 'POSTCODE' THEN 3 WHEN 'NEIGHBOURHOOD' THEN 4 ELSE 5 END"
_LP = "CASE WHEN area_level IN ('street','postcode','sector') THEN 3 WHEN area_level IN ('outcode','district') THEN 4 ELSE 5 END"
_PNAME = "['EXACT_TRANSACTION','PROPERTY_ESTIMATE','STREET_POSTCODE','NEIGHBOURHOOD','CITY_REGIONAL','NONE']"
_TNAME = "['WORLD','COUNTRY','REGION','CITY','NEIGHBOURHOOD','POSTCODE','STREET','PROPERTY']"
_TT = f"list_position({_TNAME},tier)"
_LT = "CASE area_level WHEN 'street' THEN 7 WHEN 'postcode' THEN 6 WHEN 'sector' THEN 6 WHEN 'outcode' THEN 5 WHEN 'district' THEN 4 WHEN 'country' THEN 2 ELSE 3 END"
_HONEST = f"list_extract({_PNAME},greatest({_TP},{_LP})) AS precision, list_extract({_TNAME},least({_TT},{_LT})) AS served_tier"


@query("honest_precision", f"SELECT DISTINCT tier, area_level, {_HONEST} FROM zooms, (SELECT unnest(['street','postcode','sector','outcode','district','county','state','country']) AS area_level)")
def honest_precision(spark: SparkSession, sf: str) -> DataFrame:
    rows = zoom_rows(spark, sf).select("tier").distinct().withColumn("area_level", F.explode(F.array(*map(F.lit, K.LEVELS_FINE_TO_COARSE))))
    return rows.select("tier", "area_level", M.honest_precision(F.col("area_level"), F.col("tier")).alias("precision"), M.honest_tier(F.col("area_level"), F.col("tier")).alias("served_tier"))


@query("txn_window", """SELECT viewport_id, sale_key, CAST(row_number() OVER (PARTITION BY viewport_id ORDER BY transaction_date DESC, sale_key) AS INTEGER) AS place,
  count(*) OVER (PARTITION BY viewport_id)>500 AS truncated
FROM vps JOIN sales ON lon BETWEEN west AND east AND lat BETWEEN south AND north WHERE is_residential AND transaction_date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31' QUALIFY place<=500""")
def txn_window(spark: SparkSession, sf: str) -> DataFrame:
    found = M.txn_window(bridge.viewports(spark, sf), bridge.sales(spark, sf).select("sale_key", "transaction_date", "lat", "lon", "is_residential"), date(1998, 1, 1), date(2000, 12, 31))
    return found.select("viewport_id", "sale_key", "place", "truncated")


@query("viewport_join", """SELECT viewport_id, count(*) AS dwellings, min(property_id) AS first_id, max(property_id) AS last_id, sum(property_id)::BIGINT AS id_sum
FROM vps JOIN homes ON lon BETWEEN west AND east AND lat BETWEEN south AND north GROUP BY 1""")
def viewport_join(spark: SparkSession, sf: str) -> DataFrame:
    """Dwellings in each viewport, counted; sums of ids show that they are the right ones."""
    v = P.plain_boxes(bridge.viewports(spark, sf)).select("viewport_id", "w", "s", "e", "n")
    seen = P.box_join(bridge.dwellings(spark, sf).select("property_id", "lat", "lon"), v, [])
    return seen.groupBy("viewport_id").agg(F.count(F.lit(1)).alias("dwellings"), F.min("property_id").alias("first_id"), F.max("property_id").alias("last_id"), F.sum("property_id").alias("id_sum"))


cte("gate0", f"""
SELECT v.*, j.country, j.region_code FROM vps v LEFT JOIN (
  SELECT p.viewport_id, p.country, p.region_code FROM vjur p UNION ALL
  SELECT viewport_id, arg_max(shape,(visible_area,shape)), NULL FROM seen_shapes WHERE viewport_id NOT IN (SELECT viewport_id FROM vjur) GROUP BY 1) j USING (viewport_id)""")
cte("gate", """
SELECT viewport_id, west, south, east, north, zoom, year, segment, country, region_code, CASE WHEN b='areas' AND tier='PROPERTY' THEN 'NEIGHBOURHOOD' ELSE tier END AS tier, b AS branch,
  CASE WHEN b='refused' THEN coalesce(notes,'Property price data is not currently available for this location.') END AS message FROM (
  SELECT g.*, coalesce(r.notes,c.notes) AS notes, CASE WHEN coalesce(coalesce(r.max_precision,c.max_precision)<>'NONE',false)
      THEN CASE WHEN tier='PROPERTY' THEN 'properties' ELSE 'areas' END WHEN tier<>'PROPERTY' AND g.country IS NOT NULL AND r.country IS NULL THEN 'world' ELSE 'refused' END AS b
  FROM gate0 g LEFT JOIN coverage r ON r.country=g.country AND r.region_code=g.region_code LEFT JOIN coverage c ON c.country=g.country AND c.region_code IS NULL)""")
_VJUR = f"""{pip_ctes('SELECT viewport_id AS point_id, (south+north)/2 AS lat, (west+east)/2 AS lon FROM vps')}, vjur AS (SELECT point_id AS viewport_id, country, region_code FROM pfull)"""


def gate_sql(body: str) -> str:
    """The gate depends on `vjur`, so both are stated inside the query itself."""
    from .oracle import CTES
    return f"WITH {_VJUR}, gate0_ AS ({CTES['gate0']}), gate_ AS ({CTES['gate'].replace('gate0 g', 'gate0_ g')}), {body}"





def gated(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(M.map_gate(bridge.viewports(spark, sf), bridge.country_shapes(spark, sf), bridge.region_shapes(spark, sf), bridge.coverage(spark, sf)))


@query("map_gate", gate_sql("x AS (SELECT 1) SELECT viewport_id, country, region_code, tier, branch, message FROM gate_"))
def map_gate(spark: SparkSession, sf: str) -> DataFrame:
    return gated(spark, sf).select("viewport_id", "country", "region_code", "tier", "branch", "message")


_TY = TODAY.year
_AREAS = f"""snap AS (SELECT g.*, CASE WHEN g.year>{_TY} THEN (SELECT max(year) FROM area_stats z WHERE z.country=g.country)
    ELSE (SELECT arg_min(year,(abs(year-g.year),-year)) FROM (SELECT DISTINCT country, segment, year FROM area_stats) z WHERE z.country=g.country AND z.segment=g.segment) END AS sy,
  list_position(['street','postcode','sector','outcode','district','county','state','country'],{_LEVEL_GB}) AS lv FROM gate_ g WHERE branch='areas'),
grown AS (SELECT a.*, (a.median_price/p.median_price-1)*100 AS growth FROM area_stats a LEFT JOIN area_stats p ON p.country=a.country AND p.area_level=a.area_level AND p.area_code=a.area_code AND p.segment=a.segment AND p.year=a.year-1),
live AS (SELECT s.viewport_id, k.lv AS l, k.key AS area_code, quantile_cont(e.price,0.5) AS median_price, quantile_cont(e.price,0.25) AS p25, quantile_cont(e.price,0.75) AS p75,
    quantile_cont(e.price_per_sqm,0.5) AS ppsm, count(*) AS n, list(e.district) AS districts FROM snap s JOIN evid e ON e.country=s.country AND e.lon BETWEEN s.west AND s.east AND e.lat BETWEEN s.south AND s.north
    AND e.year BETWEEN s.sy-2 AND s.sy AND (s.segment='all' OR e.property_type=s.segment),
  LATERAL (SELECT unnest([{{'lv':1,'key':'ST'||(e.property_id%700)||', '||e.pc_outcode}},{{'lv':2,'key':e.postcode}}], recursive := true)) k WHERE s.lv<=k.lv GROUP BY 1,2,3 HAVING count(*)>=2),
outlined AS (SELECT s.viewport_id, 6 AS l, a.area_code, a.median_price, a.p25_price AS p25, a.p75_price AS p75, a.median_price_per_sqm AS ppsm, a.transaction_count AS n, a.growth, v.visible_area AS vis
  FROM snap s JOIN seen_regions v ON v.viewport_id=s.viewport_id AND v.r_name=s.country JOIN nation USING (n_name) JOIN grown a ON a.country=s.country AND a.area_level='county' AND a.area_code='C'||n_nationkey
    AND a.segment=s.segment AND a.year=s.sy WHERE s.lv<=6),
found AS (SELECT viewport_id, l, area_code, median_price, p25, p75, ppsm, n, NULL::DOUBLE AS growth, NULL::DOUBLE AS vis FROM live
  UNION ALL SELECT * FROM outlined
  UNION ALL SELECT s.viewport_id, list_position(['street','postcode','sector','outcode','district','county','state','country'],a.area_level), a.area_code, a.median_price, a.p25_price, a.p75_price, a.median_price_per_sqm, a.transaction_count, a.growth, NULL
    FROM snap s JOIN grown a ON a.country=s.country AND a.segment=s.segment AND a.year=s.sy AND a.area_level<>'country' AND a.centre_lon BETWEEN s.west AND s.east AND a.centre_lat BETWEEN s.south AND s.north
    WHERE list_position(['street','postcode','sector','outcode','district','county','state','country'],a.area_level)>=s.lv
      AND NOT (a.area_level='county' AND s.viewport_id IN (SELECT viewport_id FROM outlined))
  UNION ALL SELECT s.viewport_id, 8, a.area_code, a.median_price, a.p25_price, a.p75_price, a.median_price_per_sqm, a.transaction_count, NULL, v.visible_area FROM snap s JOIN seen_shapes v USING (viewport_id) JOIN area_stats a ON a.country=v.shape AND a.area_level='country' AND a.segment=s.segment AND a.year=s.sy),
best AS (SELECT * FROM found QUALIFY l=min(l) OVER (PARTITION BY viewport_id)),
ranked AS (SELECT b.*, s.tier, s.year, s.sy, s.country, s.segment, list_extract(['street','postcode','sector','outcode','district','county','state','country'],b.l) AS area_level,
  CAST(row_number() OVER (PARTITION BY b.viewport_id ORDER BY vis DESC NULLS LAST, n DESC NULLS LAST, area_code) AS INTEGER) AS place FROM best b JOIN snap s USING (viewport_id) QUALIFY place<={_LIMIT})"""


def stats_and_sales(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Stored statistics, and the live tiles of postcodes and streets, which whoever reads them stores."""
    sales = bridge.sales(spark, sf)
    streets = sales.drop("outcode").withColumns({"street": F.concat(F.lit("ST"), (F.col("property_id") % 700).cast("string")), "outcode": F.col("pc_outcode")})
    street = F.concat(F.coalesce("street", F.lit("")), F.lit(", "), F.coalesce("outcode", F.lit("")))
    tiles = M.live_tiles(streets, "postcode", F.col("postcode")).unionByName(M.live_tiles(streets, "street", street))
    return cut_lineage(A.agg_area_stats(sales)), tiles


def shaped(spark: SparkSession, sf: str) -> DataFrame:
    """Outlines of the areas of county level."""
    nation, region = bridge.table(spark, sf, "nation"), bridge.table(spark, sf, "region")
    names = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("shape_id"), F.col("r_name").alias("country"), F.concat(F.lit("C"), "n_nationkey").alias("area_code"))
    return bridge.region_shapes(spark, sf).select("shape_id", "rings").join(names, "shape_id").withColumn("area_level", F.lit("county"))


def area_rows(spark: SparkSession, sf: str, market: DataFrame | None = None) -> DataFrame:
    stats, tiles = stats_and_sales(spark, sf)
    money = bridge.coverage(spark, sf).where("region_code IS NULL").select("country", "currency")
    return M.map_areas(gated(spark, sf), stats, cut_lineage(tiles), bridge.country_shapes(spark, sf), TODAY, market, shaped(spark, sf), money)


_LIVE = "area_level IN ('street','postcode')"


@query("map_areas", gate_sql(f"""{_AREAS} SELECT viewport_id, area_level, area_code, place, year, CAST(sy AS INTEGER) AS stats_year, round(median_price,6) AS median_price, round(p25,6) AS p25_price, round(p75,6) AS p75_price,
  round(ppsm,6) AS median_price_per_sqm, n AS transaction_count, round(growth,6) AS growth_1y_pct, round(vis,9) AS visible_area, 'TRANSACTIONS' AS basis, 'MEDIAN' AS price_statistic, 'GBP' AS currency,
  CAST(CASE WHEN {_LIVE} THEN sy-2 ELSE year END AS INTEGER) AS window_from_year, CAST(CASE WHEN {_LIVE} THEN sy ELSE year END AS INTEGER) AS window_to_year, {_HONEST}
FROM ranked WHERE year<={_TY}"""))
def map_areas(spark: SparkSession, sf: str) -> DataFrame:
    out = area_rows(spark, sf).withColumn("visible_area", F.round("visible_area", 9))
    return rounded(out.select("viewport_id", "area_level", "area_code", "place", "year", "stats_year", "median_price", "p25_price", "p75_price", "median_price_per_sqm", "transaction_count", "growth_1y_pct",
                              "visible_area", "basis", "price_statistic", "currency", "window_from_year", "window_to_year", "precision", "served_tier"), 6, ["visible_area"])


@query("map_areas_future", gate_sql(f"""{_AREAS}, moved AS ({AREA_FIT}) SELECT r.viewport_id, r.area_level, r.area_code, r.year, CAST(r.sy AS INTEGER) AS stats_year,
  round(r.median_price*exp(0.35*m.g_used*(r.year*12+6-(year(m.origin_period)*12+month(m.origin_period)))),4) AS median_price FROM ranked r
JOIN moved m ON m.country=r.country AND m.area_level=r.area_level AND m.area_code=r.area_code AND m.segment=r.segment
WHERE r.year>{_TY} AND r.year*12+6-(year(m.origin_period)*12+month(m.origin_period)) BETWEEN 1 AND 60"""))
def map_areas_future(spark: SparkSession, sf: str) -> DataFrame:
    """Future years: latest medians projected with each area's own series, omitted where none fits."""
    stats = cut_lineage(A.agg_area_stats(bridge.sales(spark, sf)))
    indices, links = stored_indices(spark, sf), area_links(spark, sf)
    columns = ["country", "area_level", "area_code", "segment", "year", "ratio", "confidence"]
    years = [FC.fc_area(stats, links, indices, None, SHORT, y).select(*columns) for y in (2002, 2003)]
    out = area_rows(spark, sf, cut_lineage(years[0].unionByName(years[1])))
    return rounded(out.where("is_forecast").select("viewport_id", "area_level", "area_code", "year", "stats_year", "median_price"), 4)


@query("coarsen", gate_sql(f"{_AREAS} SELECT DISTINCT viewport_id, tier, area_level FROM ranked WHERE year<={_TY}"))
def coarsen(spark: SparkSession, sf: str) -> DataFrame:
    return area_rows(spark, sf).select("viewport_id", "tier", "area_level").distinct()


@query("top_area", gate_sql(f"{_AREAS} SELECT viewport_id, area_code, place FROM ranked WHERE year<={_TY}"))
def top_area(spark: SparkSession, sf: str) -> DataFrame:
    return area_rows(spark, sf).select("viewport_id", "area_code", "place")


@query("dq_priced_shown", gate_sql(f"""{_AREAS} SELECT 'priced and shown once' AS rule, (SELECT count(*) FROM ranked WHERE year<={_TY}) AS checked,
  (SELECT count(*) FROM ranked WHERE year<={_TY} AND (median_price IS NULL OR median_price NOT BETWEEN 100 AND 100000000))
  + (SELECT count(*) FROM (SELECT 1 FROM ranked WHERE year<={_TY} GROUP BY viewport_id, area_code HAVING count(*)>1)) AS broken"""))
def dq_priced_shown(spark: SparkSession, sf: str) -> DataFrame:
    """Over all rows that the map shows."""
    return Q.dq_priced_shown(area_rows(spark, sf), 100.0, 1e8)


@query("agg_live", gate_sql(f"""{_AREAS} SELECT viewport_id, CASE l WHEN 1 THEN 'street' ELSE 'postcode' END AS area_level, area_code, round(median_price,6) AS median_price, round(p25,6) AS p25_price,
  round(p75,6) AS p75_price, round(ppsm,6) AS median_price_per_sqm, n AS transaction_count,
  (SELECT arg_min(x, (-c, x)) FROM (SELECT x, count(*) AS c FROM (SELECT unnest(districts) AS x) GROUP BY x)) AS market_district FROM live"""))
def agg_live(spark: SparkSession, sf: str) -> DataFrame:
    stats, tiles = stats_and_sales(spark, sf)
    tries = M.with_levels_to_try(M.year_snap(gated(spark, sf).where("branch = 'areas'"), stats, TODAY))
    box = P.plain_boxes(tries.where(F.col("area_level").isin("postcode", "street"))).select("viewport_id", "rank", "area_level", "country", "segment", "stats_year", "w", "s", "e", "n")
    return rounded(M.agg_live(cut_lineage(tiles), box).select("viewport_id", "area_level", "area_code", "median_price", "p25_price", "p75_price", "median_price_per_sqm", "transaction_count", "market_district"), 6)


@query("year_snap", gate_sql(f"{_AREAS} SELECT viewport_id, year, CAST(sy AS INTEGER) AS stats_year FROM snap"))
def year_snap(spark: SparkSession, sf: str) -> DataFrame:
    stats, _ = stats_and_sales(spark, sf)
    return M.year_snap(gated(spark, sf).where("branch = 'areas'"), stats, TODAY).select("viewport_id", "year", "stats_year")


@query("map_world", gate_sql(f"""told AS (SELECT country, area_code, segment, year, median_price, transaction_count, 'TRANSACTIONS' AS basis FROM area_stats WHERE area_level='country' AND NOT (country='ASIA' AND year>1998)
  UNION ALL SELECT country, area_code, segment, year, median_price*1.1, NULL, 'PUBLISHED' FROM area_stats WHERE area_level='country'),
one AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY country, area_code, segment, year ORDER BY basis='TRANSACTIONS' DESC)=1), w AS (SELECT g.*, (SELECT max(year) FROM area_stats z WHERE z.area_level='country' AND z.segment=g.segment AND z.year<=g.year) AS sy FROM gate_ g WHERE branch='world' AND year<={_TY})
SELECT viewport_id, a.area_code, round(a.median_price,6) AS median_price, a.transaction_count, a.basis, CAST(row_number() OVER (PARTITION BY viewport_id ORDER BY v.visible_area DESC, a.transaction_count DESC NULLS LAST, a.area_code) AS INTEGER) AS place
FROM w JOIN seen_shapes v USING (viewport_id) JOIN one a ON a.country=v.shape AND a.segment=w.segment AND a.year=w.sy"""))
def map_world(spark: SparkSession, sf: str) -> DataFrame:
    """Countries with a published figure beside recorded sales, and one that has only the published figure in its later years."""
    stats = cut_lineage(A.agg_area_stats(bridge.sales(spark, sf)))
    sold = stats.where("NOT (area_level = 'country' AND country = 'ASIA' AND year > 1998)").withColumn("basis", F.lit("TRANSACTIONS"))
    told = stats.where("area_level = 'country'").withColumns({"median_price": F.col("median_price") * 1.1, "transaction_count": F.lit(None).cast("long"), "basis": F.lit("PUBLISHED")})
    out = M.map_world(gated(spark, sf), sold.unionByName(told), bridge.country_shapes(spark, sf), TODAY)
    return rounded(out.select("viewport_id", "area_code", "median_price", "transaction_count", "basis", "place"), 6)


_THIN = """counts AS (SELECT property_id, count(*) AS sale_count, max(transaction_date) AS last_sold FROM sales GROUP BY 1),
seen AS (SELECT g.viewport_id, g.year, h.property_id, h.lat, h.lon, h.postcode, c.sale_count, c.last_sold,
    round(h.lon/(360.0/(256.0*pow(2,g.zoom))*70.0/greatest(cos(radians((g.south+g.north)/2)),0.15))) AS gx, round(h.lat/(360.0/(256.0*pow(2,g.zoom))*46.0)) AS gy
  FROM gate_ g JOIN homes h ON h.country=g.country AND h.is_residential AND h.lon BETWEEN g.west AND g.east AND h.lat BETWEEN g.south AND g.north AND (g.segment='all' OR g.segment=h.property_type) JOIN counts c USING (property_id) WHERE branch='properties'),
thin AS (SELECT *, count(*) OVER (PARTITION BY viewport_id) AS total_in_view FROM seen QUALIFY row_number() OVER (PARTITION BY viewport_id,gx,gy ORDER BY sale_count DESC, last_sold DESC, property_id)=1),
slots AS (SELECT *, row_number() OVER (PARTITION BY viewport_id,postcode ORDER BY property_id)-1 AS slot, count(*) OVER (PARTITION BY viewport_id,postcode) AS in_postcode FROM thin),
rings AS (SELECT *, CASE WHEN in_postcode>1 THEN least(0.00036,0.0001*sqrt(in_postcode)) ELSE 0 END AS ring FROM slots)"""


def thin(spark: SparkSession, sf: str) -> DataFrame:
    counts = bridge.sales(spark, sf).groupBy("property_id").agg(F.count(F.lit(1)).alias("sale_count"), F.max("transaction_date").alias("last_sold"))
    return M.thinned_dwellings(gated(spark, sf), bridge.dwellings(spark, sf), counts)


@query("win_thin", gate_sql(f"{_THIN} SELECT viewport_id, property_id, sale_count, last_sold FROM thin"))
def win_thin(spark: SparkSession, sf: str) -> DataFrame:
    return thin(spark, sf).select("viewport_id", "property_id", "sale_count", "last_sold")


@query("win_slot", gate_sql(f"{_THIN} SELECT viewport_id, property_id, CAST(slot AS INTEGER) AS slot, in_postcode FROM slots"))
def win_slot(spark: SparkSession, sf: str) -> DataFrame:
    return thin(spark, sf).select("viewport_id", "property_id", "slot", "in_postcode")


@query("win_ring", gate_sql(f"""{_THIN} SELECT viewport_id, property_id, round(CASE WHEN ring>0 THEN lat+ring*sin(2*pi()*slot/in_postcode) ELSE lat END,8) AS marker_lat,
  round(CASE WHEN ring>0 THEN lon+ring*cos(2*pi()*slot/in_postcode)/greatest(cos(radians(lat)),0.2) ELSE lon END,8) AS marker_lon FROM rings"""))
def win_ring(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(thin(spark, sf).select("viewport_id", "property_id", "marker_lat", "marker_lon"), 8)


@query("win_total", gate_sql(f"{_THIN} SELECT viewport_id, count(*) AS total_in_view FROM seen GROUP BY 1"))
def win_total(spark: SparkSession, sf: str) -> DataFrame:
    return thin(spark, sf).select("viewport_id", "total_in_view").distinct()


@query("map_properties", gate_sql(f"{_THIN}, {timeline_ctes('SELECT DISTINCT property_id, year FROM thin')} SELECT t.viewport_id, t.property_id, t.year, f.price_type, f.value, f.confidence FROM thin t JOIN figures f USING (property_id, year) WHERE f.status='OK'"))
def map_properties(spark: SparkSession, sf: str) -> DataFrame:
    markers = cut_lineage(thin(spark, sf))
    prices = figures(spark, sf, markers.select("property_id", "year"))
    return M.map_properties(markers, prices).select("viewport_id", "property_id", "year", "price_type", "value", "confidence")
