"""Queries on register rows: normalisation, rejection, identity, landed register files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bridge
from .. import constants as K
from ..functions import text as X
from ..session import fresh_path
from ..sources import files, registers
from .book import book, rounded
from .oracle import cte

QUERIES, ORACLE, query = book()


def token_sql(x: str) -> str:
    return f"trim(regexp_replace(upper(strip_accents(coalesce({x},''))),'[^A-Z0-9]+',' ','g'))"


def title_sql(x: str) -> str:
    return (f"nullif(array_to_string(list_transform(string_split({x},' '), "
            "lambda w: upper(substr(w,1,1))||lower(substr(w,2))),' '),'')")


def street_sql(x: str) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in K.STREET_WORDS.items())
    return (f"array_to_string(list_transform(string_split({token_sql(x)},' '), "
            f"lambda w: CASE w {cases} ELSE w END),' ')")


def subunit_sql(x: str) -> str:
    return f"trim(regexp_replace({token_sql(x)},'^(({'|'.join(K.SUBUNIT_WORDS)})\\b\\s*)+',''))"


def pc_sql(x: str) -> str:
    return f"regexp_replace(upper(strip_accents(coalesce({x},''))),'[\\s-]+','','g')"


cte("raw", """
SELECT l_orderkey||':'||l_linenumber AS record_id,
  CASE l_quantity WHEN 13 THEN 'abc' WHEN 17 THEN '99' WHEN 19 THEN 'NaN'
    ELSE CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS VARCHAR) END AS price,
  CASE l_quantity WHEN 23 THEN 'not a date' WHEN 29 THEN strftime(l_shipdate,'%d/%m/%Y')
    ELSE strftime(l_shipdate,'%Y-%m-%d')||' 00:00' END AS date,
  CASE l_linenumber%3 WHEN 0 THEN lower(h.postcode) WHEN 1 THEN left(h.postcode,length(h.postcode)-3)||' '||right(h.postcode,3)
    ELSE h.postcode END AS postcode,
  CASE p.p_type WHEN 'STANDARD' THEN 'D' WHEN 'PROMO' THEN 'S' WHEN 'ECONOMY' THEN 't' WHEN 'MEDIUM' THEN 'F'
    WHEN 'LARGE' THEN 'H' ELSE 'O' END AS type,
  CASE WHEN l_tax>0.05 THEN 'Y' ELSE 'N' END AS new_build,
  list_extract(['F','L','U','?'],l_suppkey%4+1) AS duration,
  CAST(l_partkey%120+1 AS VARCHAR) AS paon,
  CASE WHEN p.p_type='MEDIUM' THEN CASE WHEN l_linenumber%2=0 THEN 'Flat ' ELSE 'APARTMENT ' END||(l_partkey%9+1) ELSE '' END AS saon,
  CASE WHEN l_linenumber%4=1 THEN translate(p.p_name,'aeo','áéö') ELSE p.p_name END
    ||CASE WHEN l_linenumber%2=0 THEN ' St.' ELSE ' Street' END AS street,
  '' AS locality, 'Town '||(l_partkey%50) AS town, 'DISTRICT '||(l_partkey%100) AS district,
  'county '||(l_partkey%25) AS county,
  CASE l_returnflag WHEN 'R' THEN 'B' WHEN 'A' THEN 'A' ELSE CASE WHEN l_linenumber=1 THEN '' ELSE 'a' END END AS category,
  CASE WHEN l_linenumber=7 AND l_tax=0 THEN 'D' WHEN l_linenumber=6 THEN 'C' ELSE 'A' END AS status
FROM lineitem JOIN part p ON l_partkey=p.p_partkey JOIN homes h ON h.property_id=l_partkey""")

cte("judged", """
SELECT *, CASE WHEN upper(status)='D' THEN 'deleted' WHEN price IN ('abc','NaN') THEN 'price not a number'
  WHEN CAST(price AS DOUBLE)<100 THEN 'price too low'
  WHEN NOT regexp_matches(date,'^\\d{4}-\\d{2}-\\d{2}') THEN 'bad date' END AS problem FROM raw""")

cte("parsed", f"""
SELECT *, {pc_sql('postcode')} AS pc, nullif({token_sql('paon')},'') AS n_paon, nullif({token_sql('saon')},'') AS n_saon,
  nullif({street_sql('street')},'') AS n_street, nullif({token_sql('town')},'') AS n_town
FROM judged WHERE problem IS NULL""")

cte("clean", f"""
SELECT record_id AS source_record_id,
  substr(sha256(pc||'|'||coalesce(n_paon,'')||'|'||{subunit_sql('n_saon')}||'|'||coalesce(n_street,'')||'||'),1,24) AS property_key,
  CAST(price AS DOUBLE) AS price, CAST(left(date,10) AS DATE) AS transaction_date, pc AS postcode_norm,
  left(pc,length(pc)-3)||' '||right(pc,3) AS postcode_pretty, left(pc,length(pc)-3) AS outcode,
  left(pc,length(pc)-3)||' '||substr(pc,length(pc)-2,1) AS sector,
  CASE upper(type) WHEN 'D' THEN 'detached' WHEN 'S' THEN 'semi_detached' WHEN 'T' THEN 'terraced' WHEN 'F' THEN 'flat' ELSE 'other' END AS property_type,
  CASE duration WHEN 'F' THEN 'freehold' WHEN 'L' THEN 'leasehold' ELSE 'unknown' END AS tenure,
  new_build='Y' AS new_build, n_paon AS paon, n_saon AS saon, {title_sql('n_street')} AS street,
  CASE WHEN n_saon IS NOT NULL THEN {title_sql('n_saon')}||', ' ELSE '' END||{title_sql("n_paon||' '||n_street")} AS address_line,
  CAST(NULL AS VARCHAR) AS locality, {title_sql('n_town')} AS town,
  {title_sql(token_sql('district'))} AS district, {title_sql(token_sql('county'))} AS county,
  CASE upper(category) WHEN 'A' THEN 'STANDARD' WHEN 'B' THEN 'ADDITIONAL' ELSE 'UNKNOWN' END AS market_value_basis,
  upper(type) IN ('D','S','T','F') AS is_residential FROM parsed""")


def land_lines(df: DataFrame, path: str, packed: bool = False) -> str:
    """Write register rows as headerless CSV, the way a publisher lands them."""
    out = df.select(*K.REGISTER_COLUMNS).write.option("emptyValue", "")
    (out.option("compression", "gzip") if packed else out).csv(path)
    return path


@query("norm_token", f"SELECT record_id, {token_sql('street')} AS token FROM raw")
def norm_token(spark: SparkSession, sf: str) -> DataFrame:
    return bridge.register_rows(spark, sf).select("record_id", X.norm_token(F.col("street")).alias("token"))


@query("norm_street", f"SELECT record_id, {street_sql('street')} AS street FROM raw")
def norm_street(spark: SparkSession, sf: str) -> DataFrame:
    return bridge.register_rows(spark, sf).select("record_id", X.norm_street(F.col("street")).alias("street"))


@query("norm_subunit", f"SELECT record_id, {subunit_sql('saon')} AS subunit FROM raw")
def norm_subunit(spark: SparkSession, sf: str) -> DataFrame:
    return bridge.register_rows(spark, sf).select("record_id", X.norm_subunit(F.col("saon")).alias("subunit"))


@query("norm_postcode", f"SELECT record_id, {pc_sql('postcode')} AS postcode FROM raw")
def norm_postcode(spark: SparkSession, sf: str) -> DataFrame:
    return bridge.register_rows(spark, sf).select("record_id", X.norm_postcode(F.col("postcode")).alias("postcode"))


@query("postcode_parts", """
SELECT DISTINCT postcode, pc_area AS area, pc_outcode AS outcode,
  pc_outcode||' '||substr(postcode,length(postcode)-2,1) AS sector,
  pc_outcode||' '||right(postcode,3) AS pretty FROM homes
UNION ALL SELECT DISTINCT outcode, '', '', '', CASE WHEN length(outcode)<5 THEN outcode END FROM homes""")
def postcode_parts(spark: SparkSession, sf: str) -> DataFrame:
    homes = bridge.dwellings(spark, sf)
    codes = homes.select("postcode").union(homes.select("outcode")).distinct()
    parts = X.postcode_parts(F.col("postcode"))
    return codes.select("postcode", *[c.alias(n) for n, c in parts.items()],
                        X.pretty_postcode(F.col("postcode")).alias("pretty"))


@query("property_key", "SELECT property_key, count(*) AS records, count(DISTINCT postcode_norm) AS postcodes FROM clean GROUP BY 1")
def property_key(spark: SparkSession, sf: str) -> DataFrame:
    return registers.register_sales(bridge.register_rows(spark, sf)).groupBy("property_key").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("postcode_norm").alias("postcodes"))


@query("display_address", "SELECT DISTINCT property_key, address_line FROM clean")
def display_address(spark: SparkSession, sf: str) -> DataFrame:
    return registers.register_sales(bridge.register_rows(spark, sf)).select("property_key", "address_line").distinct()


@query("code_labels", """SELECT property_type, tenure, market_value_basis, new_build, count(*) AS records
FROM clean GROUP BY ALL""")
def code_labels(spark: SparkSession, sf: str) -> DataFrame:
    return registers.register_sales(bridge.register_rows(spark, sf)).groupBy(
        "property_type", "tenure", "market_value_basis", "new_build").agg(F.count(F.lit(1)).alias("records"))


@query("ppd_reject", "SELECT record_id, price, date, status, coalesce(problem,'kept') AS outcome FROM judged")
def ppd_reject(spark: SparkSession, sf: str) -> DataFrame:
    return bridge.register_rows(spark, sf).select(
        "record_id", "price", "date", "status", F.coalesce(registers.register_problem(), F.lit("kept")).alias("outcome"))


@query("residential_flag", """SELECT source_record_id, property_type, is_residential FROM clean""")
def residential_flag(spark: SparkSession, sf: str) -> DataFrame:
    return registers.register_sales(bridge.register_rows(spark, sf)).select(
        "source_record_id", "property_type", "is_residential")


@query("src_ppd", "SELECT * FROM clean")
def src_ppd(spark: SparkSession, sf: str) -> DataFrame:
    path = land_lines(bridge.register_rows(spark, sf), fresh_path(spark, "register"), packed=True)
    raw, _ = registers.read_register(spark, path)
    return registers.register_sales(raw)


@query("src_ppd_pick", """
SELECT CAST(year(l_shipdate) AS INTEGER) AS file_year, count(*) AS rows_read FROM lineitem
WHERE year(l_shipdate) IN (1996,1997,1998) GROUP BY 1""")
def src_ppd_pick(spark: SparkSession, sf: str) -> DataFrame:
    folder = fresh_path(spark, "landed")
    li = bridge.table(spark, sf, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("record_id"), F.year("l_shipdate").alias("_y"))
    blank = [F.lit("").alias(c) for c in K.REGISTER_COLUMNS[1:]]
    rows = li.select("record_id", *blank, "_y")
    for year, forms in ((1996, (False, True)), (1997, (True,)), (1998, (False,)), (1999, (False,))):
        for packed in forms:
            land_lines(rows.where(F.col("_y") == year), f"{folder}/pp-{year}.csv" + (".gz" if packed else ""), packed)
    paths = files.pick_register_files(files.matching(spark, folder + "/pp-*.csv*"), [1996, 1997, 1998])
    year = F.regexp_extract(F.col("_metadata.file_path"), r"pp-(\d{4})\.csv", 1).cast("int")
    plain = spark.read.schema("record_id string").csv(paths, header=False)
    return plain.groupBy(year.alias("file_year")).agg(F.count(F.lit(1)).alias("rows_read"))


# --- transfer files ----------------------------------------------------------

cte("transfers_raw", """
SELECT CAST(l_orderkey AS VARCHAR) AS id_mutation, 'P'||l_partkey AS id_parcelle,
  CASE l_quantity WHEN 23 THEN '' ELSE strftime(l_shipdate,'%Y-%m-%d') END AS date_mutation,
  CASE WHEN l_linenumber=7 THEN 'Echange' ELSE 'Vente' END AS nature_mutation,
  CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS VARCHAR) AS valeur_fonciere,
  CASE l_suppkey%5 WHEN 0 THEN 'Maison' WHEN 1 THEN 'Appartement' WHEN 2 THEN 'Dépendance' WHEN 3 THEN 'Maison'
    ELSE CASE WHEN l_linenumber=5 THEN 'Local industriel. commercial ou assimilé' ELSE '' END END AS type_local,
  CAST(CAST(l_quantity*4 AS DECIMAL(10,2)) AS VARCHAR) AS surface_reelle_bati,
  CAST(l_linenumber AS VARCHAR) AS nombre_pieces_principales, '' AS surface_terrain,
  CAST(l_partkey%90 AS VARCHAR) AS adresse_numero, 'av. des '||h.p_name AS adresse_nom_voie,
  lpad(CAST(l_partkey%95*1000 AS VARCHAR),5,'0') AS code_postal, 'commune '||(l_partkey%60) AS nom_commune,
  lpad(CAST(l_partkey%95 AS VARCHAR),2,'0') AS code_departement,
  CASE WHEN l_discount=0 THEN '' ELSE CAST(CAST(h.lon AS DECIMAL(9,4)) AS VARCHAR) END AS longitude,
  CAST(CAST(h.lat AS DECIMAL(9,4)) AS VARCHAR) AS latitude
FROM lineitem JOIN homes h ON h.property_id=l_partkey""")

cte("transfers", f"""
SELECT id_mutation, id_parcelle, CAST(date_mutation AS DATE) AS transaction_date, CAST(valeur_fonciere AS DOUBLE) AS price,
  CASE type_local WHEN 'Maison' THEN 'house' WHEN 'Appartement' THEN 'flat' END AS property_type,
  CAST(surface_reelle_bati AS DOUBLE) AS floor_area, CAST(nombre_pieces_principales AS INTEGER) AS rooms,
  CAST(NULL AS DOUBLE) AS lot_area, adresse_numero AS paon, {title_sql(street_sql('adresse_nom_voie'))} AS street,
  code_postal AS postcode_norm, {title_sql(token_sql('nom_commune'))} AS district, code_departement AS county,
  CAST(nullif(longitude,'') AS DOUBLE) AS lon, CAST(latitude AS DOUBLE) AS lat,
  type_local='Local industriel. commercial ou assimilé' AS is_commercial
FROM transfers_raw WHERE nature_mutation='Vente' AND date_mutation<>''""")

cte("single_transfers", """
SELECT id_mutation FROM transfers GROUP BY 1 HAVING count(property_type)=1 AND NOT bool_or(is_commercial)""")
cte("clean_transfers", """
SELECT t.* FROM transfers t JOIN single_transfers USING (id_mutation)
WHERE property_type IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND price>=5000 AND floor_area>=8
  AND price/floor_area BETWEEN 150 AND 60000""")


def transfer_rows(spark: SparkSession, sf: str) -> DataFrame:
    li, homes = bridge.table(spark, sf, "lineitem"), bridge.dwellings(spark, sf).select("property_id", "p_name", "lat", "lon")
    k, ln = F.col("l_partkey"), F.col("l_linenumber")
    kind = (F.when(F.col("l_suppkey") % 5 == 0, "Maison").when(F.col("l_suppkey") % 5 == 1, "Appartement")
            .when(F.col("l_suppkey") % 5 == 2, "Dépendance").when(F.col("l_suppkey") % 5 == 3, "Maison")
            .when(ln == 5, K.TRANSFER_COMMERCIAL[0]).otherwise(""))
    return li.join(homes, li["l_partkey"] == homes["property_id"]).select(
        F.col("l_orderkey").cast("string").alias("id_mutation"), F.concat(F.lit("P"), k.cast("string")).alias("id_parcelle"),
        F.when(F.col("l_quantity") == 23, "").otherwise(F.to_date("l_shipdate").cast("string")).alias("date_mutation"),
        F.when(ln == 7, "Echange").otherwise("Vente").alias("nature_mutation"),
        F.col("l_extendedprice").cast("decimal(14,2)").cast("string").alias("valeur_fonciere"), kind.alias("type_local"),
        (F.col("l_quantity") * 4).cast("decimal(10,2)").cast("string").alias("surface_reelle_bati"),
        ln.cast("string").alias("nombre_pieces_principales"), F.lit("").alias("surface_terrain"),
        (k % 90).cast("string").alias("adresse_numero"), F.concat(F.lit("av. des "), "p_name").alias("adresse_nom_voie"),
        F.lpad((k % 95 * 1000).cast("string"), 5, "0").alias("code_postal"),
        F.concat(F.lit("commune "), (k % 60).cast("string")).alias("nom_commune"),
        F.lpad((k % 95).cast("string"), 2, "0").alias("code_departement"),
        F.when(F.col("l_discount") == 0, "").otherwise(F.col("lon").cast("decimal(9,4)").cast("string")).alias("longitude"),
        F.col("lat").cast("decimal(9,4)").cast("string").alias("latitude"))


def landed_transfers(spark: SparkSession, sf: str, departments=None) -> DataFrame:
    path = fresh_path(spark, "transfers")
    transfer_rows(spark, sf).write.option("compression", "gzip").option("emptyValue", "").csv(path, header=True)
    return registers.read_transfers(spark, path, departments)


@query("src_dvf", "SELECT * FROM transfers WHERE county IN ('01','13','69','75')")
def src_dvf(spark: SparkSession, sf: str) -> DataFrame:
    return landed_transfers(spark, sf, ["01", "13", "69", "75"])


@query("dvf_filter", """SELECT property_type, is_commercial, count(*) AS records,
  min(transaction_date) AS first_sold, max(transaction_date) AS last_sold FROM transfers GROUP BY ALL""")
def dvf_filter(spark: SparkSession, sf: str) -> DataFrame:
    return landed_transfers(spark, sf).groupBy("property_type", "is_commercial").agg(
        F.count(F.lit(1)).alias("records"), F.min("transaction_date").alias("first_sold"),
        F.max("transaction_date").alias("last_sold"))


@query("dvf_bounds", "SELECT id_mutation, id_parcelle, price, floor_area FROM clean_transfers")
def dvf_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return registers.clean_transfers(landed_transfers(spark, sf)).select("id_mutation", "id_parcelle", "price", "floor_area")


@query("agg_mutation", """SELECT id_mutation, count(property_type) AS dwellings, bool_or(is_commercial) AS commercial
FROM transfers GROUP BY 1""")
def agg_mutation(spark: SparkSession, sf: str) -> DataFrame:
    return landed_transfers(spark, sf).groupBy("id_mutation").agg(
        F.count("property_type").alias("dwellings"), F.bool_or("is_commercial").alias("commercial"))


@query("join_mutation", "SELECT * FROM clean_transfers")
def join_mutation(spark: SparkSession, sf: str) -> DataFrame:
    return registers.clean_transfers(landed_transfers(spark, sf))


@query("property_key_parcel", """
SELECT DISTINCT md5(id_parcelle||'|'||coalesce(property_type,'')||'|'||CAST(CAST(floor_area AS BIGINT) AS VARCHAR)||'|'||rooms) AS property_key,
  id_parcelle FROM clean_transfers""")
def property_key_parcel(spark: SparkSession, sf: str) -> DataFrame:
    rows = registers.clean_transfers(landed_transfers(spark, sf))
    return rows.select(X.parcel_key(F.col("id_parcelle"), F.col("property_type"), F.col("floor_area").cast("long"),
                                    F.col("rooms")).alias("property_key"), "id_parcelle").distinct()


# --- gazetteer ---------------------------------------------------------------

cte("gazetteer_raw", """
SELECT postcode, pc_area AS area, pc_outcode AS outcode, pc_outcode||' '||substr(postcode,length(postcode)-2,1) AS sector,
  CAST(sum(CAST(round(lat*10000) AS BIGINT)) AS DOUBLE)/count(*)/10000 AS lat,
  CAST(sum(CAST(round(lon*10000) AS BIGINT)) AS DOUBLE)/count(*)/10000 AS lon,
  count(*) AS homes_here, min(property_id) AS first_home FROM homes GROUP BY ALL""")
cte("gazetteer", """
SELECT postcode, left(postcode,length(postcode)-3)||' '||right(postcode,3) AS postcode_pretty,
  CASE WHEN first_home%7=0 THEN 'terminated' ELSE 'live' END AS status,
  CAST(CASE WHEN first_home%10=0 THEN 9 ELSE first_home%9+1 END AS INTEGER) AS quality, lat, lon, area, outcode, sector,
  CASE WHEN (CASE WHEN first_home%10=0 THEN 9 ELSE first_home%9+1 END)<=6 THEN 'POSTCODE' ELSE 'NEIGHBOURHOOD' END AS precision,
  CASE WHEN area='BT' THEN 'Northern Ireland' WHEN area IN ('EH','G') THEN 'Scotland' WHEN area IN ('CF','LL') THEN 'Wales'
    ELSE 'England' END AS uk_country
FROM gazetteer_raw WHERE first_home%11<>0""")


def gazetteer_rows(spark: SparkSession, sf: str) -> DataFrame:
    homes = bridge.dwellings(spark, sf)

    def mean(c):
        return F.sum(F.round(F.col(c) * 10000).cast("long")).cast("double") / F.count(F.lit(1)) / 10000
    pc, first = F.col("postcode"), F.col("first_home")
    return homes.groupBy("postcode", "pc_area", "pc_outcode").agg(
        mean("lat").alias("lat"), mean("lon").alias("lon"), F.min("property_id").alias("first_home")).select(
        F.lower(X.pretty_postcode(pc)).alias("c0"), F.when(first % 7 == 0, "terminated").otherwise("live").alias("c1"),
        F.lit("small").alias("c2"), F.lit("0").alias("c3"), F.lit("0").alias("c4"),
        F.when(first % 10 == 0, "").otherwise((first % 9 + 1).cast("string")).alias("c5"), F.lit("uk").alias("c6"),
        F.when(first % 11 == 0, "95.0").otherwise(F.col("lat").cast("string")).alias("c7"), F.col("lon").cast("string").alias("c8"),
        F.lower(pc).alias("c9"), F.lit("").alias("c10"), F.lit("").alias("c11"), F.col("pc_area").alias("c12"),
        F.col("pc_outcode").alias("c13"),
        F.concat("pc_outcode", F.lit(" "), F.substring(pc, -3, 1)).alias("c14"))


def gazetteer(spark: SparkSession, sf: str) -> DataFrame:
    """The gazetteer as the register reader yields it, without landing a file."""
    g = gazetteer_rows(spark, sf).where("c7 <> '95.0'")
    quality = F.when(F.col("c5") == "", 9).otherwise(F.col("c5").try_cast("int"))
    return g.select(F.upper("c9").alias("postcode"), F.upper("c0").alias("postcode_pretty"), F.col("c1").alias("status"),
                    quality.alias("quality"), F.col("c7").cast("double").alias("lat"), F.col("c8").cast("double").alias("lon"),
                    F.col("c12").alias("area"), F.col("c13").alias("outcode"), F.col("c14").alias("sector")).withColumns(
        {"precision": registers.position_precision(F.col("quality")), "uk_country": registers.uk_country(F.col("area"))})


@query("src_postcodes", "SELECT postcode, postcode_pretty, status, quality, round(lat,6) AS lat, round(lon,6) AS lon, area, outcode, sector FROM gazetteer")
def src_postcodes(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "gazetteer")
    gazetteer_rows(spark, sf).write.option("emptyValue", "").csv(path)
    return rounded(registers.read_gazetteer(spark, path), 6)


@query("precision_quality", "SELECT postcode, quality, precision FROM gazetteer")
def precision_quality(spark: SparkSession, sf: str) -> DataFrame:
    return gazetteer(spark, sf).select("postcode", "quality", "precision")


@query("uk_country", "SELECT uk_country, area, count(*) AS postcodes FROM gazetteer GROUP BY ALL")
def uk_country(spark: SparkSession, sf: str) -> DataFrame:
    return gazetteer(spark, sf).groupBy("uk_country", "area").agg(F.count(F.lit(1)).alias("postcodes"))


@query("join_geocode", """
SELECT c.source_record_id, c.property_key, c.postcode_norm, g.precision, round(g.lat,6) AS lat, round(g.lon,6) AS lon
FROM clean c LEFT JOIN gazetteer g ON g.postcode=c.postcode_norm""")
def join_geocode(spark: SparkSession, sf: str) -> DataFrame:
    sales = registers.register_sales(bridge.register_rows(spark, sf)).select("source_record_id", "property_key", "postcode_norm")
    places = gazetteer(spark, sf).select(F.col("postcode").alias("postcode_norm"), "precision", "lat", "lon")
    return rounded(sales.join(places, "postcode_norm", "left"), 6)
