"""Queries on stored tables: merges, ledgers, exports, incremental loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bridge
from ..operators import area_state as AS
from ..operators import area_stats as A
from ..operators import ledger as L
from ..operators import loading as LD
from ..operators import upsert as U
from ..session import cut_lineage, fresh_path
from ..sources import registers
from ..streaming import incremental
from .book import book, rounded
from .oracle import cte
from .q_register import gazetteer, land_lines, transfer_rows

QUERIES, ORACLE, query = book()

cte("coverage", """
SELECT 'register' AS provider_key, r_name AS country, CAST(NULL AS VARCHAR) AS region_code, r_name AS region_name, r_regionkey<>4 AS transaction_level,
  r_regionkey<>4 AS characteristics, r_regionkey<>4 AS market_index, r_regionkey<>4 AS forecast_supported,
  CASE WHEN r_regionkey=4 THEN 'NONE' ELSE 'EXACT_TRANSACTION' END AS max_precision,
  CASE WHEN r_regionkey<>4 THEN 'POSTCODE' END AS coordinate_precision, 'GBP' AS currency,
  CASE WHEN r_regionkey=4 THEN 'No prices for '||r_name END AS notes FROM region
UNION ALL SELECT 'register', r_name, n_name, n_name, false, false, false, false, 'NONE', NULL, 'GBP', 'No prices for '||n_name
FROM nation JOIN region ON n_regionkey=r_regionkey WHERE n_nationkey%6=0""")

SALE_COLUMNS = ["source_record_id", "transaction_date", "price", "property_id", "supplier_id", "sale_area", "property_type",
                "market_value_basis", "lat"]
_ORDER = "transaction_date DESC, price DESC, property_id DESC, supplier_id DESC, sale_area DESC"


def sale_order() -> list:
    return [F.col(c).desc() for c in ("transaction_date", "price", "property_id", "supplier_id", "sale_area")]


def sale_rows(spark: SparkSession, sf: str) -> DataFrame:
    return bridge.sales(spark, sf).select(*SALE_COLUMNS, "year")


@query("win_distinct_on", f"""
SELECT source_record_id, transaction_date, price, property_id, supplier_id, sale_area FROM sales
QUALIFY row_number() OVER (PARTITION BY source_record_id ORDER BY {_ORDER})=1""")
def win_distinct_on(spark: SparkSession, sf: str) -> DataFrame:
    return U.latest(sale_rows(spark, sf), ["source_record_id"], sale_order()).select(
        "source_record_id", "transaction_date", "price", "property_id", "supplier_id", "sale_area")


# A first load up to 1998, then an overlapping one from 1998 on that wins; the point of the
# second load is missing for some rows and must not erase the stored one.
cte("first_load", f"SELECT * FROM sales WHERE year<=1998 QUALIFY row_number() OVER (PARTITION BY source_record_id ORDER BY {_ORDER})=1")
cte("second_load", f"SELECT * REPLACE (CASE WHEN sale_area>=10 THEN lat END AS lat) FROM sales WHERE year>=1998 QUALIFY row_number() OVER (PARTITION BY source_record_id ORDER BY {_ORDER})=1")
cte("merged_sales", """
SELECT coalesce(b.source_record_id,a.source_record_id) AS source_record_id, coalesce(b.transaction_date,a.transaction_date) AS transaction_date,
  coalesce(b.price,a.price) AS price, coalesce(b.property_id,a.property_id) AS property_id, coalesce(b.property_type,a.property_type) AS property_type,
  coalesce(b.market_value_basis,a.market_value_basis) AS market_value_basis, coalesce(b.lat,a.lat) AS lat
FROM first_load a FULL JOIN second_load b ON a.source_record_id=b.source_record_id""")


@query("sink_upsert_txn", "SELECT * FROM merged_sales")
def sink_upsert_txn(spark: SparkSession, sf: str) -> DataFrame:
    path, keys = fresh_path(spark, "transactions"), ["source_record_id"]
    rows = sale_rows(spark, sf)
    second = rows.where("year >= 1998").withColumn("lat", F.when(F.col("sale_area") >= 10, F.col("lat")))
    for batch in (rows.where("year <= 1998"), second, second):
        one = U.latest(batch, keys, sale_order()).drop("year", "supplier_id", "sale_area")
        U.upsert_into(path, one, keys, {"lat": "new_or_old"})
    return U.read_table(spark, path)


cte("dwelling_loads", """
SELECT * FROM (SELECT *, CASE WHEN transaction_date<DATE '1998-06-01' THEN 1 ELSE 2 END AS load FROM clean)""")
cte("dwelling_latest", """
SELECT property_key, load, max(property_type) AS property_type, min(transaction_date) AS first_seen, max(transaction_date) AS last_seen,
  max_by(address_line, (transaction_date, price, tenure, source_record_id, address_line)) AS address_line,
  max_by(tenure, (transaction_date, price, tenure, source_record_id, address_line)) AS tenure,
  CASE load WHEN 1 THEN 'feed' ELSE 'register' END AS source FROM dwelling_loads GROUP BY property_key, load""")


@query("sink_upsert_property", """
SELECT property_key, arg_min(address_line,load) AS address_line, arg_max(property_type,load) AS property_type, arg_max(tenure,load) AS tenure,
  min(first_seen) AS first_seen, max(last_seen) AS last_seen, string_agg(source,',' ORDER BY source) AS source_keys
FROM dwelling_latest GROUP BY 1""")
def sink_upsert_property(spark: SparkSession, sf: str) -> DataFrame:
    path, keys = fresh_path(spark, "properties"), ["property_key"]
    rows = registers.register_sales(bridge.register_rows(spark, sf))
    early = F.col("transaction_date") < F.lit("1998-06-01").cast("date")
    order = F.struct("transaction_date", "price", "tenure", "source_record_id", "address_line")
    for batch, source in ((rows.where(early), "feed"), (rows.where(~early), "register"), (rows.where(~early), "register")):
        seen = batch.groupBy("property_key").agg(
            F.max_by("address_line", order).alias("address_line"), F.max("property_type").alias("property_type"),
            F.max_by("tenure", order).alias("tenure"), F.min("transaction_date").alias("first_seen"),
            F.max("transaction_date").alias("last_seen")).withColumn("source_keys", F.array(F.lit(source)))
        U.upsert_into(path, seen, keys, {"address_line": "old_or_new", "property_type": "new_or_old", "tenure": "new_or_old",
                                         "first_seen": "min", "last_seen": "max", "source_keys": "union"})
    return U.read_table(spark, path).withColumn("source_keys", F.array_join("source_keys", ","))


@query("agg_array_union", """
SELECT property_id, string_agg(DISTINCT basis,',' ORDER BY basis) AS source_keys FROM
  (SELECT property_id, market_value_basis AS basis FROM sales UNION SELECT property_id, property_type FROM sales) GROUP BY 1""")
def agg_array_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = bridge.sales(spark, sf).select("property_id", F.array("market_value_basis", "property_type").alias("source_keys"))
    merged = U.upsert_rows(None, rows, ["property_id"], {"source_keys": "union"})
    return merged.withColumn("source_keys", F.array_join("source_keys", ","))


@query("win_first_last_seen", """
SELECT sale_key, property_id, min(transaction_date) OVER (PARTITION BY property_id) AS first_seen,
  max(transaction_date) OVER (PARTITION BY property_id) AS last_seen FROM sales""")
def win_first_last_seen(spark: SparkSession, sf: str) -> DataFrame:
    sales = bridge.sales(spark, sf).select("sale_key", "property_id", "transaction_date")
    # an aggregate joined back spreads a dwelling with very many sales, a window would not
    seen = sales.groupBy("property_id").agg(F.min("transaction_date").alias("first_seen"), F.max("transaction_date").alias("last_seen"))
    return sales.drop("transaction_date").join(seen, "property_id")


@query("join_property", """
SELECT c.source_record_id, c.transaction_date, c.price, p.property_id FROM clean c
JOIN (SELECT property_key, min(source_record_id) AS property_id FROM clean WHERE is_residential GROUP BY 1) p ON p.property_key=c.property_key""")
def join_property(spark: SparkSession, sf: str) -> DataFrame:
    rows = registers.register_sales(bridge.register_rows(spark, sf))
    homes = rows.where("is_residential").groupBy("property_key").agg(F.min("source_record_id").alias("property_id"))
    return rows.join(homes, "property_key").select("source_record_id", "transaction_date", "price", "property_id")


cte("idx_quarters", "SELECT country, 'IX-'||county AS area_code, segment, period, index_value, sales_volume FROM ppsm_index")


@query("sink_upsert_index", """
SELECT area_code, segment, period, round(CASE WHEN year(period)>=1999 THEN index_value+1 ELSE index_value END,6) AS index_value,
  CASE WHEN year(period)>=1999 THEN 'revised' ELSE 'first' END AS vintage FROM idx_quarters""")
def sink_upsert_index(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.published import quarterly_index
    path, keys = fresh_path(spark, "indices"), ["area_code", "segment", "period"]
    rows = quarterly_index(bridge.sales(spark, sf)).select(
        F.concat(F.lit("IX-"), "county").alias("area_code"), "segment", "period", "index_value", F.lit("first").alias("vintage"))
    revised = rows.where(F.year("period") >= 1999).withColumns({"index_value": F.col("index_value") + 1, "vintage": F.lit("revised")})
    for batch in (rows, revised):
        U.upsert_into(path, batch, keys)
    return rounded(U.read_table(spark, path), 6)


@query("sink_upsert_area", """
SELECT country, area_level, area_code, segment, year, transaction_count, round(median_price,8) AS median_price FROM area_stats""")
def sink_upsert_area(spark: SparkSession, sf: str) -> DataFrame:
    path, columns = fresh_path(spark, "area-stats"), [*A.AREA_KEYS, "transaction_count", "median_price"]
    sales = bridge.sales(spark, sf)
    for part in (sales.where("year <= 1998"), sales.where("year >= 1998")):
        U.upsert_into(path, A.agg_area_stats(part).select(*columns), A.AREA_KEYS)
    return rounded(U.read_table(spark, path), 8)


@query("sink_insert_ignore", """
SELECT district, min(county) AS county, 'kept' AS origin FROM sales WHERE year=1995 GROUP BY 1
UNION ALL SELECT district, max(outcode), 'added' FROM sales WHERE district NOT IN (SELECT district FROM sales WHERE year=1995) GROUP BY 1""")
def sink_insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    sales, path = bridge.sales(spark, sf), fresh_path(spark, "districts")
    first = sales.where("year = 1995").groupBy("district").agg(F.min("county").alias("county")).withColumn("origin", F.lit("kept"))
    more = sales.groupBy("district").agg(F.max("outcode").alias("county")).withColumn("origin", F.lit("added"))
    for batch in (first, more, more):
        U.insert_into(path, batch, ["district"])
    return U.read_table(spark, path)


@query("sink_upsert_ref", """
SELECT provider_key, country, region_code, max_precision, CASE WHEN region_code IS NULL THEN 'updated' ELSE notes END AS notes FROM coverage""")
def sink_upsert_ref(spark: SparkSession, sf: str) -> DataFrame:
    path, keys = fresh_path(spark, "coverage"), ["provider_key", "country", "region_code"]
    rows = bridge.coverage(spark, sf).select(*keys, "max_precision", "notes")
    for batch in (rows, rows.where("region_code IS NULL").withColumn("notes", F.lit("updated"))):
        U.upsert_into(path, batch, keys)
    return U.read_table(spark, path)


cte("units", """
SELECT 'register' AS source_key, strftime(transaction_date,'%Y-%m') AS unit, count(*)||':'||count(DISTINCT property_id) AS signature,
  min(month(transaction_date)) AS m FROM sales GROUP BY 2""")


def landed_units(spark: SparkSession, sf: str) -> DataFrame:
    months = bridge.sales(spark, sf, by_home=True).groupBy(F.trunc("transaction_date", "month").alias("first")).agg(
        F.concat_ws(":", F.count(F.lit(1)), F.countDistinct("property_id")).alias("signature"))
    return months.select(F.date_format("first", "yyyy-MM").alias("unit"), "signature", F.month("first").alias("m"), F.lit("register").alias("source_key"))


@query("sink_ledger", "SELECT source_key, unit, signature FROM units WHERE m%2<>0 OR m%3=0")
def sink_ledger(spark: SparkSession, sf: str) -> DataFrame:
    units = cut_lineage(landed_units(spark, sf))
    ledger = units.where("m % 2 = 0").select(
        "source_key", "unit", F.when(F.col("m") % 3 == 0, "stale").otherwise(F.col("signature")).alias("signature"), F.lit("complete").alias("status"))
    path = fresh_path(spark, "ledger")
    ledger.write.parquet(path)
    return L.pending_units(units.drop("m"), spark.read.parquet(path)).select("source_key", "unit", "signature")


@query("agg_rowcounts", """
SELECT 'register' AS source_key, paon AS unit, CASE WHEN count_if(problem IS NULL)>0 THEN 'complete' ELSE 'failed' END AS status,
  count(*) AS rows_read, count_if(problem IS NULL)::BIGINT AS rows_written, count_if(problem IS NOT NULL)::BIGINT AS rows_rejected FROM judged GROUP BY paon""")
def agg_rowcounts(spark: SparkSession, sf: str) -> DataFrame:
    judged = bridge.register_rows(spark, sf).withColumn("problem", registers.register_problem())
    return L.run_rows(L.load_counts(judged, "paon", "problem"), "register", "paon")


@query("sink_source_mark", "SELECT market_value_basis AS source_key, max(transaction_date) AS last_record, count(*) AS record_count FROM sales GROUP BY 1")
def sink_source_mark(spark: SparkSession, sf: str) -> DataFrame:
    rows, path = bridge.sales(spark, sf).withColumn("source_key", F.col("market_value_basis")), fresh_path(spark, "sources")
    for part in (rows.where("source_key = 'ADDITIONAL'"), rows.where("source_key = 'STANDARD' AND year < 1999"), rows.where("source_key = 'STANDARD'")):
        L.mark_sources(path, part)
    return U.read_table(spark, path)


@query("sink_export", f"""
SELECT 'provider_coverage' AS table_name, country||'/'||coalesce(region_code,'') AS item,
  CASE WHEN transaction_level THEN 'CITY_REGIONAL' ELSE max_precision END AS detail,
  CASE WHEN transaction_level THEN coalesce(notes||' ','')||'{L.K.EXPORT_NOTE}' ELSE notes END AS notes FROM coverage
UNION ALL SELECT 'area_stats', area_level, CAST(count(*) AS VARCHAR), NULL FROM area_stats WHERE area_level<>'sector' GROUP BY area_level
UNION ALL SELECT 'market_indices', 'points', CAST(count(*) AS VARCHAR), NULL FROM idx_quarters WHERE period>=DATE '1995-01-01'""")
def sink_export(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.published import quarterly_index
    sales = bridge.sales(spark, sf)
    paths = L.export({"provider_coverage": bridge.coverage(spark, sf), "area_stats": A.agg_area_stats(sales),
                      "market_indices": quarterly_index(sales)}, "lean", fresh_path(spark, "export"))
    cov = spark.read.parquet(paths["provider_coverage"]).select(
        F.lit("provider_coverage").alias("table_name"), F.concat("country", F.lit("/"), F.coalesce("region_code", F.lit(""))).alias("item"),
        F.col("max_precision").alias("detail"), "notes")
    none = F.lit(None).cast("string").alias("notes")
    stats = spark.read.parquet(paths["area_stats"]).groupBy("area_level").agg(F.count(F.lit(1)).cast("string").alias("detail")).select(
        F.lit("area_stats").alias("table_name"), F.col("area_level").alias("item"), "detail", none)
    idx = spark.read.parquet(paths["market_indices"]).agg(F.count(F.lit(1)).cast("string").alias("detail")).select(
        F.lit("market_indices").alias("table_name"), F.lit("points").alias("item"), "detail", none)
    return cov.unionByName(stats).unionByName(idx)


@query("src_tables", "SELECT property_id, count(*) AS sale_count, max(transaction_date) AS last_sale FROM sales WHERE year=1999 GROUP BY 1")
def src_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A stored table read back with partition and column pruning."""
    path = fresh_path(spark, "stored-sales")
    bridge.sales(spark, sf).select("property_id", "transaction_date", "country", "year", "price").write.partitionBy("country", "year").parquet(path)
    return spark.read.parquet(path).where("year = 1999").groupBy("property_id").agg(
        F.count(F.lit(1)).alias("sale_count"), F.max("transaction_date").alias("last_sale"))


@query("set_dedupe_points", """
SELECT round(lat,2) AS lat2, round(lon,2) AS lon2, min(property_id) AS property_id FROM homes GROUP BY 1,2""")
def set_dedupe_points(spark: SparkSession, sf: str) -> DataFrame:
    """Results at the same rounded position are one result: the first wins."""
    homes = bridge.dwellings(spark, sf)
    return homes.groupBy(F.round("lat", 2).alias("lat2"), F.round("lon", 2).alias("lon2")).agg(F.min("property_id").alias("property_id"))


# --- incremental -------------------------------------------------------------
_CLEAN_ORDER = ("transaction_date DESC NULLS LAST, address_line DESC NULLS LAST, county DESC NULLS LAST, district DESC NULLS LAST, is_residential DESC NULLS LAST, "
                "locality DESC NULLS LAST, market_value_basis DESC NULLS LAST, new_build DESC NULLS LAST, outcode DESC NULLS LAST, paon DESC NULLS LAST, postcode_norm DESC NULLS LAST, "
                "postcode_pretty DESC NULLS LAST, price DESC NULLS LAST, property_key DESC NULLS LAST, property_type DESC NULLS LAST, saon DESC NULLS LAST, sector DESC NULLS LAST, "
                "street DESC NULLS LAST, tenure DESC NULLS LAST, town DESC NULLS LAST")


@query("inc_files", f"""
WITH waves AS (SELECT *, CASE WHEN CAST(paon AS INTEGER)%2=0 THEN 2 ELSE 1 END AS wave FROM clean)
SELECT source_record_id, transaction_date, price, property_key, property_type, market_value_basis FROM waves
QUALIFY row_number() OVER (PARTITION BY source_record_id ORDER BY wave DESC, {_CLEAN_ORDER})=1""")
def inc_files(spark: SparkSession, sf: str) -> DataFrame:
    folder, table, progress = (fresh_path(spark, n) for n in ("landing", "stream-sales", "progress"))
    rows = bridge.register_rows(spark, sf)
    even = F.col("paon").cast("int") % 2 == 0
    # rows with too few fields are rejected like the batch reader does
    spark.createDataFrame([("short1,250000,1999-04-01 00:00,AB1 2CD,D,N,F,1,,STREET",), ("short2,250000",)], "line string").write.text(f"{folder}/wave=9")
    for wave, part in enumerate((rows.where(~even), rows.where(even))):
        land_lines(part, f"{folder}/wave={wave}")
        incremental.load_landed_files(spark, f"{folder}/wave=*", table, progress, "register")
    incremental.load_landed_files(spark, f"{folder}/wave=*", table, progress, "register")  # nothing new
    return U.read_table(spark, table).select("source_record_id", "transaction_date", "price", "property_key", "property_type", "market_value_basis")


@query("inc_area", """
SELECT country, area_level, area_code, segment, year, transaction_count, round(median_price,8) AS median_price, mean_price FROM area_stats""")
def inc_area(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches after a first load: late sales, then corrected versions of sales that had a wrong price, year and district."""
    sales, state = bridge.sales(spark, sf), fresh_path(spark, "area-state")
    late = (F.col("year") == 2001) | ((F.col("year") == 1999) & (F.col("sale_area") == 7))
    wrong = (F.col("year") == 1998) & (F.col("sale_area") == 9)
    right = sales.where(wrong)
    first_told = right.withColumns({"price": F.col("price") * 2, "year": F.lit(1996), "district": F.lit("D0")})
    begun = sales.where(~late & ~wrong).unionByName(first_told)
    AS.start(state, begun)
    stored = cut_lineage(A.agg_area_stats(begun))
    stored = cut_lineage(AS.refreshed(stored, state, cut_lineage(AS.add(state, sales.where(late)))))
    fresh = AS.refreshed(stored, state, cut_lineage(AS.add(state, right, first_told)))
    return rounded(fresh.select(*A.AREA_KEYS, "transaction_count", "median_price", "mean_price"), 8, ["mean_price"])


# --- loads -------------------------------------------------------------------
cte("gb_waves", "SELECT *, CASE WHEN CAST(paon AS INTEGER)%2=0 THEN 2 ELSE 1 END AS wave FROM clean")
cte("gb_latest", f"""
SELECT s.*, g.lat, g.lon FROM (SELECT * FROM gb_waves QUALIFY row_number() OVER (PARTITION BY source_record_id, wave ORDER BY {_CLEAN_ORDER})=1) s
LEFT JOIN gazetteer g ON g.postcode=s.postcode_norm""")
cte("gb_loaded", """
SELECT 'GB' AS country, CAST(year(transaction_date) AS INTEGER) AS year, * EXCLUDE (lat, lon), lat, lon FROM (
  SELECT b.* EXCLUDE (lat, lon), coalesce(b.lat,a.lat) AS lat, coalesce(b.lon,a.lon) AS lon
  FROM gb_latest b LEFT JOIN gb_latest a ON a.source_record_id=b.source_record_id AND a.wave=1 WHERE b.wave=2
  UNION ALL SELECT * FROM gb_latest a WHERE wave=1 AND source_record_id NOT IN (SELECT source_record_id FROM gb_latest WHERE wave=2))
WHERE market_value_basis='STANDARD' AND is_residential AND lat IS NOT NULL""")
cte("fr_loaded", """
SELECT 'FR' AS country, CAST(year(transaction_date) AS INTEGER) AS year, property_type, price, floor_area, county, district
FROM clean_transfers QUALIFY row_number() OVER (PARTITION BY id_mutation, id_parcelle ORDER BY transaction_date DESC, price DESC, floor_area DESC)=1""")


def _levels_sql(source: str, levels: list[str]) -> str:
    own = f"SELECT *, unnest(['all', property_type]) AS segment FROM {source}"
    return " UNION ALL ".join(f"SELECT country, '{a}' AS area_level, {a} AS area_code, segment, year, price FROM ({own})" for a in levels)


def _loaded_stats(source: str, levels: list[str]) -> str:
    least = " ".join(f"WHEN '{a}' THEN {A.K.LEVEL_MIN_SALES[a]}" for a in levels)
    return f"""SELECT country, area_level, area_code, segment, year, count(*) AS transaction_count, round(median(price),8) AS median_price,
  CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE)/count(*) AS mean_price FROM ({_levels_sql(source, levels)})
WHERE area_code IS NOT NULL GROUP BY ALL HAVING count(*)>=CASE area_level {least} END"""


def loaded_store(spark: SparkSession, sf: str) -> str:
    """Both countries loaded: two overlapping waves of the register, the second landed twice, transfers."""
    store, landing = fresh_path(spark, "store"), fresh_path(spark, "landing")
    rows = cut_lineage(bridge.register_rows(spark, sf))
    even = F.col("paon").cast("int") % 2 == 0
    land_lines(rows.where(~even), f"{landing}/wave-1")
    land_lines(rows.where(even), f"{landing}/wave-2", packed=True)
    spark.createDataFrame([("short1,250000,1999-04-01 00:00,AB1 2CD,D,N,F,1,,STREET",), ("short2,250000",)], "line string").coalesce(1).write.mode("append").text(f"{landing}/wave-1")
    transfer_rows(spark, sf).write.option("compression", "gzip").option("emptyValue", "").csv(f"{landing}/transfers", header=True)
    places = cut_lineage(gazetteer(spark, sf))

    def register(unit: str):
        return lambda: LD.load_register(spark, f"{landing}/{unit}", store, unit, "register", "GB", places)
    LD.load_all([register("wave-1"), register("wave-2"), register("wave-2"), lambda: LD.load_transfers(spark, f"{landing}/transfers", store, "transfers", "transfers", "FR")])
    return store


@query("load_gb", _loaded_stats("gb_loaded", ["country", "county", "district", "outcode", "sector"]))
def load_gb(spark: SparkSession, sf: str) -> DataFrame:
    """Area statistics of the sales that the register loads stored."""
    sales = U.read_table(spark, f"{loaded_store(spark, sf)}/sales").where("country = 'GB'")
    return rounded(A.agg_area_stats(LD.as_sales(sales)).select(*A.AREA_KEYS, "transaction_count", "median_price", "mean_price"), 8, ["mean_price"])


@query("load_fr", _loaded_stats("fr_loaded", ["country", "county", "district"]))
def load_fr(spark: SparkSession, sf: str) -> DataFrame:
    """The same of the transfers."""
    sales = U.read_table(spark, f"{loaded_store(spark, sf)}/sales").where("country = 'FR'")
    return rounded(A.agg_area_stats(LD.as_sales(sales)).select(*A.AREA_KEYS, "transaction_count", "median_price", "mean_price"), 8, ["mean_price"])


@query("run_ledger", """
WITH r AS (SELECT 'wave-'||CASE WHEN CAST(paon AS INTEGER)%2=0 THEN 2 ELSE 1 END AS unit, problem, record_id FROM judged)
SELECT 'register' AS source_key, unit, 'complete' AS status, count(*)+CASE unit WHEN 'wave-1' THEN 2 ELSE 0 END AS rows_read,
  count(DISTINCT CASE WHEN problem IS NULL THEN record_id END) AS rows_written,
  count_if(problem IS NOT NULL)::BIGINT+CASE unit WHEN 'wave-1' THEN 2 ELSE 0 END AS rows_rejected, CAST(1 AS BIGINT) AS runs FROM r GROUP BY unit
UNION ALL SELECT 'transfers', 'transfers', 'complete', (SELECT count(*) FROM transfers_raw), (SELECT count(DISTINCT (id_mutation, id_parcelle)) FROM clean_transfers),
  (SELECT count(*) FROM transfers_raw)-(SELECT count(*) FROM clean_transfers), 1""")
def run_ledger(spark: SparkSession, sf: str) -> DataFrame:
    state = L.ledger_state(spark, f"{loaded_store(spark, sf)}/ledger")
    return state.select("source_key", "unit", "status", "rows_read", "rows_written", "rows_rejected", "runs")
