from datetime import date

import pytest
from pyspark.sql import functions as F

from hearthline.operators import forecast as FC
from hearthline.operators import places as P
from hearthline.operators import upsert as U
from hearthline.operators import viewports as M
from hearthline.policies import ForecastPolicy
from hearthline.session import cut_lineage, fresh_path

SHAPE = "shape_id string, rings array<array<struct<x:double,y:double>>>"


def test_replay_changes_nothing(spark):
    path = fresh_path(spark, "t")
    first = spark.createDataFrame([(None, 1, "a", 1.0), ("x", 2, "b", 2.0)], "k string, v int, s string, g double")
    second = spark.createDataFrame([("x", 3, "c", None), ("y", 4, None, 4.0), (None, 5, "z", 5.0)], "k string, v int, s string, g double")
    for batch in (first, second):
        U.upsert_into(path, batch, ["k"], {"g": "new_or_old"})
    once = sorted(map(str, U.read_table(spark, path).collect()))
    U.upsert_into(path, second, ["k"], {"g": "new_or_old"})
    again = sorted(map(str, U.read_table(spark, path).collect()))
    assert once == again and len(once) == 3
    row = U.read_table(spark, path).where("k = 'x'").first()
    assert (row.v, row.s, row.g) == (3, "c", 2.0)


def test_bucket_number_stays_with_the_table(spark):
    path = fresh_path(spark, "t")
    rows = spark.range(50).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    U.upsert_into(path, rows, ["k"], buckets=8)
    U.upsert_into(path, rows.withColumn("v", F.col("v") + 1), ["k"], buckets=16)
    assert sorted(r.v for r in U.read_table(spark, path).collect()) == list(range(1, 51))


def bucket_sizes(spark, path):
    return {r[0]: r[1] for r in spark.read.parquet(path).groupBy(U.BUCKET).count().collect()}


def test_buckets_split_as_the_table_grows(spark):
    """Begun with 50 rows, grown to 60,000: buckets stay small, no key is there twice, untouched buckets are not rewritten."""
    path, size = fresh_path(spark, "t"), 500

    def batch(first, last, v):
        return spark.range(first, last).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(v).alias("v"))
    for first, last, v in [(0, 50, 1), (25, 400, 2), (300, 20_000, 3), (0, 30, 4), (19_000, 60_000, 5)]:
        U.upsert_into(path, batch(first, last, v), ["k"], rows_per_bucket=size)
    U.insert_into(path, batch(59_990, 60_010, 6), ["k"], rows_per_bucket=size)
    table = U.read_table(spark, path)
    assert table.count() == table.select("k").distinct().count() == 60_010
    want = {4: 30, 2: 270, 3: 18_700, 5: 41_000, 6: 10}
    assert {r.v: r[1] for r in table.groupBy("v").count().collect()} == want
    sizes = bucket_sizes(spark, path)
    assert len(sizes) == -(-60_010 // size) and max(sizes.values()) < 2.6 * size
    assert spark.read.parquet(path).where(F.col(U.BUCKET) != U.bucket_of(["k"], len(sizes))).count() == 0


def test_a_split_that_was_cut_short_is_finished(spark, monkeypatch):
    path = fresh_path(spark, "t")
    rows = spark.range(3000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"))
    swap = U._swap_split

    def dies(folder, note):
        folder.drop_buckets(note["old"])  # rows are gone from the table, the stage holds them
        raise OSError("executor lost")
    monkeypatch.setattr(U, "_swap_split", dies)
    with pytest.raises(OSError):
        U.upsert_into(path, rows, ["k"], buckets=2, rows_per_bucket=200)
    monkeypatch.setattr(U, "_swap_split", swap)
    U.upsert_into(path, rows.where("cast(k as int) < 10").withColumn("v", F.lit(2)), ["k"], rows_per_bucket=200)
    table = U.read_table(spark, path)
    assert {r.v: r[1] for r in table.groupBy("v").count().collect()} == {1: 2990, 2: 10} and table.select("k").distinct().count() == 3000
    assert len(bucket_sizes(spark, path)) == 15


def test_rows_of_one_key_are_not_mixed(spark):
    path = fresh_path(spark, "t")
    rows = [("x", i, f"s{i}", 2 * i) for i in range(20)]
    U.upsert_into(path, spark.createDataFrame(rows, "k string, a int, b string, c int").repartition(7), ["k"])
    row = U.read_table(spark, path).first()
    assert tuple(row) in rows and U.read_table(spark, path).count() == 1


def test_refresh_touches_the_group_a_sale_leaves(spark):
    from hearthline import bridge
    from hearthline.operators import area_state as S
    from hearthline.operators import area_stats as A
    old = bridge.sales(spark, "/root/testdata/sf0.001")
    moved = old.where("sale_area = 7 AND year = 1999")
    changed = moved.withColumn("year", F.lit(1997))
    now = old.join(moved.select("sale_key"), "sale_key", "left_anti").select(*old.columns).unionByName(changed)
    state = fresh_path(spark, "state")
    S.start(state, old)
    fresh = S.refreshed(A.agg_area_stats(old), state, S.add(state, changed, moved))
    columns = [*A.AREA_KEYS, "transaction_count", "median_price"]
    assert sorted(map(str, fresh.select(*columns).collect())) == sorted(map(str, A.agg_area_stats(now).select(*columns).collect()))


def test_merge_of_rows_with_other_columns(spark):
    path = fresh_path(spark, "t")
    U.upsert_into(path, spark.createDataFrame([("x", 1, "a"), ("y", 2, "b")], "k string, v int, old string"), ["k"])
    U.upsert_into(path, spark.createDataFrame([("x", 3, 0.5), ("z", 4, 1.5)], "k string, v int, fresh double"), ["k"])
    rows = {r.k: (r.v, r.old, r.fresh) for r in U.read_table(spark, path).collect()}
    assert rows == {"x": (3, "a", 0.5), "y": (2, "b", None), "z": (4, None, 1.5)}


def test_insert_keeps_what_is_stored(spark):
    path = fresh_path(spark, "t")
    for batch in ([("x", 1), (None, 2)], [("x", 9), (None, 9), ("y", 5), ("y", 7)], [("y", 8)], []):
        U.insert_into(path, spark.createDataFrame(batch, "k string, v int"), ["k"])
    assert {(r.k, r.v) for r in U.read_table(spark, path).collect()} == {("x", 1), (None, 2), ("y", 7)} and U.read_table(spark, path).count() == 3


def test_ledger_of_failing_and_repeated_runs(spark):
    from hearthline.operators import ledger as L
    path, calls = fresh_path(spark, "ledger"), []

    def work(counts):
        calls.append(1)
        counts["read"] = 10 * len(calls)
        if len(calls) == 1:
            raise OSError("no such disk")
        counts["written"], counts["rejected"] = 7, 3
    with pytest.raises(OSError):
        L.run_unit(spark, path, "s", "u", "v1", work)
    state = L.ledger_state(spark, path).first()
    assert (state.status, state.rows_read, state.rows_written, state.error, state.runs) == ("failed", 10, 0, "no such disk", 1)
    assert L.run_unit(spark, path, "s", "u", "v1", work) and not L.run_unit(spark, path, "s", "u", "v1", work)
    assert L.run_unit(spark, path, "s", "u", "v2", work) and L.run_unit(spark, path, "s", "other", "v1", work) and len(calls) == 4
    rows = {r.unit: (r.status, r.signature, r.rows_read, r.rows_written, r.rows_rejected, r.runs) for r in L.ledger_state(spark, path).collect()}
    assert rows == {"u": ("complete", "v2", 30, 7, 3, 3), "other": ("complete", "v1", 40, 7, 3, 1)}
    assert [r.status for r in L.ledger_events(spark, path).where("unit = 'u'").orderBy("event").collect()] == ["running", "failed", "running", "complete", "running", "complete"]


def test_marks_of_other_sources_stay(spark):
    from hearthline.operators import ledger as L
    path = fresh_path(spark, "marks")
    for rows in ([("a", date(2001, 1, 1)), ("b", date(2002, 1, 1))], [("a", date(2000, 1, 1)), ("a", date(1999, 1, 1))]):
        L.mark_sources(path, spark.createDataFrame(rows, "source_key string, transaction_date date"))
    assert {tuple(r) for r in U.read_table(spark, path).select("source_key", "last_record", "record_count").collect()} == {("a", date(2001, 1, 1), 2), ("b", date(2002, 1, 1), 1)}


def test_shapes(spark):
    ell = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)]
    square = [(0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8)]
    shapes = spark.createDataFrame([("L", [ell]), ("sq", [square])], SHAPE)
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 0.5, 3.0), (5, 1.05, 2.0)], "point_id int, lat double, lon double")
    assert dict(map(tuple, P.point_in_polygon(points, shapes).collect())) == {1: "sq", 3: "L"}
    near = P.nearest_polygon(points.where("point_id in (2, 5)"), shapes).collect()
    assert [r.point_id for r in near] == [5] and abs(near[0].distance_m - 5560) < 1
    boxes = spark.createDataFrame([(1, 0.5, 0.5, 5.0, 5.0), (2, 170.0, 0.0, -170.0, 10.0)], "box_id int, west double, south double, east double, north double")
    seen = {(r.box_id, r.shape_id): r for r in P.polygon_in_view(boxes, shapes).collect()}
    assert set(seen) == {(1, "L"), (1, "sq")} and abs(seen[1, "L"].visible_area - 3.25) < 1e-9
    inside = spark.createDataFrame([(1, seen[1, "L"].lat, seen[1, "L"].lon)], "point_id int, lat double, lon double")
    assert P.point_in_polygon(inside, shapes).count() == 1


def test_ladder(spark):
    zooms = [(14.5, "PROPERTY"), (14.49, "STREET"), (13.2, "STREET"), (12.0, "POSTCODE"), (10.5, "NEIGHBOURHOOD"), (9.0, "CITY"), (7.0, "REGION"), (4.5, "COUNTRY"), (0.0, "WORLD")]
    df = spark.createDataFrame(zooms, "z double, want string")
    assert df.where(M.tier_of(F.col("z")) != F.col("want")).count() == 0
    served = spark.range(1).select(M.honest_tier(F.lit("county"), F.lit("STREET")).alias("a"), M.honest_tier(F.lit("sector"), F.lit("WORLD")).alias("b"),
                                   M.honest_precision(F.lit("county"), F.lit("STREET")).alias("c")).first()
    assert tuple(served) == ("REGION", "WORLD", "CITY_REGIONAL")


def series(spark, months, monthly):
    rows = [("c", "A", "local_authority", "all", date(1990 + m // 12, m % 12 + 1, 1), 100.0 * (1 + monthly) ** m) for m in range(months)]
    return spark.createDataFrame(rows, "country string, area_code string, area_level string, segment string, period date, index_value double")


def test_known_drift_is_recovered(spark):
    fit = FC.fc_fit(series(spark, 200, 0.004), ForecastPolicy()).first()
    assert abs(fit.g_long - 0.0039920) < 1e-6 and fit.residual_sigma < 1e-9
    assert FC.fc_fit(series(spark, 95, 0.004), ForecastPolicy()).count() == 0


def test_intervals_widen_and_sigma_interpolates(spark):
    fit = FC.fc_fit(series(spark, 200, 0.004), ForecastPolicy()).withColumn("horizon", F.explode(F.array(*map(F.lit, (0, 12, 36, 60, 240)))))
    sigma = spark.createDataFrame([(12, 0.06), (60, 0.16)], "horizon int, sigma double")
    rows = {r.horizon: r for r in FC.fc_project(fit, ForecastPolicy(), sigma).collect()}
    assert rows[0].ratio == rows[0].ratio_low == rows[0].ratio_high == 1.0
    assert abs(rows[36].sigma - 0.11) < 1e-9 and abs(rows[240].sigma - 0.32) < 1e-9
    widths = [rows[h].ratio_high / rows[h].ratio_low for h in (12, 36, 60, 240)]
    assert widths == sorted(widths)


def test_incoming_rows_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def seen(parts):
        for part in parts:
            made.add(part.num_rows)
            yield part
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "k long, v string").mapInArrow(seen, "k long, v string")
    for _ in range(2):
        U.upsert_into(str(tmp_path / "t"), rows, ["k"])
    assert made.value == 100 and U.read_table(spark, str(tmp_path / "t")).count() == 50


def _star(spark, folder):
    """Small tables of the star schema: 3000 sales of 100 dwellings, some dwellings unknown or not given."""
    spark.range(3000).selectExpr(
        "id AS l_orderkey", "1 AS l_linenumber", "CASE WHEN id % 50 = 0 THEN NULL ELSE id * 7 % 110 END AS l_partkey", "id % 5 AS l_suppkey", "CAST(id % 40 AS DOUBLE) AS l_quantity",
        "CASE WHEN id % 33 = 0 THEN NULL ELSE timestampadd(DAY, CAST(id * 13 % 400 AS INT), TIMESTAMP '1997-01-20') END AS l_shipdate", "CAST(id AS DOUBLE) AS l_extendedprice",
        "'A' AS l_returnflag").write.parquet(f"{folder}/lineitem.parquet")
    spark.range(100).selectExpr("id AS p_partkey", "'n' AS p_name", "10 AS p_size", "'SMALL' AS p_type").write.parquet(f"{folder}/part.parquet")
    spark.range(25).selectExpr("id AS n_nationkey", "id % 5 AS n_regionkey", "'N' AS n_name").write.parquet(f"{folder}/nation.parquet")
    spark.range(5).selectExpr("id AS r_regionkey", "concat('R', id) AS r_name").write.parquet(f"{folder}/region.parquet")
    return str(folder)


def test_units_are_counted_in_as_many_tasks_as_sales_need(spark, tmp_path, monkeypatch):
    from hearthline import bridge
    from hearthline.plans import q_tables as Q
    sf = _star(spark, tmp_path)
    monkeypatch.setattr(bridge, "ROWS_PER_TASK", 100)
    assert ", 30), REPARTITION_BY_NUM" in Q.landed_units(spark, sf)._jdf.queryExecution().executedPlan().toString()
    sales = bridge.sales(spark, sf)
    assert sales.exceptAll(bridge.sales(spark, sf, by_home=True)).isEmpty()
    held = {}
    for r in sales.collect():
        held.setdefault(r.transaction_date and r.transaction_date.strftime("%Y-%m"), []).append(r.property_id)
    want = {(unit, f"{len(ids)}:{len(set(ids))}", unit and int(unit[-2:])) for unit, ids in held.items()}
    assert {(r.unit, r.signature, r.m) for r in Q.landed_units(spark, sf).collect()} == want and None in held and len(want) > 10


def test_stored_estimates_of_today_are_not_made_again(spark, monkeypatch):
    from datetime import date

    from hearthline.operators import timeline as TL
    from hearthline.policies import GB_POLICY
    from hearthline.plans.q_forecast import SHORT

    def refused(*_, **__):
        raise AssertionError("valued again")
    monkeypatch.setattr(TL.V, "val_avm", refused)
    homes = spark.createDataFrame([(1, "L", "D1", "flat", 50.0, 0.0, 40.0), (2, "L", "D1", "flat", 50.0, 0.1, 40.0)],
                                  "property_id long, country string, district string, property_type string, lat double, lon double, floor_area double")
    current = homes.selectExpr("property_id", "country", "district", "property_type", "DATE '2001-11-30' AS as_of", "IF(property_id = 1, 'OK', 'INSUFFICIENT_EVIDENCE') AS status",
                               "100D AS estimated_price", "90D AS low_estimate", "110D AS high_estimate", "'HIGH' AS confidence", "5 AS comparable_count")
    sales = spark.createDataFrame([], "property_id long, year int, transaction_date date, price double, sale_key string, market_value_basis string")
    indices = spark.createDataFrame([], "country string, area_code string, area_level string, segment string, period date, index_value double")
    links = spark.createDataFrame([], "country string, district string, area_code string")
    wanted = homes.selectExpr("property_id", "explode(array(2001, 2003)) AS year")
    rows = TL.val_price_year(wanted, homes, sales, sales, indices, links, GB_POLICY, SHORT, None, date(2001, 11, 30), current).collect()
    assert {(r.property_id, r.year, r.price_type, r.value, r.status) for r in rows} == {
        (1, 2001, "CURRENT_ESTIMATE", 100.0, "OK"), (2, 2001, None, None, "INSUFFICIENT_EVIDENCE"),
        (1, 2003, None, None, "OUT_OF_RANGE"), (2, 2003, None, None, "INSUFFICIENT_EVIDENCE")}


def test_failing_loads_are_raised_when_all_have_run():
    import pytest

    from hearthline.operators.loading import load_all
    ran = []

    def bad(name):
        ran.append(name)
        raise ValueError(f"no file for {name}")
    with pytest.raises(RuntimeError, match="2 of 4 loads failed: no file for a; no file for c"):
        load_all([lambda: bad("a"), lambda: ran.append("b"), lambda: bad("c"), lambda: ran.append("d")])
    assert ran == ["a", "b", "c", "d"]
    load_all([lambda: True, lambda: False])


def test_extents_shared_by_segments_and_years_are_met_once(spark, monkeypatch):
    from hearthline.operators import places as P
    schema = "country string, area_level string, area_code string, segment string, year int, west double, south double, east double, north double"
    stats = spark.createDataFrame([("c", level, code, segment, year, *box) for level, code, box in (
        ("district", "D2", (0.0, 0.0, 1.0, 1.0)), ("district", "D1", (0.0, 0.0, 1.0, 1.0)), ("county", "C", (0.0, 0.0, 4.0, 4.0)), ("sector", "S", (None,) * 4))
        for segment in ("all", "flat") for year in (2000, 2001, 2002)] + [("c", "district", "D3", "all", 2003, 0.0, 0.0, 0.5, 0.5)], schema)
    points = spark.createDataFrame([(1, "c", 0.2, 0.2), (2, "c", 0.8, 0.8), (3, "c", 3.0, 3.0), (4, "d", 0.2, 0.2), (5, "c", 9.0, 9.0)], "point_id int, country string, lat double, lon double")
    met, join = [], P.box_join
    monkeypatch.setattr(P, "box_join", lambda points, boxes, keys: met.append(boxes.count()) or join(points, boxes, keys))
    got = {tuple(r) for r in P.area_contains(points, stats).collect()}
    assert got == {(1, "c", "district", "D3"), (2, "c", "district", "D1"), (3, "c", "county", "C")}
    assert met == [4]


def test_evidence_is_counted_before_it_is_spread(spark, monkeypatch):
    from hearthline import bridge
    from hearthline.operators import area_stats as A
    from hearthline.operators import quality as Q
    sales = cut_lineage(bridge.sales(spark, "/root/testdata/sf0.001"))
    spread, real = [], Q.with_segments
    monkeypatch.setattr(Q, "with_segments", lambda rows: spread.append(rows.count()) or real(rows))
    stats = A.agg_area_stats(sales)
    assert [tuple(r) for r in Q.dq_evidence_only(stats, sales).collect()] == [("count backed by evidence", stats.count(), 0)]
    more = stats.withColumn("transaction_count", F.col("transaction_count") + 1)
    assert Q.dq_evidence_only(more, sales).first().broken == stats.count()
    keys = ["country", "property_type", "year", "county", "district", "outcode", "sector"]
    assert spread[0] == A.evidence(sales).select(*keys).distinct().count() < A.evidence(sales).count()


def test_year_snap_makes_no_tiles(spark, monkeypatch):
    """The tiles of the live answers are no part of the years with figures, so nothing stores them."""
    from hearthline.plans import q_map
    stored, real = [], q_map.cut_lineage
    monkeypatch.setattr(q_map, "cut_lineage", lambda df: stored.append(df.columns) or real(df))
    q_map.year_snap(spark, "/root/testdata/sf0.001")
    assert stored and not [c for c in stored if "tile" in c]
