import random
import statistics

from pyspark.sql import functions as F

from hearthline.functions.quantiles import counted, exact_quantiles, quantiles_of_counts, spread_quantiles, weighted_lower_quantile
from hearthline.session import cut_lineage


def test_quartile_rules(spark):
    df = spark.createDataFrame([("k", float(v)) for v in (1, 2, 3, 10)], "k string, v double")
    wanted = {"v": {"a": 0.25, "b": 0.5, "c": 0.75}}
    assert tuple(exact_quantiles(df, ["k"], wanted).first())[1:] == (1.75, 2.5, 4.75)
    assert tuple(exact_quantiles(df, ["k"], wanted, "exclusive").first())[1:] == (1.25, 2.5, 8.25)


def test_large_and_small_groups(spark):
    rng = random.Random(5)
    rows = [("hot", round(rng.lognormvariate(12, 1), 2)) for _ in range(4000)] + [("hot", 250000.0)] * 2000 + [("cold", rng.uniform(-5, 5)) for _ in range(301)]
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = {"v": {"a": 0.25, "b": 0.5, "c": 0.75}}
    got = {r.k: r for r in exact_quantiles(df, ["k"], wanted, "exclusive").collect()}
    for k in ("hot", "cold"):
        want = statistics.quantiles([v for g, v in rows if g == k], n=4)
        assert all(abs(a - b) < 1e-6 for a, b in zip(got[k][1:], want))


def test_null_keys_null_values_and_several_measures(spark):
    df = spark.createDataFrame([(None, 1.0, None), (None, 3.0, None), ("a", None, None), ("b", -1.0, 4.0), ("b", -2.0, 8.0)], "k string, v double, w double")
    got = {r.k: tuple(r)[1:] for r in exact_quantiles(df, ["k"], {"v": {"m": 0.5}, "w": {"q": 0.5, "t": 1.0}}, also=[F.count(F.lit(1)).alias("n")]).collect()}
    assert got == {None: (2, 2.0, None, None), "a": (1, None, None, None), "b": (2, -1.5, 6.0, 8.0)}


def test_weighted_lower_quantile(spark):
    rows = [("u", v, 1.0) for v in (1.0, 2.0, 3.0, 4.0)] + [("d", 1.0, 0.1), ("d", 9.0, 5.0), ("d", 20.0, 0.1)] + [("z", v, 0.0) for v in (1.0, 2.0, 3.0)]
    out = {r.k: r.m for r in weighted_lower_quantile(spark.createDataFrame(rows, "k string, v double, w double"), ["k"], "v", "w", {"m": 0.5}).collect()}
    assert out == {"u": 2.0, "d": 9.0, "z": 2.0}


def test_partitioning_does_not_matter(spark):
    from hearthline import bridge
    from hearthline.operators.area_stats import AREA_KEYS, agg_area_stats
    sales = bridge.sales(spark, "/root/testdata/sf0.001")
    a = agg_area_stats(sales).orderBy(*AREA_KEYS).collect()
    b = agg_area_stats(sales.repartition(3, F.col("price"))).orderBy(*AREA_KEYS).collect()
    assert a == b and len(a) > 10


def test_state_of_counts_follows_changed_sales(spark, tmp_path):
    """Batches, corrected prices, a sale that leaves its year and area: the state gives what a full run over the final sales gives."""
    from hearthline.operators import area_state as S
    from hearthline.operators.area_stats import AREA_KEYS, agg_area_stats
    rng = random.Random(3)
    schema = ("country string, property_type string, year int, market_value_basis string, is_residential boolean, lat double, lon double, price double, price_per_sqm double, "
              "county string, district string, outcode string, sector string")

    def sale(year, district):
        hot = rng.random() < 0.4
        return ("c", rng.choice(["flat", "detached", None]), year, rng.choice(["STANDARD", "STANDARD", "ADDITIONAL"]), True, 50 + rng.random(), 1 + rng.random(),
                250000.0 if hot else round(rng.lognormvariate(12, 1), 2), rng.choice([None, round(rng.uniform(1000, 9000), 2)]), "k", district, f"O{district}", f"S{district}")
    first = [sale(2000 + i % 3, f"D{i % 4}") for i in range(900)]
    batch = [sale(2001, "D1") for _ in range(200)] + [sale(2005, "D9") for _ in range(60)]
    changed = [(*r[:7], r[7] * 1.5, *r[8:]) for r in first[:50]] + [(*r[:2], 2002, *r[3:]) for r in first[50:90]]
    final = changed + first[90:] + batch

    def frame(rows):
        return spark.createDataFrame(rows, schema)
    state = str(tmp_path / "state")
    S.start(state, frame(first))
    stored = agg_area_stats(frame(first))
    stored = S.refreshed(stored, state, S.add(state, frame(batch)))
    touched = S.add(state, frame(changed), frame(first[:90]))
    stored = S.refreshed(stored, state, touched)
    columns = [c for c in agg_area_stats(frame(final)).columns]

    def rows(df):
        return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()], key=str)
    want = rows(agg_area_stats(frame(final)))
    assert rows(stored) == want and len(want) > 100
    # what is emptied disappears, and a compacted state says the same
    gone = [r for r in final if r[10] == "D9"]
    stored = S.refreshed(stored, state, S.add(state, frame([]), frame(gone)))
    assert rows(stored) == rows(agg_area_stats(frame([r for r in final if r[10] != "D9"])))
    S.compacted(spark, state, str(tmp_path / "compact"))
    assert S.settled(spark, str(tmp_path / "compact")).exceptAll(S.settled(spark, state)).count() == 0
    assert len(AREA_KEYS) == 5


def test_groups_made_of_finer_ones(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["n", None]), rng.choice(["a", "b", None]), rng.choice(["x", "y"]), rng.choice([None, round(rng.lognormvariate(3, 2), 1), -rng.random(), 7.0]), rng.uniform(1, 1.1)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "land string, place string, kind string, v double, w double")
    spread_rows = []

    def spread(groups):
        spread_rows.append(groups.count())
        return groups.withColumn("area", F.explode(F.array(F.lit("whole"), F.col("place"))))
    wanted = {"w": {"q": 0.25}, "v": {"a": 0.5, "b": 0.9}}
    got = {(r.land, r.area): tuple(r)[2:] for r in spread_quantiles(df, ["land", "place", "kind"], ["land", "area"], spread, wanted, {"w": "n", "v": "n_v"}).collect()}
    assert spread_rows[0] < 1500  # bins are spread, not the 6000 values
    spreads = [(land, area, v, w) for land, place, _, v, w in rows for area in ("whole", place)]
    assert set(got) == {s[:2] for s in spreads}

    def at(values, p):
        rank = p * (len(values) - 1)
        low = int(rank)
        return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (rank - low)
    for key, (n, n_v, q, a, b) in got.items():
        vs, ws = (sorted(s[i] for s in spreads if s[:2] == key and s[i] is not None) for i in (2, 3))
        assert (n, n_v) == (len(ws), len(vs)) and all(abs(x - y) < 1e-9 for x, y in ((q, at(ws, 0.25)), (a, at(vs, 0.5)), (b, at(vs, 0.9))))


def test_a_group_without_values_of_one_measure(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, None), ("b", None, None)], "k string, v double, w double")
    got = spread_quantiles(df, ["k"], ["k"], lambda groups: groups, {"v": {"m": 0.5}, "w": {"q": 0.5}}, {"v": "n", "w": "n_w"}).collect()
    assert [tuple(r) for r in got] == [("a", 2, 0, 2.0, None)]


def test_counts_are_never_broadcast(spark):
    """A stored file is small beside the rows that levels and segments make of it, and its size is all the planner knows."""
    stored = cut_lineage(spark.range(2000).selectExpr("id % 3 AS k", "CAST(id % 7 AS DOUBLE) AS v"))
    spread = counted(stored, ["k"], ["v"]).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("k"))))
    found = quantiles_of_counts(spread, ["k"], [{"m": 0.5}])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert {tuple(r) for r in found.collect()} == {(k, 3.0) for k in range(3)}


def test_area_statistics_move_numbers_not_keys(spark):
    """Values that are put in order travel without area codes, and spread only where they can be a quartile."""
    import re

    from hearthline import bridge
    from hearthline.operators.area_stats import agg_area_stats
    plan = agg_area_stats(bridge.sales(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) if "_v#" in x]
    assert moved and not [x for x in moved if "area_code" in x or "sector" in x]


def test_no_two_groups_share_a_number(spark, monkeypatch):
    from hearthline.functions import quantiles as Q
    groups = cut_lineage(spark.createDataFrame([("a", None), (None, "a"), (None, None), ("a", "a"), ("b", "a")], "x string, y string"))
    assert groups.select(Q.numbered(groups, ["x", "y"])).distinct().count() == 5
    real = Q._number
    monkeypatch.setattr(Q, "_number", lambda keys, seed: F.length("x").cast("long") if seed < 2 else real(keys, seed))
    assert groups.select(Q.numbered(groups, ["x", "y"])).distinct().count() == 5


def test_wanted_bins_are_never_broadcast(spark):
    """Wanted bins are stored small, but held in memory as rows they are many times their file."""
    rows = cut_lineage(spark.range(3000).selectExpr("CAST(id % 50 AS STRING) AS place", "CAST(id % 7 AS DOUBLE) AS v"))
    found = spread_quantiles(rows, ["place"], ["area"], lambda groups: groups.withColumn("area", F.lit("whole")), {"v": {"m": 0.5}}, {"v": "n"})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [tuple(r) for r in found.collect()] == [("whole", 3000, 3.0)]


def test_batches_are_appended_without_a_shuffle(spark):
    from hearthline import bridge
    from hearthline.operators import area_stats as A
    plan = A.finest_rows(cut_lineage(bridge.sales(spark, "/root/testdata/sf0.001")), ["country", "district"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_quarterly_index_moves_numbers_not_keys(spark):
    import re

    from hearthline import bridge
    from hearthline.operators.published import quarterly_index
    plan = quarterly_index(bridge.sales(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) if "_v#" in x]
    assert moved and not [x for x in moved if "county" in x]
