"""The radius search against brute force, on evidence with a very hot point."""

import math
import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from hearthline.functions import geo
from hearthline.functions.sorted_arrays import count_up_to
from hearthline.operators import comparables as C
from hearthline.operators import search_tree as ST
from hearthline.policies import SearchPolicy

POLICY = SearchPolicy(radius_steps_m=(400, 800, 1600), target_comparables=5, nearest=12)
DAY = date(2020, 6, 30)


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return round(2 * 6371008.771415 * math.asin(min(1.0, math.sqrt(x))), 6)


def fixture():
    rng = random.Random(11)
    sales = []
    for i in range(900):
        if i % 3 == 0:  # a third of all sales at one point, many of them of one dwelling
            lat, lon, home = 60.5, 10.5, 1 if i % 2 else i
        else:
            lat, lon, home = 60.5 + rng.uniform(-0.03, 0.03), 10.5 + rng.uniform(-0.06, 0.06), 1000 + i % 80
        sales.append((f"s{i:04d}", home, "c", round(lat, 5), round(lon, 5), rng.choice(["flat", "house"]), 100.0 + i, DAY - timedelta(days=rng.randrange(3000)), 50.0, "d"))
    targets = [(f"t{j}", rng.choice([1, 1005, 7777]), "c", *((60.5, 10.5) if j % 4 == 0 else (round(60.5 + rng.uniform(-0.03, 0.03), 5), round(10.5 + rng.uniform(-0.06, 0.06), 5))),
                rng.choice(["flat", "house"]), 50.0, "d", DAY, date(2015, 6, 1), DAY) for j in range(40)]
    return sales, targets


EV = "sale_key string, property_id long, country string, lat double, lon double, property_type string, price double, transaction_date date, floor_area double, district string"
TG = "target_id string, property_id long, country string, lat double, lon double, property_type string, floor_area double, district string, as_of date, date_from date, date_to date"


def wanted(t, sales, typed, policy):
    """(radius, keys of the nearest) of one target by looking at every sale."""
    near = []
    for s in sales:
        if s[2] == t[2] and s[1] != t[1] and t[9] <= s[7] <= t[10] and (not typed or s[5] == t[5]):
            near.append((metres((t[3], t[4]), (s[3], s[4])), -s[7].toordinal(), s[0]))
    radius = next((r for r in policy.radius_steps_m if sum(d <= r for d, _, _ in near) >= policy.target_comparables), policy.radius_steps_m[-1])
    return radius, [k for _, _, k in sorted(n for n in near if n[0] <= radius)[:policy.nearest]]


def check_search(spark, sales, targets, policy=POLICY):
    ev, tg = spark.createDataFrame(sales, EV), spark.createDataFrame(targets, TG)
    tree = ST.build(ev, policy.nearest)
    for typed in (True, False):
        got = {}
        for r in C.expand_radius(C.radius_candidates(tg, ev, tree, policy, typed), policy).collect():
            got.setdefault(r.target_id, (r.radius_m, []))[1].append((r.nearness, r.sale_key))
        for t in targets:
            radius, keys = wanted(t, sales, typed, policy)
            have = got.get(t[0])
            assert [k for _, k in sorted(have[1])] == keys if have else keys == []
            assert have is None or have[0] == radius
    return ev, tg, tree


def test_search_equals_brute_force(spark):
    sales, targets = fixture()
    check_search(spark, sales, targets)


def test_many_dates_share_one_search(spark):
    sales, targets = fixture()
    windows = [(date(2012 + y, 1, 1), date(2014 + y, 5, 9 + y)) for y in range(7)] + [(date(2030, 1, 1), date(2031, 1, 1)), (date(2019, 1, 1), date(2018, 1, 1))]
    many = [(f"{t[0]}/{n}", *t[1:8], until, since, until) for t in targets[::3] for n, (since, until) in enumerate(windows)]
    ev, tg, tree = check_search(spark, sales, many)
    places, _ = C.places_of(tg, ev, False)
    assert places.count() == len({(t[1], t[3], t[4]) for t in many})


def town():
    """A town of 4,000 points in two square kilometres beside empty land, and dwellings around it."""
    rng = random.Random(8)
    sales = [(f"s{i:05d}", i, "c", round(51.0 + rng.uniform(0, 0.013), 6), round(4.0 + rng.uniform(0, 0.02), 6), rng.choice(["flat", "house"]), 1.0,
              DAY - timedelta(days=rng.randrange(2000)), 50.0, "d") for i in range(4000)]
    land = [(50.99, 4.01), (50.995, 3.99), (51.0065, 3.985), (51.02, 4.03), (51.005, 4.01), (50.97, 4.0), (51.0, 4.0)]
    return sales, [(f"t{j}", -1 - j, "c", *p, "house", 50.0, "d", DAY, date(2015, 6, 1), DAY) for j, p in enumerate(land)]


def test_town_beside_an_empty_cell(spark):
    policy = SearchPolicy(radius_steps_m=(400, 800, 1600, 3200, 6400), target_comparables=5, nearest=12)
    sales, targets = town()
    ev, tg, tree = check_search(spark, sales, targets, policy)
    assert tree.sites.groupBy("country", "node").count().agg(F.max("count")).first()[0] <= ST.MOST
    places, _ = C.places_of(tg, ev, False)
    leaves = ST.leaves_in_reach(places, tree, 6400.0, policy.nearest, policy.radius_steps_m, policy.target_comparables)
    opened = leaves.join(tree.sites, ["country", "node"]).groupBy("place").count().agg(F.max("count")).first()[0]
    assert opened < 700  # of 4,000 points, all within 6,400 m of every dwelling


def test_antimeridian_poles_and_two_countries(spark):
    rng = random.Random(4)
    spots = [(0.0, 180.0), (-17.0, -180.0), (66.5, 179.999), (89.2, 20.0), (-89.97, 0.0), (0.0, 0.0)]

    def near(spot, metres_off):
        lat = max(-90.0, min(90.0, spot[0] + rng.uniform(-1, 1) * metres_off / 111195))
        lon = spot[1] + rng.uniform(-1, 1) * metres_off / 111195 / max(0.01, math.cos(math.radians(spot[0])))
        return round(lat, 6), round((lon + 180) % 360 - 180, 6)
    sales = [(f"s{i:04d}", i % 200, rng.choice("ab"), *near(spots[i % 6], 2500), rng.choice(["flat", "house"]), 1.0, DAY - timedelta(days=rng.randrange(900)), 1.0, "d") for i in range(900)]
    targets = [(f"t{j}", rng.choice([j, None]), rng.choice("ab"), *near(spots[j % 6], 2000), "flat", 1.0, "d", DAY, date(2019, 1, 1), DAY) for j in range(60)]
    ev, tg, _ = check_search(spark, sales, targets)
    got = {r.target_id: (r.sales_within, r.nearest_m) for r in C.radius_counts(tg, ev, 1600.0).collect()}
    for t in targets:
        found = [d for s in sales if s[2] == t[2] and s[1] != t[1] and t[9] <= s[7] <= t[10] for d in [metres((t[3], t[4]), (s[3], s[4]))] if d <= 1600]
        assert got.get(t[0]) == ((len(found), min(found)) if found else None)


def test_counts_keep_every_sale_of_a_crowded_day(spark):
    sales = [(f"s{i}", i % 7, "c", 10.0, 10.0, "flat", 1.0, DAY, 1.0, "d") for i in range(3000)]
    tg = spark.createDataFrame([("t", 3, "c", 10.0, 10.001, "flat", 1.0, "d", DAY, DAY, DAY)], TG)
    [row] = C.radius_counts(tg, spark.createDataFrame(sales, EV), 400.0).collect()
    assert row.sales_within == sum(i % 7 != 3 for i in range(3000))


def test_countries_with_their_own_policy(spark):
    sales, targets = fixture()
    sales = [(k, h, "fr" if i % 2 else "gb", *rest) for i, (k, h, _, *rest) in enumerate(sales)]
    targets = [(k, h, "fr" if j % 3 else "gb", *rest) for j, (k, h, _, *rest) in enumerate(targets)]
    near, far = SearchPolicy(radius_steps_m=(200, 450), target_comparables=4, nearest=6, min_comparables=1), POLICY
    ev, tg = spark.createDataFrame(sales, EV), spark.createDataFrame(targets, TG)
    got = C.val_comparables_by_policy(tg, ev, {"fr": near}, far)
    for country, policy in (("fr", near), ("gb", far)):
        alone = C.val_comparables(tg.where(F.col("country") == country), ev, policy)
        columns = ["target_id", "sale_key", "radius_m", "similarity", "type_restricted"]
        want = sorted(tuple(r) for r in alone.select(*columns).collect())
        assert sorted(tuple(r) for r in got.where(F.col("country") == country).select(*columns).collect()) == want and want


def test_nothing_to_search(spark):
    ev, tg = spark.createDataFrame([], EV), spark.createDataFrame(fixture()[1], TG)
    assert C.val_comparables(tg, ev, POLICY).collect() == [] and C.radius_counts(tg, ev, 100.0).collect() == []
    assert C.val_comparables(spark.createDataFrame([], TG), spark.createDataFrame(fixture()[0], EV), POLICY).collect() == []


def test_binary_search(spark):
    rows = [(sorted(random.Random(n).choices(range(0, 400, 3), k=n)), x) for n in (0, 1, 2, 63, 64, 65, 3000) for x in (-1, 0, 1, 199, 200, 201, 396, 500)]
    df = spark.createDataFrame(rows, "v array<int>, x int").select("v", "x", count_up_to(F.col("v"), F.col("x")).alias("n"))
    assert all(r.n == sum(v <= r.x for v in r.v) for r in df.collect())


def test_cells_cover_the_circle(spark):
    rng = random.Random(3)
    for r in (25.0, 400.0, 6400.0):
        rows = []
        for _ in range(200):
            lat, lon = rng.uniform(-80, 80), rng.choice([rng.uniform(-180, 180), 179.9999, -180.0])
            bearing, d = rng.uniform(0, 2 * math.pi), r * rng.uniform(0.5, 1.0) / 111195.0
            rows.append((lat, lon, lat + d * math.cos(bearing), (lon + d * math.sin(bearing) / math.cos(math.radians(lat)) + 180) % 360 - 180))
        df = spark.createDataFrame(rows, "lat double, lon double, plat double, plon double")
        bits = geo.bits_for(r / 2)
        near = df.where(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")) <= r)
        cells = geo.touched_cells(F.col("lat"), F.col("lon"), r, bits)
        assert near.where(~F.array_contains(cells, geo.dyadic_cell(F.col("plat"), F.col("plon"), bits))).count() == 0 and near.count() > 100


def test_similarity_is_monotone(spark):
    def score(distance=100.0, months=6, target="detached", sale="detached", ta=100.0, sa=100.0):
        return spark.range(1).select(C.similarity(F.lit(distance), F.lit(months), F.lit(target), F.lit(sale), F.lit(ta), F.lit(sa)).alias("s")).first()["s"]
    base = score()
    assert 0 <= base <= 1 and score(distance=5000.0) < base and score(months=40) < base and score(sa=300.0) < base
    assert score(sale="flat") < 0.13 and score(target="terraced", sale="semi_detached") > score(target="flat", sale="detached")
