import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from hearthline.operators import places as P
from hearthline.operators import viewports as M

FIRST, LAST = date(1998, 1, 1), date(2000, 12, 31)


def test_newest_sales_of_wide_and_narrow_views(spark, monkeypatch):
    rng = random.Random(4)
    sales = [(f"s{i:05d}", FIRST + timedelta(days=rng.randrange(-100, 1200)), rng.uniform(50, 52), rng.uniform(-2, 0), rng.random() < 0.9) for i in range(6000)]
    sales += [(f"old{i}", FIRST, 55.0, -1.0, True) for i in range(12)] + [("none", None, 51.0, -1.0, True)]
    views = [(i, -40.0, 30.0, 40.0, 60.0) for i in range(30)] + [(100, -1.1, 50.9, -0.9, 51.1), (101, -1.5, 54.0, 1.0, 56.0), (102, 10.0, 10.0, 11.0, 11.0), (None, -1.3, 50.2, -1.0, 50.5)]
    views += [(200, -1.2, 50.5, -1.0, 50.7)] * 2 + [(201, 170.0, 50.0, -0.5, 52.0)]
    paired, join = [], P.box_join

    def counted(*args):
        out = join(*args)
        paired.append(out.count())
        return out
    monkeypatch.setattr(P, "box_join", counted)
    seen = M.txn_window(spark.createDataFrame(views, "viewport_id long, west double, south double, east double, north double"),
                        spark.createDataFrame(sales, "sale_key string, transaction_date date, lat double, lon double, is_residential boolean"), FIRST, LAST, 10)
    got = {}
    for r in seen.orderBy("viewport_id", "place").collect():
        got.setdefault(r.viewport_id, []).append((r.sale_key, r.place, r.truncated))
    want = {}
    for v, w, s, e, n in views:
        held = [(-d.toordinal(), k) for k, d, lat, lon, home in sales if home and d and FIRST <= d <= LAST and s <= lat <= n and ((w <= lon <= e) if w <= e else (lon >= w or lon <= e))]
        want.setdefault(v, []).extend(held)
    want = {v: [(k, i + 1, len(held) > 10) for i, (_, k) in enumerate(sorted(held)[:10])] for v, held in want.items() if held}
    assert got == want
    assert sum(paired) < len(views) * 200  # all pairs are over 140,000


def test_no_views_and_no_sales(spark):
    views = spark.createDataFrame([(1, -1.0, 50.0, 0.0, 51.0)], "viewport_id long, west double, south double, east double, north double")
    sales = spark.createDataFrame([("a", FIRST, 50.5, -0.5, True)], "sale_key string, transaction_date date, lat double, lon double, is_residential boolean")
    assert M.txn_window(views, sales.where(F.lit(False)), FIRST, LAST).count() == 0 and M.txn_window(views.where(F.lit(False)), sales, FIRST, LAST).count() == 0
    assert [(r.sale_key, r.place, r.truncated) for r in M.txn_window(views, sales, FIRST, LAST).collect()] == [("a", 1, False)]
