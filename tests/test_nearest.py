from pyspark.sql import functions as F

from hearthline.operators import places as P
from hearthline.operators import search_tree as ST


def test_one_search_answers_postcodes_and_regions(spark, monkeypatch):
    gazetteer = spark.createDataFrame([(f"P{i:02d}", 50.0 + i / 50, -1.0 - i / 9, "live", "Scotland" if i % 2 else "England") for i in range(60)] + [("GONE", 50.0, -1.0, "terminated", "Wales")],
                                      "postcode string, lat double, lon double, status string, uk_country string")
    points = spark.createDataFrame([(i, 50.003 + i / 80, -1.01 - i / 15) for i in range(95)] + [(7, 54.5, -6.5), (7, 54.6, -6.6), (None, 51.0, -1.5), (900, None, None), (901, 10.0, 10.0)],
                                   "point_id long, lat double, lon double")
    searches, build = [], ST.build
    monkeypatch.setattr(ST, "build", lambda *a, **k: searches.append(1) or build(*a, **k))
    every, off = P.knn_postcode_apart(points, gazetteer)
    regions = P.uk_region(points, gazetteer, off)
    assert len(searches) == 1

    def rows(df):
        return sorted(map(str, df.select(*sorted(df.columns)).where(F.col("point_id").isNotNull()).collect()))
    assert rows(every) == rows(P.knn_postcode(points, gazetteer)) and rows(regions) == rows(P.uk_region(points, gazetteer))
    assert every.count() > 20 and off.count() <= every.count()
