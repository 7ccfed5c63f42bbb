"""Polygons against plain loops: containment, nearness across the antimeridian, visible parts of random and holed shapes."""

import math
import random

from pyspark.sql import functions as F

from hearthline.functions import geo
from hearthline.operators import places as P
from hearthline.operators import shapes as S

SHAPE = "shape_id string, rings array<array<struct<x:double,y:double>>>"
POINT = "point_id int, lat double, lon double"
BOX = "box_id int, west double, south double, east double, north double"


def star(rng, x, y, size, corners):
    """A closed ring with corners at random distances, counter-clockwise."""
    return [(x + size * rng.uniform(0.2, 1) * math.cos(2 * math.pi * k / corners), y + size * rng.uniform(0.2, 1) * math.sin(2 * math.pi * k / corners)) for k in range(corners)]


def shapes_of():
    rng = random.Random(12)
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    hole = [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0)]
    return {"holed": [square, hole], "star": [star(rng, 2.0, 2.0, 3.0, 301)], "thin": [[(-5.0, 0.1), (9.0, 3.9), (9.0, 3.95)]], "dot": [[(1.0, 1.0), (1.001, 1.0), (1.0, 1.001)]],
            "two": [star(rng, -2.0, 3.0, 1.0, 7), star(rng, 6.0, -1.0, 1.5, 40)], "empty": []}


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
                odd = not odd
    return odd


def shoelace(ring):
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])) / 2


def clipped(ring, w, s, e, n):
    """Signed area of a ring inside a box, cut by one side after the other."""
    for axis, limit, sign in ((0, w, 1), (0, e, -1), (1, s, 1), (1, n, -1)):
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            a, b = (p[axis] - limit) * sign, (q[axis] - limit) * sign
            if a >= 0:
                out.append(p)
            if (a >= 0) != (b >= 0):
                t = a / (a - b)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        ring = out
        if len(ring) < 3:
            return 0.0
    return shoelace(ring)


def test_containment(spark):
    rng, shapes = random.Random(1), shapes_of()
    table = spark.createDataFrame([(k, v) for k, v in shapes.items()], SHAPE)
    points = [(i, rng.uniform(-2, 6), rng.uniform(-6, 10)) for i in range(3000)]
    points += [(3000 + i, round(rng.uniform(-1, 5) * 8) / 8, round(rng.uniform(-1, 5) * 8) / 8) for i in range(300)]  # corners, edges and grid lines
    frame = spark.createDataFrame(points, POINT).repartition(4)
    got = {(r.point_id, r.shape_id) for r in S.containing(frame, table).collect()}
    want = {(i, k) for i, y, x in points for k in shapes if inside(shapes[k], x, y)}
    assert got == want
    kinds = {r.k: r.n for r in S.covering(table).groupBy(F.col("edges").isNull().alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds[True] > 1000  # most of the area answers by key alone
    smallest = {k: abs(sum(map(shoelace, v))) for k, v in shapes.items()}
    best = {}
    for i, k in want:
        best[i] = min(best.get(i, (9e9, "")), (smallest[k], k))
    assert dict(map(tuple, P.point_in_polygon(frame, table).collect())) == {i: k for i, (_, k) in best.items()}


def test_visible_parts(spark):
    rng, shapes = random.Random(2), shapes_of()
    table = spark.createDataFrame([(k, v) for k, v in shapes.items()], SHAPE)
    boxes = []
    for i in range(60):
        w, s = rng.uniform(-7, 8), rng.uniform(-3, 5)
        boxes.append((i, w, s, w + rng.choice([0.01, 0.5, 3, 20]), s + rng.choice([0.01, 0.5, 3, 20])))
    seen = {(r.box_id, r.shape_id): r for r in P.polygon_in_view(spark.createDataFrame(boxes, BOX), table).collect()}
    for i, w, s, e, n in boxes:
        for k, rings in shapes.items():
            area = abs(sum(clipped(r, w, s, e, n) for r in rings))
            row = seen.get((i, k))
            if area > 1e-9 or row:
                assert row and abs(row.visible_area - area) < 1e-9
            if area > 1e-4:
                assert row.lat is not None
            if row and row.lat is not None:
                assert w <= row.lon <= e and s <= row.lat <= n and inside(rings, row.lon, row.lat)


def test_nearness_across_the_antimeridian(spark):
    rng = random.Random(3)
    east = [(179.2, -1.0), (179.99, -1.0), (179.99, 1.0), (179.2, 1.0)]
    west = [(-179.9, 2.0), (-179.0, 2.0), (-179.0, 4.0), (-179.9, 4.0)]
    long = [(10.0, 60.0), (30.0, 70.0), (30.0, 70.001)]
    shapes = {"east": [east], "west": [west], "long": [long]}
    points = [(i, rng.uniform(-1.3, 4.3), (rng.uniform(178.9, 181.2) + 180) % 360 - 180) for i in range(400)]
    points += [(400 + i, 60 + t * 10 + rng.uniform(-0.3, 0.3), 10 + t * 20 + rng.uniform(-0.3, 0.3)) for i, t in enumerate(rng.random() for _ in range(200))]
    limit = 15000.0

    def metres(y, x, ring):
        best = 9e9
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            scale = math.cos(math.radians(y)) * S.M_PER_DEG
            ax, ay = ((x1 - x + 180) % 360 - 180) * scale, (y1 - y) * S.M_PER_DEG
            dx, dy = (x2 - x1) * scale, (y2 - y1) * S.M_PER_DEG
            t = max(0.0, min(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
            best = min(best, math.hypot(ax + t * dx, ay + t * dy))
        return round(best, 6)
    got = {r.point_id: (r.distance_m, r.shape_id) for r in P.nearest_polygon(spark.createDataFrame(points, POINT), spark.createDataFrame(list(shapes.items()), SHAPE), limit).collect()}
    want = {i: best for i, y, x in points for best in [min((metres(y, x, r[0]), k) for k, r in shapes.items())] if best[0] <= limit}
    assert got.keys() == want.keys() and len(want) > 100
    assert all(abs(got[i][0] - want[i][0]) < 1e-4 and got[i][1] == want[i][1] for i in want)
    assert {k for _, k in want.values()} == set(shapes) and any(x < 0 and got.get(i, (0, ""))[1] == "east" for i, _, x in points[:400])
    # a long slanted edge lies in the cells it crosses, not in all of its bounding box
    edges = S.edges_of(spark.createDataFrame([("long", [long])], SHAPE)).withColumn("n", F.size(S.crossed_cells(F.lit(0.0937))))
    assert edges.agg(F.max("n")).first()[0] <= 20 / 0.0937 + 10.001 / 0.0937 + 2  # its bounding box holds 22,000


def test_no_points_and_no_shapes(spark):
    table, points = spark.createDataFrame([], SHAPE), spark.createDataFrame([(1, 1.0, 1.0)], POINT)
    full = spark.createDataFrame([(k, v) for k, v in shapes_of().items()], SHAPE)
    assert P.point_in_polygon(points, table).collect() == [] and P.nearest_polygon(points, table).collect() == []
    assert P.point_in_polygon(spark.createDataFrame([], POINT), full).collect() == []
    assert P.polygon_in_view(spark.createDataFrame([], BOX), full).collect() == [] and geo.bits_for(15000.0) == 10


def test_nearest_postcode(spark):
    """A dense town, lone postcodes, points far from all, and both sides of 180 degrees."""
    rng = random.Random(9)
    codes = [(f"T{i:04d}", 52.0 + rng.uniform(0, 0.02), 1.0 + rng.uniform(0, 0.02)) for i in range(1500)] + [("LONE", 52.0, 1.25), ("EAST", 52.3, 179.99), ("WEST", 52.3, -179.97)]
    codes += [("AAAA", *codes[0][1:])]
    rows = [(p, y, x, "live", "England") for p, y, x in codes] + [("DEAD", 52.0, 1.3, "terminated", "England"), ("NONE", 52.0, 1.31, "live", None)]
    points = [(i, 52.0 + rng.uniform(-0.2, 0.2), 1.0 + rng.uniform(-0.2, 0.4)) for i in range(150)] + [(200, 52.3, 179.999), (201, 52.3, -179.999), (202, 10.0, 10.0), (203, codes[0][1], codes[0][2]), (204, None, 1.0)]
    got = {r.point_id: (round(r.distance_m, 3), r.postcode) for r in P.knn_postcode(
        spark.createDataFrame(points, POINT), spark.createDataFrame(rows, "postcode string, lat double, lon double, status string, uk_country string")).collect()}

    def metres(a, b):
        p, q = math.radians(a[0]), math.radians(b[0])
        x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return round(2 * 6371008.771415 * math.asin(math.sqrt(x)), 3)
    want = {i: best for i, y, x in points if y is not None for best in [min((metres((y, x), c[1:]), c[0]) for c in codes)] if best[0] <= 25000}
    assert got == want and len(want) > 100 and got[203] == (0.0, "AAAA")
