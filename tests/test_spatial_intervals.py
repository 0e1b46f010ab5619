import math
import random

import pytest

from lamina.operators.intervals import as_of, overlaps
from lamina.operators.spatial import nearest_boxes

BOX = "box bigint, grp string, left double, top double, right double, bottom double, level string"
POINT = "point bigint, grp string, px double, py double, t string"


def brute_nearest(points, boxes):
    out = {}
    for p, g, x, y, _ in points:
        if x is None or math.isnan(x):
            continue
        found = [(math.hypot(max(a - x, x - c, 0), max(b - y, y - d, 0)), k) for k, h, a, b, c, d, _ in boxes if g is not None and h == g and None not in (a, b, c, d)]
        if found:
            out[p] = min(found)
    return out


@pytest.mark.parametrize("tile", [1.0, 16.0, 1000.0])
def test_nearest_box_is_that_of_all_pairs(spark, tile):
    r = random.Random(7)
    boxes = []
    for k in range(900):
        g = "hot" if k % 3 == 0 else r.choice("abc")
        x, y, w, h = r.uniform(-500, 500), r.uniform(-300, 300), r.choice([0, 1, 5, 80, 700]), r.choice([0, 2, 30])
        x, y = (x / 20, y / 20) if g == "hot" and k % 2 else (x, y)
        boxes.append((k, g, x, y, x + w, y + h, None))
    boxes += [(900, "far", 9000.0, 9000.0, 9001.0, 9001.0, None), (901, "far", None, 0.0, 1.0, 1.0, None), (902, None, 0.0, 0.0, 1.0, 1.0, None), (903, "tie", 3.0, 0.0, 4.0, 1.0, None), (904, "tie", -4.0, 0.0, -3.0, 1.0, None)]
    points = [(k, r.choice(["hot", "a", "b", "c", "far", "none", None]), r.uniform(-2000, 2000), r.uniform(-400, 400), None) for k in range(250)]
    points += [(250, "tie", 0.0, 0.5, None), (251, "a", None, 1.0, None), (252, "a", float("nan"), 1.0, None), (253, "hot", 0.0, 0.0, None)]
    got = {x.point: (x.distance, x.box) for x in nearest_boxes(spark.createDataFrame(points, POINT), spark.createDataFrame(boxes, BOX), tile).collect()}
    want = brute_nearest(points, boxes)
    assert got.keys() == want.keys() and all(got[p][1] == want[p][1] and abs(got[p][0] - want[p][0]) < 1e-9 for p in want)


@pytest.mark.parametrize("boxes_of_a_tile, cell, rows", [(3, 2.0, 0), (20, 0.5, 50_000), (3, 16.0, 40)])
def test_tiles_of_few_boxes_and_of_many(spark, monkeypatch, boxes_of_a_tile, cell, rows):
    from lamina.operators import spatial

    for name, value in (("BOXES", boxes_of_a_tile), ("CELL", cell), ("BROADCAST_ROWS", rows)):
        monkeypatch.setattr(spatial, name, value)
    r = random.Random(11)
    boxes = []
    for k in range(700):  # "a": a cloud in a wide field; "line": without height; "one": the same box again and again
        g = r.choice(["a", "a", "line", "one"])
        x, y, w, h = r.uniform(-900, 900), r.uniform(-900, 900), r.choice([0, 3, 40, 1500]), r.choice([0, 7, 60])
        x, y, w, h = {"a": (x / 90, y / 90, w / 30, h / 30) if k % 4 else (x, y, w, h), "line": (x, -5.0, w, 0), "one": (2.0, 3.0, 1, 1)}[g]
        boxes.append((k, g, x, y, x + w, y + h, None))
    points = [(k, r.choice(["a", "line", "one"]), r.uniform(-1500, 1500) / r.choice([1, 90]), r.uniform(-1500, 1500) / r.choice([1, 90]), None) for k in range(200)]
    got = {x.point: (x.distance, x.box) for x in nearest_boxes(spark.createDataFrame(points, POINT), spark.createDataFrame(boxes, BOX), 8.0).collect()}
    want = brute_nearest(points, boxes)
    assert got.keys() == want.keys() and all(got[p][1] == want[p][1] and abs(got[p][0] - want[p][0]) < 1e-9 for p in want)


def test_no_boxes_or_points(spark):
    points, boxes = spark.createDataFrame([(1, "a", 0.0, 0.0, None)], POINT), spark.createDataFrame([(1, "a", 0.0, 0.0, 1.0, 1.0, None)], BOX)
    assert nearest_boxes(points, boxes.limit(0), 1.0).count() == 0 and nearest_boxes(points.limit(0), boxes, 1.0).count() == 0


@pytest.mark.parametrize("width", [3.0, 50.0, 1e6])
def test_as_of_carries_the_last_value(spark, width):
    r = random.Random(3)
    left = [(k, r.choice(["hot", "hot", "a", "b", "none", None]), r.choice([None, *range(-20, 400)]), "x") for k in range(400)]
    right = [(r.choice(["hot", "hot", "a", "b", None]), r.choice([None, *range(0, 380, 7)]), k, r.choice([None, "v", "w"])) for k in range(300)]
    got = {x.id: x.found for x in as_of(spark.createDataFrame(left, "id bigint, key string, at bigint, slice string"), spark.createDataFrame(right, "key string, at bigint, n bigint, v string"), "key", "at", _value(), width, _order()).collect()}
    want = {}
    for k, key, at, _ in left:
        found = [(t, n, v) for g, t, n, v in right if key is not None and at is not None and g == key and t is not None and t <= at]
        want[k] = f"{max(found, key=lambda x: x[:2])[2]}" if found else None
    assert {k: v for k, v in got.items()} == {k: None if v is None else v for k, v in want.items()}


def _value():
    from pyspark.sql import functions as F

    return F.coalesce("v", F.lit("None"))


def _order():
    from pyspark.sql import functions as F

    return F.col("n")


@pytest.mark.parametrize("least", [1, 10])
def test_overlaps_are_those_of_all_pairs(spark, least):
    r = random.Random(5)
    row = lambda k: (k, r.choice(["hot", "hot", "a", None]), (s := r.randrange(-300, 300)), r.choice([None, s, s - 2, s + 1, s + 10, s + r.randrange(1, 200), s + 5000]), "x")
    a, b = [row(k) for k in range(200)], [row(k) for k in range(150)]
    df = lambda rows: spark.createDataFrame(rows, "id bigint, key string, s bigint, e bigint, level string")
    got = sorted((x.a.id, x.b.id) for x in overlaps(df(a), df(b), "key", "s", "e", least).collect())
    want = sorted((i, j) for i, g, s, e, _ in a for j, h, t, f, _ in b if g is not None and g == h and None not in (s, e, t, f) and s < e and t < f and s < f and t < e)
    assert got == want and len(set(got)) == len(got)
