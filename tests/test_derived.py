import datetime
import os
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from lamina.functions import numbers, variant
from lamina.operators import reach, sheet, sketches
from lamina.sources.listing import FolderListing

TEXTS = ["true", "false", " true ", "12", "-0.5", "1e3", "0x1F", "0", "", None, "x", "True", "12px", "9007199254740993", "1e400", "door.open"]


def test_values_keep_their_kind(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    rows = df.select("t", variant.kind(variant.typed(F.col("t"))).alias("kind"), variant.text(variant.typed(F.col("t"))).alias("text"), numbers.state_value(F.col("t")).alias("plain")).collect()
    assert [(x.kind, x.text) for x in rows] == [(x.plain.kind, x.plain.value) for x in rows]


def test_matches_as_texts_do(spark):
    wanted = ["", None, "true", "12", "12.0", "0", "x", "false", "31", "1e400"]
    df = spark.createDataFrame([(t, w) for t in TEXTS for w in wanted], "t string, w string")
    v, s = variant.typed(F.col("t")), numbers.state_value(F.col("t"))
    for x in df.select("t", "w", variant.matches(v, F.col("w")).alias("typed"), numbers.state_matches(s["kind"], s["value"], F.col("w")).alias("plain")).collect():
        assert x.typed == x.plain, (x.t, x.w)


def test_objects_take_any_key_and_survive_json(spark):
    df = spark.createDataFrame([(1, {"a.b": "1", "$": "true", "k": "v"}), (2, {}), (3, None)], "n int, state map<string,string>")
    put = df.select("n", variant.put(variant.typed_state(F.col("state")), "k", F.lit(2.5).cast("variant")).alias("v")).withColumn("v", F.parse_json(F.to_json("v")))
    at = lambda k: variant.get(variant.entries(F.col("v")), k)
    got = {x.n: (x.a, x.b, x.c, x.size) for x in put.select("n", variant.text(at("a.b")).alias("a"), variant.kind(at("$")).alias("b"), variant.text(at("k")).alias("c"), F.size(variant.entries(F.col("v"))).alias("size")).collect()}
    assert got == {1: ("1", "boolean", "2.5", 3), 2: (None, None, "2.5", 1), 3: (None, None, "2.5", 1)}
    odd = spark.range(1).select(F.parse_json(F.lit("[1]")).alias("v")).select(F.size(variant.entries(F.col("v"))).alias("n")).first().n
    assert odd == 0


def shortest(links, starts):
    ways, out = {}, {s: 0 for s in starts if s is not None}
    for a, b in links:
        ways.setdefault(a, []).append(b)
    queue = deque(out)
    while queue:
        a = queue.popleft()
        for b in ways.get(a, []) if a is not None else []:
            if b is not None and b not in out:
                out[b] = out[a] + 1
                queue.append(b)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_reached_nodes_are_those_of_a_search(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(110)] + [(100 + k, 101 + k) for k in range(12)] + [(112, 100), (5, 100), (3, 3), (None, 4), (4, None)]
    links += [(7, 200 + k) for k in range(300)] + links[:20]
    starts = [1, 7, 7, 5, None, 999]
    got = reach.reachable(spark.createDataFrame(links, "source int, target int"), spark.createDataFrame([(s,) for s in starts], "s int")).collect()
    assert {x.node: x.steps for x in got} == shortest(links, starts) and len(got) == len({x.node for x in got})


def test_nothing_is_reached_from_nothing(spark):
    none = spark.createDataFrame([], "source string, target string")
    assert reach.reachable(none, none.select("source")).count() == 0
    assert [tuple(x) for x in reach.reachable(none, spark.createDataFrame([("a",)], "s string")).collect()] == [("a", 0)]


def test_sketches_of_days_merge_to_what_the_whole_gives(spark):
    r, day = random.Random(5), datetime.datetime(2024, 1, 1)
    rows = [(day + datetime.timedelta(days=r.randrange(90)), r.choice("ab"), r.randrange(3000), r.choice([None, float("nan"), r.gauss(0, 1)])) for _ in range(20000)] + [(None, "a", 1, 1.0), (day, "empty", None, None)]
    df = spark.createDataFrame(rows, "ts timestamp, k string, u int, v double")
    months = sketches.merged(sketches.daily(df, "ts", ["k"], F.col("u"), F.col("v")), "month", ["k"])
    years = sketches.merged(months, "year", ["k"]).select("k", "n", sketches.distinct_estimate().alias("u"), sketches.quantile(0.5).alias("q"), "least", "most")
    for x in years.collect():
        own = [t for t in rows if t[1] == x.k and t[0] is not None]
        values, users = sorted(t[3] for t in own if t[3] is not None and t[3] == t[3]), len({t[2] for t in own if t[2] is not None})
        assert x.n == len(own) and abs(x.u - users) <= 5 * sketches.STANDARD_ERROR * users
        if values:
            assert (x.least, x.most) == (values[0], values[-1]) and abs(sum(v < x.q for v in values) / len(values) - 0.5) <= sketches.RANK_ERROR + 1 / len(values)
        else:
            assert x.q is None


def test_a_listing_follows_its_folder(spark, tmp_path):
    folder = tmp_path / "images"
    folder.mkdir()

    def put(name, size, at):
        (folder / name).write_bytes(b"x" * size)
        os.utime(folder / name, (at, at))

    def names():
        return [(x.name, x.size) for x in listing.read().collect()]

    put("a.png", 3, 1_700_000_000)
    put("b.txt", 3, 1_700_000_001)
    listing = FolderListing(spark, str(folder), str(tmp_path / "home"))
    assert listing.refresh() == {"new": 2, "overwritten": 0, "deleted": 0} and names() == [("a.png", 3)]
    put("c.webp", 5, 1_700_000_100)
    put("d e.gif", 1, 1_700_000_100)
    assert listing.refresh() == {"new": 2, "overwritten": 0, "deleted": 0} and names() == [("c.webp", 5), ("d e.gif", 1), ("a.png", 3)]
    version = listing.table.commits()[-1]["version"]
    assert listing.refresh() == {"new": 0, "overwritten": 0, "deleted": 0} and listing.table.commits()[-1]["version"] == version
    put("a.png", 9, 1_700_000_200)
    (folder / "c.webp").unlink()
    assert FolderListing(spark, str(folder), str(tmp_path / "home")).refresh() == {"new": 0, "overwritten": 1, "deleted": 1}
    assert names() == [("a.png", 9), ("d e.gif", 1)] and [x.name for x in listing.read(version).collect()] == ["c.webp", "d e.gif", "a.png"]


def test_projections_have_both_axes_and_the_total(spark):
    r = random.Random(9)
    pixels = [(r.choice(["s", "t"]), r.randrange(6), r.randrange(4), r.choice([0, 24, 25, 255])) for _ in range(90)]
    seen = {p[:3] for p in pixels if p[3] > 24}
    want = {}
    for s, x, y in seen:
        for k in ((s, "x", x), (s, "y", y), (s, None, None)):
            want[k] = want.get(k, 0) + 1
    got = sheet.projections(spark.createDataFrame(pixels, "sheet_id string, x int, y int, a int"), total=True).collect()
    assert {(g.sheet_id, g.axis, g.i): g.n for g in got} == want and len(got) == len(want)
