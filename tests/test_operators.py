"""Operators on small fixtures, with ties, nulls and bounds."""

import random

import pytest
from pyspark.sql import functions as F

from lamina import schema
from lamina.operators import dedupe, frames, lookup, ordered, scene, sheet
from lamina.sources import library

def now():
    return F.lit("2024-01-02 03:04:05").cast("timestamp")


def layers(spark, *rows):
    """One scene whose layers have the given fields."""
    names = sorted({k for r in rows for k in r})
    kind = {"x": "double", "y": "double", "width": "double", "height": "double", "scale": "double", "zIndex": "double", "opacity": "double", "parallax": "double", "visible": "boolean", "locked": "boolean"}
    base = spark.createDataFrame([([tuple(r.get(n) for n in names) for r in rows],)], "l array<struct<" + ", ".join(f"{n}: {kind.get(n, 'string')}" for n in names) + ">>")
    return base.select(F.from_json(F.to_json("l"), f"ARRAY<{schema.LAYER}>").alias("layers"))


def test_keyed_lookup_last_wins(spark):
    assets = spark.createDataFrame([("a", "old", 0), ("b", "b", 1), ("a", "new", 2)], "id string, name string, ordinal int")
    rows = spark.createDataFrame([("a",), ("c",)], "id string")
    assert sorted(map(tuple, lookup.keyed(rows, assets, "id", "left", "ordinal").collect())) == [("a", "new"), ("c", None)]
    assert [tuple(r) for r in lookup.keyed(rows, assets, "id", "inner", "ordinal").collect()] == [("a", "new")]


def test_priority_clip(spark):
    df = spark.createDataFrame([(["x", "y", "z"], "y", "z"), (["x", "y"], "q", "y"), (["x", "y"], None, None), ([], "x", "x"), (None, "x", "x")], "ids array<string>, a string, d string")
    clips = F.transform("ids", lambda i: F.struct(i.alias("id")))
    assert [r[0] for r in df.select(lookup.priority_clip(clips, F.col("a"), F.col("d"))["id"]).collect()] == ["y", "y", "x", None, None]


def test_nearest_first_then_reach(spark):
    points = spark.createDataFrame([("s1", 0.0), ("s2", 100.0), ("s3", 999.0)], "scene string, px double")
    boxes = spark.createDataFrame([("a", 5.0, 1.0, 0), ("b", 10.0, 50.0, 1), ("c", 95.0, 9.0, 2), ("d", 105.0, 9.0, 3)], "box string, bx double, radius double, ordinal int")
    got = lookup.nearest_in_reach(points, boxes, "scene", F.abs(F.col("px") - F.col("bx")), F.col("radius"), ["ordinal"], F.lit(True))
    assert sorted((r.scene, r.box) for r in got.collect()) == [("s2", "c")]  # s1: a is nearest but out of its reach; s2: tie by order


def test_binding_match_and_owner(spark):
    rows = [(0, "l0", "sprite", True, [("c1", "KeyA")]), (1, "l1", "sprite", False, [("c2", "KeyB")]), (2, "l2", "effect", True, [("c3", "keya"), ("c4", "KEYB")]), (3, "l3", "background", True, [("c5", "KeyC")])]
    bound = lambda c: F.struct(c["id"].alias("id"), F.struct(F.lit("keyboard").alias("triggerType"), c["v"].alias("triggerValue")).alias("binding"))
    df = spark.createDataFrame(rows, "ordinal int, layer_id string, type string, visible boolean, c array<struct<id: string, v: string>>").withColumn("animations", F.transform("c", bound))
    own = spark.createDataFrame([(0, "a0", [("c", "KeyX")], "KeyZ"), (1, "a1", [], "KeyA"), (2, "a2", None, "keyz"), (3, "a3", None, "KeyC")], "ordinal int, id string, c array<struct<id: string, v: string>>, b string")
    own = own.withColumn("animations", F.transform("c", bound)).withColumn("binding", F.struct(F.lit("keyboard").alias("triggerType"), F.col("b").alias("triggerValue")))
    keys = spark.createDataFrame([("KeyA",), ("keyb",), ("KeyZ",), ("KeyQ",), ("KeyC",)], "code string")
    got = sorted(map(tuple, lookup.binding_match(df, keys, own).collect()))
    assert got == [("KeyA", "l0", "c1", None), ("KeyC", None, None, "a3"), ("KeyZ", None, None, "a2"), ("keyb", "l2", "c4", None)]
    assets = spark.createDataFrame([("a", 0, ("s1",), [("s9",)]), ("b", 1, ("s9",), None)], "id string, ordinal int, sprite struct<id: string>, n array<struct<id: string>>").withColumn("animations", F.transform("n", lambda x: F.struct(x.alias("sprite")))).drop("n")
    assert [r.id for r in lookup.owner_of_sprite(assets, "s9").collect()] == ["a"] and lookup.owner_of_sprite(assets, "no").count() == 0


def test_flatten_links_and_counts(spark):
    ls = spark.createDataFrame([("l1", "a"), ("l2", "b"), ("l3", None)], "layer string, assetId string")
    assets = spark.createDataFrame([("a", "A", "sa", ["c1", "c2"]), ("b", "B", "sb", [])], "id string, name string, sprite string, n array<string>").withColumn("animations", F.transform("n", lambda c: F.struct(c.alias("id"), F.lit(None).cast("string").alias("sprite")))).drop("n")
    got = sorted((r.layer, r.clip and r.clip.id, r.sprite) for r in lookup.flatten_clips(ls, assets).collect())
    assert sorted(got, key=repr) == sorted([("l1", "c1", "sa"), ("l1", "c2", "sa"), ("l2", None, "sb")], key=repr)
    assert lookup.missing_rows(spark.createDataFrame([("a", 1), ("z", 2)], "k string, v int"), spark.createDataFrame([("a", 9)], "k string, v int"), "k").count() == 2
    linked = spark.createDataFrame([("l", "scene-link", "s1"), ("m", "scene-link", "no"), ("n", "subtitle", "s1")], "id string, a string, t string").select("id", F.struct(F.col("a").alias("actionType"), F.col("t").alias("targetSceneId")).alias("interaction"))
    got = lookup.linked_scenes(linked, spark.createDataFrame([("s1", "One")], "id string, name string")).select("id", "status", "targetName").collect()
    assert sorted(map(tuple, got)) == [("l", "go", "One"), ("m", "fail", None)]


def test_library_documents(spark, tmp_path):
    def read(content):
        p = tmp_path / f"{random.random()}.json"
        if content is not None:
            p.write_bytes(content)
        r = library.read_library(spark, str(p), now()).first()
        return len(r.assets), len(r.scenes), r.updatedTime

    empty = "2024-01-02T03:04:05.000Z"
    assert read(None) == read(b"{broken") == read(b"") == (0, 0, empty)
    assert read("﻿".encode() + b'{"assets": [{"id": "a"}], "scenes": {}, "updatedTime": "t"}') == (1, 0, "t")
    assert read(b'{"assets": 5, "scenes": [{"id": "s", "layers": []}]}') == (0, 1, empty)
    lib = library.parsed_library(spark.createDataFrame([('{"assets": [{"id": "a"}, {"id": "b"}]}',)], "value string"), now())
    library.write_library(lib, str(tmp_path / "out"), now())
    again = library.read_libraries(spark, str(tmp_path / "out"))
    assert [(r.ordinal, r.id) for r in library.rows_of(again, "assets").collect()] == [(0, "a"), (1, "b")] and again.first().updatedTime == empty


def test_listing_and_latest(spark, tmp_path):
    import os

    for k, name in enumerate(("b.PNG", "a.png", "x.txt", "noext", "c d.gif")):
        (tmp_path / name).write_bytes(b"x" * (k + 1))
        os.utime(tmp_path / name, (1000, 1000 if k < 2 else 2000))
    assert [(r.name, r.extension, r.size) for r in library.list_images(spark, str(tmp_path)).collect()] == [("c d.gif", "gif", 5), ("a.png", "png", 2), ("b.PNG", "png", 1)]
    c = spark.createDataFrame([(2, "m2", True), (1, "m1", False), (3, "m3", True)], "priority int, manifest string, readable boolean")
    assert library.latest(c).first()[0] is None and library.latest(c.filter("priority > 1")).first()[0] == "m2"


def test_upsert_and_cascade(spark):
    base = spark.createDataFrame([("a", 0, "s0", "u0"), ("b", 1, "s1", "u1")], "id string, ordinal int, savedTime string, updatedTime string")
    new = spark.createDataFrame([("b", 0, None, None), ("c", 1, "mine", None)], base.schema)
    got = library.renumbered(library.upsert(base, new, "id", now()), "side", "ordinal")
    assert [(r.id, r.ordinal, r.savedTime, r.updatedTime[:4]) for r in got.orderBy("ordinal").collect()] == [("b", 0, "2024-01-02T03:04:05.000Z", "2024"), ("c", 1, "mine", "2024"), ("a", 2, "s0", "u0")]
    assets = spark.createDataFrame([("a",), ("b",)], "id string")
    scenes = spark.createDataFrame([("s", [("l1", "a"), ("l2", None), ("l3", "b")]), ("t", None)], "id string, layers array<struct<id: string, assetId: string>>")
    left, kept = library.delete_asset(assets, scenes, "a")
    assert [r.id for r in left.collect()] == ["b"] and {r.id: [x.id for x in r.layers] for r in kept.collect()} == {"s": ["l2", "l3"], "t": []}
    assert library.delete_asset(assets, scenes, "none")[0].count() == 2
    assert [r.id for r in library.delete_scene(scenes, "s").collect()] == ["t"]
    with pytest.raises(Exception, match="Scene not found"):
        library.delete_scene(scenes, "none").collect()
    good, bad = library.checked_scenes(scenes)
    assert (good.count(), bad.count()) == (1, 1)


def test_scene_normalisation(spark):
    df = layers(spark, {"id": "b", "type": "background", "y": 0.0, "width": 0.0, "scale": 0.0, "parallax": 0.0, "locked": True}, {"id": "c", "type": "background", "y": 5.0, "width": 30.0, "fit": "cover"}, {"id": "s", "type": "sprite"})
    out = df.select(scene.normalised(F.struct("layers", F.lit(100.0).alias("width"), F.lit(50.0).alias("height"))).alias("l")).first().l
    b, c, s = out
    assert (b.y, b.width, b.height, b.scale, b.parallax, b.opacity, b.locked, b.fit) == (50, 100, 50, 1, 0, 1, False, "stretch")
    assert (c.y, c.width, c.height, c.fit, c.position) == (5, 30, 50, "cover", "left center") and s.scale is None
    df = layers(spark, {"id": "1", "assetId": "kit"}, {"id": "2"}, {"id": "3", "assetId": "own"})
    assert [x.id for x in df.select(scene.without_built_ins(F.col("layers"), ["kit"]).alias("l")).first().l] == ["2", "3"]


def test_frame_resize(spark):
    df = layers(spark, {"id": "b", "type": "background", "y": 51.0, "width": 101.0, "height": 50.0}, {"id": "c", "type": "background", "y": 10.0, "width": 60.0, "height": 20.0})
    df = df.select("layers", F.lit(100.0).alias("width"), F.lit(50.0).alias("height"), F.lit(None).cast("double").alias("viewportWidth"), F.lit(0.0).alias("viewportHeight"), F.lit(90.0).alias("cameraX"))
    r = scene.resized(df, F.lit(150.0), F.lit(80.0)).first()
    assert (r.width, r.height, r.viewportWidth, r.viewportHeight, r.cameraX) == (150, 80, 150, 80, 0)
    assert [(x.width, x.height, x.y) for x in r.layers] == [(150, 80, 80), (60, 20, 10)]


def test_layer_edits(spark):
    df = layers(spark, {"id": "b", "type": "background", "imageUrl": "u"}, {"id": "s", "type": "sprite", "x": 1.005, "y": 0.0, "zIndex": 1.0, "locked": False, "name": "S"}, {"id": "k", "type": "sprite", "locked": True})
    do = lambda c: {x.id: x for x in df.select(c.alias("l")).first().l}
    assert do(scene.patch_layer(F.col("layers"), "s", {"x": F.lit(9.0)}))["s"].x == 9 and do(scene.patch_unlocked(F.col("layers"), "k", {"x": F.lit(9.0)}))["k"].x is None
    assert set(do(scene.deleted(F.col("layers"), "s"))) == {"b", "k"} and set(do(scene.deleted(F.col("layers"), "k"))) == {"b", "s", "k"}
    cleared = do(scene.deleted(F.col("layers"), "b"))["b"]
    assert (cleared.imageUrl, cleared.color, cleared.name) == (None, "#000000", "Black Background")
    copy = df.select(scene.copied_layer(F.get("layers", F.lit(1)), "copy", 2, F.lit(7.0), "new").alias("c")).first().c
    assert (copy.id, copy.name, copy.y, copy.zIndex) == ("new", "S copy", 48, 7)
    bg = df.select(scene.background_from(F.get("layers", F.lit(0)), F.get("layers", F.lit(1))).alias("c")).first().c
    assert (bg.id, bg.type, bg.x) == ("b", "background", 1.005)


def test_interactions(spark):
    df = spark.createDataFrame([(["interactable"], None, "interact"), (["x"], None, "go"), (["x"], 5.0, "go"), (None, None, None)], "tags array<string>, r double, action string")
    own = F.when(F.col("r").isNotNull(), F.from_json(F.to_json(F.struct(F.col("r").alias("triggerRadius"))), schema.INTERACTION))
    layer = F.struct(F.coalesce(own, F.lit(None).cast(schema.INTERACTION)).alias("interaction"))
    asset = F.struct(F.lit("a").alias("id"), F.lit("Box").alias("name"), "tags", F.struct(F.col("action").alias("actionName"), F.lit("KeyF").alias("triggerValue")).alias("binding"))
    got = [r.i for r in df.select(scene.interaction_of(layer, asset).alias("i")).collect()]
    assert (got[0].promptText, got[0].promptKey, got[0].triggerRadius) == ("Interact", "F", 180) and got[1] is None and got[3] is None
    assert (got[2].promptText, got[2].triggerRadius, got[2].preset) == ("Box", 5, "inspect")


def test_clips_and_filters(spark):
    asset = F.from_json(F.lit('{"id":"a","defaultAnimationId":"y","sprite":{"id":"s0"},"animations":[{"id":"x","sprite":{"id":"s1"}},{"id":"y","sprite":{"id":"s2"},"binding":{"actionName":"go"}}]}'), schema.ASSET)
    r = spark.range(1).select(scene.patched_clip(asset, "y", {"name": F.lit("N")}, {"triggerValue": F.lit("KeyZ")}).alias("a")).first().a
    assert (r.sprite.id, r.binding.triggerValue, r.animations[1].name, r.animations[0].name) == ("s2", "KeyZ", "N", None)
    new = F.from_json(F.lit('{"id":"s9"}'), schema.SPRITE)
    r = spark.range(1).select(scene.replaced_sprite(asset, "s1", new).alias("a")).first().a
    assert (r.sprite.id, [c.sprite.id for c in r.animations]) == ("s0", ["s9", "s2"])
    light = lambda p: F.from_json(F.lit('{"preset":"%s","brightness":1,"contrast":1.04,"saturate":0.5,"rimLightColor":"#000000","rimLightOpacity":0.2,"edgeLightColor":"#ffffff","edgeLightOpacity":1}' % p), schema.LAYER_LIGHT)
    none = F.lit(None).cast(schema.LAYER_LIGHT)
    text = lambda *a: spark.range(1).select(scene.render_filter(*a)).first()[0]
    assert text(light("none"), none, F.lit("npc"), light("x")) == "none" and text(light("n"), none, F.lit("npc"), light("x")) == "brightness(1) contrast(1.04) saturate(0.5)"
    assert "rgba(0, 0, 0, 0.2)" in text(light("none"), none, F.lit("player"), light("x"))


def loop_runs(counts, threshold, gap, least):
    runs, start = [], None
    for i, v in enumerate([*counts, threshold]):
        if v > threshold and start is None:
            start = i
        if v <= threshold and start is not None:
            if runs and start - runs[-1][1] <= gap:
                runs[-1][1] = i
            else:
                runs.append([start, i])
            start = None
    return [tuple(r) for r in runs if r[1] - r[0] >= least]


def test_runs(spark):
    r = random.Random(1)
    cases = {"f": ([0, 0, 5, 5, 0, 0, 5, 5, 5, 0, 0, 0, 0, 0, 5], 3, 2, 2)} | {f"r{k}": ([r.randrange(8) for _ in range(60)], r.randrange(6), r.randrange(4), r.randrange(1, 5)) for k in range(30)}
    rows = [(n, i, v, t, g, m) for n, (c, t, g, m) in cases.items() for i, v in enumerate(c)]
    df = spark.createDataFrame(rows, "k string, i int, v int, t int, g int, m int")
    got = {n: [] for n in cases}
    for x in ordered.projection_runs(df, ["k"], "i", "v", F.col("t"), F.col("g"), F.col("m")).orderBy("k", "start").collect():
        got[x.k].append((x.start, x.end))
    assert got == {n: loop_runs(*c) for n, c in cases.items()} and got["f"] == [(2, 9)]


def test_bounds(spark):
    def bounds(runs, expected, size):
        df = spark.createDataFrame([(runs,)], "r array<struct<start: int, end: int>>")
        return df.select(ordered.run_bounds(F.col("r"), F.lit(expected), F.lit(size))).first()[0]

    assert bounds([(10, 20), (40, 50), (70, 80)], 3, 100) == [0, 30, 60, 90]
    assert bounds([(10, 20)], 1, 100) == [0, 100] and bounds([(10, 20)], 2, 100) is None and bounds(None, 2, 100) is None
    assert bounds([(10, 11), (11, 12)], 2, 3) is None  # not rising
    assert bounds([(0, 10), (12, 20), (50, 60)], 3, 58) == [0, 10, 36, 58]


def test_reorder(spark):
    rows = [("s", n, z, k) for k, (n, z) in enumerate([("a", 5), ("b", 9), ("c", 5), ("d", 1)])]
    df = spark.createDataFrame(rows, "scene string, id string, zIndex int, ordinal int")
    order = lambda s, t: [r.id for r in scene.reordered(df, "scene", s, t).orderBy(F.desc("zIndex")).collect()]
    assert order("d", "b") == ["d", "b", "a", "c"] and order("b", "c") == ["a", "c", "b", "d"] and order("a", "a") == ["b", "a", "c", "d"]
    assert {r.id: r.zIndex for r in scene.reordered(df, "scene", "a", "no").collect()} == {"a": 5, "b": 9, "c": 5, "d": 1}
    assert sorted(r.zIndex for r in scene.reordered(df, "scene", "c", "a").collect()) == [10, 20, 30, 40]


def test_names_tails_and_tops(spark):
    free = lambda names: ordered.first_free_name(spark.createDataFrame([(x,) for x in names], "n string"), "n", "A.b").first()[0]
    assert free([]) == free([None, "A.b Copy 2"]) == "A.b Copy" and free(["A.b Copy", "A.b Copy 2", "Axb Copy 3"]) == "A.b Copy 3" and free(["A.b Copy", "A.b Copy 3", "A.b Copy 02"]) == "A.b Copy 2"
    df = spark.createDataFrame([(list(range(100)),), (list(range(5)),), ([],)], "a array<int>")
    assert [r[0] for r in df.select(ordered.tail(F.col("a"), 80)).collect()] == [list(range(20, 100)), list(range(5)), []]
    assert [(len(r[0].shown), r[0].more) for r in df.select(ordered.head_and_more(F.col("a"), 24)).collect()] == [(24, 76), (5, 0), (0, 0)]
    assert [r[0] and r[0][-1] for r in df.select(ordered.padded(F.col("a"), F.lit(7))).collect()] == [6, 4, None]
    z = spark.createDataFrame([("s", 1, 0), ("s", 3, 1), ("s", 3, 2)], "k string, zIndex int, ordinal int")
    assert ordered.top_by_z(z, "k").first().ordinal == 1


def test_greedy_dedupe(spark):
    def loop(rows):
        seen, out = set(), []
        for o, *keys in rows:
            keys = {(k, v) for k, v in enumerate(keys) if v is not None}
            if not keys & seen:
                seen |= keys
                out.append(o)
        return out

    chain = [(0, "k1", "u1"), (1, "k2", "u1"), (2, "k2", "u2"), (3, None, None), (4, None, "u2")]
    r = random.Random(5)
    for rows in (chain, [(k, f"a{r.randrange(25)}", f"b{r.randrange(25)}" if r.random() < 0.8 else None) for k in range(80)]):
        df = spark.createDataFrame(rows, "o int, a string, b string")
        assert sorted(x.o for x in dedupe.greedy(df, "o", [F.col("a"), F.col("b")]).collect()) == loop(rows)
    assert loop(chain) == [0, 2, 3]


def test_gallery(spark):
    sprite = lambda i, url: '{"id":"%s","frames":["f"],"spritesheetPng":"%s"}' % (i, url)
    assets = spark.createDataFrame([(0, "npc", "A", '{"animations":[{"name":"","sprite":%s},{"name":"c2","sprite":%s}]}' % (sprite("s1", "u1"), sprite("s2", "u1"))), (1, "prop", "B", '{"sprite":%s}' % sprite("s3", "u3"))], "ordinal int, role string, name string, j string")
    assets = assets.withColumn("x", F.from_json("j", schema.ASSET)).select("ordinal", "role", "name", "x.animations", "x.sprite")
    sprites = spark.createDataFrame([(0, '{"id":"s2","characterName":"two","frames":["f","g"],"spritesheetPng":"u2"}')], "ordinal int, j string").withColumn("x", F.from_json("j", schema.SPRITE)).select("ordinal", "x.*")
    files = spark.createDataFrame([(0, "f.png", "png", "u3", 10), (1, "g.png", "png", "u9", 2048)], "ordinal int, name string, extension string, url string, size long")
    got = dedupe.gallery_entries(assets, sprites, files).orderBy("place").collect()
    assert [(r.key, r.title, r.meta) for r in got] == [("sprite_s1", "A", "npc / 1 frames"), ("sprite_s3", "B", "prop / 1 frames"), ("sprite_s2", "two", "2 frames"), ("file_g.png", "g", "PNG / 2 KB")]


def test_chroma_rules(spark):
    pixels = [(0, 255, 0, 255), (100, 166, 100, 255), (200, 60, 200, 255), (150, 120, 140, 255), (200, 80, 100, 255), (90, 60, 90, 255), (60, 200, 200, 255), (100, 160, 160, 255), (10, 20, 30, 77)]
    df = spark.createDataFrame([("s", k, 0, *p) for k, p in enumerate(pixels)], "sheet_id string, x int, y int, r int, g int, b int, a int")
    got = [(r.r, r.g, r.b, r.a) for r in sheet.keyed_out(df).orderBy("x").collect()]
    assert got == [(0, 255, 0, 0), (100, 108, 100, 255 - int(31 / 47 * 255)), (200, 60, 200, 0), (140, 120, 140, 255 - int(2 / 16 * 255)), (64, 80, 64, 255), (54, 60, 54, 255), (60, 200, 200, 0), (100, 108, 108, 255 - int(22 / 34 * 255)), (10, 20, 30, 77)]


def squares(size, cells, blob=30):
    """Opaque squares in the middle of chosen cells of a grid of ``size`` pixels a cell."""
    return [("s", cx * size + size // 2 - blob // 2 + i, cy * size + size // 2 - blob // 2 + j, 9, 9, 9, 255) for cx, cy in cells for i in range(blob) for j in range(blob)]


PIXELS, SHEETS = "sheet_id string, x int, y int, r int, g int, b int, a int", "sheet_id string, width int, height int, columns int, rows int"


def test_sheets(spark):
    sheets = spark.createDataFrame([("s", 200, 200, 2, 2)], SHEETS)
    full = spark.createDataFrame(squares(100, [(0, 0), (1, 0), (0, 1), (1, 1)]), PIXELS)
    g = sheet.grid(full, sheets).first()
    assert (g.mode, g.x_bounds, g.y_bounds) == ("auto_detected", [0, 100, 200], [0, 100, 200])
    one_row = spark.createDataFrame(squares(100, [(0, 0), (1, 0)]), PIXELS)
    g = sheet.grid(one_row, sheets).first()
    assert (g.mode, g.x_bounds) == ("proportional_fallback", [0, 100, 200])  # both axes, though x alone was found
    assert sheet.grid(full, sheets, forced=True).first().mode == "proportional_forced"
    m = sheet.manifests(one_row, sheets, 64, 64, "now").first()
    assert m.frameCount == 4 and m.sourceCells[0] == [1, 1, 99, 99] and m.frameBboxes[2:] == [None, None] and m.rootAnchors[0] == [32.0, 19.52] and m.rootAnchors[3] is None
    x, y, w, h = m.frameBboxes[0]
    assert (w, h) == (52, 52) and 4 <= x <= 8 and 4 <= y <= 8
    with pytest.raises(Exception, match="no visible pixels"):
        sheet.manifests(spark.createDataFrame([("s", 0, 0, 0, 0, 0, 0)], PIXELS), sheets, 64, 64, "now").collect()


def test_faint_pixels_use_the_fallback_anchor(spark):
    cells = spark.createDataFrame([("s", 1, 1, [-1, 51], [-1, 51])], "sheet_id string, columns int, rows int, x_bounds array<int>, y_bounds array<int>")  # a cell of 50 within its border
    faint = spark.createDataFrame([("s", 10, 10, 0, 0, 0, 24), ("s", 19, 29, 0, 0, 0, 5)], PIXELS)
    f = sheet.frames(faint, cells).first()
    assert tuple(f.bbox) == (10, 10, 20, 30) and (f.anchor.x, f.anchor.y) == (15, pytest.approx(16.4))
    solid = spark.createDataFrame([("s", 10, 10, 0, 0, 0, 100), ("s", 13, 10, 0, 0, 0, 200), ("s", 10, 19, 0, 0, 0, 255)], PIXELS)
    assert sheet.frames(solid, cells).first().anchor.x == pytest.approx(12)


def test_generators(spark):
    df = spark.createDataFrame([("a slime", 12), ("walk", 12), ("glow", 3)], "p string, n int")
    p = frames.procedural(df, "p", F.col("n")).filter("p = 'a slime' AND frame = 3").first()
    assert p.parameters["scaleY"] == pytest.approx(1.22) and p.parameters["scaleX"] == pytest.approx(1.22**-0.5)
    m = frames.reference_motion(df, "p", F.col("n"), F.lit(4)).collect()
    assert {bool(r.error) for r in m if r.p == "walk"} == {True} and all(r.move and r.error is None for r in m if r.p == "glow") and len(m) == 27
    assert [r[0] for r in spark.createDataFrame([(16,), (12,), (13,), (None,)], "n int").select(frames.generation_size(F.col("n"))).collect()] == [16, 12, 12, 12]
    s = frames.sliced(spark.createDataFrame([("<svg a><g/></svg>",)], "m string"), "m", F.lit(3), F.lit(2)).orderBy("frame").collect()
    assert 'viewBox="0 256 256 256"' in s[2].markup and "<g/>" in s[2].markup
    b = frames.bundled(spark.createDataFrame([("k", 1, "<svg>1</svg>"), ("k", 0, "<svg>0</svg>")], "k string, i int, m string"), "k", "i", "m", 4).first().sheet
    assert b.index(">0</g>") < b.index(">1</g>") and 'width="1024" height="256"' in b
    e = spark.createDataFrame([(["a", "b"], 4), (["a", "b"], 1)], "f array<string>, n int").select(frames.exported(F.col("f"), F.col("n"), F.lit(3))).collect()
    assert [r[0] for r in e] == [["a", "b", "b", "b"], ["a", "a", "a"]]
    assert frames.preset_frames(spark, {"coin": 4, "fire": 6}).count() == 10
    bat = frames.preset_frames(spark).filter("family = 'bat' AND frame = 4").first().parameters
    assert bat["wing1"] == pytest.approx(215) and bat["bob"] == pytest.approx(0) and frames.preset_frames(spark).count() == 52


def test_built_in_tables(spark):
    from lamina.sources import builtin

    assert [builtin.viewports(spark).count(), builtin.interaction_presets(spark).count(), builtin.kit_assets(spark).count(), builtin.kit_layers(spark).count(), builtin.preset_sprites(spark).count()] == [11, 6, 6, 6, 4]
    eye = builtin.kit_assets(spark).orderBy("ordinal").first()
    assert eye.animations[0].id == "clip_eye_inspect_idle" != eye.defaultAnimationId and "inspect-hotspot" in eye.tags
    assert [r.id for r in builtin.kit_assets(spark).orderBy("ordinal").collect()] == list(builtin.KIT_IDS)


def test_ends_gather_only_what_is_kept(spark):
    df = spark.createDataFrame([("u", k, k) for k in range(9)] + [("v", 1, 7)], "key string, at int, v int")
    assert {r.key: r["values"] for r in ordered.ends(df, "key", [F.col("at")], F.col("v"), 3).collect()} == {"u": [0, 1, 2], "v": [7]}
    assert {r.key: r["values"] for r in ordered.ends(df, "key", [F.col("at")], F.col("v"), 3, last=True).collect()} == {"u": [6, 7, 8], "v": [7]}


def test_flagship_takes_the_newest_of_the_joined_orders(spark, tmp_path):
    from lamina.plans import queries  # noqa: F401  registers them
    from lamina.plans.registry import QUERIES

    orders = spark.range(150).select(F.col("id").alias("o_orderkey"), F.when(F.col("id") < 30, 99).otherwise(1).alias("o_custkey"), F.expr("date_sub(date'2024-01-01', cast(id AS int))").alias("o_orderdate"), F.lit(1.0).alias("o_totalprice"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "c")], "c_custkey int, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    assert [r.o_orderkey for r in QUERIES["flagship"](spark, str(tmp_path)).collect()] == list(range(30, 130))


def test_record_queries_agree_with_their_sql(spark):
    """Each query over the smallest tables beside its SQL."""
    import os

    import duckdb
    from lamina.plans import queries, registry, scenes  # noqa: F401

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    norm = lambda rows: sorted(repr(tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r)) for r in rows)
    for name in ("scene_normalised", "scene_resized", "layer_geometry", "key_bindings", "nearby_interaction", "kit_corrections", "interaction_fold", "scene_history"):
        sql = registry.ORACLE_SQL[name]
        order = sorted(con.sql(sql).columns)
        got = [tuple(r[c] for c in order) for r in registry.QUERIES[name](spark, sf).collect()]
        columns = ", ".join(f'"{c}"' for c in order)
        assert norm(got) == norm(con.sql(f"SELECT {columns} FROM ({sql})").fetchall()), name
