"""Scalar rules on hand-computed values."""

import pytest
from pyspark.sql import functions as F

from lamina.functions import geometry as g
from lamina.functions import numbers as n
from lamina.functions import text as t


@pytest.fixture(scope="module")
def ev(spark):
    one = spark.range(1)
    return lambda *cols: one.select(*(c.alias(f"c{k}") for k, c in enumerate(cols))).first() if len(cols) > 1 else one.select(cols[0].alias("c")).first()[0]


def test_three_roundings(ev):
    for x, up, even, away in ((-2.5, -2, -2, -3), (2.5, 3, 2, 3), (3.5, 4, 4, 4), (313.5, 314, 314, 314), (940.5, 941, 940, 941)):
        assert tuple(ev(n.round_half_up(F.lit(x)), F.bround(F.lit(x)), F.round(F.lit(x)))) == (up, even, away)


def test_two_defaults_and_null_clamps(ev):
    null = F.lit(None).cast("double")
    assert tuple(ev(n.or_default(F.lit(0.0), 5.0), n.or_default(null, 5.0), n.or_default(F.lit(float("nan")), 5.0), n.or_default(F.lit(2.0), 5.0), F.coalesce(F.lit(0.0), F.lit(5.0)))) == (5, 5, 5, 2, 0)
    assert tuple(ev(n.clamp(null, 0, 1), n.clamp(F.lit(7.0), 0, 1), n.layer_scale(F.lit(0.0)), n.text_or(F.lit(""), "d"))) == (None, 1, 0.05, "d")


def test_numbers_from_text(ev):
    got = [ev(n.number(F.lit(x))) for x in ("", " 12 ", "1e3", "0x10", "x", "1.5.2", "-.5", "NaN", "1_0")]
    assert got == [0, 12, 1000, 16, None, None, -0.5, None, None]
    assert [ev(n.bounded_integer(F.lit(x), 8, 1, 60)) for x in (None, "", "2.5", "99", "abc", "-4")] == [8, 1, 3, 60, 8, 1]
    assert [ev(n.port(F.lit(x), 3000)) for x in ("8080", "0", "80.5", "", None, "70000")] == [8080, 3000, 3000, 3000, 3000, 3000]
    s = ev(n.export_settings(F.lit("0"), F.lit(None).cast("string"), F.lit("400"), F.lit("x"), F.lit("12.5")))
    assert (s.columns, s.fps, s.frameCount, s.frameHeight, s.frameWidth) == (1, 8, 256, 256, 13)


def test_state_texts(ev):
    got = [tuple(ev(n.state_value(F.lit(x)))) for x in (None, "", "true", " false ", "1", "1.0", "1e3", "0x10", "key")]
    assert got == [("text", ""), ("text", ""), ("boolean", "true"), ("boolean", "false"), ("number", "1"), ("number", "1"), ("number", "1000"), ("number", "16"), ("text", "key")]
    m = lambda k, v, e: ev(n.state_matches(F.lit(k).cast("string"), F.lit(v).cast("string"), F.lit(e).cast("string")))
    assert m("number", "1.0", "1") and m("boolean", "true", None) and not m("boolean", "false", "") and not m(None, None, "") and not m(None, None, "x") and m("text", "a", " a ") and not m("number", "0", None)
    assert ev(n.put_state(F.create_map(F.lit("a"), F.lit("1")), "a", "2")) == {"a": "2"}


def test_times_and_records(ev):
    ts = F.lit("2024-03-05 14:07:09.5").cast("timestamp")
    assert tuple(ev(n.iso_time(ts), n.time_label(ts), n.record_id("asset", "x", 5))) == ("2024-03-05T14:07:09.500Z", "Mar 05, 02:07 PM", "asset_x_5")
    a, b = F.struct(F.lit(1).alias("x"), F.lit(None).cast("int").alias("y")), F.struct(F.lit(1).alias("x"))
    assert ev(n.same_record(a, b)) is True


def test_names(ev):
    assert [ev(t.safe_name(F.lit(x))) for x in ("Ab c!", "走路_", "!!", "__x__")] == ["ab_c", "走路", "sprite", "x"]
    assert [ev(t.safe_filename(F.lit(x))) for x in (" Ab 走 c ", "走")] == ["ab_c", "spritesheet"]
    assert [ev(t.download_filename(F.lit(x), "gif")) for x in (None, "a/b c.png", "x.GIF", "a:*?b", "", "..")] == ["spritesheet_export.gif", "b_c.gif", "x.GIF", "a_b.gif", "spritesheet_export.gif", "...gif"]
    assert ev(t.split_tags(F.lit(" a, b\tc,,"))) == ["a", "b", "c"]
    assert ev(t.without_extension(F.lit("a.b.png"))) == "a.b" and ev(t.css_url(F.lit('a"b\\'))) == 'url("a\\"b\\\\")'


def test_markup(ev):
    assert ev(t.escape_markup(F.lit('<a b="&lt;">'))) == "&lt;a b=&quot;&amp;lt;&quot;&gt;"
    assert [ev(t.trim_markup(F.lit(x), wrapper="<svg>")) for x in ("x<svg a>1</svg>y", "1", None, "<svg>1", " <svg></svg></svg> z")] == ["<svg a>1</svg>", "<svg>1</svg>", "<svg></svg>", "<svg>1", "<svg></svg></svg>"]
    assert ev(t.markup_body(F.lit("<svg a><g/></svg>"))) == "<g/>"


def test_labels_and_families(ev):
    assert [ev(t.key_label(F.lit(x))) for x in (None, "", "KeyD", "digit5", "Key", "Space")] == ["E", "E", "D", "5", "Key", "Space"]
    label = lambda *x: ev(t.clip_label(*map(F.lit, x)))
    assert label("left", "walk", "n", "keyboard", "KeyA") == "Walk Left A" and label("none", "idle", "n", "auto", "auto") == "Idle" and label("none", "run", "n", "auto", "x") == "n"
    assert [ev(t.animation_family(F.lit(x))) for x in ("COMBAT", "a spinning slime", "cold", None, "spark orb")] == ["flyer", "slime", "astral", "astral", "coin"]
    assert [ev(t.motion(F.lit(x))) for x in ("running slash", "攻击", "jump", "glow", "")] == ["walk", "attack", "jump", "magic", "idle"]
    assert [ev(t.default_game_state(F.lit(k), F.lit("Go Up"))) for k in ("auto", "mouse", "keyboard", "state")] == ["scene.go_up.loop", "scene.go_up.clicked", "input.go_up", "state.go_up"]
    assert [ev(t.file_size(F.lit(x))) for x in (0, 1, 1536, 5 << 20)] == ["0 KB", "1 KB", "2 KB", "5.0 MB"]
    assert [ev(t.viewport_ratio(F.lit(a), F.lit(b))) for a, b in ((16, 9), (9, 16), (0, 1))] == ["1.78:1", "1:1.78", "custom"]
    assert ev(t.rgba(F.lit("#ff3e75"), F.lit(0.32))) == "rgba(255, 62, 117, 0.32)" and ev(t.rgba(F.lit("red"), F.lit(1.0))) == "red"
    assert ev(t.filter_text(F.lit("none"), F.lit(None).cast("string"))) == "none" and ev(t.filter_text(F.lit("a"), F.lit("none"), F.lit("b"))) == "a b"


def test_data_urls_and_paths(ev):
    got = ev(t.data_url(F.lit("data:image/jpeg;base64,aGk=")))
    assert (got.extension, bytes(got.content)) == ("jpg", b"hi") and ev(t.data_url(F.lit("data:image/gif;base64,aGk="))) is None
    path = lambda x: tuple(ev(t.guarded_path(F.lit(x))))
    assert path("/generated/a/b%20c.png?x#y") == (200, "a/b c.png") and path("https://h/generated/x.png") == (200, "x.png")
    for bad in ("/other/x", "/generated/../x", "/generated/a/../../generated/x", "/generated/%2e%2e/x", None):
        assert path(bad) == (400, None)
    assert path("/generated/a/../b.png")[0] == 200


SPRITE = "frameSize array<double>, cellSize double, gridColumns double, sheetSize array<double>, frames array<string>, frameCount int"


def test_sprite_geometry(spark):
    rows = [(([64.0, 32.0], None, None, [256.0, 64.0], ["a"] * 8, 3),), (([0.0, 1.0], 100.0, 2.5, None, None, 5),), ((None, 0.0, None, None, [], None),), (None,)]
    df = spark.createDataFrame(rows, f"s struct<{SPRITE}>").select(g.frame_size(F.col("s")).alias("f"), g.grid_columns(F.col("s")).alias("c"), g.grid_rows(F.col("s")).alias("r"), g.frame_total(F.col("s")).alias("n"))
    assert [(x.f.width, x.f.height, x.c, x.r, x.n) for x in df.collect()] == [(64, 32, 4, 2, 8), (100, 100, 3, 2, 5), (256, 256, 1, 1, 0), (256, 256, 1, 1, 0)]


def test_boxes_and_distance(ev):
    sprite = F.struct(F.array(F.lit(100.0), F.lit(50.0)).alias("frameSize"), F.lit(0.0).alias("cellSize"))
    layer = F.struct(F.lit(10.0).alias("x"), F.lit(200.0).alias("y"), F.lit(2.0).alias("scale"), F.lit(0.0).alias("parallax"))
    b = ev(g.world_bounds(layer, sprite))
    assert (b.left, b.right, b.top, b.bottom, b.centerX, b.centerY) == (10, 210, 100, 200, 110, 150)
    zone = lambda w, h: ev(g.zone_bounds(g.world_bounds(layer, sprite), F.struct(F.lit(w).alias("zoneWidth"), F.lit(h).alias("zoneHeight"), F.lit(None).cast("double").alias("zoneOffsetX"), F.lit(5.0).alias("zoneOffsetY"))))
    assert (zone(0.0, 10.0).width, zone(0.0, 10.0).height, zone(0.0, 10.0).centerY) == (200, 24, 155)
    box = g.world_bounds(layer, sprite)
    assert [ev(g.distance_to_box(F.lit(x), F.lit(y), box)) for x, y in ((20.0, 150.0), (213.0, 204.0), (0.0, 150.0))] == [0, 5, 10]
    assert ev(g.on_stage(layer, 50.0, 0.5)).left == 5


def test_frames_and_cells(ev):
    assert ev(g.proportional_bounds(F.lit(1254), F.lit(4))) == [0, 314, 627, 940, 1254]
    assert tuple(ev(g.inset_cell(F.lit(0), F.lit(0), F.lit(314), F.lit(314)))) == (3, 3, 311, 311)
    assert tuple(ev(g.inset_cell(F.lit(0), F.lit(0), F.lit(1), F.lit(1)))) == (1, 1, 2, 2)
    assert [ev(g.anchored(F.lit(512), F.lit(s), F.lit(100.0), F.lit(256.0))) for s in (500, 510, 100)] == [8, 1, 156]
    frames = F.array(F.lit("a"), F.lit("b"), F.lit(""))
    assert [ev(g.frame_at(frames, F.lit(k))) for k in (0, 4, 5)] == ["a", "b", "a"] and ev(g.frame_at(F.array().cast("array<string>"), F.lit(3))) == ""
    assert tuple(ev(g.inferred_frame(F.lit(1000), F.lit(250)))) == (250, 250) and tuple(ev(g.inferred_frame(F.lit(100), F.lit(333)))) == (100, 111)
    assert tuple(ev(g.preview_box(F.lit(100), F.lit(100), F.lit(1000.0), F.lit(500.0)))) == (255, 255)
    assert [ev(g.clamp_frame_side(F.lit(x), 100)) for x in (None, 0.4, 250.5)] == [1, 1, 100]
    assert ev(g.grid_fits(F.lit(4), F.lit(1), F.lit(25), F.lit(10), F.lit(99), F.lit(9))) and not ev(g.grid_fits(F.lit(4), F.lit(1), F.lit(25), F.lit(10), F.lit(98), F.lit(10)))
    assert tuple(ev(g.thumb_position(F.lit(5), F.lit(4), F.lit(1)))) == (pytest.approx(100 / 3), 0)


def test_motion(ev):
    m = ev(g.harmonic(F.lit("jump"), F.lit(11), 12))
    assert m.effect == "dust" and m.scaleX == pytest.approx(1.08) and m.y == pytest.approx(-30 * 0.258819, abs=1e-4)
    r = ev(g.restrained(g.harmonic(F.lit("attack"), F.lit(3), 12)))
    assert r.rotate == 4.5 and r.x <= 10
