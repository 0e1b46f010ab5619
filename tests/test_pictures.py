"""Markup of frames against literal texts."""

from pyspark.sql import functions as F

from lamina.functions.numbers import decimal_text, fixed_text
from lamina.operators import frames, pictures


def test_numbers_as_text(spark):
    df = spark.createDataFrame([(100.0,), (0.5,), (-0.0000001,), (1e-5,), (-2.5,), (12345678.25,), (None,)], "x double")
    assert [r[0] for r in df.select(decimal_text(F.col("x"))).collect()] == ["100", "0.5", "0", "0.00001", "-2.5", "12345678.25", None]
    assert [r[0] for r in df.select(fixed_text(F.col("x"), 2)).collect()] == ["100.00", "0.50", "-0.00", "0.00", "-2.50", "12345678.25", None]


def test_whole_pictures(spark):
    rows = spark.createDataFrame([("a star",), ("coin",)], "p string")
    got = {(r.family, r.frame): r.markup for r in pictures.drawn(frames.procedural(rows, "p", F.lit(16)), pictures.templates(spark, pictures.GENERATED)).collect()}
    opened = '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 256 256" width="256" height="256">'
    assert got["astral", 2] == opened + '<g transform="translate(128, 128) rotate(45) scale(1.12) translate(-128, -128)"><circle cx="128" cy="128" r="82" fill="none" stroke="#F59E0B" stroke-width="3" stroke-dasharray="14 10" opacity="0.65"/></g></svg>'
    assert len(got) == 32 and 'rx="96" ry="96" fill="#8B5CF6" stroke="#7C3AED"' in got["coin", 0] and 'stroke="#5B21B6"' in got["coin", 8] and "scale(1, 1)" in got["coin", 8]
    assert "scale(" not in got["coin", 4] and 'rotate(-20)"' in got["coin", 4]  # edge on: no emblem


def test_templates_of_the_caller(spark):
    own = spark.createDataFrame([("slime", [("<a b='{x}' c='{none}'/>", None, None, None), ("<high/>", "x", 1.0, None), ("<low/>", "x", None, 1.0)])], pictures.TEMPLATE)
    df = spark.createDataFrame([("slime", {"x": 1.0}), ("slime", {"x": 1.5, "width": 9.0}), ("slime", {}), ("slime", None), ("other", {"x": 1.0}), (None, {"x": 1.0})], "family string, parameters map<string,double>")
    got = [r.markup and r.markup[len(pictures.OPEN) : -6] for r in pictures.drawn(df, own).collect()]
    expected = ["<a b='1' c=''/><low/>", "<a b='1.5' c=''/><high/>", "<a b='' c=''/>", "<a b='' c=''/>", None, None]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert pictures.drawn(df.limit(0), own).count() == 0


def test_reference_sheets(spark):
    rows = spark.createDataFrame([(1, "stand", "a<b", "Pixel"), (2, "Walking", "c", None), (3, None, None, None), (4, "attack", "d", None)], "k int, p string, i string, s string")
    got = {r.k: r for r in pictures.reference_sheets(pictures.reference_cells(rows, "p", "i", "s", F.lit(12), F.lit(4)), "k", 4).collect()}
    assert got[2].sheet is None and "walking" in got[2].error and got[1].error is None and got[3].sheet.count('href=""') == 12 and len(got) == 4
    cell = '<g id="frame_7"><ellipse cx="640" cy="474" rx="58.0" ry="9" fill="#0f172a" opacity=".18"/><circle cx="604" cy="338" r="3" fill="#ffffff" opacity=".5"/><g transform="translate(638.50 384.00) rotate(0.00) scale(1.000 1.000) translate(-128 -128)">'
    cell += '<image href="a&lt;b" x="38" y="38" width="180" height="180" preserveAspectRatio="xMidYMid meet" style="image-rendering:pixelated"/></g></g>'
    assert cell in got[1].sheet.replace("rotate(-0.00)", "rotate(0.00)") and got[1].sheet.count("<g id=") == 12
    assert 'viewBox="0 0 1024 768" width="1024" height="768"' in got[1].sheet
    assert '<path d="M 54 176 Q 136 54 214 116" fill="none" stroke="#f8fbff" stroke-width="8" stroke-linecap="round" opacity="0.22"/>' in got[4].sheet


def test_bundled_sheets_have_a_view(spark):
    rows = spark.createDataFrame([("k", k, f"<svg>{k}</svg>") for k in range(3)], "k string, i int, m string")
    sheet = frames.bundled(rows, "k", "i", "m", 2).first().sheet
    assert sheet == '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 512 512" width="512" height="512"><g transform="translate(0 0)">0</g><g transform="translate(256 0)">1</g><g transform="translate(0 256)">2</g></svg>'
