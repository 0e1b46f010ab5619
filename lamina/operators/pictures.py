"""Markup of frames: templates filled with a frame's numbers, and sheets of a reference image in motion.

Numbers stand with at most ``DIGITS`` decimals, and elements without line breaks between them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import decimal_text, fixed_text
from ..functions.text import escape_markup
from .frames import motion_kind, reference_motion, spread

DIGITS = 6
OPEN, CLOSE = '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 256 256" width="256" height="256">', "</svg>"
#: A part of a picture: names in braces are numbers of the frame; it is drawn if ``low`` < ``number`` <= ``high``, where a null asks nothing.
TEMPLATE = "family string, parts array<struct<markup: string, number: string, low: double, high: double>>"

# What moves in the pictures of each family. Gradients are plain colours here, and what stands still on a moving body
# (faces, gems, ridges) is left to templates of the caller.
GENERATED = {
    "slime": (
        '<ellipse cx="128" cy="216" rx="{shadowX}" ry="{shadowY}" fill="#082F49" fill-opacity="0.3"/>',
        '<g transform="translate(128, 210) scale({scaleX}, {scaleY}) rotate({wobble}) translate(-128, -210)"><path d="M 60 210 C 50 140, 70 80, 128 80 C 186 80, 206 140, 196 210 C 196 220, 60 220, 60 210 Z" fill="#0284C7" stroke="#0F172A" stroke-width="6"/>',
        '<g transform="translate({lookX}, {bob})"><path d="M 124 163 Q 128 {mouth} 132 163" fill="none" stroke="#0F172A" stroke-width="3" stroke-linecap="round"/></g></g>',
    ),
    "coin": (
        '<ellipse cx="128" cy="220" rx="{shadow}" ry="10" fill="#2E1065" fill-opacity="0.25"/><g transform="translate(128, 128)">',
        ('<ellipse cx="0" cy="0" rx="{rim}" ry="96" fill="#8B5CF6" stroke="#7C3AED" stroke-width="8"/><ellipse cx="0" cy="0" rx="{core}" ry="72" fill="#A78BFA" stroke="#C084FC" stroke-width="4"/>', "face", 0.0, None),
        ('<ellipse cx="0" cy="0" rx="{rim}" ry="96" fill="#8B5CF6" stroke="#5B21B6" stroke-width="8"/><ellipse cx="0" cy="0" rx="{core}" ry="72" fill="#7C3AED" stroke="#C084FC" stroke-width="4"/>', "face", None, 0.0),
        ('<g transform="scale({width}, 1)"><circle cx="0" cy="0" r="30" fill="none" stroke="#F3E8FF" stroke-width="5" stroke-dasharray="10 5" transform="rotate({emblem})"/></g>', "width", 0.2, None),
        '<ellipse cx="0" cy="0" rx="{sheen}" ry="80" fill="#FFFFFF" opacity="0.32" transform="rotate({glint})"/></g>',
    ),
    "fire": (
        '<g transform="translate(128,128) scale(1.1) translate(-128,-128)"><circle cx="128" cy="128" r="{pulse}" fill="#EA580C"/><circle cx="{p1X}" cy="{p1Y}" r="{p1Size}" fill="#DC2626"/><circle cx="{p2X}" cy="{p2Y}" r="{p2Size}" fill="#DC2626" opacity="0.85"/>',
        '<circle cx="{node1X}" cy="{node1Y}" r="{node1Size}" fill="#FDE047" opacity="0.8"/><circle cx="{node2X}" cy="{node2Y}" r="{node2Size}" fill="#FFF" opacity="0.9"/></g>',
    ),
    "slash": (
        '<ellipse cx="128" cy="220" rx="60" ry="8" fill="#4C0519" fill-opacity="{shadowOpacity}"/>',
        ('<path d="M 40 180 Q 128 {arcY} 216 120" fill="none" stroke="#FDA4AF" stroke-width="{arcWidth}" stroke-linecap="round" opacity="{sweepOpacity}"/><path d="M 40 180 Q 128 {arcY} 216 120" fill="none" stroke="#FFFFFF" stroke-width="4" stroke-linecap="round" opacity="{sweepShine}"/>', "sweepOpacity", 0.0, None),
        '<g transform="translate(128, 140) rotate({angle}) translate(-128, -140)"><path d="M 121 132 L 121 40 L 128 20 L 135 40 L 135 132 Z" fill="#FDA4AF" stroke="#9F1239" stroke-width="3"/></g>',
        ('<circle cx="160" cy="110" r="30" fill="#FFE4E6" filter="blur(3px)"/>', "flash", 0.0, None),
    ),
    "flyer": (
        '<ellipse cx="128" cy="225" rx="{shadow}" ry="7" fill="#0284C7" fill-opacity="{shadowOpacity}"/><g transform="translate(0, {bob})">',
        '<path d="M 110 120 C 80 {wing1}, 45 {wing2}, 30 {wing3} C 48 {wing4}, 68 {wing5}, 90 128 Z" fill="#38BDF8"/><path d="M 146 120 C 176 {wing1}, 211 {wing2}, 226 {wing3} C 208 {wing4}, 188 {wing5}, 166 128 Z" fill="#38BDF8"/><circle cx="128" cy="120" r="22" fill="#7DD3FC" stroke="#0284C7" stroke-width="4.5"/></g>',
    ),
    "astral": ('<g transform="translate(128, 128) rotate({spin}) scale({pulse}) translate(-128, -128)"><circle cx="128" cy="128" r="82" fill="none" stroke="#F59E0B" stroke-width="3" stroke-dasharray="14 10" opacity="0.65"/></g>',),
}
PRESETS = {
    "slime": (
        '<ellipse cx="128" cy="216" rx="{shadowX}" ry="{shadowY}" fill="#061D09" fill-opacity="0.35"/><g transform="translate(128, 210) scale({scaleX}, {scaleY}) rotate({wobble}) translate(-128, -210)">',
        '<g transform="translate({lookX}, {bob})"><path d="M 123 162 Q 128 {mouth} 133 162" fill="none" stroke="#0F172A" stroke-width="3.5" stroke-linecap="round"/></g></g>',
    ),
    "coin": (
        '<ellipse cx="128" cy="220" rx="{shadow}" ry="12" fill="#000000" fill-opacity="0.25"/><g transform="translate(128, 128)">',
        ('<ellipse cx="0" cy="0" rx="{rim}" ry="100" fill="#E6B800" stroke="#B38F00" stroke-width="8"/>', "face", 0.0, None),
        ('<ellipse cx="0" cy="0" rx="{rim}" ry="100" fill="#E6B800" stroke="#806600" stroke-width="8"/>', "face", None, 0.0),
        '<ellipse cx="0" cy="0" rx="{core}" ry="74" fill="#F5C024" stroke="#FFDF4D" stroke-width="4"/><ellipse cx="0" cy="0" rx="{sheen}" ry="84" fill="#FFFFFF" opacity="0.3" transform="rotate({glint})"/></g>',
    ),
    "bat": (
        '<ellipse cx="128" cy="225" rx="{shadow}" ry="8" fill="#000000" fill-opacity="{shadowOpacity}"/><g transform="translate(0, {bob})">',
        '<path d="M 108 125 L 25 {wing3} L 55 {wing5} L 108 125" fill="#4338CA"/><path d="M 148 125 L 231 {wing3} L 201 {wing5} L 148 125" fill="#4338CA"/></g>',
    ),
    "fire": (
        '<ellipse cx="128" cy="128" rx="85" ry="50" fill="none" stroke="#F43F5E" stroke-width="1.5" transform="rotate({ring1}, 128, 128)"/><ellipse cx="128" cy="128" rx="70" ry="40" fill="none" stroke="#F59E0B" stroke-width="2.5" transform="rotate({ring2}, 128, 128)"/>',
        '<circle cx="128" cy="128" r="{pulse}" fill="#EA580C"/><circle cx="{p1X}" cy="{p1Y}" r="{p1Size}" fill="#F97316"/><circle cx="{p2X}" cy="{p2Y}" r="{p2Size}" fill="#F97316" opacity="0.8"/>',
        '<circle cx="{spark1X}" cy="{spark1Y}" r="{spark1Size}" fill="#FFF" opacity="{spark1Opacity}"/><circle cx="{spark2X}" cy="{spark2Y}" r="{spark2Size}" fill="#FFEFA6" opacity="{spark2Opacity}"/>',
    ),
}


def templates(spark: SparkSession, pictures: dict) -> DataFrame:
    """The tables above as rows."""
    whole = lambda p: (p, None, None, None) if isinstance(p, str) else p
    return spark.createDataFrame([(k, [whole(p) for p in parts]) for k, parts in pictures.items()], TEMPLATE)


def drawn(frames: DataFrame, pictures: DataFrame, family: str = "family", numbers: str = "parameters", digits: int = DIGITS) -> DataFrame:
    """``frames`` with ``markup``: the parts of the family's template that are drawn, with the numbers in place.

    ``pictures`` has a row for each family (``TEMPLATE``) and may be any size. A family without a template gives null, a name
    that isn't a number of the frame nothing, and braces can't stand in markup otherwise. ``width`` and ``sweepShine`` follow from other numbers.
    """
    n = F.col(numbers)
    more = F.create_map(F.lit("width"), F.abs(n["face"]), F.lit("sweepShine"), n["sweepOpacity"] * 1.2)
    held = frames.withColumn("_n", F.map_concat(F.map_filter(n, lambda k, _: ~k.isin("width", "sweepShine")), more))
    held = held.withColumn("_t", F.transform_values("_n", lambda _, v: decimal_text(v, digits)))
    named = pictures.select(F.col("family").alias("_family"), F.col("parts").alias("_parts"))

    def shown(p):
        x = F.col("_n")[p["number"]]
        return p["number"].isNull() | F.coalesce((x > F.coalesce(p["low"], F.lit(-math.inf))) & (x <= F.coalesce(p["high"], F.lit(math.inf))), F.lit(False))

    def filled(p):
        piece = lambda x, k: F.when(k % 2 == 0, x).otherwise(F.coalesce(F.col("_t")[x], F.lit("")))
        return F.array_join(F.transform(F.split(p["markup"], "[{}]"), piece), "")

    body = F.array_join(F.transform(F.filter("_parts", shown), filled), "")
    return held.join(named, held[family] == named["_family"], "left").withColumn("markup", F.concat(F.lit(OPEN), body, F.lit(CLOSE))).drop("_n", "_t", "_family", "_parts")


PIXELATED = "pixel|像素"


def cell_begin() -> Column:
    """A cell of ``reference_motion`` up to the link of its image."""
    whole = lambda c: c.cast("long").cast("string")
    text, left, top = lambda c: decimal_text(c, DIGITS), F.col("x"), F.col("y")

    def arc(k, bend, end):
        e = F.get("effects", F.lit(k))
        place = lambda dx, dy: (whole(left + dx), F.lit(" "), whole(top + dy))
        return F.concat(F.lit('<path d="M '), *place(e["x"], e["y"]), F.lit(" Q "), *place(*bend), F.lit(" "), *place(*end), F.lit('" fill="none" stroke="'), e["colour"], F.lit('" stroke-width="'), whole(e["size"]), F.lit('" stroke-linecap="round" opacity="'), text(e["opacity"]), F.lit('"/>'))

    def particle(e):
        return F.concat(F.lit('<circle cx="'), fixed_text(left + e["x"], 1), F.lit('" cy="'), fixed_text(top + e["y"], 1), F.lit('" r="'), fixed_text(e["size"], 1), F.lit('" fill="'), e["colour"], F.lit('" opacity=".82"/>'))

    dot = F.get("effects", F.lit(0))
    dot = F.concat(F.lit('<circle cx="'), text(left + dot["x"]), F.lit('" cy="'), whole(top + dot["y"]), F.lit('" r="3" fill="#ffffff" opacity=".5"/>'))
    effects = F.when(F.col("move.effect") == "slash", F.concat(arc(0, (136, 54), (214, 116)), arc(1, (138, 78), (204, 128)))).when(F.size("effects") > 1, F.array_join(F.transform("effects", particle), "")).otherwise(dot)
    m = lambda k, digits: fixed_text(F.col(f"move.{k}"), digits)
    return F.concat(
        F.lit('<g id="frame_'), whole(F.col("frame") + 1), F.lit('"><ellipse cx="'), whole(left + 128), F.lit('" cy="'), whole(top + 218), F.lit('" rx="'), fixed_text(F.col("shadow"), 1), F.lit('" ry="9" fill="#0f172a" opacity=".18"/>'), effects,
        F.lit('<g transform="translate('), fixed_text(left + 128 + F.col("move.x"), 2), F.lit(" "), fixed_text(top + 128 + F.col("move.y"), 2), F.lit(") rotate("), m("rotate", 2), F.lit(") scale("), m("scaleX", 3), F.lit(" "), m("scaleY", 3),
        F.lit(') translate(-128 -128)"><image href="'),
    )


def cell_end(prompt: str, image: str, style: str) -> Column:
    """The rest of a cell, which all cells of a row have."""
    said = F.lower(F.concat_ws(" ", F.coalesce(F.col(prompt), F.lit("")), F.coalesce(F.col(style), F.lit(""))))
    return F.concat(
        escape_markup(F.coalesce(F.col(image), F.lit(""))), F.lit('" x="38" y="38" width="180" height="180" preserveAspectRatio="xMidYMid meet" style="'), F.when(said.rlike(PIXELATED), "image-rendering:pixelated").otherwise(""), F.lit('"/></g></g>'),
    )


def sheet_begin(n: Column, columns: int, side: int = 256) -> Column:
    """A sheet of ``n`` cells up to the first."""
    size = [F.lit(str(columns * side)), (F.ceil(n / columns) * side).cast("string")]
    opened = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), F.concat_ws(" ", *size), F.lit('" width="'), size[0], F.lit('" height="'), size[1], F.lit('">'))
    return F.concat(opened, F.lit('<defs><filter id="softShadow"><feGaussianBlur stdDeviation="2"/></filter></defs>'))


def reference_cells(rows: DataFrame, prompt: str, image: str, style: str, count: Column, columns: Column) -> DataFrame:
    """Frames of ``reference_motion`` with ``cell``: the image as it stands on the sheet, its shadow and effects; null where there is an error. A null image is an empty link, a null prompt or style an empty text."""
    r = reference_motion(rows, prompt, count, columns)
    return r.withColumn("cell", F.when(F.col("error").isNull(), F.concat(cell_begin(), cell_end(prompt, image, style))))


def whole_sheets(rows: DataFrame, prompt: str, image: str, style: str, count: Column, columns: int) -> DataFrame:
    """``rows`` with error and sheet: what ``reference_cells`` and ``reference_sheets`` make of each row, without a row for each cell.

    A cell follows from the prompt's kind, the count and the place, but for the row's image and style, so the begins of cells are computed once for each
    kind and count (a few) and broadcast; a row's own text stands between them.
    """
    kinds = rows.withColumn("_n", count.cast("int")).withColumn("_kind", F.concat_ws("|", motion_kind(prompt), F.col("_n")))
    first = kinds.groupBy("_kind").agg(F.min(prompt).alias("said"), F.any_value("_n").alias("_n"))
    cells = reference_motion(first, "said", F.col("_n"), F.lit(columns)).select("_kind", "frame", "error", F.when(F.col("error").isNull(), cell_begin()).alias("begin"))
    cells = cells.groupBy("_kind").agg(F.max("error").alias("error"), F.array_sort(F.collect_list(F.struct("frame", "begin"))).alias("parts"))
    cells = cells.select("_kind", "error", sheet_begin(F.size("parts"), columns).alias("_begin"), F.transform("parts", lambda p: p["begin"]).alias("_parts"))
    met = spread(kinds).join(F.broadcast(cells), "_kind").withColumn("_end", cell_end(prompt, image, style))
    sheet = F.concat("_begin", F.call_function("array_join", F.col("_parts"), F.col("_end")), "_end", F.lit(CLOSE))
    return met.select(*rows.columns, "error", F.when(F.col("error").isNull(), sheet).alias("sheet"))


def reference_sheets(cells: DataFrame, key: str, columns: int, side: int = 256) -> DataFrame:
    """``key``, error and sheet: the cells of each sheet (a few frames) in order; no sheet where there is an error."""
    parts = cells.groupBy(key).agg(F.max("error").alias("error"), F.array_sort(F.collect_list(F.struct("frame", "cell"))).alias("parts"))
    return parts.select(key, "error", F.when(F.col("error").isNull(), F.concat(sheet_begin(F.size("parts"), columns, side), F.array_join(F.transform("parts", lambda p: p["cell"]), ""), F.lit(CLOSE))).alias("sheet"))
