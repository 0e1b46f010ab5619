"""Queries over markup of frames, each beside SQL in which the expected texts are written out."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import frames, pictures
from .registry import query
from .scenes import FAMILY_SQL, LOOPS, PROMPTS


def decimals(x: str) -> str:
    return rf"regexp_replace(CAST(CAST(round({x}, 6) AS DECIMAL(30,6)) AS VARCHAR), '\.?0+$', '')"


def text_of(*parts: str) -> str:
    """SQL for a text in which braces hold SQL of a number; a part that begins with ``IF condition:`` is empty elsewhere."""
    out = []
    for part in parts:
        asked, _, rest = part.partition(":") if part.startswith("IF ") else ("", "", part)
        text = " || ".join(decimals(x) if k % 2 else f"'{x}'" for k, x in enumerate(re.split("[{}]", rest)))
        out.append(f"CASE WHEN {asked[3:]} THEN {text} ELSE '' END" if asked else text)
    return """'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 256 256" width="256" height="256">' || """ + " || ".join(out) + " || '</svg>'"


# What is expected, apart from the operator's own tables; i is the frame, a its angle.
DRAWN = {
    "slime": (
        '<ellipse cx="128" cy="216" rx="{75 / sqrt(1 + 0.22 * sin(a))}" ry="{12 * (1 - 0.22 * sin(a))}" fill="#082F49" fill-opacity="0.3"/>',
        '<g transform="translate(128, 210) scale({1 / sqrt(1 + 0.22 * sin(a))}, {1 + 0.22 * sin(a)}) rotate({5 * cos(a * 2)}) translate(-128, -210)">',
        '<path d="M 60 210 C 50 140, 70 80, 128 80 C 186 80, 206 140, 196 210 C 196 220, 60 220, 60 210 Z" fill="#0284C7" stroke="#0F172A" stroke-width="6"/>',
        '<g transform="translate({6 * sin(a)}, {2.64 * sin(a)})"><path d="M 124 163 Q 128 {167 + 2.5 * sin(a * 2)} 132 163" fill="none" stroke="#0F172A" stroke-width="3" stroke-linecap="round"/></g></g>',
    ),
    "coin": (
        '<ellipse cx="128" cy="220" rx="{85 * (0.8 + 0.1 * sin(a))}" ry="10" fill="#2E1065" fill-opacity="0.25"/><g transform="translate(128, 128)">',
        'IF i < 4 OR i > 9:<ellipse cx="0" cy="0" rx="{96 * abs(cos(a))}" ry="96" fill="#8B5CF6" stroke="#7C3AED" stroke-width="8"/><ellipse cx="0" cy="0" rx="{72 * abs(cos(a))}" ry="72" fill="#A78BFA" stroke="#C084FC" stroke-width="4"/>',
        'IF i BETWEEN 4 AND 9:<ellipse cx="0" cy="0" rx="{96 * abs(cos(a))}" ry="96" fill="#8B5CF6" stroke="#5B21B6" stroke-width="8"/><ellipse cx="0" cy="0" rx="{72 * abs(cos(a))}" ry="72" fill="#7C3AED" stroke="#C084FC" stroke-width="4"/>',
        'IF i NOT IN (3, 9):<g transform="scale({abs(cos(a))}, 1)"><circle cx="0" cy="0" r="30" fill="none" stroke="#F3E8FF" stroke-width="5" stroke-dasharray="10 5" transform="rotate({i * 15})"/></g>',
        '<ellipse cx="0" cy="0" rx="{80 * abs(cos(a))}" ry="80" fill="#FFFFFF" opacity="0.32" transform="rotate({15 * sin(a) - 35})"/></g>',
    ),
    "fire": (
        '<g transform="translate(128,128) scale(1.1) translate(-128,-128)"><circle cx="128" cy="128" r="{34 + 6 * sin(a * 4)}" fill="#EA580C"/><circle cx="{128 + 42 * cos(a * 2.2)}" cy="{120 + 30 * sin(a * 1.5 - pi() / 4)}" r="{15 + 6 * cos(a)}" fill="#DC2626"/>',
        '<circle cx="{128 + 48 * cos(a * 1.8 + pi())}" cy="{115 + 35 * sin(a * 2.1 + pi() / 3)}" r="{13 + 5 * sin(a)}" fill="#DC2626" opacity="0.85"/>',
        '<circle cx="{112 + 10 * cos(a * 3)}" cy="{100 - (i * 6) % 65}" r="{2 + i % 3}" fill="#FDE047" opacity="0.8"/><circle cx="{144 + 12 * sin(a * 2)}" cy="{110 - ((i + 4) * 6) % 70}" r="{1.5 + i % 2.5}" fill="#FFF" opacity="0.9"/></g>',
    ),
    "slash": (
        '<ellipse cx="128" cy="220" rx="60" ry="8" fill="#4C0519" fill-opacity="{0.3 * (1 - sin(a / 2))}"/>',
        'IF i BETWEEN 3 AND 8:<path d="M 40 180 Q 128 {80 - 40 * sin(a / 2)} 216 120" fill="none" stroke="#FDA4AF" stroke-width="{12 + 8 * sin(a / 2)}" stroke-linecap="round" opacity="{0.7 - abs(i / 12 - 0.45) * 1.5}"/>',
        'IF i BETWEEN 3 AND 8:<path d="M 40 180 Q 128 {80 - 40 * sin(a / 2)} 216 120" fill="none" stroke="#FFFFFF" stroke-width="4" stroke-linecap="round" opacity="{0.84 - abs(i / 12 - 0.45) * 1.8}"/>',
        '<g transform="translate(128, 140) rotate({180 * sin(a / 2) - 45}) translate(-128, -140)"><path d="M 121 132 L 121 40 L 128 20 L 135 40 L 135 132 Z" fill="#FDA4AF" stroke="#9F1239" stroke-width="3"/></g>',
        'IF i IN (5, 6, 7):<circle cx="160" cy="110" r="30" fill="#FFE4E6" filter="blur(3px)"/>',
    ),
    "flyer": (
        '<ellipse cx="128" cy="225" rx="{58 - 9.8 * cos(a)}" ry="7" fill="#0284C7" fill-opacity="{0.22 - 0.07 * cos(a)}"/><g transform="translate(0, {14 * cos(a)})">',
        '<path d="M 110 120 C 80 {120 + 75 * sin(a)}, 45 {120 - 55 * sin(a)}, 30 {120 - 25 * sin(a)} C 48 {120 - 5 * sin(a)}, 68 {120 + 10 * sin(a)}, 90 128 Z" fill="#38BDF8"/>',
        '<path d="M 146 120 C 176 {120 + 75 * sin(a)}, 211 {120 - 55 * sin(a)}, 226 {120 - 25 * sin(a)} C 208 {120 - 5 * sin(a)}, 188 {120 + 10 * sin(a)}, 166 128 Z" fill="#38BDF8"/>',
        '<circle cx="128" cy="120" r="22" fill="#7DD3FC" stroke="#0284C7" stroke-width="4.5"/></g>',
    ),
    "astral": ('<g transform="translate(128, 128) rotate({i * 30}) scale({1 + 0.12 * sin(a * 2)}) translate(-128, -128)"><circle cx="128" cy="128" r="82" fill="none" stroke="#F59E0B" stroke-width="3" stroke-dasharray="14 10" opacity="0.65"/></g>',),
}
LOOPED = {
    "slime": (
        '<ellipse cx="128" cy="216" rx="{75 / sqrt(1 + 0.2 * sin(a))}" ry="{12 * (1 - 0.2 * sin(a))}" fill="#061D09" fill-opacity="0.35"/><g transform="translate(128, 210) scale({1 / sqrt(1 + 0.2 * sin(a))}, {1 + 0.2 * sin(a)}) rotate({4 * cos(a * 2)}) translate(-128, -210)">',
        '<g transform="translate({8 * sin(a)}, {3 * sin(a)})"><path d="M 123 162 Q 128 {166 + 3 * sin(a * 2)} 133 162" fill="none" stroke="#0F172A" stroke-width="3.5" stroke-linecap="round"/></g></g>',
    ),
    "coin": (
        '<ellipse cx="128" cy="220" rx="{90 * (0.8 + 0.1 * sin(a))}" ry="12" fill="#000000" fill-opacity="0.25"/><g transform="translate(128, 128)">',
        'IF i < 4 OR i > 9:<ellipse cx="0" cy="0" rx="{100 * abs(cos(a))}" ry="100" fill="#E6B800" stroke="#B38F00" stroke-width="8"/>',
        'IF i BETWEEN 4 AND 9:<ellipse cx="0" cy="0" rx="{100 * abs(cos(a))}" ry="100" fill="#E6B800" stroke="#806600" stroke-width="8"/>',
        '<ellipse cx="0" cy="0" rx="{74 * abs(cos(a))}" ry="74" fill="#F5C024" stroke="#FFDF4D" stroke-width="4"/><ellipse cx="0" cy="0" rx="{84 * abs(cos(a))}" ry="84" fill="#FFFFFF" opacity="0.3" transform="rotate({15 * sin(a) - 30})"/></g>',
    ),
    "bat": (
        '<ellipse cx="128" cy="225" rx="{60 - 9.6 * cos(a)}" ry="8" fill="#000000" fill-opacity="{0.25 - 0.096 * cos(a)}"/><g transform="translate(0, {12 * cos(a)})">',
        '<path d="M 108 125 L 25 {125 - 30 * sin(a)} L 55 {125 + 15 * sin(a)} L 108 125" fill="#4338CA"/><path d="M 148 125 L 231 {125 - 30 * sin(a)} L 201 {125 + 15 * sin(a)} L 148 125" fill="#4338CA"/></g>',
    ),
    "fire": (
        '<ellipse cx="128" cy="128" rx="85" ry="50" fill="none" stroke="#F43F5E" stroke-width="1.5" transform="rotate({i * 10 - 15}, 128, 128)"/><ellipse cx="128" cy="128" rx="70" ry="40" fill="none" stroke="#F59E0B" stroke-width="2.5" transform="rotate({30 - i * 15}, 128, 128)"/>',
        '<circle cx="128" cy="128" r="{32 + 4 * sin(a * 3)}" fill="#EA580C"/><circle cx="{120 + 40 * cos(a)}" cy="{128 + 25 * sin(a * 2)}" r="{14 + 6 * sin(a)}" fill="#F97316"/><circle cx="{136 - 45 * cos(a)}" cy="{120 - 35 * sin(a)}" r="{12 + 5 * cos(a)}" fill="#F97316" opacity="0.8"/>',
        '<circle cx="{110 + 10 * sin(a + 1)}" cy="{100 - (i * 4) % 60}" r="{2 + i % 3}" fill="#FFF" opacity="{0.6 + 0.4 * sin(a)}"/><circle cx="{140 + 8 * cos(a + 3)}" cy="{110 - ((i + 6) * 4) % 65}" r="{1 + i % 4}" fill="#FFEFA6" opacity="{0.5 + 0.5 * cos(a)}"/>',
    ),
}


@query(f"""
WITH p AS (SELECT p_partkey, lower(list_extract({list(PROMPTS)}, CAST(p_partkey % 6 + 1 AS INTEGER)) || ' ' || p_name) AS p FROM part), f AS (SELECT p_partkey, {FAMILY_SQL} AS family FROM p),
m AS (SELECT family, i, CASE family {' '.join(f"WHEN '{k}' THEN {text_of(*v)}" for k, v in DRAWN.items())} END AS markup FROM (SELECT family, i, i * 2 * pi() / 12 AS a FROM (SELECT DISTINCT family FROM f), range(0, 12) r(i)))
SELECT p_partkey, family, CAST(i AS INTEGER) AS frame, md5(markup) AS digest, length(markup) AS n_chars FROM f JOIN m USING (family)
""")
def generated_pictures(t):
    """The picture of each frame that a part's prompt asks for."""
    prompt = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, PROMPTS)), (F.col("p_partkey") % 6 + 1).cast("int")), "p_name")
    parts = t("part").select("p_partkey", prompt.alias("prompt"))
    rows = frames.procedural(parts, "prompt", F.lit(12), lambda x: pictures.drawn(x, pictures.templates(parts.sparkSession, pictures.GENERATED)))
    return rows.select("p_partkey", "family", "frame", F.md5("markup").alias("digest"), F.length("markup").cast("long").alias("n_chars"))


@query(f"""
WITH f AS (SELECT p_partkey, list_extract({list(LOOPS)}, CAST(p_partkey % 5 + 1 AS INTEGER)) AS family FROM part),
m AS ({' UNION ALL '.join(f"SELECT '{k}' AS family, i, {text_of(*v)} AS markup FROM (SELECT i, i * 2 * pi() / {LOOPS[k][0]} AS a FROM range(0, {LOOPS[k][0]}) r(i))" for k, v in LOOPED.items())})
SELECT p_partkey, family, CAST(i AS INTEGER) AS frame, md5(markup) AS digest, length(markup) AS n_chars FROM f JOIN m USING (family)
""")
def preset_pictures(t):
    """The picture of each frame of the built-in loop that a part names."""
    family = F.get(F.array(*map(F.lit, LOOPS)), (F.col("p_partkey") % 5).cast("int"))
    parts = t("part").select("p_partkey", family.alias("family"))
    rows = frames.loops(parts, "family", finish=lambda x: pictures.drawn(x, pictures.templates(parts.sparkSession, pictures.PRESETS)))
    return rows.select("p_partkey", "family", "frame", F.md5("markup").alias("digest"), F.length("markup").cast("long").alias("n_chars"))


SAID = ("walk on", "attack", "jump up", "magic spell", "stand", "burning flame", "pixel glow")


def places(x: str, digits: int) -> str:
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || CAST(CAST(round(abs({x}), {digits}) AS DECIMAL(30,{digits})) AS VARCHAR))"


def sheet_sql() -> str:
    at, whole = lambda d, n: f"CAST({d} + {n} AS VARCHAR)", lambda x: f"CAST({x} AS VARCHAR)"
    arc = lambda m, q, e, colour, width, least, more: f"""'<path d="M ' || {at('ox', m[0])} || ' ' || {at('oy', m[1])} || ' Q ' || {at('ox', q[0])} || ' ' || {at('oy', q[1])} || ' ' || {at('ox', e[0])} || ' ' || {at('oy', e[1])} || '" fill="none" stroke="{colour}" stroke-width="{width}" stroke-linecap="round" opacity="' || {decimals(f'{least} + greatest(0, w) * {more}')} || '"/>'"""

    def dot(p: int) -> str:
        turn, reach = f"(t * 2 * pi() + {p} * pi() / 4)", f"(58 + sin(t * 2 * pi() + {p}) * 8)"
        colour = f"CASE WHEN k = 5 THEN '{('#ffd166', '#ff6a2a')[p % 2]}' ELSE '{('#f6d365', '#64d8ff')[p % 2]}' END"
        x, y = places(f"(ox + 128 + cos({turn}) * {reach})", 1), places(f"(oy + 124 + sin({turn} * 1.15) * {reach} * 0.55)", 1)
        return f"""'<circle cx="' || {x} || '" cy="' || {y} || '" r="{2.5 + p % 3}" fill="' || {colour} || '" opacity=".82"/>'"""

    dots = " || ".join(map(dot, range(8)))
    return f"""
WITH m AS (SELECT p_partkey, i, p_partkey % 7 AS k, i / 12.0 AS t, CAST(i % 4 * 256 AS INTEGER) AS ox, CAST(i // 4 * 256 AS INTEGER) AS oy FROM part, range(0, 12) r(i)),
w AS (SELECT *, sin(t * 2 * pi()) AS w, cos(t * 2 * pi()) AS c, sin(t * pi()) AS arc, sin(least(1.0, t * 1.65) * pi()) AS strike FROM m),
v AS (SELECT *, CASE k WHEN 1 THEN greatest(-30.0, least(12.0, strike * -7)) WHEN 2 THEN greatest(-30.0, arc * -30) ELSE w * -5 END AS y, CASE WHEN k = 1 THEN strike * 8 WHEN k = 2 THEN w * 2 WHEN k IN (3, 6) THEN 0.0 ELSE c * 1.5 END AS x,
  greatest(-4.5, least(4.5, CASE WHEN k = 1 THEN strike * 18 - 8 WHEN k = 2 THEN w * 4 WHEN k IN (3, 6) THEN c * 2 ELSE w * 2 END)) AS turn,
  greatest(0.94, least(1.05, 1 + CASE WHEN k = 1 THEN strike * 0.04 WHEN k = 2 THEN CASE WHEN i > 10 THEN 0.08 ELSE 0 END WHEN k IN (3, 6) THEN w * 0.018 ELSE w * 0.025 END)) AS sx,
  greatest(0.94, least(1.05, 1 - CASE WHEN k = 1 THEN strike * 0.02 WHEN k = 2 THEN CASE WHEN i > 10 THEN 0.08 ELSE 0 END WHEN k IN (3, 6) THEN w * 0.018 ELSE w * 0.025 END)) AS sy FROM w WHERE k > 0),
e AS (SELECT *, CASE WHEN k = 1 THEN {arc((54, 176), (136, 54), (214, 116), '#f8fbff', 8, 0.22, 0.45)} || {arc((64, 184), (138, 78), (204, 128), '#56c7ff', 3, 0.25, 0.55)}
  WHEN k IN (3, 5, 6) THEN {dots} ELSE '<circle cx="' || {decimals('ox + 92 + w * 6')} || '" cy="' || {whole('oy + 82')} || '" r="3" fill="#ffffff" opacity=".5"/>' END AS effects FROM v),
s AS (SELECT p_partkey, string_agg('<g id="frame_' || {whole('i + 1')} || '"><ellipse cx="' || {at('ox', 128)} || '" cy="' || {at('oy', 218)} || '" rx="' || {places('(58 * (1 - least(0.28, abs(y) / 120)))', 1)} || '" ry="9" fill="#0f172a" opacity=".18"/>' || effects
  || '<g transform="translate(' || {places('(ox + 128 + x)', 2)} || ' ' || {places('(oy + 128 + y)', 2)} || ') rotate(' || {places('turn', 2)} || ') scale(' || {places('sx', 3)} || ' ' || {places('sy', 3)} || ') translate(-128 -128)"><image href="/i?a=1&amp;b=' || p_partkey
  || '" x="38" y="38" width="180" height="180" preserveAspectRatio="xMidYMid meet" style="' || CASE WHEN k = 6 OR p_partkey % 2 = 1 THEN 'image-rendering:pixelated' ELSE '' END || '"/></g></g>', '' ORDER BY i) AS cells FROM e GROUP BY p_partkey),
z AS (SELECT p_partkey, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 1024 768" width="1024" height="768"><defs><filter id="softShadow"><feGaussianBlur stdDeviation="2"/></filter></defs>' || cells || '</svg>' AS sheet FROM s)
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'walking needs more than one reference image' END AS error, md5(sheet) AS digest, length(sheet) AS n_chars FROM part LEFT JOIN z USING (p_partkey)"""


@query(sheet_sql())
def reference_sheets(t):
    """Sheets of a reference image in motion with shadow and effects, a sheet for each part; walking is an error."""
    k = F.col("p_partkey")
    rows = t("part").select("p_partkey", F.get(F.array(*map(F.lit, SAID)), (k % 7).cast("int")).alias("prompt"), F.concat(F.lit("/i?a=1&b="), k.cast("string")).alias("image"), F.when(k % 2 == 1, "Pixel Art").alias("style"))
    sheets = pictures.whole_sheets(rows, "prompt", "image", "style", F.lit(12), 4)
    return sheets.select("p_partkey", "error", F.md5("sheet").alias("digest"), F.length("sheet").cast("long").alias("n_chars"))
