"""Row-producing operators: frame lists, procedural motion, slices and bundles."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import grid_cell, harmonic, restrained
from ..functions.numbers import lit
from ..functions.text import animation_family, escape_markup, markup_body, motion
from .ordered import padded


def per_frame(rows: DataFrame, count: Column) -> DataFrame:
    """A row for each frame index from 0."""
    return rows.withColumn("frame", F.explode(F.sequence(F.lit(0), count.cast("int") - 1)))


def windows(rows: DataFrame, count: Column, columns: Column, width: Column, height: Column) -> DataFrame:
    """frame, column, row, x, y of each frame's window on its sheet."""
    r = per_frame(rows, count).withColumn("_c", grid_cell(F.col("frame"), columns))
    return r.withColumns({"column": F.col("_c.column"), "row": F.col("_c.row"), "x": F.col("_c.column") * width, "y": F.col("_c.row") * height}).drop("_c")


def window_markup(url: Column, x: Column, y: Column, width: Column, height: Column, sheet_width: Column, sheet_height: Column) -> Column:
    """A frame as a view on the sheet's image."""
    n = lambda c: c.cast("string")
    return F.concat(
        F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), n(width), F.lit('" height="'), n(height), F.lit('" viewBox="'), F.concat_ws(" ", n(x), n(y), n(width), n(height)), F.lit('" overflow="hidden"><image href="'), escape_markup(url),
        F.lit('" x="0" y="0" width="'), n(sheet_width), F.lit('" height="'), n(sheet_height), F.lit('" preserveAspectRatio="none"/></svg>'),
    )


def generation_size(count: Column) -> Column:
    """12 or 16 frames; anything else, texts among it, is 12."""
    return F.when(count == 16, 16).otherwise(12)


# The numbers that move a picture. A wave is base + amplitude * f(frequency * phase + shift) for f sin, cos or |cos|; a
# line goes base + step * frame; a fall goes base - ((frame + ahead) * step) % span; a turn goes base + frame % span.
FAMILIES = {
    "slime": {"scaleY": ("sin", 1, 0.22, 1, 0), "wobble": ("cos", 0, 5, 2, 0), "lookX": ("sin", 0, 6, 1, 0), "bob": ("sin", 0, 2.64, 1, 0), "mouth": ("sin", 167, 2.5, 2, 0)},
    "coin": {"shadow": ("sin", 68, 8.5, 1, 0), "face": ("cos", 0, 1, 1, 0), "rim": ("abscos", 0, 96, 1, 0), "core": ("abscos", 0, 72, 1, 0), "sheen": ("abscos", 0, 80, 1, 0), "glint": ("sin", -35, 15, 1, 0), "emblem": ("line", 0, 15)},
    "fire": {
        "pulse": ("sin", 34, 6, 4, 0), "p1X": ("cos", 128, 42, 2.2, 0), "p1Y": ("sin", 120, 30, 1.5, -math.pi / 4), "p1Size": ("cos", 15, 6, 1, 0), "p2X": ("cos", 128, 48, 1.8, math.pi), "p2Y": ("sin", 115, 35, 2.1, math.pi / 3), "p2Size": ("sin", 13, 5, 1, 0),
        "node1X": ("cos", 112, 10, 3, 0), "node1Y": ("fall", 100, 0, 6, 65), "node1Size": ("turn", 2, 3), "node2X": ("sin", 144, 12, 2, 0), "node2Y": ("fall", 110, 4, 6, 70), "node2Size": ("turn", 1.5, 2.5),
    },
    "slash": {"angle": ("sin", -45, 180, 0.5, 0), "shadowOpacity": ("sin", 0.3, -0.3, 0.5, 0), "arcY": ("sin", 80, -40, 0.5, 0), "arcWidth": ("sin", 12, 8, 0.5, 0)},
    "flyer": {"bob": ("cos", 0, 14, 1, 0), "shadow": ("cos", 58, -9.8, 1, 0), "shadowOpacity": ("cos", 0.22, -0.07, 1, 0), "wing1": ("sin", 120, 75, 1, 0), "wing2": ("sin", 120, -55, 1, 0), "wing3": ("sin", 120, -25, 1, 0), "wing4": ("sin", 120, -5, 1, 0), "wing5": ("sin", 120, 10, 1, 0)},
    "astral": {"pulse": ("sin", 1, 0.12, 2, 0), "spin": ("sweep", 0, 360)},
}
PRESETS = {
    "slime": {"scaleY": ("sin", 1, 0.2, 1, 0), "wobble": ("cos", 0, 4, 2, 0), "lookX": ("sin", 0, 8, 1, 0), "bob": ("sin", 0, 3, 1, 0), "mouth": ("sin", 166, 3, 2, 0)},
    "coin": {"shadow": ("sin", 72, 9, 1, 0), "face": ("cos", 0, 1, 1, 0), "rim": ("abscos", 0, 100, 1, 0), "core": ("abscos", 0, 74, 1, 0), "sheen": ("abscos", 0, 84, 1, 0), "glint": ("sin", -30, 15, 1, 0), "reflection": ("cos", 128, 60, 1, 0)},
    "bat": {"bob": ("cos", 0, 12, 1, 0), "shadow": ("cos", 60, -9.6, 1, 0), "shadowOpacity": ("cos", 0.25, -0.096, 1, 0), "wing1": ("sin", 125, 90, 1, 0), "wing2": ("sin", 125, -60, 1, 0), "wing3": ("sin", 125, -30, 1, 0), "wing4": ("sin", 125, -10, 1, 0), "wing5": ("sin", 125, 15, 1, 0)},
    "fire": {
        "pulse": ("sin", 32, 4, 3, 0), "p1X": ("cos", 120, 40, 1, 0), "p1Y": ("sin", 128, 25, 2, 0), "p1Size": ("sin", 14, 6, 1, 0), "p2X": ("cos", 136, 45, 1, math.pi), "p2Y": ("sin", 120, 35, 1, math.pi), "p2Size": ("cos", 12, 5, 1, 0),
        "ring1": ("line", -15, 10), "ring2": ("line", 30, -15), "tail": ("line", 0, 30), "spark1X": ("sin", 110, 10, 1, 1), "spark1Y": ("fall", 100, 0, 4, 60), "spark1Size": ("turn", 2, 3), "spark1Opacity": ("sin", 0.6, 0.4, 1, 0),
        "spark2X": ("cos", 140, 8, 1, 3), "spark2Y": ("fall", 110, 6, 4, 65), "spark2Size": ("turn", 1, 4), "spark2Opacity": ("cos", 0.5, 0.5, 1, 0),
    },
}
PRESET_FRAMES = {"slime": 12, "coin": 12, "bat": 16, "fire": 12}


def number_at(rule: tuple, frame: Column, count: Column) -> Column:
    """A number of the tables above at ``frame`` of ``count``."""
    kind, base, *r = rule
    if kind == "line":
        return base + frame * r[0]
    if kind == "sweep":
        return base + frame * (r[0] / count)
    if kind == "fall":
        return base - ((frame + r[0]) * r[1]) % r[2]
    if kind == "turn":
        return base + frame % F.lit(r[0])
    wave = {"sin": F.sin, "cos": F.cos, "abscos": lambda x: F.abs(F.cos(x))}[kind]
    return base + r[0] * wave(frame * (2 * math.pi) / count * r[1] + r[2])


def parameters(tables: dict, family: Column, frame: Column, count: Column) -> Column:
    """map of the numbers of a family's picture. Widths that keep a slime's volume and a slash's visible sweep follow from the others."""
    out = F.create_map().cast("map<string,double>")
    for name, rules in tables.items():
        values = {k: number_at(rule, frame, count) for k, rule in rules.items()}
        if name == "slime":
            values |= {"scaleX": 1 / F.sqrt(values["scaleY"]), "shadowX": 75 / F.sqrt(values["scaleY"]), "shadowY": 12 * (2 - values["scaleY"])}
        if name == "slash":
            done = frame / count
            values |= {"sweepOpacity": F.when(done.between(0.2, 0.7), 0.7 - F.abs(done - 0.45) * 1.5).otherwise(0.0), "flash": F.when((done > 0.4) & (done < 0.6), 1.0).otherwise(0.0)}
        out = F.when(family == name, F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("double"))))).otherwise(out)
    return out


#: Pairs of family and count whose numbers are computed once and broadcast; with more of them they are computed for each row.
KINDS = 1_000


def spread(rows: DataFrame) -> DataFrame:
    """Rows of which each becomes many: a table of a few bytes is read by a few tasks, so they are dealt to four for each core."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def same(df: DataFrame) -> DataFrame:
    return df


def procedural(prompts: DataFrame, prompt: str, count: Column, finish: Callable[[DataFrame], DataFrame] = same) -> DataFrame:
    """A row for each frame of each prompt: family, phase and the numbers of its picture.

    They follow from family and count, so they are computed once for each pair and joined. ``finish`` adds what follows from
    them alone (markup, say), and may give more or fewer rows; of the columns it sees only family, frame, phase and parameters are meant.
    """

    def numbers(df: DataFrame) -> DataFrame:
        at = per_frame(df, F.col("_count")).withColumn("phase", F.col("frame") * 2 * math.pi / F.col("_count"))
        return finish(at.withColumn("parameters", parameters(FAMILIES, F.col("family"), F.col("frame"), F.col("_count"))))

    rows = prompts.withColumn("family", animation_family(F.col(prompt))).withColumn("_count", count)
    kinds = rows.select("family", "_count").distinct()
    if kinds.limit(KINDS + 1).count() > KINDS:
        return numbers(rows).drop("_count")
    known = numbers(kinds)
    return spread(rows).join(F.broadcast(known), ["family", "_count"]).select(*prompts.drop("family").columns, *known.drop("_count").columns)


def loops(rows: DataFrame, family: str, counts: dict[str, int] = PRESET_FRAMES, finish: Callable[[DataFrame], DataFrame] = same) -> DataFrame:
    """``rows`` with the frames of the built-in loop that ``family`` names: frame, n and the numbers of its picture. Rows that name none have no frames.

    The numbers of a loop are computed once and joined; ``finish`` as in ``procedural``, with family, n, frame and parameters.
    """
    known = per_frame(rows.sparkSession.createDataFrame(list(counts.items()), "family string, n int"), F.col("n"))
    numbers = finish(known.withColumn("parameters", parameters(PRESETS, F.col("family"), F.col("frame"), F.col("n"))))
    more = [c for c in numbers.columns if c != "family"]
    kept = rows.drop(*(c for c in more if c in rows.columns))
    return spread(kept).join(F.broadcast(numbers.withColumnRenamed("family", "_family")), F.col(family) == F.col("_family")).select(*kept.columns, *more)


def preset_frames(spark, counts: dict[str, int] = PRESET_FRAMES) -> DataFrame:
    """Frames of the built-in loops (family: frames)."""
    return loops(spark.createDataFrame([(f,) for f in counts], "family string"), "family", counts)


# Words of a prompt that ask for an effect, and the effects' colours.
WALKING, FIERY, MAGIC = "walk|walking|run|走|行走|跑", "fire|flame|火", "magic|spell|cast|glow|spark|魔法|光|粒子|施法"
PARTICLES, FIRE_COLOURS, MAGIC_COLOURS = 8, ("#ffd166", "#ff6a2a"), ("#f6d365", "#64d8ff")


def motion_kind(prompt: str) -> Column:
    """A text for all of a prompt that ``reference_motion`` follows."""
    said = F.lower(F.coalesce(F.col(prompt), F.lit("")))
    return F.concat_ws("|", F.coalesce(motion(F.col(prompt)), F.lit("")), *(said.rlike(x).cast("string") for x in (WALKING, FIERY, MAGIC)))


def reference_motion(rows: DataFrame, prompt: str, count: Column, columns: Column) -> DataFrame:
    """Frames of a reference image moved within limits, on a grid, with shadow and effects; walking needs a rig and is an error row."""
    said = F.lower(F.coalesce(F.col(prompt), F.lit("")))
    r = windows(rows.withColumn("motion", motion(F.col(prompt))), count, columns, F.lit(256), F.lit(256))
    walks, fiery = said.rlike(WALKING), said.rlike(FIERY)
    r = r.withColumn("error", F.when(walks, "walking needs more than one reference image")).withColumn("move", F.when(~walks, restrained(harmonic(F.col("motion"), F.col("frame"), count))))
    phase = F.col("frame") * (2 * math.pi) / count
    spark = lambda x, y, size, opacity, colour: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), size.cast("double").alias("size"), opacity.cast("double").alias("opacity"), colour.alias("colour"))

    def particle(p):
        turn = phase + p * (2 * math.pi / PARTICLES)
        reach = 58 + F.sin(phase + p) * 8
        colour = F.when(fiery, F.when(p % 2 == 1, FIRE_COLOURS[1]).otherwise(FIRE_COLOURS[0])).otherwise(F.when(p % 2 == 1, MAGIC_COLOURS[1]).otherwise(MAGIC_COLOURS[0]))
        return spark(128 + F.cos(turn) * reach, 124 + F.sin(turn * 1.15) * reach * 0.55, 2.5 + p % 3, F.lit(0.82), colour)

    glow = F.greatest(F.lit(0.0), F.sin(phase))
    slash = F.array(*(spark(F.lit(x), F.lit(y), F.lit(w), least + glow * more, F.lit(c)) for x, y, w, least, more, c in ((54, 176, 8, 0.22, 0.45, "#f8fbff"), (64, 184, 3, 0.25, 0.55, "#56c7ff"))))
    dot = F.array(spark(92 + F.sin(phase) * 6, F.lit(82), F.lit(3), F.lit(0.5), F.lit("#ffffff")))
    many = F.transform(F.sequence(F.lit(0), F.lit(PARTICLES - 1)), particle)
    effects = F.when(F.col("move.effect") == "slash", slash).when((F.col("move.effect") == "magic") | fiery | said.rlike(MAGIC), many).otherwise(dot)
    shadow = 58 * (1 - F.least(F.lit(0.28), F.abs(F.col("move.y")) / 120))
    return r.withColumn("shadow", F.when(~walks, shadow)).withColumn("effects", F.when(~walks, effects))


def sliced(rows: DataFrame, sheet: str, count: Column, columns: Column, side: int = 256) -> DataFrame:
    """A sheet's markup as one view for each frame."""
    r = windows(rows.withColumn("_body", markup_body(F.col(sheet))), count, columns, F.lit(side), F.lit(side))
    view = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="'), F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string"), F.lit(str(side)), F.lit(str(side))), F.lit(f'" width="{side}" height="{side}">'), F.col("_body"), F.lit("</svg>"))
    return r.withColumn("markup", view).drop("_body")


def bundled(frames: DataFrame, key: str, index: str, markup: str, columns: int, side: int = 256) -> DataFrame:
    """Frames of each ``key`` in order on one sheet."""
    cell = grid_cell(F.col(index), columns)
    moved = F.concat(F.lit('<g transform="translate('), (cell["column"] * side).cast("string"), F.lit(" "), (cell["row"] * side).cast("string"), F.lit(')">'), markup_body(F.col(markup)), F.lit("</g>"))
    parts = frames.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), moved.alias("g")))).alias("parts"))
    size = lambda n: (n * side).cast("string")
    rows = F.ceil(F.size("parts") / columns)
    width, height = size(F.lit(columns)), size(rows)
    return parts.select(key, F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), F.concat_ws(" ", width, height), F.lit('" width="'), width, F.lit('" height="'), height, F.lit('">'), F.array_join(F.transform("parts", lambda p: p["g"]), ""), F.lit("</svg>")).alias("sheet"))


def exported(frames: Column, count: Column, fps: Column) -> Column:
    """Frames of an export: as many as asked for, or the only one for a second."""
    return F.when(count > 1, padded(frames, count)).otherwise(F.array_repeat(F.get(frames, F.lit(0)), F.greatest(F.lit(1), fps)))


def ticker(milliseconds: Column, fps: Column, count) -> Column:
    """The frame that shows after so many milliseconds."""
    return (F.floor(milliseconds * fps / 1000) % lit(count)).cast("int")
