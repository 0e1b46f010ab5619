"""Geometry of frames, layers and zones, as column expressions over struct columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import clamp, lit, or_default, round_half_up


def frame_size(sprite: Column) -> Column:
    """struct(width, height): the frame size if both are positive, else the square cell, else 256."""
    w, h = F.get(sprite["frameSize"], F.lit(0)), F.get(sprite["frameSize"], F.lit(1))
    good, cell = F.coalesce((w > 0) & (h > 0), F.lit(False)), or_default(sprite["cellSize"], 256.0)
    return F.struct(F.when(good, w).otherwise(cell).alias("width"), F.when(good, h).otherwise(cell).alias("height"))


def frame_total(sprite: Column) -> Column:
    return F.coalesce(F.nullif(F.coalesce(F.array_size(sprite["frames"]), F.lit(0)), F.lit(0)), sprite["frameCount"], F.lit(0))


def grid_columns(sprite: Column) -> Column:
    own, width = sprite["gridColumns"], frame_size(sprite)["width"]
    sheet = or_default(F.get(sprite["sheetSize"], F.lit(0)), width)
    inferred = F.greatest(F.lit(1), round_half_up(sheet / F.greatest(F.lit(1.0), width)))
    return F.when(sprite.isNull(), 1).when(own > 0, round_half_up(own)).otherwise(inferred).cast("int")


def grid_rows(sprite: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(1), frame_total(sprite)) / grid_columns(sprite))).cast("int")


def frame_at(frames: Column, index: Column) -> Column:
    """The frame at ``index``, which goes round; the first where it is empty; '' where there is none."""
    at = F.get(frames, (index % F.greatest(F.lit(1), F.size(frames))).cast("int"))
    return F.coalesce(F.nullif(at, F.lit("")), F.get(frames, F.lit(0)), F.lit(""))


def grid_cell(index: Column, columns) -> Column:
    return F.struct((index % lit(columns)).alias("column"), F.floor(index / lit(columns)).alias("row"))


def thumb_position(index: Column, columns: Column, rows: Column) -> Column:
    """Background position in percent; 0 along an axis of one."""
    cell = grid_cell(index, columns)
    at = lambda k, n: F.when(n <= 1, 0.0).otherwise(k / (n - 1) * 100)
    return F.struct(at(cell["column"], columns).alias("x"), at(cell["row"], rows).alias("y"))


def viewport(scene: Column, default_width: float = 1280.0) -> Column:
    return F.struct(F.least(or_default(scene["viewportWidth"], default_width), scene["width"]).alias("width"), or_default(scene["viewportHeight"], scene["height"]).alias("height"))


def _box(left: Column, top: Column, width: Column, height: Column) -> Column:
    return F.struct(
        left.alias("left"), (left + width).alias("right"), top.alias("top"), (top + height).alias("bottom"), width.alias("width"), height.alias("height"),
        (left + width * 0.5).alias("centerX"), (top + height * 0.5).alias("centerY"),
    )


def world_bounds(layer: Column, sprite: Column) -> Column:
    """The box of a layer whose position is its lower left corner; empty without a sprite."""
    size = frame_size(sprite)
    width = F.when(sprite.isNull(), 0.0).otherwise(size["width"]) * layer["scale"]
    height = F.when(sprite.isNull(), 0.0).otherwise(size["height"]) * layer["scale"]
    return _box(layer["x"], layer["y"] - height, width, height)


def zone_bounds(bounds: Column, interaction: Column) -> Column:
    """The box that an interaction reacts in: its own size or the layer's (0 and null inherit), at least 24."""
    width = F.greatest(F.lit(24.0), or_default(interaction["zoneWidth"], bounds["width"]))
    height = F.greatest(F.lit(24.0), or_default(interaction["zoneHeight"], bounds["height"]))
    x = bounds["centerX"] + F.coalesce(interaction["zoneOffsetX"], F.lit(0.0))
    y = bounds["centerY"] + F.coalesce(interaction["zoneOffsetY"], F.lit(0.0))
    return _box(x - width / 2, y - height / 2, width, height)


def distance_to_box(x: Column, y: Column, box: Column) -> Column:
    """0 inside, else the distance to the nearest edge."""
    return F.hypot(F.greatest(box["left"] - x, x - box["right"], F.lit(0.0)), F.greatest(box["top"] - y, y - box["bottom"], F.lit(0.0)))


def on_stage(layer: Column, camera_x, stage_scale) -> Column:
    """Screen position; a null parallax moves with the world, 0 stays."""
    return F.struct(((layer["x"] - lit(camera_x) * F.coalesce(layer["parallax"], F.lit(1.0))) * lit(stage_scale)).alias("left"), (layer["y"] * lit(stage_scale)).alias("top"), (layer["scale"] * lit(stage_scale)).alias("scale"))


def clamp_frame_side(value: Column, most) -> Column:
    return F.when(value.isNull() | F.isnan(value), 1).otherwise(clamp(round_half_up(value), 1, F.greatest(F.lit(1), lit(most)))).cast("int")


def inferred_frame(width: Column, height: Column) -> Column:
    """The frame of a sheet with one row (or one column) of about square frames."""
    n = F.greatest(F.lit(1), round_half_up(F.greatest(width, height) / F.greatest(F.lit(1), F.least(width, height))))
    part = F.greatest(F.lit(1), F.floor(F.greatest(width, height) / n))
    wide = width >= height
    return F.struct(F.when(wide, part).otherwise(width).cast("long").alias("width"), F.when(wide, height).otherwise(part).cast("long").alias("height"))


def preview_box(frame_w: Column, frame_h: Column, view_w: Column, view_h: Column) -> Column:
    """The largest box of a frame's shape in a view; narrow views (up to 760) have margins of their own."""
    ratio, compact = F.greatest(F.lit(0.01), frame_w / F.greatest(F.lit(1), frame_h)), view_w <= 760
    most_w = F.when(compact, F.least(view_w * 0.88, F.lit(560.0))).otherwise(F.least(view_w * 0.7, F.lit(640.0)))
    most_h = F.greatest(F.lit(120), view_h - F.when(compact, 330).otherwise(245))
    tall = most_w / ratio > most_h
    width, height = F.when(tall, most_h * ratio).otherwise(most_w), F.when(tall, most_h).otherwise(most_w / ratio)
    return F.struct(F.greatest(F.lit(1), round_half_up(width)).cast("int").alias("width"), F.greatest(F.lit(1), round_half_up(height)).cast("int").alias("height"))


def grid_fits(columns: Column, rows: Column, frame_w: Column, frame_h: Column, sheet_w: Column, sheet_h: Column) -> Column:
    """Whether a grid is inside its sheet, with one pixel of slack."""
    return (columns * frame_w <= sheet_w + 1) & (rows * frame_h <= sheet_h + 1)


def proportional_bounds(size: Column, count: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), count.cast("int")), lambda i: F.bround(i * size / count).cast("int"))


def inset_cell(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A cell without its border of one per cent (at least one pixel), never empty."""
    inset = F.greatest(F.lit(1), F.bround(F.least(x1 - x0, y1 - y0) * 0.01).cast("int"))
    left, top = F.least(x1, x0 + inset), F.least(y1, y0 + inset)
    return F.struct(left.alias("x0"), top.alias("y0"), F.greatest(left + 1, x1 - inset).alias("x1"), F.greatest(top + 1, y1 - inset).alias("y1"))


def anchored(frame: Column, size: Column, anchor_offset: Column, target: Column) -> Column:
    """Where a sprite of ``size`` goes along one axis so that its anchor meets ``target``: 4 pixels from either edge, or in the middle if it is too large."""
    return F.when(size <= frame - 8, F.greatest(F.lit(4), F.least(frame - size - 4, F.bround(target - anchor_offset)))).otherwise(F.floor((frame - size) / 2)).cast("int")


def harmonic(kind: Column, index: Column, count) -> Column:
    """struct(x, y, rotate, scaleX, scaleY, effect) of a motion at frame ``index`` of ``count``."""
    t = index / lit(count)
    wave, cosine, arc = F.sin(t * 2 * F.pi()), F.cos(t * 2 * F.pi()), F.sin(t * F.pi())
    strike, late = F.sin(F.least(F.lit(1.0), t * 1.65) * F.pi()), F.when(t > 0.84, 0.08).otherwise(0.0)

    def at(x, y, rotate, sx, sy, effect):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), rotate.cast("double").alias("rotate"), sx.cast("double").alias("scaleX"), sy.cast("double").alias("scaleY"), F.lit(effect).alias("effect"))

    a = F.abs(wave)
    return (
        F.when(kind == "walk", at(cosine * 3, a * -9, wave * 3, 1 + a * 0.025, 1 - a * 0.025, "dust"))
        .when(kind == "attack", at(strike * 8, strike * -7, strike * 18 - 8, 1 + strike * 0.04, 1 - strike * 0.02, "slash"))
        .when(kind == "jump", at(wave * 2, arc * -30, wave * 4, 1 + late, 1 - late, "dust"))
        .when(kind == "magic", at(F.lit(0), wave * -5, cosine * 2, 1 + wave * 0.018, 1 - wave * 0.018, "magic"))
        .otherwise(at(cosine * 1.5, wave * -5, wave * 2, 1 + wave * 0.025, 1 - wave * 0.025, "idle"))
    )


def restrained(m: Column) -> Column:
    """A motion within what a reference image bears."""
    limits = {"x": (-10.0, 10.0), "y": (-30.0, 12.0), "rotate": (-4.5, 4.5), "scaleX": (0.94, 1.05), "scaleY": (0.94, 1.05)}
    return F.struct(*(clamp(m[k], *v).alias(k) for k, v in limits.items()), m["effect"].alias("effect"))
