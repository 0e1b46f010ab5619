"""From pixels of sprite sheets to frames: keying, grid detection, cells, anchors, scale and placement.

Pixels are rows (sheet_id, x, y, r, g, b, a); sheets are rows (sheet_id, width, height, columns, rows). Everything is
grouped by sheet and axis or cell, with partial aggregates, so a sheet's pixels are never in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import anchored, inset_cell, proportional_bounds
from ..plans.lineage import cut
from .ordered import projection_runs, run_bounds

# Fixed values of the normalisation.
VISIBLE = 24
UPPER_BODY, ANCHOR_HEIGHT, FALLBACK_HEIGHT, MARGIN = 0.58, 0.305, 0.32, 12


def keyed_out(pixels: DataFrame) -> DataFrame:
    """Green, magenta, magenta spill and cyan made transparent or cleaned; the first rule that holds decides."""
    r, g, b, a = (F.col(c) for c in "rgba")
    warm, cold = F.greatest(r, b), F.least(r, b)
    green, magenta, cyan = g - warm, cold - g, F.least(g, b) - r

    def cut(score: Column, low: int, width: int) -> Column:
        return 255 - F.greatest(F.lit(0), F.least(F.lit(255), ((score - low) / width * 255).cast("int")))

    def rgba(*values) -> Column:
        return F.struct(*((v if isinstance(v, Column) else F.lit(v)).cast("int").alias(n) for n, v in zip("rgba", values)))

    clear = rgba(r, g, b, 0)
    pale, spill, shade = F.greatest(g + 4, cold), F.greatest(F.lit(0), F.least(g + 10, cold - 36)), F.greatest(F.lit(0), F.least(r + 8, F.least(g, b) - 24))
    out = (
        F.when((g > 130) & (green > 35), F.when(green > 82, clear).otherwise(rgba(r, F.least(g, warm + 8), b, cut(green, 35, 47))))
        .when((r > 120) & (b > 120) & (g < 170) & (magenta > 18), F.when(magenta > 34, clear).otherwise(rgba(pale, g, pale, cut(magenta, 18, 16))))
        .when((a > 0) & (r > 55) & (b > 55) & (g < 115) & (magenta > 12), F.when((warm > 150) & (magenta > 28), clear).otherwise(rgba(spill, g, spill, a)))
        .when((g > 135) & (b > 135) & (r < 130) & (cyan > 38), F.when(cyan > 72, clear).otherwise(rgba(r, shade, shade, cut(cyan, 38, 34))))
        .otherwise(rgba(r, g, b, a))
    )
    return pixels.withColumn("_p", out).select(*(c for c in pixels.columns if c not in "rgba"), *(F.col(f"_p.{c}").alias(c) for c in "rgba"))


def projections(pixels: DataFrame, total: bool = False) -> DataFrame:
    """sheet_id, axis, i, n: visible pixels of each column and row that has any; with ``total`` also of the sheet (axis and i null). One pass by grouping sets."""
    seen = pixels.filter(F.col("a") > VISIBLE).select("sheet_id", "x", "y").distinct()
    sets = [["sheet_id", "x"], ["sheet_id", "y"], *([["sheet_id"]] if total else [])]
    counts = seen.groupingSets(sets, "sheet_id", "x", "y").agg(F.grouping("x").alias("_no_x"), F.grouping("y").alias("_no_y"), F.count("*").alias("n"))
    axis = F.when(F.col("_no_x") == 0, "x").when(F.col("_no_y") == 0, "y")
    return counts.select("sheet_id", F.coalesce("x", "y").alias("i"), "n", axis.alias("axis"))


def axis_runs(pixels: DataFrame, sheets: DataFrame) -> DataFrame:
    """sheet_id, axis, runs: ordered arrays of (start, end)."""
    length = F.when(F.col("axis") == "x", F.col("width")).otherwise(F.col("height"))
    across = F.when(F.col("axis") == "x", F.col("height")).otherwise(F.col("width"))
    counts = projections(pixels).join(sheets.select("sheet_id", "width", "height"), "sheet_id")
    threshold = F.greatest(F.lit(3), F.bround(across * 0.006).cast("int"))
    runs = projection_runs(counts, ["sheet_id", "axis"], "i", "n", threshold, F.greatest(F.lit(6), F.floor(length / 160)), F.greatest(F.lit(12), F.floor(length / 80)))
    return runs.groupBy("sheet_id", "axis").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))


def grid(pixels: DataFrame, sheets: DataFrame, forced: bool = False) -> DataFrame:
    """``sheets`` with x_bounds, y_bounds, mode and runs. Both axes are detected, or both are proportional."""
    px, py = proportional_bounds(F.col("width"), F.col("columns")), proportional_bounds(F.col("height"), F.col("rows"))
    if forced:
        return sheets.withColumns({"x_bounds": px, "y_bounds": py, "mode": F.lit("proportional_forced")})
    runs = axis_runs(pixels, sheets)
    side = lambda axis: runs.filter(F.col("axis") == axis).select("sheet_id", F.col("runs").alias(f"{axis}_runs"))
    both = sheets.join(side("x"), "sheet_id", "left").join(side("y"), "sheet_id", "left")
    found = both.withColumn("fx", run_bounds(F.col("x_runs"), F.col("columns"), F.col("width"))).withColumn("fy", run_bounds(F.col("y_runs"), F.col("rows"), F.col("height")))
    good = F.col("fx").isNotNull() & F.col("fy").isNotNull()
    return found.withColumns({"x_bounds": F.when(good, F.col("fx")).otherwise(px), "y_bounds": F.when(good, F.col("fy")).otherwise(py), "mode": F.when(good, "auto_detected").otherwise("proportional_fallback")}).drop("fx", "fy")


def cells(grids: DataFrame) -> DataFrame:
    """sheet_id, frame, column, row and the crop box of each cell, inset from the grid."""
    each = grids.select("sheet_id", "columns", "x_bounds", "y_bounds", F.explode(F.sequence(F.lit(0), F.col("columns") * F.col("rows") - 1)).alias("frame"))
    each = each.withColumn("column", F.col("frame") % F.col("columns")).withColumn("row", F.floor(F.col("frame") / F.col("columns")).cast("int"))
    at = lambda bounds, k: F.get(F.col(bounds), k)
    return each.select("sheet_id", "frame", "column", "row", inset_cell(at("x_bounds", F.col("column")), at("y_bounds", F.col("row")), at("x_bounds", F.col("column") + 1), at("y_bounds", F.col("row") + 1)).alias("cell"))


def frames(pixels: DataFrame, grids: DataFrame) -> DataFrame:
    """Each cell with its bounding box (in the cell; null if nothing is visible) and the anchor of its upper body.

    A pixel's cell follows from its place among the bounds; only that one cell is joined. Pixels are read once: boxes and anchors come from
    sums by line, of which a cell has no more than its height.
    """
    all_cells = cells(grids)
    place = lambda bounds, at: F.size(F.filter(bounds, lambda b: b <= F.col(at))) - 1
    seen = pixels.filter("a > 0").join(grids.select("sheet_id", "columns", "x_bounds", "y_bounds"), "sheet_id")
    seen = seen.select("sheet_id", "x", "y", "a", (place("y_bounds", "y") * F.col("columns") + place("x_bounds", "x")).alias("frame"))
    inside = (F.col("x") >= F.col("cell.x0")) & (F.col("x") < F.col("cell.x1")) & (F.col("y") >= F.col("cell.y0")) & (F.col("y") < F.col("cell.y1"))
    own = seen.join(all_cells, ["sheet_id", "frame"]).filter(inside).select("sheet_id", "frame", (F.col("x") - F.col("cell.x0")).alias("x"), (F.col("y") - F.col("cell.y0")).alias("y"), "a")
    visible = F.when(F.col("a") > VISIBLE, F.col("a")).cast("long")
    lines = own.groupBy("sheet_id", "frame", "y").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.sum(visible).alias("w"), F.sum(F.col("x") * visible).alias("wx"))
    boxes = lines.groupBy("sheet_id", "frame").agg(F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), (F.max("y") + 1).alias("y1"), F.collect_list(F.struct("y", "w", "wx")).alias("lines"))
    upper = F.greatest(F.col("y0") + 1, F.col("y0") + ((F.col("y1") - F.col("y0")) * UPPER_BODY).cast("int"))
    total = lambda value: F.aggregate(F.filter("lines", lambda e: (e["y"] < upper) & e["w"].isNotNull()), F.lit(0).cast("long"), lambda n, e: n + value(e))
    weight = total(lambda e: e["w"])
    some = lambda sum_: F.when(weight > 0, sum_ / weight)
    boxes = boxes.withColumn("ax", some(total(lambda e: e["wx"]))).withColumn("ay", some(total(lambda e: e["y"] * e["w"]))).drop("lines")
    out = all_cells.join(boxes, ["sheet_id", "frame"], "left")
    anchor = F.struct(F.coalesce("ax", (F.col("x0") + F.col("x1")) / 2).alias("x"), F.coalesce("ay", F.col("y0") + (F.col("y1") - F.col("y0")) * FALLBACK_HEIGHT).alias("y"))
    seen = F.col("x0").isNotNull()
    return out.select(*all_cells.columns, F.when(seen, F.struct("x0", "y0", "x1", "y1")).alias("bbox"), F.when(seen, anchor).alias("anchor"))


def placed(all_frames: DataFrame, frame_width: int, frame_height: int) -> DataFrame:
    """Frames with the sheet's one scale and the box where each goes; a sheet with nothing visible is an error."""
    w, h = F.col("bbox.x1") - F.col("bbox.x0"), F.col("bbox.y1") - F.col("bbox.y0")
    scales = all_frames.groupBy("sheet_id").agg(F.least((frame_width - MARGIN) / F.max(w), (frame_height - MARGIN) / F.max(h)).alias("s"))
    scales = scales.select("sheet_id", F.coalesce("s", F.raise_error(F.lit("no visible pixels")).cast("double")).alias("scale"))
    size = lambda n: F.greatest(F.lit(1), F.bround(n * F.col("scale")).cast("int"))
    x = anchored(F.lit(frame_width), size(w), (F.col("anchor.x") - F.col("bbox.x0")) * F.col("scale"), F.lit(frame_width / 2))
    y = anchored(F.lit(frame_height), size(h), (F.col("anchor.y") - F.col("bbox.y0")) * F.col("scale"), F.lit(frame_height * ANCHOR_HEIGHT))
    return all_frames.join(scales, "sheet_id").withColumn("placed", F.when(F.col("bbox").isNotNull(), F.array(x, y, size(w), size(h))))


def manifests(pixels: DataFrame, sheets: DataFrame, frame_width: int, frame_height: int, now: str, forced: bool = False) -> DataFrame:
    """One manifest for each sheet. Grids (a row for each sheet) and frames are checkpointed: both are read more than once. Pixels are read twice, for the grids and for the frames."""
    clean = keyed_out(pixels)
    grids = cut(grid(clean, sheets, forced))
    done = placed(cut(frames(clean, grids)), frame_width, frame_height)
    item = F.struct("frame", F.array("cell.x0", "cell.y0", "cell.x1", "cell.y1").alias("cell"), "placed")
    lists = done.groupBy("sheet_id").agg(F.array_sort(F.collect_list(item)).alias("f"))
    anchor = F.array(F.lit(round(frame_width / 2, 2)), F.lit(round(frame_height * ANCHOR_HEIGHT, 2)))
    return grids.join(lists, "sheet_id").select(
        "sheet_id", (F.col("columns") * F.col("rows")).alias("frameCount"), F.array(F.lit(frame_width), F.lit(frame_height)).alias("frameSize"), F.array(F.col("columns") * frame_width, F.col("rows") * frame_height).alias("sheetSize"),
        F.array("width", "height").alias("sourceSheetSize"), F.transform("f", lambda x: x["cell"]).alias("sourceCells"), F.transform("f", lambda x: x["placed"]).alias("frameBboxes"),
        F.transform("f", lambda x: F.when(x["placed"].isNotNull(), anchor)).alias("rootAnchors"), F.struct("mode", F.col("x_bounds").alias("xBounds"), F.col("y_bounds").alias("yBounds")).alias("gridDetection"), F.lit(now).alias("createdTime"),
    )
