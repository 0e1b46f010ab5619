"""Nearest boxes by a tree of tiles that cells of points read from the top, and two looks at the boxes themselves.

A box lies in one tile: that of its left upper corner, at the first level whose tiles are at least half as wide as the box; tiles of level k are ``STEP`` ** k times as
wide as those of level 0. A tile stands for all boxes in it and below by the rectangle around them, which gives a least and a greatest distance from a cell of points.
In a round each cell reads what is below of the tiles that it has kept, and drops what is farther than the least of all greatest distances, so it ends with the
tiles of boxes along the nearest front, however far away or dense the boxes are. There are as many rounds as levels; neither points nor boxes take part in them.

Then each point meets the boxes of the nearest of its cell's tiles, which gives a distance that a nearest box can't exceed, and at last those of the tiles within that
distance. So boxes are dealt by tile twice and kept nowhere, and of the pairs that meet only a minimum for each point goes on.

Level 0 of a group is as wide as ``tile`` halved or doubled until about ``BOXES`` boxes are in a tile, and narrower if some tile has many more, so tiles are fewer
than boxes by that much, and a point reads about as many boxes of a large table as of a small one. Of equal rectangles in a group only the first by ``box`` counts. Groups
(scenes) meet only themselves. Tables of few rows are broadcast, others joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import dropped
from ..plans.lineage import stored as cut

#: Tiles of a level in one of the next along an axis (as bits), levels at most, boxes of a tile of level 0 (about), and how many times as many call for narrower tiles.
BITS, LEVELS, BOXES, MANY = 2, 24, 1024, 4
#: Times that tiles are made narrower at most, width of a cell of points in tiles of level 0, and rows of a table that is broadcast.
NARROWER, CELL, BROADCAST_ROWS = 3, 2.0, 50_000
STEP = 1 << BITS
SIDES, TILE = ("left", "top", "right", "bottom"), ("level", "tx", "ty")


def whole(*columns: str) -> Column:
    return F.expr(" AND ".join(f"{x} IS NOT NULL AND NOT isnan({x})" for x in columns))


def rectangle(*more: Column) -> list[Column]:
    """Aggregates: the rectangle around rectangles."""
    return [F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), *more]


def least_distance(box: Column | None = None, x: tuple[str, str] = ("px", "px"), y: tuple[str, str] = ("py", "py")) -> Column:
    """From the nearest point of a cell (or a point) to the nearest that a rectangle may hold."""
    left, top, right, bottom = (F.col(c) if box is None else box[c] for c in SIDES)
    return F.hypot(F.greatest(left - F.col(x[1]), F.col(x[0]) - right, F.lit(0.0)), F.greatest(top - F.col(y[1]), F.col(y[0]) - bottom, F.lit(0.0)))


def greatest_distance(box: Column | None = None, x: tuple[str, str] = ("px", "px"), y: tuple[str, str] = ("py", "py")) -> Column:
    """What no point of a cell (or no point) exceeds to the boxes that a rectangle is around."""
    left, top, right, bottom = (F.col(c) if box is None else box[c] for c in SIDES)
    return F.hypot(F.greatest(F.col(x[1]) - left, right - F.col(x[0])), F.greatest(F.col(y[1]) - top, bottom - F.col(y[0])))


def hinted(df: DataFrame) -> DataFrame:
    """A stored table, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def at(c: str, width: Column) -> Column:
    return F.floor(F.col(c) / width).cast("long")


def tile_key(row: Column | None = None) -> Column:
    """Level, tx and ty in one number. Tiles of a group farther than 2 ** 28 tiles from the origin may share one, then points meet boxes of both."""
    level, tx, ty = (F.col(c) if row is None else row[c] for c in TILE)
    return F.shiftleft(tx, 34).bitwiseXOR(F.shiftleft(ty, 5)).bitwiseXOR(level.cast("long"))


def placed(boxes: DataFrame, groups: DataFrame) -> DataFrame:
    """``boxes`` with level, tx and ty of their tiles."""
    size = F.greatest(F.col("right") - F.col("left"), F.col("bottom") - F.col("top"))
    level = F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.coalesce(F.ceil(F.log(float(STEP), size / F.col("width") / 2)), F.lit(0)))).cast("int")
    rows = boxes.join(groups, "grp").select("grp", "box", *SIDES, level.alias("level"), at("left", F.col("width")).alias("tx"), at("top", F.col("width")).alias("ty"))
    return rows.withColumns({c: F.expr(f"shiftright({c}, level * {BITS})") for c in ("tx", "ty")})


def laid_out(boxes: DataFrame, tile: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boxes with the keys of their tiles (not stored), the tiles (grp, level, tx, ty, rectangle), and grp and width of tiles of level 0."""
    extent = lambda c: F.nanvl(F.max(c) - F.min(c), F.lit(0.0))
    wide, high, share = F.col("wide"), F.col("high"), F.lit(float(BOXES)) / F.col("n")
    even = F.greatest(F.sqrt(wide) * F.sqrt(high) * F.sqrt(share), F.greatest(wide, high) * share)
    doubled = F.floor(F.greatest(F.lit(-900.0), F.least(F.lit(900.0), F.coalesce(F.log2(even / tile), F.lit(0.0)))))
    groups = cut(boxes.groupBy("grp").agg(F.count("*").alias("n"), extent("left").alias("wide"), extent("top").alias("high")).select("grp", (F.lit(tile) * F.pow(F.lit(2.0), doubled)).alias("width")))
    for k in range(NARROWER + 1):
        items = placed(boxes, hinted(groups))
        tiles = cut(items.groupBy("grp", *TILE).agg(*rectangle(F.count("*").alias("n"))))
        crowded = tiles.filter(F.col("level") == 0).groupBy("grp").agg(F.max("n").alias("most")).filter(F.col("most") > MANY * BOXES)
        if k == NARROWER or crowded.isEmpty():
            break
        narrower = F.coalesce(F.pow(F.lit(2.0), F.ceil(F.log(4.0, F.col("most") / BOXES))), F.lit(1.0))
        before, groups = groups, cut(groups.join(crowded, "grp", "left").select("grp", (F.col("width") / narrower).alias("width")))
        dropped(before, tiles)
    items = items.select("grp", tile_key().alias("key"), *SIDES, "box")
    if not tiles.filter(F.col("n") > MANY * BOXES).isEmpty():  # in a tile, equal rectangles may be as many as there are boxes
        items = items.repartition("grp", "key").groupBy("grp", "key", *SIDES).agg(F.min("box").alias("box"))
    return items, tiles, groups


def tree(tiles: DataFrame, groups: DataFrame) -> list[DataFrame]:
    """For each level from 0: what is below a tile of it, or its own boxes (grp, ux, uy of that tile; level, tx, ty, rectangle; leaf: a tile of boxes). The last has one tile of each group, or few."""
    sizes = tiles.groupBy("grp").agg(*rectangle(F.max("level").alias("level"))).join(groups, "grp")
    size = F.greatest(F.col("right") - F.col("left"), F.col("bottom") - F.col("top"))
    top = sizes.agg(F.max(F.greatest("level", F.least(F.lit(LEVELS), F.coalesce(F.ceil(F.log(float(STEP), size / F.col("width"))), F.lit(0)))))).first()[0]
    if top is None:
        return []
    levels: list[DataFrame] = []
    for k in range(top + 1):
        parts = [tiles.filter(F.col("level") == k).select("grp", F.col("tx").alias("ux"), F.col("ty").alias("uy"), *TILE, *SIDES, F.lit(True).alias("leaf"))]
        if levels:
            inner = levels[-1].groupBy("grp", F.col("ux").alias("tx"), F.col("uy").alias("ty")).agg(*rectangle())
            parts.append(inner.select("grp", *(F.shiftright(c, BITS).alias(u) for c, u in (("tx", "ux"), ("ty", "uy"))), F.lit(k - 1).alias("level"), "tx", "ty", *SIDES, F.lit(False).alias("leaf")))
        levels.append(cut(reduce(DataFrame.unionByName, parts)))
    return levels


def near(cells: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """grp, cx, cy, tiles: of each cell of points the tiles of boxes that may hold the nearest of one of them."""
    cell, span = ("grp", "cx", "cy"), ("x0", "x1", "y0", "y1")
    columns = (*cell, *span, *TILE, *SIDES, "least", "leaf")
    distances = {"least": least_distance(x=("x0", "x1"), y=("y0", "y1")), "most": greatest_distance(x=("x0", "x1"), y=("y0", "y1"))}

    def kept(rows: DataFrame) -> DataFrame:
        bounded = rows.withColumn("now", F.min("most").over(Window.partitionBy(*cell)))
        return cut(bounded.filter("least <= now").select(*columns, F.col("now").alias("bound")))

    state = kept(cells.join(hinted(levels[-1]), "grp").withColumns(distances))
    for k in range(len(levels) - 2, -1, -1):
        inner = state.filter(~F.col("leaf")).select(*cell, *span, F.col("tx").alias("ux"), F.col("ty").alias("uy"), "bound")
        met = inner.join(hinted(levels[k]), ["grp", "ux", "uy"]).withColumns(distances).filter("least <= bound")
        rows = met.select(*columns, F.least("most", "bound").alias("most")).unionByName(state.filter("leaf").select(*columns, F.col("bound").alias("most")))
        before, state = state, kept(rows)
        dropped(before)
    out = cut(state.groupBy(*cell).agg(F.collect_list(F.struct(tile_key().alias("key"), *SIDES)).alias("tiles")))
    dropped(state)
    return out


def nearest_boxes(points: DataFrame, boxes: DataFrame, tile: float) -> DataFrame:
    """point, box, distance: the nearest box of its group for each point, of equal distance the first by ``box``; none for a point whose group has no box.

    ``points``: point, grp, px, py; ``boxes``: box, grp, left, top, right, bottom. Rows with a null or NaN coordinate are left out, a null group is none.
    Both are read several times. The result is a table in the shared folder.
    """
    points = points.filter(whole("px", "py")).filter("grp IS NOT NULL").select("point", "grp", F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py"))
    boxes = boxes.filter(whole(*SIDES)).filter("grp IS NOT NULL").select("grp", "box", *(F.col(c).cast("double").alias(c) for c in SIDES))
    items, tiles, groups = laid_out(boxes, tile)
    levels = tree(tiles, groups)
    if not levels:
        dropped(tiles, groups)
        return points.select("point", F.lit(None).cast(boxes.schema["box"].dataType).alias("box"), F.lit(None).cast("double").alias("distance")).limit(0)
    width = F.col("width") * CELL
    points = points.join(hinted(groups), "grp").select("point", "grp", "px", "py", at("px", width).alias("cx"), at("py", width).alias("cy"))
    cells = cut(points.groupBy("grp", "cx", "cy").agg(F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1")))
    around = near(cells, levels)
    few = (around.agg(F.sum(F.size("tiles"))).first()[0] or 0) <= BROADCAST_ROWS
    met = lambda rows: rows.repartition("point").join(F.broadcast(around), ["grp", "cx", "cy"]) if few else rows.join(around, ["grp", "cx", "cy"])

    # The tile whose middle is nearest: any would do, a near one bounds well.
    apart = lambda t, c, a, b: F.abs(F.col(c) - t[a] / 2 - t[b] / 2)
    nearest = F.array_min(F.transform("tiles", lambda t: F.struct((apart(t, "px", "left", "right") + apart(t, "py", "top", "bottom")).alias("d"), t["key"].alias("key"))))
    first = met(points).select("point", "grp", "px", "py", nearest["key"].alias("key"))
    bounds = cut(first.join(items, ["grp", "key"]).groupBy("point").agg(F.min(least_distance()).alias("bound")))

    bounded = points.join(bounds.withColumnRenamed("point", "p"), F.col("point").eqNullSafe(F.col("p"))).drop("p")
    within = met(bounded).select("point", "grp", "px", "py", "bound", F.explode(F.filter("tiles", lambda t: least_distance(t) <= F.col("bound"))).alias("t"))
    pairs = within.select("point", "grp", "px", "py", "bound", F.col("t.key").alias("key")).join(items, ["grp", "key"]).withColumn("least", least_distance()).filter("least <= bound")
    best = cut(pairs.groupBy("point").agg(F.min(F.struct("least", "box")).alias("b")).select("point", "b.box", F.col("b.least").alias("distance")))
    dropped(tiles, groups, *levels, cells, around, bounds)
    return best
