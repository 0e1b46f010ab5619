"""The scene operators over nested records made of the driver's tables, each beside SQL over the flat ones.

An order is a scene, its lines are layers and their parts assets. The fields of these records are stated once, as
expressions that both engines read; what is compared is what the operators make of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, numbers, text
from ..operators import frames, lookup, ordered, scene, sheet
from ..schema import INTERACTION
from ..sources import builtin, library
from ..streaming import reducers
from .lineage import cut, fresh_path
from .registry import query

LAYERS = "SELECT l_orderkey AS scene, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS ordinal, l_partkey AS part, l_suppkey AS supp FROM lineitem"
FIELDS = {
    "id": "concat(scene, '-', ordinal)",
    "name": "concat('Layer ', part)",
    "type": "CASE (part + ordinal) % 5 WHEN 0 THEN 'background' WHEN 1 THEN 'sprite' WHEN 2 THEN 'effect' WHEN 3 THEN 'foreground' ELSE 'ground' END",
    "visible": "supp % 4 <> 0",
    "locked": "CASE WHEN supp % 3 = 0 THEN NULL ELSE supp % 7 = 0 END",
    "assetId": "CASE WHEN part % 6 = 0 THEN NULL ELSE concat('asset_', part % 60) END",
    "activeAnimationId": "CASE WHEN supp % 2 = 0 THEN concat('clip_', part % 60, '_', supp % 4) END",
    "x": "CAST(part % 900 AS DOUBLE)",
    "y": "CASE WHEN part % 9 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(supp * 3 % 700 AS DOUBLE) END",
    "scale": "CASE WHEN part % 8 = 0 THEN CAST(0 AS DOUBLE) ELSE (part % 20 + 1) / CAST(8 AS DOUBLE) END",
    "zIndex": "CASE WHEN part % 11 = 0 THEN NULL ELSE CAST(part % 40 AS DOUBLE) END",
    "opacity": "CASE WHEN part % 13 = 0 THEN NULL ELSE CAST(0.5 AS DOUBLE) END",
    "parallax": "CASE WHEN part % 3 = 0 THEN NULL ELSE CAST(0.5 AS DOUBLE) END",
    "width": "CASE part % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS DOUBLE) WHEN 2 THEN CAST(1000 AS DOUBLE) ELSE CAST(supp % 500 + 1 AS DOUBLE) END",
    "height": "CASE part % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS DOUBLE) WHEN 2 THEN CAST(719 AS DOUBLE) ELSE CAST(supp % 300 + 1 AS DOUBLE) END",
    "fit": "CASE part % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'cover' END",
    "position": "CASE WHEN part % 2 = 0 THEN NULL ELSE 'center' END",
}
SCENE_FIELDS = {
    "width": "CASE WHEN scene % 2 = 0 THEN CAST(3840 AS DOUBLE) ELSE CAST(1000 AS DOUBLE) END",
    "height": "CAST(720 AS DOUBLE)",
    "viewportWidth": "CASE scene % 3 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS DOUBLE) ELSE CAST(1100 AS DOUBLE) END",
    "viewportHeight": "CASE scene % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS DOUBLE) ELSE CAST(600 AS DOUBLE) END",
    "cameraX": "CAST(scene % 3000 AS DOUBLE)",
    "groundY": "CAST(500 + scene % 40 AS DOUBLE)",
}
OF_SCENE = {f"scene_{k}": v for k, v in SCENE_FIELDS.items()}


def listed(fields: dict[str, str]) -> str:
    return ", ".join(f'{v} AS "{k}"' for k, v in fields.items())


#: Common tables for the SQL: l (layers with all fields and those of their scene).
WITH = f"WITH raw AS ({LAYERS}), l AS (SELECT scene, ordinal, part, supp, {listed(FIELDS)}, {listed(OF_SCENE)} FROM raw)"


def flat(t) -> DataFrame:
    # By the name that later groupings have, so that wide rows aren't shuffled again.
    place = F.row_number().over(Window.partitionBy("scene").orderBy("l_linenumber", "part", "supp")) - 1
    rows = t("lineitem").select(F.col("l_orderkey").alias("scene"), "l_linenumber", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))
    rows = rows.select("scene", place.alias("ordinal"), "part", "supp")
    return rows.select("scene", "ordinal", "part", "supp", *(F.expr(v).alias(k) for k, v in FIELDS.items()))


def nested(t) -> DataFrame:
    """scene, its own fields, and layers in order."""
    rows = flat(t).groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("ordinal", "part", "supp", *FIELDS))).alias("layers"))  # layers of one scene
    return rows.select("scene", *(F.expr(v).alias(k) for k, v in SCENE_FIELDS.items()), "layers")


def each(df: DataFrame, *fields: str, array: str = "layers") -> DataFrame:
    return df.select("scene", F.explode(array).alias("x")).select("scene", "x.ordinal", *(F.col(f"x.{f}").alias(f) for f in fields))


BUILT_IN = [f"asset_{k}" for k in range(1, 6)]


@query(WITH + f""", k AS (SELECT * FROM l WHERE "assetId" IS NULL OR "assetId" NOT IN ({', '.join(f"'{x}'" for x in BUILT_IN)}))
SELECT scene, ordinal, CASE WHEN b THEN FALSE ELSE locked END AS locked, CASE WHEN b AND (width IS NULL OR width = 0) AND (height IS NULL OR height = 0) AND y = 0 THEN CASE WHEN height > 0 THEN height ELSE scene_height END ELSE y END AS y,
  CASE WHEN b AND scale = 0 THEN 1.0 ELSE scale END AS scale, CASE WHEN b THEN coalesce("zIndex", 0.0) ELSE "zIndex" END AS "zIndex", CASE WHEN b THEN coalesce(opacity, 1.0) ELSE opacity END AS opacity, CASE WHEN b THEN coalesce(parallax, 1.0) ELSE parallax END AS parallax,
  CASE WHEN NOT b THEN width WHEN width > 0 THEN width ELSE scene_width END AS width, CASE WHEN NOT b THEN height WHEN height > 0 THEN height ELSE scene_height END AS height,
  CASE WHEN b AND coalesce(fit, '') = '' THEN 'stretch' ELSE fit END AS fit, CASE WHEN b THEN coalesce(position, 'left center') ELSE position END AS position
FROM (SELECT *, type = 'background' AS b FROM k)
""")
def scene_normalised(t):
    """Built-in layers go, backgrounds are completed."""
    kept = nested(t).withColumn("layers", scene.without_built_ins(F.col("layers"), BUILT_IN))
    done = kept.select("scene", scene.normalised(F.struct("layers", "width", "height")).alias("layers"))
    return each(done, "locked", "y", "scale", "zIndex", "opacity", "parallax", "width", "height", "fit", "position")


WANTED = "CASE WHEN scene % 4 = 0 THEN CAST(2000 AS DOUBLE) WHEN scene % 4 = 1 THEN CAST(0 AS DOUBLE) END"


@query(WITH + f""", v AS (SELECT *, coalesce(nullif({WANTED}, 0), nullif("scene_viewportWidth", 0), 1280.0) AS w, coalesce(nullif("scene_viewportHeight", 0), scene_height) AS h FROM l),
n AS (SELECT *, greatest(scene_width, w) AS nw, greatest(scene_height, h) AS nh, type = 'background' AND (coalesce(width, 0) = 0 OR abs(width - scene_width) <= 2) AS wide, type = 'background' AND (coalesce(height, 0) = 0 OR abs(height - scene_height) <= 2) AS high FROM v)
SELECT scene, ordinal, CASE WHEN wide THEN nw ELSE width END AS width, CASE WHEN high THEN nh ELSE height END AS height, CASE WHEN high AND abs(y - scene_height) <= 2 THEN nh ELSE y END AS y,
  greatest(0.0, least("scene_cameraX", greatest(0.0, nw - least(w, nw)))) AS camera, least(w, nw) AS view_w, h AS view_h, nw AS scene_w, nh AS scene_h FROM n
""")
def scene_resized(t):
    """Scenes grown to a viewport, with their backgrounds."""
    big = scene.resized(nested(t), F.expr(WANTED), F.lit(None).cast("double"))
    rows = big.select("scene", F.col("cameraX").alias("camera"), F.col("viewportWidth").alias("view_w"), F.col("viewportHeight").alias("view_h"), F.col("width").alias("scene_w"), F.col("height").alias("scene_h"), F.explode("layers").alias("x"))
    return rows.select("scene", "x.ordinal", "x.width", "x.height", "x.y", "camera", "view_w", "view_h", "scene_w", "scene_h")


@query(WITH + """SELECT scene, ordinal, CASE WHEN ordinal = 1 THEN 0.25 ELSE opacity END AS patched, CASE WHEN ordinal = 1 AND type IN ('sprite', 'effect', 'foreground') AND NOT coalesce(locked, FALSE) THEN 2.0 ELSE parallax END AS unlocked,
  CASE WHEN ordinal = 1 THEN name || '!' ELSE name END AS renamed, type IN ('sprite', 'effect', 'foreground') AS visual, type IN ('sprite', 'effect', 'foreground', 'background') AS transformable FROM l""")
def layer_patches(t):
    """One layer of each scene patched by id; locked and undrawn ones bear only the plain patch."""
    target = F.concat(F.col("scene").cast("string"), F.lit("-1"))
    both = nested(t).withColumn("layers", scene.patch_layer(F.col("layers"), target, {"opacity": 0.25, "name": lambda x: F.concat(x["name"], F.lit("!"))}))
    both = both.withColumn("layers", scene.patch_unlocked(F.col("layers"), target, {"parallax": 2.0}))
    rows = both.select("scene", F.explode("layers").alias("x"))
    return rows.select("scene", "x.ordinal", F.col("x.opacity").alias("patched"), F.col("x.parallax").alias("unlocked"), F.col("x.name").alias("renamed"), scene.is_visual(F.col("x")).alias("visual"), scene.is_transformable(F.col("x")).alias("transformable"))


@query(WITH + """SELECT scene, ordinal, CASE WHEN ordinal = 0 AND NOT coalesce(locked, FALSE) THEN 'Black Background' ELSE name END AS name, CASE WHEN ordinal = 0 AND NOT coalesce(locked, FALSE) THEN 1.0 ELSE opacity END AS opacity
FROM l WHERE ordinal <> 0 OR coalesce(locked, FALSE) OR type = 'background'""")
def layer_deletion(t):
    """The first layer of each scene deleted: backgrounds are cleared, locked layers stay."""
    typed = nested(t).withColumn("layers", F.transform("layers", lambda x: x.withField("imageUrl", F.lit("a.png")).withField("color", F.lit("#fff"))))
    return each(typed.withColumn("layers", scene.deleted(F.col("layers"), F.concat(F.col("scene").cast("string"), F.lit("-0")))), "name", "opacity")


@query(WITH + """SELECT scene, ordinal, 'n' || ordinal AS copy_id, name || ' copy' AS copy_name, round(x + 72, 2) AS copy_x, round(y + 48, 2) AS copy_y, CAST(99 AS DOUBLE) AS copy_z, name AS background_name, locked AS background_locked,
  "zIndex" AS background_z, 'center center' AS cleared_position, FALSE AS interaction FROM l WHERE type = 'background'""")
def layer_copies(t):
    """Copies a step on, and what a background takes from another layer or loses."""
    own = F.struct(*FIELDS, F.lit("a.png").alias("imageUrl"), F.lit("#fff").alias("color"), F.struct(F.lit(True).alias("enabled")).alias("interaction"))
    rows = flat(t).filter("type = 'background'").select("scene", "ordinal", own.alias("layer"))
    copy = scene.copied_layer(F.col("layer"), "copy", 2, 99.0, F.concat(F.lit("n"), F.col("ordinal").cast("string")))
    moved = scene.background_from(F.col("layer"), F.col("layer").withField("zIndex", F.lit(5.0)).withField("name", F.lit("other")).withField("locked", F.lit(True)))
    done = rows.select("scene", "ordinal", copy.alias("c"), moved.alias("b"), scene.cleared_background(F.col("layer")).alias("e"), scene.without_interaction(F.col("layer")).alias("i"))
    return done.select(
        "scene", "ordinal", F.col("c.id").alias("copy_id"), F.col("c.name").alias("copy_name"), F.col("c.x").alias("copy_x"), F.col("c.y").alias("copy_y"), F.col("c.zIndex").alias("copy_z"), F.col("b.name").alias("background_name"),
        F.col("b.locked").alias("background_locked"), F.col("b.zIndex").alias("background_z"), F.col("e.position").alias("cleared_position"), F.col("i.interaction.enabled").alias("interaction"),
    )


# Sprites of parts: half of them state a frame size, the others a cell, or nothing.
OF_PART = {
    "fw": "CASE part % 4 WHEN 0 THEN CAST(64 + part % 10 AS DOUBLE) WHEN 1 THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
    "fh": "CASE part % 4 WHEN 0 THEN CAST(48 AS DOUBLE) WHEN 1 THEN CAST(120 + part % 7 AS DOUBLE) ELSE CAST(32 AS DOUBLE) END",
    "cell": "CASE WHEN part % 4 = 2 THEN CAST(90 AS DOUBLE) END",
    "n_frames": "part % 6",
    "own_columns": "CASE WHEN part % 5 = 0 THEN CAST(2.5 AS DOUBLE) END",
    "sheet_w": "CAST(400 + part % 300 AS DOUBLE)",
}


def sprite() -> Column:
    c = {k: F.expr(v) for k, v in OF_PART.items()}
    names = F.when(c["n_frames"] > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), c["n_frames"]).cast("int")), lambda i: F.concat(F.lit("f"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.struct(
        F.concat(F.lit("sprite_"), F.col("part").cast("string")).alias("id"), F.concat(F.lit("Part "), F.col("part").cast("string")).alias("characterName"), names.alias("frames"), F.lit(3).alias("frameCount"),
        F.array(c["fw"], c["fh"]).alias("frameSize"), c["cell"].alias("cellSize"), c["own_columns"].alias("gridColumns"), F.array(c["sheet_w"], F.lit(300.0)).alias("sheetSize"),
    )


SPRITES = f"""p AS (SELECT scene, ordinal, part, x, y, scale, parallax, supp, {listed(OF_PART)}, scene_width, scene_height, "scene_viewportWidth" AS vw, "scene_viewportHeight" AS vh, "scene_cameraX" AS cam FROM l),
s AS (SELECT *, CASE WHEN fw > 0 AND fh > 0 THEN fw ELSE coalesce(cell, 256.0) END AS w, CASE WHEN fw > 0 AND fh > 0 THEN fh ELSE coalesce(cell, 256.0) END AS h FROM p),
b AS (SELECT *, x AS l, y - h * scale AS t, w * scale AS bw, h * scale AS bh FROM s),
z AS (SELECT *, greatest(24.0, CASE WHEN supp % 3 = 0 THEN 40.0 ELSE bw END) AS zw, greatest(24.0, CASE WHEN supp % 5 = 0 THEN 10.0 ELSE bh END) AS zh, l + bw * 0.5 + CASE WHEN supp % 2 = 0 THEN 7.0 ELSE 0.0 END AS cx, t + bh * 0.5 AS cy FROM b)"""


@query(WITH + ", " + SPRITES + """
SELECT scene, ordinal, w, h, l AS box_left, t AS box_top, round(bw, 6) AS box_width, round(cx - zw / 2, 6) AS zone_left, round(cy + zh / 2, 6) AS zone_bottom, zw AS zone_width,
  round(sqrt(pow(greatest(cx - zw / 2 - 300, 300 - cx - zw / 2, 0), 2) + pow(greatest(cy - zh / 2 - 400, 400 - cy - zh / 2, 0), 2)), 6) AS distance,
  CAST(CASE WHEN own_columns > 0 THEN floor(own_columns + 0.5) ELSE greatest(1, floor(sheet_w / greatest(1, w) + 0.5)) END AS INTEGER) AS columns,
  CAST(CASE WHEN n_frames > 0 THEN n_frames ELSE 3 END AS INTEGER) AS total,
  CAST(greatest(1, ceil(greatest(1, CASE WHEN n_frames > 0 THEN n_frames ELSE 3 END) / (CASE WHEN own_columns > 0 THEN floor(own_columns + 0.5) ELSE greatest(1, floor(sheet_w / greatest(1, w) + 0.5)) END))) AS INTEGER) AS rows,
  CASE WHEN n_frames = 0 THEN '' ELSE 'f' || (1 + supp % n_frames) END AS frame,
  round((x - cam * coalesce(parallax, 1.0)) * 1.5, 6) AS screen_x, least(coalesce(nullif(vw, 0), 1280.0), scene_width) AS view_w, coalesce(nullif(vh, 0), scene_height) AS view_h FROM z
""")
def layer_geometry(t):
    """Boxes, zones, distances, grids and screen places of layers."""
    rows = flat(t).select("scene", "ordinal", "supp", F.struct("x", "y", "scale", "parallax").alias("layer"), sprite().alias("sprite"), *(F.expr(v).alias(k) for k, v in OF_SCENE.items()))
    zone = F.struct(F.when(F.col("supp") % 3 == 0, 40.0).otherwise(0.0).alias("zoneWidth"), F.when(F.col("supp") % 5 == 0, 10.0).alias("zoneHeight"), F.when(F.col("supp") % 2 == 0, 7.0).alias("zoneOffsetX"), F.lit(None).cast("double").alias("zoneOffsetY"))
    size = geometry.frame_size(F.col("sprite"))
    rows = rows.withColumn("box", geometry.world_bounds(F.col("layer"), F.col("sprite"))).withColumn("zone", geometry.zone_bounds(F.col("box"), zone))
    of_scene = F.struct(*(F.col(f"scene_{k}").alias(k) for k in SCENE_FIELDS))
    r = lambda c: F.round(c, 6)
    return rows.select(
        "scene", "ordinal", size["width"].alias("w"), size["height"].alias("h"), F.col("box.left").alias("box_left"), F.col("box.top").alias("box_top"), r(F.col("box.width")).alias("box_width"), r(F.col("zone.left")).alias("zone_left"),
        r(F.col("zone.bottom")).alias("zone_bottom"), F.col("zone.width").alias("zone_width"), r(geometry.distance_to_box(F.lit(300.0), F.lit(400.0), F.col("zone"))).alias("distance"), geometry.grid_columns(F.col("sprite")).alias("columns"),
        geometry.frame_total(F.col("sprite")).alias("total"), geometry.grid_rows(F.col("sprite")).alias("rows"), geometry.frame_at(F.col("sprite.frames"), F.col("supp")).alias("frame"),
        r(geometry.on_stage(F.col("layer"), F.col("scene_cameraX"), 1.5)["left"]).alias("screen_x"), geometry.viewport(of_scene)["width"].alias("view_w"), geometry.viewport(of_scene)["height"].alias("view_h"),
    )


# Assets: one for each remainder of a part's number; clips in order, some bound to keys.
ASSETS = "SELECT DISTINCT CAST(p_partkey % 60 AS INTEGER) AS k FROM part"
CLIPS = "SELECT k, CAST(n AS INTEGER) AS n FROM assets, range(0, 4) t(n) WHERE n < k % 4"


def assets(t) -> DataFrame:
    """ordinal (the number), id, name, role, defaultAnimationId, animations, binding, sprite and tags."""
    k = t("part").select((F.col("p_partkey") % 60).cast("int").alias("ordinal")).distinct()
    n = F.col("ordinal")
    key = lambda i: F.concat(F.lit("Key"), F.char(65 + (n * 3 + i) % 26))
    binding = lambda i: F.struct(F.when((n + i) % 2 == 0, "keyboard").otherwise("auto").alias("triggerType"), key(i).alias("triggerValue"), F.concat(F.lit("act"), i.cast("string")).alias("actionName"))
    of_sprite = lambda i: F.struct(F.concat(F.lit("s"), n.cast("string"), F.lit("_"), i.cast("string")).alias("id"), F.transform(F.sequence(F.lit(0), (n + i) % 7), lambda j: j.cast("string")).alias("frames"))
    clip = lambda i: F.struct(F.concat(F.lit("clip_"), n.cast("string"), F.lit("_"), i.cast("string")).alias("id"), F.concat(F.lit("Clip "), i.cast("string")).alias("name"), binding(i).alias("binding"), F.when(i != 2, of_sprite(i)).alias("sprite"), ((n + i) % 3 == 0).alias("loop"))
    clips = F.when(n % 4 == 0, F.array().cast(k.select(F.array(clip(F.lit(0)))).schema[0].dataType)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n % 4 - 1, F.lit(0))), clip))
    return k.select(
        "ordinal", F.concat(F.lit("asset_"), n.cast("string")).alias("id"), F.concat(F.lit("Asset "), n.cast("string")).alias("name"), F.when(n % 10 == 1, "player").otherwise("prop").alias("role"),
        F.when(n % 5 > 0, F.concat(F.lit("clip_"), n.cast("string"), F.lit("_1"))).alias("defaultAnimationId"), clips.alias("animations"), binding(F.lit(5)).alias("binding"), of_sprite(F.lit(9)).alias("sprite"),
        F.when(n % 3 == 0, F.array(F.lit("interactable"), F.lit("x"))).otherwise(F.array(F.lit("y"))).alias("tags"),
    )


def key_sql(i: str) -> str:
    return f"'Key' || chr(CAST(65 + (k * 3 + {i}) % 26 AS INTEGER))"


OF_ASSETS = f"assets AS ({ASSETS}), clips AS ({CLIPS})"


@query(WITH + f""", {OF_ASSETS}, m AS (SELECT l.scene, l.ordinal, l."activeAnimationId" AS active, a.k FROM l JOIN assets a ON l."assetId" = 'asset_' || a.k WHERE type IN ('sprite', 'effect', 'foreground'))
SELECT scene, ordinal, 'clip_' || m.k || '_' || n AS clip, CASE WHEN n IS NULL OR n = 2 THEN 's' || m.k || '_9' ELSE 's' || m.k || '_' || n END AS sprite FROM m LEFT JOIN clips c ON c.k = m.k
""")
def scene_clips(t):
    """A row for each clip of each drawn layer's asset."""
    found = lookup.flatten_clips(flat(t).filter(F.col("type").isin(*scene.VISUAL_TYPES)).select("scene", "ordinal", "assetId"), assets(t))
    return found.select("scene", "ordinal", F.col("clip.id").alias("clip"), F.col("sprite.id").alias("sprite"))


@query(WITH + f""", {OF_ASSETS}, m AS (SELECT l.scene, l.ordinal, l."activeAnimationId" AS active, a.k, CASE WHEN a.k % 5 > 0 THEN 1 END AS d, a.k % 4 AS n FROM l JOIN assets a ON l."assetId" = 'asset_' || a.k),
c AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM clips WHERE clips.k = m.k AND 'clip_' || clips.k || '_' || clips.n = active) THEN CAST(split_part(active, '_', 3) AS INTEGER) WHEN d < n THEN d WHEN n > 0 THEN 0 END AS picked FROM m)
SELECT scene, ordinal, 'clip_' || k || '_' || picked AS clip, 's' || k || '_' || CASE WHEN picked IS NULL OR picked = 2 THEN 9 ELSE picked END AS sprite,
  coalesce((k + picked) % 3 = 0 AND (k + picked) % 2 = 1, FALSE) AS autoplays FROM c
""")
def clip_resolution(t):
    """The active clip of a layer, else its asset's default, else the first; the asset's sprite where a clip has none."""
    a = assets(t).select(F.col("id").alias("assetId"), "animations", "defaultAnimationId", F.col("sprite").alias("own"))
    rows = lookup.keyed(flat(t).select("scene", "ordinal", "assetId", "activeAnimationId"), a, "assetId")
    args = F.col("animations"), F.col("activeAnimationId"), F.col("defaultAnimationId")
    clip = lookup.priority_clip(*args)
    plays = F.coalesce(clip["loop"] & (clip["binding"]["triggerType"] == "auto"), F.lit(False))
    return rows.select("scene", "ordinal", clip["id"].alias("clip"), lookup.priority_sprite(*args, F.col("own"))["id"].alias("sprite"), plays.alias("autoplays"))


@query(WITH + f""", {OF_ASSETS}, codes AS (SELECT DISTINCT 'KEY' || chr(CAST(65 + n_nationkey % 26 AS INTEGER)) AS code FROM nation), s AS (SELECT DISTINCT scene FROM l),
hit AS (SELECT code, l.ordinal, l.id, c.n, 'clip_' || c.k || '_' || c.n AS clip, row_number() OVER (PARTITION BY code ORDER BY l.scene, l.ordinal, c.n) AS rn FROM codes JOIN clips c ON lower({key_sql('n').replace('k *', 'c.k *')}) = lower(code) AND (c.k + c.n) % 2 = 0
  JOIN l ON l."assetId" = 'asset_' || c.k AND visible AND type IN ('sprite', 'effect', 'foreground')),
own AS (SELECT code, min(k) AS k FROM codes JOIN assets ON k % 4 = 0 AND (k + 5) % 2 = 0 AND lower({key_sql('5')}) = lower(code) GROUP BY code)
SELECT code, id AS layer_id, clip AS clip_id, CASE WHEN id IS NULL THEN 'asset_' || k END AS asset_id FROM codes LEFT JOIN (SELECT * FROM hit WHERE rn = 1) USING (code) LEFT JOIN own USING (code) WHERE id IS NOT NULL OR k IS NOT NULL
""")
def key_bindings(t):
    """What each key does, over all scenes in order: the first drawn layer with a clip for it, else an asset of its own."""
    a = assets(t)
    codes = t("nation").select(F.concat(F.lit("KEY"), F.char(65 + F.col("n_nationkey") % 26)).alias("code")).distinct()
    rows = lookup.keyed(flat(t), a.select(F.col("id").alias("assetId"), "animations"), "assetId")
    place = F.struct("scene", "ordinal").alias("ordinal")
    return lookup.binding_match(rows.select(place, F.col("id").alias("layer_id"), "type", "visible", "animations"), codes, a.select(F.struct(F.lit(0).cast("long").alias("scene"), "ordinal").alias("ordinal"), "id", "animations", "binding"))


@query(f"WITH {OF_ASSETS}, h AS (SELECT k FROM assets WHERE 's' || k || '_9' = 's9_1' UNION ALL SELECT k FROM clips WHERE n <> 2 AND 's' || k || '_' || n = 's9_0') SELECT 'asset_' || min(k) AS id FROM h HAVING count(*) > 0")
def sprite_owner(t):
    """The first asset that shows a sprite, itself or in a clip."""
    return lookup.owner_of_sprite(assets(t), "s9_0").select("id")


@query(WITH + """, n AS (SELECT scene, count(*) AS n_layers FROM l WHERE "assetId" IS NULL OR "assetId" <> 'asset_7' GROUP BY scene), s AS (SELECT DISTINCT scene FROM l)
SELECT s.scene, coalesce(n_layers, 0) AS n_layers, (SELECT count(DISTINCT p_partkey % 60) FROM part WHERE p_partkey % 60 <> 7) AS n_assets FROM s LEFT JOIN n ON n.scene = s.scene WHERE s.scene <> (SELECT min(scene) FROM s)""")
def asset_deletion(t):
    """An asset deleted with every layer that shows it, and a scene deleted."""
    scenes = nested(t).withColumn("id", F.col("scene").cast("string"))
    left, kept = library.delete_asset(assets(t), scenes, "asset_7")
    first = str(t("lineitem").agg(F.min("l_orderkey")).first()[0])
    n = left.agg(F.count("*").alias("n_assets"))
    return library.delete_scene(kept, first).select("scene", F.size("layers").cast("long").alias("n_layers")).join(F.broadcast(n), F.lit(True))


@query(WITH + """, s AS (SELECT DISTINCT scene FROM l) SELECT l.scene, l.ordinal, CASE WHEN s.scene IS NULL THEN 'fail' ELSE 'go' END AS status, 'Scene ' || s.scene AS "targetName"
FROM l LEFT JOIN s ON s.scene = l.scene + l.supp % 9 WHERE l.part % 2 = 0""")
def scene_links(t):
    """Links of layers to scenes that may not exist."""
    rows = flat(t)
    action = F.struct(F.when(F.col("part") % 2 == 0, "scene-link").otherwise("subtitle").alias("actionType"), (F.col("scene") + F.col("supp") % 9).cast("string").alias("targetSceneId"))
    scenes = rows.select("scene").distinct().select(F.col("scene").cast("string").alias("id"), F.concat(F.lit("Scene "), F.col("scene").cast("string")).alias("name"))
    return lookup.linked_scenes(rows.select("scene", "ordinal", action.alias("interaction")), scenes).select("scene", "ordinal", "status", "targetName")


# --- interactions ---------------------------------------------------------------------------------

def interactions(t) -> DataFrame:
    """Drawn layers beside their asset and the interaction that some of them state."""
    rows = flat(t).filter(F.col("type").isin(*scene.VISUAL_TYPES))
    eighth = F.col("supp") % 8 == 0
    stated = F.struct((F.col("supp") % 12 != 0).alias("enabled"), F.when(eighth, "Said").alias("subtitle"), F.when(eighth, 90.0).alias("triggerRadius"))
    own = F.from_json(F.to_json(stated), INTERACTION)
    a = assets(t).select(F.col("id").alias("assetId"), F.struct("id", "name", "role", "tags", "binding").alias("asset"))
    return lookup.keyed(rows.withColumn("own", F.when(F.col("supp") % 4 == 0, own)), a, "assetId", "left")


@query(WITH + f""", {OF_ASSETS}, m AS (SELECT l.*, a.k FROM l LEFT JOIN assets a ON l."assetId" = 'asset_' || a.k WHERE type IN ('sprite', 'effect', 'foreground'))
SELECT scene, ordinal, CASE WHEN supp % 4 = 0 THEN supp % 12 <> 0 ELSE TRUE END AS enabled, CASE WHEN supp % 8 = 0 THEN 'Said' ELSE 'There is something worth inspecting here.' END AS subtitle, CASE WHEN supp % 8 = 0 THEN CAST(90 AS DOUBLE) ELSE CAST(180 AS DOUBLE) END AS radius,
  CASE WHEN k IS NULL THEN 'E' ELSE chr(CAST(65 + (k * 3 + 5) % 26 AS INTEGER)) END AS key, CASE WHEN k IS NULL THEN 'Inspect' ELSE 'Asset ' || k END AS prompt
FROM m WHERE coalesce(k % 3 = 0, FALSE) OR supp % 4 = 0
""")
def layer_interactions(t):
    """What a layer states over what its asset gives over the defaults; none where neither is interactive."""
    rows = interactions(t).select("scene", "ordinal", scene.interaction_of(F.struct(F.col("own").alias("interaction")), F.col("asset")).alias("i")).filter("i IS NOT NULL")
    return rows.select("scene", "ordinal", "i.enabled", "i.subtitle", F.col("i.triggerRadius").alias("radius"), F.col("i.promptKey").alias("key"), F.col("i.promptText").alias("prompt"))


@query("""
WITH p AS (SELECT * FROM (VALUES (0, 'inspect', 'subtitle', 'Inspect', 'There is something worth inspecting here.', NULL, FALSE, NULL), (1, 'pickup', 'pickup-item', 'Pick up', 'Picked up an item.', NULL, FALSE, TRUE), (2, 'toggle', 'toggle-layer', 'Use', 'Something changed.', NULL, NULL, NULL),
  (3, 'scene-link', 'scene-link', 'Enter', 'Moving to another scene.', NULL, NULL, NULL), (4, 'animated', 'play-animation', 'Activate', 'The object starts moving.', NULL, NULL, NULL), (5, 'conditional', 'set-state', 'Inspect', 'The condition is satisfied.', 'It does not seem ready yet.', NULL, NULL)) v(k, preset, action, prompt, said, fails, shows, hides))
SELECT p_partkey, preset, 'near-click' AS mode, action, prompt, said, coalesce(fails, 'old fail') AS fails, coalesce(shows, p_size % 2 = 0) AS shows, hides, CASE WHEN p_size % 3 = 0 THEN CAST(77 AS DOUBLE) ELSE floor(p_retailprice + 0.5) END AS zone_w,
  CASE WHEN p_size % 2 = 0 THEN CAST(120 AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END AS zone_h, CASE WHEN preset = 'pickup' THEN 'part_' || p_partkey END AS item, CASE WHEN preset = 'conditional' THEN 'part_' || p_partkey END AS state_key, TRUE AS enabled
FROM part JOIN p ON k = p_partkey % 6
""")
def preset_overlays(t):
    """An interaction preset, looked up and laid over a layer's interaction."""
    spark = t("part").sparkSession
    presets = builtin.interaction_presets(spark).select("ordinal", F.struct("preset", "label", "triggerMode", "actionType", "promptText", "subtitle", "failSubtitle", "showText", "hideLayerOnPickup").alias("p"))
    own = F.struct(F.lit("old").alias("subtitle"), F.lit("old fail").alias("failSubtitle"), (F.col("p_size") % 2 == 0).alias("showText"), F.when(F.col("p_size") % 3 == 0, 77.0).alias("zoneWidth"))
    rows = t("part").withColumn("own", F.from_json(F.to_json(own), INTERACTION)).withColumn("ordinal", (F.col("p_partkey") % 6).cast("int"))
    box = F.struct(F.col("p_retailprice").alias("width"), F.when(F.col("p_size") % 2 == 0, 0.0).otherwise(F.col("p_size").cast("double")).alias("height"))
    done = lookup.keyed(rows, presets, "ordinal").select("p_partkey", scene.with_preset(F.col("own"), F.col("p"), box, F.concat(F.lit("Part "), F.col("p_partkey").cast("string"))).alias("i"))
    return done.select(
        "p_partkey", "i.preset", F.col("i.triggerMode").alias("mode"), F.col("i.actionType").alias("action"), F.col("i.promptText").alias("prompt"), F.col("i.subtitle").alias("said"), F.col("i.failSubtitle").alias("fails"), F.col("i.showText").alias("shows"),
        F.col("i.hideLayerOnPickup").alias("hides"), F.col("i.zoneWidth").alias("zone_w"), F.col("i.zoneHeight").alias("zone_h"), F.col("i.itemId").alias("item"), F.col("i.setStateKey").alias("state_key"), "i.enabled",
    )


@query(WITH + ", " + SPRITES + f""", v AS (SELECT l.scene, l.ordinal, l.visible, l.type, l.part % 60 AS k, l.supp, b.x, b.y, b.l, b.t, b.bw, b.bh FROM l JOIN b ON l.scene = b.scene AND l.ordinal = b.ordinal WHERE l."assetId" IS NOT NULL AND l.visible AND l.type IN ('sprite', 'effect', 'foreground')),
pl AS (SELECT scene, px, py FROM (SELECT scene, l + bw * 0.5 AS px, t + bh * 0.5 AS py, row_number() OVER (PARTITION BY scene ORDER BY ordinal) AS rn FROM v WHERE k % 10 = 1) WHERE rn = 1),
i AS (SELECT *, greatest(24.0, bw) AS zw, greatest(24.0, bh) AS zh, l + bw * 0.5 AS cx, t + bh * 0.5 AS cy, CASE WHEN supp % 8 = 0 THEN 90.0 ELSE 180.0 END AS radius FROM v WHERE k % 10 <> 1 AND (k % 3 = 0 OR supp % 4 = 0) AND (supp % 4 <> 0 OR supp % 12 <> 0) AND (k <> 27 OR scene % 2 = 0)),
d AS (SELECT i.*, sqrt(pow(greatest(cx - zw / 2 - px, px - cx - zw / 2, 0), 2) + pow(greatest(cy - zh / 2 - py, py - cy - zh / 2, 0), 2)) AS raw FROM i JOIN pl ON pl.scene = i.scene),
q AS (SELECT *, round(raw, 6) AS distance FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY distance, ordinal) AS rn FROM q)
SELECT scene, ordinal, round(distance, 4) AS distance FROM r WHERE rn = 1 AND distance <= radius
""")
def nearby_interaction(t):
    """What a scene's player can reach: the nearest interactive layer, if it is within that layer's own radius; a vehicle only once it is ready."""
    rows = interactions(t).filter("visible AND asset IS NOT NULL").withColumn("box", geometry.world_bounds(F.struct("x", "y", "scale"), sprite())).withColumn("i", scene.interaction_of(F.struct(F.col("own").alias("interaction")), F.col("asset")))
    first = lookup.first_wins(rows.filter("asset.role = 'player'").select("scene", "ordinal", F.col("box.centerX").alias("px"), F.col("box.centerY").alias("py")), "scene", "ordinal").select(F.col("scene").alias("of"), "px", "py")
    phase = F.when(F.col("scene") % 2 == 0, "ready").otherwise("approaching")
    zones = lookup.reachable(rows.filter("asset.role <> 'player' AND i.enabled"), F.col("asset.id"), phase, "asset_27").select("scene", "ordinal", geometry.zone_bounds(F.col("box"), F.col("i")).alias("zone"), F.col("i.triggerRadius").alias("radius"))
    distance = F.round(geometry.distance_to_box(F.col("px"), F.col("py"), F.col("zone")), 6)
    return lookup.nearest_in_reach(first, zones, "of", distance, F.col("radius"), ["ordinal"], F.col("of") == F.col("scene")).select("scene", "ordinal", F.round("distance", 4).alias("distance"))


# --- kit, scenes and assets -----------------------------------------------------------------------

KIT_SQL = """(VALUES ('asset_scene_e_trigger_point', 'layer_scene_e_trigger_point', 0.55, 82), ('asset_scene_ticket_machine', 'layer_scene_ticket_machine', 0.22, 24), ('asset_scene_backpack_ui', 'layer_scene_backpack_ui', 0.18, 120),
  ('asset_scene_backpack_panel', 'layer_scene_backpack_panel', 0.72, 118), ('asset_scene_boarding_train', 'layer_scene_boarding_train', 0.44, 86), ('asset_scene_station_sign_13', 'layer_scene_station_sign_13', 0.36, 12)) k(asset, id, scale, z)"""
SCENES_SQL = f"s AS (SELECT o_orderkey AS scene FROM orders), sc AS (SELECT scene, {listed(SCENE_FIELDS)} FROM s)"


def scene_rows(t) -> DataFrame:
    rows = t("orders").select(F.col("o_orderkey").alias("scene"))
    return rows.select("scene", *(F.expr(v).alias(k) for k, v in SCENE_FIELDS.items()))


@query(f"""
WITH {SCENES_SQL}, v AS (SELECT *, least(coalesce(nullif("viewportWidth", 0), 1280.0), width) AS view FROM sc),
own AS (
  SELECT scene, 'layer_scene_ticket_machine' AS id, 'asset_scene_ticket_machine' AS a, CASE WHEN scene % 2 = 0 THEN 0.22 ELSE 0.3 END AS s, 5.0 AS z, 1.0 AS x, 2.0 AS y, 'none' AS light FROM v WHERE scene % 3 = 0
  UNION ALL SELECT scene, 'mine', 'asset_scene_backpack_ui', CASE WHEN scene % 2 = 0 THEN 0.18 ELSE 0.35 END, CASE WHEN scene % 2 = 0 THEN 120.0 ELSE 7.0 END, CASE WHEN scene % 2 = 0 THEN 1210.0 ELSE 3.0 END, CASE WHEN scene % 2 = 0 THEN 96.0 ELSE 4.0 END, 'neon-station' FROM v
  UNION ALL SELECT scene, 'layer_scene_station_sign_13', 'asset_scene_station_sign_13', CASE WHEN scene % 2 = 0 THEN 0.36 ELSE 0.48 END, 8.0, CASE WHEN scene % 2 = 0 THEN 920.0 ELSE 5.0 END, CASE WHEN scene % 2 = 0 THEN 292.0 ELSE 6.0 END, 'none' FROM v WHERE scene % 5 = 0
  UNION ALL SELECT scene, 'layer_scene_boarding_train', 'asset_scene_boarding_train', 0.9, 9.0, 7.0, 8.0, 'none' FROM v WHERE scene % 7 = 0
),
kit AS (
  SELECT scene, 'layer_scene_station_sign_13' AS id, 'asset_scene_station_sign_13' AS a, 0.36 AS s, 12.0 AS z, 920.0 AS x, 292.0 AS y, NULL AS prompt, NULL AS radius FROM v
  UNION ALL SELECT scene, 'layer_scene_ticket_machine', 'asset_scene_ticket_machine', 0.22, 24.0, 720.0, "groundY" + 3, NULL, NULL FROM v
  UNION ALL SELECT scene, 'layer_scene_backpack_ui', 'asset_scene_backpack_ui', 0.18, 120.0, 1210.0, 96.0, NULL, NULL FROM v
  UNION ALL SELECT scene, 'layer_scene_boarding_train', 'asset_scene_boarding_train', 0.44, 86.0, "cameraX" + view + 180, height - 36, NULL, NULL FROM v
  UNION ALL SELECT scene, 'layer_scene_eye_hotspot_ticket_machine', 'asset_scene_e_trigger_point', 0.55, 82.0, 738.0, "groundY" - 12, 'Use ticket machine', 155.0 FROM v
  UNION ALL SELECT scene, 'layer_scene_eye_hotspot_notice', 'asset_scene_e_trigger_point', 0.55, 82.0, 390.0, "groundY" - 18, 'Inspect notice', 145.0 FROM v
  UNION ALL SELECT scene, 'layer_scene_eye_hotspot_platform_edge', 'asset_scene_e_trigger_point', 0.55, 82.0, 1480.0, "groundY" - 14, 'Wait for train', 190.0 FROM v
),
a AS (
  SELECT scene, id, a, s, z, x, y, light, NULL AS prompt, NULL AS radius FROM own
  UNION ALL SELECT scene, id, a, s, z, x, y, 'none', prompt, radius FROM kit WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.scene = kit.scene AND own.id = kit.id)
)
SELECT scene, id, a AS "assetId", CAST(s AS DOUBLE) AS scale, CAST(z AS DOUBLE) AS "zIndex", CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, light, CAST(prompt AS VARCHAR) AS prompt, CAST(radius AS DOUBLE) AS radius FROM a
""")
def kit_corrections(t):
    """Kit layers and hotspots that a scene lacks are added; its own ones that are too large are put back, and lose their light."""
    scenes = scene_rows(t)
    templates = scene.completing_layers(scenes, "scene").select("scene", "id", "assetId", "scale", "zIndex", "x", "y", F.col("lighting.preset").alias("light"), F.col("promptText").alias("prompt"), F.col("triggerRadius").alias("radius"))
    large = F.col("scene") % 2 == 0
    lit = F.struct(*(F.lit(v).alias(k) for k, v in (builtin.KIT_LIGHT | {"preset": "neon-station"}).items()))
    row = lambda i, a, s, z, x, y: F.struct(F.lit(i).alias("id"), F.lit(a).alias("assetId"), s.alias("scale"), F.lit(z).alias("zIndex"), F.lit(1.0).alias("parallax"), F.lit(x).alias("x"), F.lit(y).alias("y"), lit.alias("lighting"))
    machine = row("layer_scene_ticket_machine", builtin.TICKET_MACHINE, F.when(large, 0.31).otherwise(0.3), 5.0, 1.0, 2.0)
    hud = row("mine", builtin.BACKPACK, F.when(large, 0.36).otherwise(0.35), 7.0, 3.0, 4.0)
    sign = row("layer_scene_station_sign_13", builtin.SIGN, F.when(large, 0.49).otherwise(0.48), 8.0, 5.0, 6.0)
    train = row("layer_scene_boarding_train", builtin.TRAIN, F.lit(0.9), 9.0, 7.0, 8.0)
    of = lambda n, x: F.when(F.col("scene") % n == 0, x)
    own = scenes.select("scene", F.explode(F.filter(F.array(of(3, machine), hud, of(5, sign), of(7, train)), lambda x: x.isNotNull())).alias("x"))
    none = lambda kind: F.lit(None).cast(kind)
    own = own.select("scene", scene.corrected_kit_layer(F.col("x")).alias("x")).select("scene", "x.id", "x.assetId", "x.scale", "x.zIndex", "x.x", "x.y", F.col("x.lighting.preset").alias("light"), none("string").alias("prompt"), none("double").alias("radius"))
    key = F.concat_ws("/", F.col("scene").cast("string"), "id")
    return lookup.missing_rows(templates.withColumn("k", key), own.withColumn("k", key), "k").drop("k")


@query("""
SELECT p_partkey, 'asset_' || safe || '_' || act || '_' || p_size AS made, p_name || ' / ' || act AS made_name, 'asset_static_' || safe || '_9' AS static_id, 'static.' || safe AS static_state, 'asset_' || safe || '_' || act || '_5' AS imported_id, 'clip_' || act || '_5' AS clip_id,
  CASE WHEN p_size % 3 = 0 THEN 'KeyZ' WHEN p_size % 2 = 0 THEN 'auto' ELSE 'KeyF' END AS trigger, CASE WHEN p_size % 2 = 0 THEN 'scene.' || act || '.loop' ELSE 'input.' || act END AS state,
  p_size || ' columns, ' || CAST(ceil(12.0 / p_size) AS INTEGER) || ' rows, 12 active frames.' AS grid, CAST(p_size % 4 + 1 AS INTEGER) AS n_tags, 'layer_' || act || '_7' AS layer_id, 'clip_' || act || '_5' AS active,
  CAST(450 AS DOUBLE) AS x, CAST(502 AS DOUBLE) AS y, round(greatest(0.05, least(2.5, 220.0 / greatest(1, p_size * 10))), 6) AS scale
FROM (SELECT *, lower(regexp_replace(regexp_replace(p_name, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS safe, 'act' || p_size % 7 AS act FROM part)
""")
def built_assets(t):
    """Assets made of a sprite, an upload and an imported sheet, and the layer that shows one."""
    size, now = F.col("p_size"), F.lit("2024-01-01T00:00:00.000Z")
    action, tags = F.concat(F.lit("act"), (size % 7).cast("string")), F.array_join(F.transform(F.sequence(F.lit(0), size % 4), lambda i: F.concat(F.lit("t"), i.cast("string"))), ", ")
    kind = F.when(size % 2 == 0, "auto").otherwise("keyboard")
    rows = t("part").select("p_partkey", size.alias("p_size"), F.col("p_name").alias("title"), action.alias("action"), tags.alias("tags"), kind.alias("kind"), F.concat("p_name", F.lit(".png")).alias("file"))
    made = scene.new_asset(F.struct(F.col("title").alias("characterName")), "prop", F.struct(F.col("action").alias("actionName")), F.col("tags"), now, F.col("p_size"))
    still = scene.static_asset(F.lit("data:x"), F.col("file"), F.lit(10), F.lit(20), now, 9)
    sheet_of = F.struct(F.lit("u").alias("url"), F.lit(64).alias("frameWidth"), (size * 10).alias("frameHeight"), F.lit(12).alias("frameCount"), size.alias("columns"), F.lit(640).alias("width"), F.lit(640).alias("height"), F.lit(8.0).alias("fps"))
    imported = scene.imported_asset(F.col("title"), F.col("action"), "prop", F.col("kind"), F.when(size % 3 == 0, " KeyZ ").otherwise(" "), F.lit(""), F.col("tags"), sheet_of, F.lit(True), now, 5)
    rows = rows.select("p_partkey", "p_size", made.alias("m"), still.alias("s"), imported.alias("i"))
    shown = scene.inserted_layer(F.col("i"), F.struct(F.lit(1000.0).alias("width"), F.lit(500.0).alias("groundY")), 7)
    rows = rows.withColumn("l", shown)
    return rows.select(
        "p_partkey", F.col("m.id").alias("made"), F.col("m.name").alias("made_name"), F.col("s.id").alias("static_id"), F.col("s.binding.gameState").alias("static_state"), F.col("i.id").alias("imported_id"), F.col("i.defaultAnimationId").alias("clip_id"),
        F.col("i.binding.triggerValue").alias("trigger"), F.col("i.binding.gameState").alias("state"), F.col("i.sprite.adaptiveFramePolicy").alias("grid"), F.size("i.tags").alias("n_tags"), F.col("l.id").alias("layer_id"), F.col("l.activeAnimationId").alias("active"),
        F.col("l.x").alias("x"), F.col("l.y").alias("y"), F.round("l.scale", 6).alias("scale"),
    )


@query(WITH + """, p AS (SELECT scene, name, "zIndex", row_number() OVER (PARTITION BY scene ORDER BY ordinal) - 1 AS n FROM l WHERE type = 'sprite')
SELECT scene, CAST(n + 2 AS INTEGER) AS ordinal, 'layer_player_scene_9_' || n AS id, name, CAST(420 + n * 36 AS DOUBLE) AS x, CAST(522 AS DOUBLE) AS y, greatest(coalesce("zIndex", 30.0), 30.0) AS "zIndex", 'New Scene ' || (scene + 1) AS title FROM p
UNION ALL SELECT scene, 0, 'layer_sky', 'Background', 0::DOUBLE, 720::DOUBLE, 0::DOUBLE, 'New Scene ' || (scene + 1) FROM (SELECT DISTINCT scene FROM l)
UNION ALL SELECT scene, 1, 'layer_ground', 'Ground', 0::DOUBLE, 520::DOUBLE, 10::DOUBLE, 'New Scene ' || (scene + 1) FROM (SELECT DISTINCT scene FROM l)""")
def new_scenes(t):
    """A new scene with the players of another one side by side."""
    rows = nested(t)
    kind = rows.select(scene.default_scene()["layers"]).schema[0].dataType.simpleString()
    players = F.from_json(F.to_json(F.filter("layers", lambda x: x["type"] == "sprite")), kind)
    made = rows.select("scene", scene.new_scene(players, F.col("scene"), 9).alias("s")).select("scene", F.col("s.name").alias("title"), F.posexplode("s.layers").alias("ordinal", "x"))
    return made.select("scene", "ordinal", "x.id", "x.name", "x.x", "x.y", "x.zIndex", "title")


@query(f"""
WITH {OF_ASSETS} SELECT 'asset_' || a.k AS id, CAST(n AS INTEGER) AS n, CASE WHEN n = 1 THEN 'Patched' ELSE 'Clip ' || n END AS clip, CASE WHEN n = 1 THEN 'KeyP' ELSE {key_sql('n').replace('k *', 'a.k *')} END AS bound,
  CASE WHEN a.k % 5 > 0 AND a.k % 4 > 1 THEN 'KeyP' ELSE {key_sql('0').replace('k *', 'a.k *')} END AS asset_bound, CASE WHEN a.k % 5 > 0 AND a.k % 4 > 1 THEN 's' || a.k || '_1' ELSE 'new' END AS asset_sprite, CASE WHEN n = 0 THEN 'new' WHEN n <> 2 THEN 's' || a.k || '_' || n END AS clip_sprite
FROM assets a JOIN clips c ON a.k = c.k
""")
def clip_patches(t):
    """One clip patched, asset and default clip in step; a sprite replaced wherever it shows."""
    a = F.struct("id", "sprite", "binding", "defaultAnimationId", "animations")
    first = F.concat(F.lit("s"), F.col("ordinal").cast("string"), F.lit("_0"))
    second = F.concat(F.lit("clip_"), F.col("ordinal").cast("string"), F.lit("_1"))
    done = assets(t).select(F.col("id").alias("key"), first.alias("first"), scene.patched_clip(a, second, {"name": "Patched"}, {"triggerValue": "KeyP"}).alias("a"))
    done = done.select("key", scene.replaced_sprite(F.col("a"), F.col("first"), F.col("a.sprite").withField("id", F.lit("new"))).alias("a"))
    rows = done.select("key", "a", F.posexplode("a.animations").alias("n", "c"))
    return rows.select(F.col("key").alias("id"), "n", F.col("c.name").alias("clip"), F.col("c.binding.triggerValue").alias("bound"), F.col("a.binding.triggerValue").alias("asset_bound"), F.col("a.sprite.id").alias("asset_sprite"), F.col("c.sprite.id").alias("clip_sprite"))


@query("""
WITH n AS (SELECT p_partkey, greatest(1, CAST(floor(coalesce(CASE WHEN p_size % 2 = 0 THEN p_size * 2.5 END, 64) + 0.5) AS INTEGER)) AS fw, 48 AS fh, greatest(1, CAST(floor(coalesce(CASE WHEN p_size % 3 = 0 THEN p_size - 5.5 END, 12) + 0.5) AS INTEGER)) AS n,
  greatest(1, CAST(floor(coalesce(CASE WHEN p_size % 5 = 0 THEN p_size / 4.0 END, 4) + 0.5) AS INTEGER)) AS c FROM part), r AS (SELECT *, greatest(1, CAST(ceil(CAST(n AS DOUBLE) / c) AS INTEGER)) AS r FROM n)
SELECT p_partkey, c AS columns, r AS rows, fw AS width, n AS count, CAST(c * fw <= 501 AND r * fh <= 401 AS BOOLEAN) AS fits, CAST(least(64, greatest(1, c)) AS INTEGER) AS export_columns, CAST(least(60, greatest(1, n)) AS INTEGER) AS export_fps FROM r WHERE c * fw <= 501 AND r * fh <= 401
""")
def rebuilt_grids(t):
    """Sheets cut anew; grids that exceed their sheet go. Their numbers as an export takes them."""
    s = F.col("p_size")
    current = F.struct(F.lit(64.0).alias("frameWidth"), F.lit(48.0).alias("frameHeight"), F.lit(12.0).alias("frameCount"), F.lit(4.0).alias("columns"), F.lit(500).alias("width"), F.lit(400).alias("height"))
    patch = F.struct(F.when(s % 2 == 0, s * 2.5).alias("frameWidth"), F.lit(None).cast("double").alias("frameHeight"), F.when(s % 3 == 0, s - 5.5).alias("frameCount"), F.when(s % 5 == 0, s / 4.0).alias("columns"))
    rows = t("part").select("p_partkey", scene.rebuilt_grid(current, patch).alias("g")).filter("g IS NOT NULL")
    fits = geometry.grid_fits(F.col("g.columns"), F.col("g.rows"), F.col("g.frameWidth"), F.col("g.frameHeight"), F.lit(500), F.lit(400))
    export = numbers.export_settings(F.col("g.columns").cast("string"), F.col("g.frameCount").cast("string"), F.lit("x"), F.lit(None).cast("string"), F.lit("256"))
    return rows.select("p_partkey", "g.columns", "g.rows", F.col("g.frameWidth").alias("width"), F.col("g.frameCount").alias("count"), fits.alias("fits"), export["columns"].alias("export_columns"), export["fps"].alias("export_fps"))


@query(WITH + """, r AS (SELECT scene, ordinal, id, "zIndex", row_number() OVER (PARTITION BY scene ORDER BY "zIndex" DESC NULLS LAST, ordinal) - 1 AS p, count(*) OVER (PARTITION BY scene) AS n FROM l),
s AS (SELECT *, min(CASE WHEN ordinal = 0 THEN p END) OVER (PARTITION BY scene) AS s, min(CASE WHEN ordinal = 2 THEN p END) OVER (PARTITION BY scene) AS t FROM r)
SELECT scene, ordinal, CASE WHEN s IS NULL OR t IS NULL THEN "zIndex" ELSE CAST((n - CASE WHEN p = s THEN t WHEN p > s AND p <= t THEN p - 1 WHEN p < s AND p >= t THEN p + 1 ELSE p END) * 10 AS DOUBLE) END AS "zIndex" FROM s""")
def layer_restacked(t):
    """The first layer of each scene moved to the third one's place in the stack."""
    rows = flat(t).select("scene", "ordinal", F.concat(F.lit("layer "), F.col("ordinal").cast("string")).alias("id"), "zIndex")
    return scene.reordered(rows, "scene", "layer 0", "layer 2").select("scene", "ordinal", "zIndex")


# --- texts, boards, documents and states ---------------------------------------------------------


def light_sql(b: str, c: str, s: str) -> str:
    return f"'brightness(' || {b} || ') contrast(' || {c} || ') saturate(' || {s} || ')'"


@query(f"""
WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_size % 5 = 0 THEN 'none' ELSE {light_sql('p_size', "'1.5'", "'0.25'")} END AS scene_light,
  CASE WHEN p_size % 3 = 0 THEN 'none' WHEN p_size % 3 = 1 OR p_size % 2 = 0 THEN {light_sql("'0.5'", 'p_size', "'2'")} || ' sepia(0.08) drop-shadow(-5px 0 8px rgba(16, 32, 255, 0.5)) drop-shadow(7px 0 10px rgba(255, 0, 16, 0.25)) drop-shadow(0 14px 18px rgba(4, 0, 12, 0.5))' END AS own FROM part)
SELECT p_partkey, CASE WHEN scene_light = 'none' AND coalesce(own, 'none') = 'none' THEN 'none' WHEN coalesce(own, 'none') = 'none' THEN scene_light WHEN scene_light = 'none' THEN own ELSE scene_light || ' ' || own END AS style FROM p
""")
def style_filters(t):
    """Style texts of a scene's and a layer's light; players are always lit."""
    s = F.col("p_size")
    light = lambda preset, b, c, x: F.struct(preset.alias("preset"), b.cast("double").alias("brightness"), c.cast("double").alias("contrast"), x.cast("double").alias("saturate"), F.lit("#ff0010").alias("edgeLightColor"), F.lit(0.25).alias("edgeLightOpacity"), F.lit("#1020ff").alias("rimLightColor"), F.lit(0.5).alias("rimLightOpacity"))
    of_scene = light(F.when(s % 5 == 0, "none").otherwise("x"), s, F.lit(1.5), F.lit(0.25))
    lit_by = light(F.lit("x"), F.lit(0.5), s, F.lit(2.0))
    own = F.when(s % 3 == 0, light(F.lit("none"), F.lit(1), F.lit(1), F.lit(1))).when(s % 3 == 1, lit_by)
    rows = t("part").select("p_partkey", "p_size", of_scene.alias("scene"), own.alias("own"), F.when(s % 2 == 0, "player").otherwise("prop").alias("role"), lit_by.alias("usual"))
    return rows.select("p_partkey", scene.render_filter(F.col("scene"), F.col("own"), F.col("role"), F.col("usual")).alias("style"))


@query("""
WITH s AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders), cur AS (SELECT max(k) AS k FROM s),
r AS (SELECT s.k, row_number() OVER (ORDER BY ordinal) AS slot FROM s, cur WHERE s.k <> cur.k)
SELECT CAST(k AS VARCHAR) AS id, 'Scene ' || k AS name, CAST(k % 4 AS INTEGER) AS layers, '1.60:1' AS ratio, CAST(slot AS INTEGER) AS slot FROM r WHERE slot <= 5
UNION ALL SELECT CAST(k AS VARCHAR), 'Scene ' || k, CAST(k % 4 AS INTEGER), '1.60:1', 0 FROM cur
""")
def flow_board(t):
    """The current scene and the first others on a board."""
    k = F.col("o_orderkey")
    layers = F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda x: x <= k % 4)
    rows = t("orders").select(k.cast("string").alias("id"), F.concat(F.lit("Scene "), k.cast("string")).alias("name"), layers.alias("layers"), F.lit(1280.0).alias("viewportWidth"), F.lit(800.0).alias("viewportHeight"), k.alias("ordinal"))
    return scene.flow_cards(rows, str(t("orders").agg(F.max("o_orderkey")).first()[0]))


@query(f"""
WITH {OF_ASSETS} SELECT 'asset_' || k AS id, CAST((k + 9) % 7 + 1 AS INTEGER) AS n_frames, least((k + 9) % 7 + 1, 3) || '+' || greatest(0, (k + 9) % 7 - 2) AS strip, CASE WHEN k % 4 = 0 THEN 'none' WHEN k % 4 = 2 THEN 'Walk Right ' || ({key_sql('0')})[4:] WHEN k % 8 = 1 THEN 'Walk Left' ELSE 'Clip 0' END AS label FROM assets WHERE (k + 9) % 7 + 1 > 2
""")
def drawn_assets(t):
    """Assets with more than two frames, their first thumbnails and the label of their first clip."""
    n = F.size("sprite.frames")
    head = ordered.head_and_more(F.col("sprite.frames"), 3)
    clip = F.try_element_at(F.col("animations"), F.lit(1))
    direction = F.when(F.col("ordinal") % 4 == 2, "right").when(F.col("ordinal") % 8 == 1, "left")
    label = text.clip_label(direction, clip["binding"]["actionName"], clip["name"], clip["binding"]["triggerType"], clip["binding"]["triggerValue"])
    return assets(t).filter(n > 2).select("id", n.alias("n_frames"), F.concat(F.size(head["shown"]).cast("string"), F.lit("+"), head["more"].cast("string")).alias("strip"), F.when(clip.isNull(), "none").otherwise(label).alias("label"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 3) THEN 0 ELSE 2 END AS n_assets, CASE WHEN o_orderkey % 5 IN (0, 4) THEN 0 ELSE 1 END AS n_scenes, CASE WHEN o_orderkey % 5 = 1 THEN 'then' ELSE '2024-01-02T03:04:05.000Z' END AS updated,
  CASE WHEN o_orderkey % 5 NOT IN (0, 3) THEN 'a' || o_orderkey END AS first_asset FROM orders
""")
def library_documents(t):
    """Library documents as text: whole ones, one with a byte order mark, broken ones and wrong lists."""
    k = F.col("o_orderkey")
    whole = F.concat(F.lit('{"assets": [{"id": "a'), k.cast("string"), F.lit('"}, {"id": "b"}], "scenes": '))
    body = (
        F.when(k % 5 == 0, "{broken").when(k % 5 == 1, F.concat(whole, F.lit('[{"id": "s"}], "updatedTime": "then"}'))).when(k % 5 == 2, F.concat(F.lit("\ufeff"), whole, F.lit('[{"id": "s"}]}')))
        .when(k % 5 == 3, '{"assets": 5, "scenes": [{"id": "s"}]}').otherwise(F.concat(whole, F.lit('{"id": "s"}}')))
    )
    now = F.lit("2024-01-02 03:04:05").cast("timestamp")
    docs = t("orders").select("o_orderkey", body.alias("value"))
    parsed = library.parsed_library(docs, now, keep=("o_orderkey",))
    return parsed.select("o_orderkey", F.size("assets").alias("n_assets"), F.size("scenes").alias("n_scenes"), F.col("updatedTime").alias("updated"), F.try_element_at("assets", F.lit(1))["id"].alias("first_asset"))


@query("SELECT n_nationkey, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS ordinal, n_name AS name, '2024-01-02T03:04:05.000Z' AS updated FROM nation")
def library_round_trip(t):
    """A library written whole and read again, its order kept."""
    spark = t("nation").sparkSession
    asset = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    listed_assets = t("nation").groupBy().agg(F.array_sort(F.collect_list(F.struct("n_nationkey", asset.alias("a")))).alias("x"))  # 25 nations
    document = listed_assets.select(F.to_json(F.struct(F.transform("x", lambda x: x["a"]).alias("assets"))).alias("value"))
    path, now = fresh_path(spark, "library"), F.lit("2024-01-02 03:04:05").cast("timestamp")
    library.write_library(library.parsed_library(document, now), path, now)
    again = library.read_libraries(spark, path)
    rows = again.select("updatedTime", F.posexplode("assets").alias("ordinal", "x"))
    return rows.select(F.col("x.id").cast("long").alias("n_nationkey"), "ordinal", "x.name", F.col("updatedTime").alias("updated"))


@query("SELECT CASE WHEN count(*) FILTER (WHERE p_partkey % 7 = 0) > 0 THEN 'manifest ' || min(p_partkey) FILTER (WHERE p_partkey % 7 = 0) END AS manifest FROM part")
def latest_manifest(t):
    """The first manifest that exists."""
    found = t("part").filter("p_partkey % 7 = 0").select(F.col("p_partkey").alias("priority"), F.concat(F.lit("manifest "), F.col("p_partkey").cast("string")).alias("manifest"), F.lit(True).alias("readable"))
    return library.latest(found)


@query("""
WITH f AS (SELECT page_id, 'sheet_' || lpad(CAST(page_id AS VARCHAR), 9, '0') || '.' || CASE page_id % 4 WHEN 0 THEN 'PNG' WHEN 1 THEN 'txt' WHEN 2 THEN 'webp' ELSE 'gif' END AS name, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * (page_id % 9) AS modified, strlen(html) AS size FROM pages)
SELECT name, '/generated/' || name AS url, lower(split_part(name, '.', 2)) AS extension, size, strftime(modified, '%Y-%m-%dT%H:%M:%S.000Z') AS "updatedTime" FROM f WHERE page_id % 4 <> 1 ORDER BY modified DESC, name
""")
def image_listing(t):
    """The images of a folder's files, newest first; of the same time, by name."""
    k = F.col("page_id")
    ending = F.when(k % 4 == 0, "PNG").when(k % 4 == 1, "txt").when(k % 4 == 2, "webp").otherwise("gif")
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + k % 9 * 3600)
    files = t("pages").select(F.concat(F.lit("file:/a/b/sheet_"), F.lpad(k.cast("string"), 9, "0"), F.lit("."), ending).alias("path"), F.octet_length("html").cast("long").alias("length"), at.alias("modificationTime"))
    return library.image_listing(files)


@query("""
WITH p AS (SELECT p_partkey, p_size FROM part) SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 3 ELSE 2 END AS n_keys, CASE WHEN p_size % 3 = 1 THEN 'new' WHEN p_size % 3 = 0 THEN 'old' ELSE 'old' END AS a, CASE WHEN p_size % 3 = 2 THEN 'new' ELSE CASE WHEN p_size % 3 = 0 THEN 'old' ELSE 'old' END END AS b,
  p_size % 2 = 0 AS same, round(p_size / 8.0, 2) AS fixed, 'layer_' || p_size || '_x' AS id, CASE WHEN p_size % 9 = 0 THEN 80 ELSE p_size * 100 END AS port FROM p
""")
def scene_states(t):
    """State maps with a key set, equality of records, fixed decimals, ids of parts and ports."""
    s = F.col("p_size")
    state = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("old"))
    put = numbers.put_state(state, F.element_at(F.array(F.lit("c"), F.lit("a"), F.lit("b")), (s % 3 + 1).cast("int")), F.lit("new"))
    same = numbers.same_record(F.struct(s.alias("x"), F.lit(None).cast("string").alias("y")), F.struct((s + s % 2).alias("x"), F.lit(None).cast("string").alias("y")))
    port = numbers.port(F.when(s % 9 == 0, F.lit("70000")).otherwise((s * 100).cast("string")), 80)
    rows = t("part").select("p_partkey", put.alias("m"), same.alias("same"), numbers.fixed(s / 8).alias("fixed"), numbers.record_id("layer", s, "x").alias("id"), port.alias("port"))
    return rows.select("p_partkey", F.size("m").alias("n_keys"), F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), "same", "fixed", "id", "port")


# --- generators -----------------------------------------------------------------------------------


def numbers_sql(numbers: dict[str, str]) -> str:
    """A list of (name, value) for DuckDB."""
    return "[" + ", ".join(f"{{'name': '{k}', 'value': CAST({v} AS DOUBLE)}}" for k, v in numbers.items()) + "]"


# What is expected of the generators is written out here, apart from the operator's own tables; i is the frame, a its angle.
GENERATED = {
    "slime": {
        "scaleY": "1 + 0.22 * sin(a)", "scaleX": "1 / sqrt(1 + 0.22 * sin(a))", "wobble": "5 * cos(a * 2)", "lookX": "6 * sin(a)", "bob": "12 * (0.22 * sin(a))", "mouth": "167 + 2.5 * sin(a * 2)",
        "shadowX": "75 / sqrt(1 + 0.22 * sin(a))", "shadowY": "12 * (1 - 0.22 * sin(a))",
    },
    "coin": {"shadow": "85 * (0.8 + 0.1 * sin(a))", "face": "cos(a)", "rim": "96 * abs(cos(a))", "core": "72 * abs(cos(a))", "sheen": "80 * abs(cos(a))", "glint": "15 * sin(a) - 35", "emblem": "i * 15"},
    "fire": {
        "pulse": "34 + 6 * sin(a * 4)", "p1X": "128 + 42 * cos(a * 2.2)", "p1Y": "120 + 30 * sin(a * 1.5 - pi() / 4)", "p1Size": "15 + 6 * cos(a)", "p2X": "128 + 48 * cos(a * 1.8 + pi())", "p2Y": "115 + 35 * sin(a * 2.1 + pi() / 3)", "p2Size": "13 + 5 * sin(a)",
        "node1X": "112 + 10 * cos(a * 3)", "node1Y": "100 - (i * 6) % 65", "node1Size": "2 + i % 3", "node2X": "144 + 12 * sin(a * 2)", "node2Y": "110 - ((i + 4) * 6) % 70", "node2Size": "1.5 + i % 2.5",
    },
    "slash": {
        "angle": "180 * sin(a / 2) - 45", "shadowOpacity": "0.3 * (1 - sin(a / 2))", "arcY": "80 - 40 * sin(a / 2)", "arcWidth": "12 + 8 * sin(a / 2)",
        "sweepOpacity": "CASE WHEN i BETWEEN 3 AND 8 THEN 0.7 - abs(i / 12 - 0.45) * 1.5 ELSE 0 END", "flash": "CASE WHEN i IN (5, 6, 7) THEN 1 ELSE 0 END",
    },
    "flyer": {
        "bob": "14 * cos(a)", "shadow": "58 - 14 * cos(a) * 0.7", "shadowOpacity": "0.22 - 14 * cos(a) * 0.005", "wing1": "120 + 75 * sin(a)", "wing2": "120 - 55 * sin(a)", "wing3": "120 - 25 * sin(a)", "wing4": "120 - 5 * sin(a)", "wing5": "120 + 10 * sin(a)",
    },
    "astral": {"pulse": "1 + 0.12 * sin(a * 2)", "spin": "i * 30"},
}
LOOPS = {
    "slime": (12, {
        "scaleY": "1 + 0.2 * sin(a)", "scaleX": "1 / sqrt(1 + 0.2 * sin(a))", "wobble": "4 * cos(a * 2)", "lookX": "8 * sin(a)", "bob": "15 * (0.2 * sin(a))", "mouth": "166 + 3 * sin(a * 2)", "shadowX": "75 / sqrt(1 + 0.2 * sin(a))", "shadowY": "12 * (1 - 0.2 * sin(a))",
    }),
    "coin": (12, {"shadow": "90 * (0.8 + 0.1 * sin(a))", "face": "cos(a)", "rim": "100 * abs(cos(a))", "core": "74 * abs(cos(a))", "sheen": "84 * abs(cos(a))", "glint": "15 * sin(a) - 30", "reflection": "128 + 60 * cos(a)"}),
    "bat": (16, {
        "bob": "12 * cos(a)", "shadow": "60 - 12 * cos(a) * 0.8", "shadowOpacity": "0.25 - 12 * cos(a) * 0.008", "wing1": "125 + 90 * sin(a)", "wing2": "125 - 60 * sin(a)", "wing3": "125 - 30 * sin(a)", "wing4": "125 - 10 * sin(a)", "wing5": "125 + 15 * sin(a)",
    }),
    "fire": (12, {
        "pulse": "32 + 4 * sin(a * 3)", "p1X": "120 + 40 * cos(a)", "p1Y": "128 + 25 * sin(a * 2)", "p1Size": "14 + 6 * sin(a)", "p2X": "136 + 45 * cos(a + pi())", "p2Y": "120 + 35 * sin(a + pi())", "p2Size": "12 + 5 * cos(a)",
        "ring1": "i * 10 - 15", "ring2": "30 - i * 15", "tail": "i * 30", "spark1X": "110 + 10 * sin(a + 1)", "spark1Y": "100 - (i * 4) % 60", "spark1Size": "2 + i % 3", "spark1Opacity": "0.6 + 0.4 * sin(a)",
        "spark2X": "140 + 8 * cos(a + 3)", "spark2Y": "110 - ((i + 6) * 4) % 65", "spark2Size": "1 + i % 4", "spark2Opacity": "0.5 + 0.5 * cos(a)",
    }),
}
PROMPTS = ("A jelly blob", "Spinning coin", "a flame", "Sword", "a bat", "stars")
FAMILY_SQL = """CASE WHEN regexp_matches(p, 'slime|jelly|blob|squish|bounce') THEN 'slime' WHEN regexp_matches(p, 'coin|spin|rotate|orb|globe') THEN 'coin' WHEN regexp_matches(p, 'fire|flame|burn|plasma|spark|explosion|hot') THEN 'fire'
  WHEN regexp_matches(p, 'sword|slash|blade|strike|cut|impact') THEN 'slash' WHEN regexp_matches(p, 'bird|bat|wing|fly|flight|ghost|hover') THEN 'flyer' ELSE 'astral' END"""


def each_number(df: DataFrame) -> DataFrame:
    return df.select("*", F.explode("parameters").alias("name", "value")).withColumn("value", F.round("value", 6))


@query(f"""
WITH p AS (SELECT p_partkey, lower(list_extract({list(PROMPTS)}, CAST(p_partkey % 6 + 1 AS INTEGER)) || ' ' || p_name) AS p FROM part), f AS (SELECT p_partkey, {FAMILY_SQL} AS family FROM p),
n AS (SELECT family, i, CASE family {' '.join(f"WHEN '{k}' THEN {numbers_sql(v)}" for k, v in GENERATED.items())} END AS x FROM (SELECT family, i, i * 2 * pi() / 12 AS a FROM (SELECT DISTINCT family FROM f), range(0, 12) r(i)))
SELECT p_partkey, family, CAST(i AS INTEGER) AS frame, x.name AS name, round(x.value, 6) + 0.0 AS value FROM f JOIN (SELECT family, i, unnest(x) AS x FROM n) USING (family)
""")
def generated_frames(t):
    """Every number of the frames that a prompt asks for, of which each part has one."""
    prompt = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, PROMPTS)), (F.col("p_partkey") % 6 + 1).cast("int")), "p_name")
    rows = frames.procedural(t("part").select("p_partkey", prompt.alias("prompt")), "prompt", F.lit(12), each_number)
    return rows.select("p_partkey", "family", "frame", "name", "value")


@query(f"""
WITH f AS (SELECT p_partkey, list_extract({list(LOOPS)}, CAST(p_partkey % 5 + 1 AS INTEGER)) AS family FROM part),
n AS ({' UNION ALL '.join(f"SELECT '{k}' AS family, i, unnest({numbers_sql(v)}) AS x FROM (SELECT i, i * 2 * pi() / {n} AS a FROM range(0, {n}) r(i))" for k, (n, v) in LOOPS.items())})
SELECT p_partkey, family, CAST(i AS INTEGER) AS frame, x.name AS name, round(x.value, 6) + 0.0 AS value FROM f JOIN n USING (family)
""")
def preset_loops(t):
    """Every number of the built-in loop that a part names; a fifth of the parts names none."""
    family = F.get(F.array(*map(F.lit, LOOPS)), (F.col("p_partkey") % 5).cast("int"))
    rows = frames.loops(t("part").select("p_partkey", family.alias("family")), "family", finish=each_number)
    return rows.select("p_partkey", "family", "frame", "name", "value")


MOVES_SQL = """
WITH m AS (SELECT n_nationkey, i, n_nationkey % 5 AS k, i / 12.0 AS t FROM nation, range(0, 12) r(i)),
w AS (SELECT *, sin(t * 2 * pi()) AS w, cos(t * 2 * pi()) AS c, sin(t * pi()) AS arc, sin(least(1.0, t * 1.65) * pi()) AS strike FROM m),
v AS (SELECT *, CASE k WHEN 1 THEN greatest(-30.0, least(12.0, strike * -7)) WHEN 2 THEN greatest(-30.0, least(12.0, arc * -30)) ELSE w * -5 END AS y, CASE k WHEN 1 THEN greatest(-10.0, least(10.0, strike * 8)) WHEN 2 THEN w * 2 WHEN 3 THEN 0.0 ELSE c * 1.5 END AS x,
  CASE k WHEN 1 THEN strike * 18 - 8 WHEN 2 THEN w * 4 WHEN 3 THEN c * 2 ELSE w * 2 END AS turn FROM w)
"""


@query(MOVES_SQL + """SELECT n_nationkey, CAST(i AS INTEGER) AS frame, CASE WHEN k = 0 THEN 'walking needs more than one reference image' END AS error, CASE WHEN k > 0 THEN round(x, 6) END AS x, CASE WHEN k > 0 THEN round(y, 6) END AS y, CASE WHEN k > 0 THEN round(greatest(-4.5, least(4.5, turn)), 6) END AS rotate,
  CASE WHEN k > 0 THEN round(58 * (1 - least(0.28, abs(y) / 120)), 6) END AS shadow, CAST(CASE k WHEN 0 THEN -1 WHEN 1 THEN 2 WHEN 3 THEN 8 ELSE 1 END AS INTEGER) AS n_effects,
  CASE k WHEN 1 THEN 54.0 WHEN 2 THEN round(92 + w * 6, 6) WHEN 3 THEN round(128 + c * (58 + w * 8), 6) WHEN 4 THEN round(92 + w * 6, 6) END AS effect_x FROM v""")
def reference_frames(t):
    """A reference picture in motion, with shadow and effects; walking is an error."""
    words = F.array(*map(F.lit, ("walk on", "attack", "jump up", "magic spell", "stand")))
    rows = frames.reference_motion(t("nation").withColumn("prompt", F.element_at(words, (F.col("n_nationkey") % 5 + 1).cast("int"))), "prompt", F.lit(12), F.lit(4))
    r = lambda c: F.round(c, 6)
    return rows.select("n_nationkey", "frame", "error", r(F.col("move.x")).alias("x"), r(F.col("move.y")).alias("y"), r(F.col("move.rotate")).alias("rotate"), r(F.col("shadow")).alias("shadow"), F.coalesce(F.array_size("effects"), F.lit(-1)).alias("n_effects"), r(F.try_element_at("effects", F.lit(1))["x"]).alias("effect_x"))


@query("""
SELECT n_nationkey, CAST(i AS INTEGER) AS frame, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="' || (i % 2 * 256) || ' ' || (i // 2 * 256) || ' 256 256" width="256" height="256">' || '<g transform="translate(0 0)"><a' || n_nationkey || '/></g><g transform="translate(256 0)"><b/></g><g transform="translate(0 256)"><c/></g>' || '</svg>' AS markup,
  '<svg xmlns="http://www.w3.org/2000/svg" width="64" height="48" viewBox="' || (i % 2 * 64) || ' ' || (i // 2 * 48) || ' 64 48" overflow="hidden"><image href="a&amp;b" x="0" y="0" width="128" height="96" preserveAspectRatio="none"/></svg>' AS view FROM nation, range(0, 3) t(i)
""")
def sheet_markup(t):
    """Frames bundled on a sheet, the sheet cut into views, and views on an image."""
    body = F.when(F.col("i") == 0, F.concat(F.lit("<a"), F.col("n_nationkey").cast("string"), F.lit("/>"))).when(F.col("i") == 1, "<b/>").otherwise("<c/>")
    own = t("nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).withColumn("markup", F.concat(F.lit("<svg>"), body, F.lit("</svg>")))
    cut = frames.sliced(frames.bundled(own, "n_nationkey", "i", "markup", 2), "sheet", F.lit(3), F.lit(2))
    at = geometry.grid_cell(F.col("frame"), 2)
    view = frames.window_markup(F.lit("a&b"), at["column"] * 64, at["row"] * 48, F.lit(64), F.lit(48), F.lit(128), F.lit(96))
    return cut.select("n_nationkey", "frame", "markup", view.alias("view"))


# --- sheets ---------------------------------------------------------------------------------------

# A nation's sheet: 3 x 2 cells of 40 pixels on green, a blob in each, its top row faint; in every fifth sheet the blobs touch.
SHEET_W, SHEET_H = 120, 80
PIXELS = f"""px AS (SELECT n_nationkey AS k, x, y, CASE WHEN NOT (CASE WHEN n_nationkey % 5 = 0 THEN TRUE ELSE x % 40 >= 6 + n_nationkey % 5 AND x % 40 < 30 + n_nationkey % 5 END AND y % 40 >= 5 AND y % 40 < 33) THEN 0 WHEN y % 40 = 5 THEN 20 ELSE 255 END AS a
  FROM nation, range(0, {SHEET_W}) a(x), range(0, {SHEET_H}) b(y))"""
GRID = f"""WITH {PIXELS}, h AS (SELECT k, 'x' AS axis, x AS i, count(*) AS n FROM px WHERE a > 24 GROUP BY k, x UNION ALL SELECT k, 'y', y, count(*) FROM px WHERE a > 24 GROUP BY k, y),
up AS (SELECT *, i - row_number() OVER (PARTITION BY k, axis ORDER BY i) AS island FROM h WHERE n > 3), isl AS (SELECT k, axis, min(i) AS s, max(i) + 1 AS e FROM up GROUP BY k, axis, island),
mk AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY k, axis ORDER BY s) <= 6 THEN 0 ELSE 1 END AS opens FROM isl), nr AS (SELECT *, sum(opens) OVER (PARTITION BY k, axis ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM mk),
ru AS (SELECT k, axis, min(s) AS s, max(e) AS e FROM nr GROUP BY k, axis, run HAVING max(e) - min(s) >= 12), ce AS (SELECT k, axis, list((s + e) / 2.0 ORDER BY s) AS c FROM ru GROUP BY k, axis),
bo AS (SELECT k, axis, CASE WHEN axis = 'x' AND len(c) = 3 THEN [greatest(0, round_even(c[1] - (c[3] - c[1]) / 4, 0)), round_even((c[1] + c[2]) / 2, 0), round_even((c[2] + c[3]) / 2, 0), least({SHEET_W}, round_even(c[3] + (c[3] - c[1]) / 4, 0))]
  WHEN axis = 'y' AND len(c) = 2 THEN [greatest(0, round_even(c[1] - (c[2] - c[1]) / 2, 0)), round_even((c[1] + c[2]) / 2, 0), least({SHEET_H}, round_even(c[2] + (c[2] - c[1]) / 2, 0))] END AS b FROM ce),
g AS (SELECT k, max(b) FILTER (WHERE axis = 'x') AS xb, max(b) FILTER (WHERE axis = 'y') AS yb FROM bo GROUP BY k),
gr AS (SELECT k, xb IS NOT NULL AND yb IS NOT NULL AS found, CASE WHEN xb IS NOT NULL AND yb IS NOT NULL THEN xb ELSE [0, 40, 80, 120] END AS xb, CASE WHEN xb IS NOT NULL AND yb IS NOT NULL THEN yb ELSE [0, 40, 80] END AS yb FROM g),
ce2 AS (SELECT k, found, f, xb[f % 3 + 1] AS l, xb[f % 3 + 2] AS r, yb[f // 3 + 1] AS t, yb[f // 3 + 2] AS b FROM gr, range(0, 6) z(f)), ins AS (SELECT *, greatest(1, round_even(least(r - l, b - t) * 0.01, 0)) AS k1 FROM ce2),
cell AS (SELECT k, found, f, least(r, l + k1) AS x0, least(b, t + k1) AS y0, greatest(least(r, l + k1) + 1, r - k1) AS x1, greatest(least(b, t + k1) + 1, b - k1) AS y1 FROM ins),
own AS (SELECT c.k, f, x - x0 AS x, y - y0 AS y, a FROM px JOIN cell c ON c.k = px.k AND x >= x0 AND x < x1 AND y >= y0 AND y < y1 WHERE a > 0),
box AS (SELECT k, f, min(x) AS bx0, min(y) AS by0, max(x) + 1 AS bx1, max(y) + 1 AS by1 FROM own GROUP BY k, f),
body AS (SELECT own.k, own.f, sum(x * a) / sum(a) AS ax, sum(y * a) / sum(a) AS ay FROM own JOIN box ON own.k = box.k AND own.f = box.f WHERE a > 24 AND y < greatest(by0 + 1, by0 + trunc((by1 - by0) * 0.58)) GROUP BY own.k, own.f)
"""


def sheets(t) -> tuple[DataFrame, DataFrame]:
    """Pixels as painted, green where nothing is, and the sheets' sizes."""
    k, x, y = F.col("n_nationkey"), F.col("x"), F.col("y")
    rows = t("nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(SHEET_W - 1))).alias("x")).select("*", F.explode(F.sequence(F.lit(0), F.lit(SHEET_H - 1))).alias("y"))
    blob = F.when(k % 5 == 0, True).otherwise((x % 40 >= 6 + k % 5) & (x % 40 < 30 + k % 5)) & (y % 40 >= 5) & (y % 40 < 33)
    colour = {"r": F.when(blob, 200).otherwise(0), "g": F.when(blob, 60).otherwise(255), "b": F.when(blob, 40).otherwise(0), "a": F.when(blob & (y % 40 == 5), 20).otherwise(255)}
    pixels = rows.select(k.alias("sheet_id"), "x", "y", *(v.alias(n) for n, v in colour.items()))
    return pixels, t("nation").select(k.alias("sheet_id"), F.lit(SHEET_W).alias("width"), F.lit(SHEET_H).alias("height"), F.lit(3).alias("columns"), F.lit(2).alias("rows"))


@query(f"WITH {PIXELS} SELECT k, 'x' AS axis, CAST(x AS INTEGER) AS i, count(*) AS n FROM px WHERE a > 24 GROUP BY k, x UNION ALL SELECT k, 'y', CAST(y AS INTEGER), count(*) FROM px WHERE a > 24 GROUP BY k, y")
def sheet_projections(t):
    """Visible pixels of each column and row of a keyed sheet."""
    pixels, _ = sheets(t)
    return sheet.projections(sheet.keyed_out(pixels)).select(F.col("sheet_id").alias("k"), "axis", "i", "n")


@query(GRID + """, sc AS (SELECT k, least((64 - 12) / max(bx1 - bx0), (48 - 12) / max(by1 - by0)) AS s FROM box GROUP BY k)
SELECT c.k, CAST(c.f AS INTEGER) AS frame, CASE WHEN found THEN 'auto_detected' ELSE 'proportional_fallback' END AS mode, CAST(x0 AS INTEGER) AS x0, CAST(y0 AS INTEGER) AS y0, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1,
  CAST(bx0 AS INTEGER) AS bx0, CAST(by0 AS INTEGER) AS by0, CAST(bx1 AS INTEGER) AS bx1, CAST(by1 AS INTEGER) AS by1, round(ax, 6) AS ax, round(ay, 6) AS ay, round(s, 6) AS scale,
  CAST(greatest(1, round_even((bx1 - bx0) * s, 0)) AS INTEGER) AS placed_w, CAST(greatest(1, round_even((by1 - by0) * s, 0)) AS INTEGER) AS placed_h,
  CAST(CASE WHEN greatest(1, round_even((bx1 - bx0) * s, 0)) <= 56 THEN greatest(4, least(64 - greatest(1, round_even((bx1 - bx0) * s, 0)) - 4, round_even(32 - (ax - bx0) * s, 0))) ELSE floor((64 - greatest(1, round_even((bx1 - bx0) * s, 0))) / 2) END AS INTEGER) AS placed_x,
  CAST(CASE WHEN greatest(1, round_even((by1 - by0) * s, 0)) <= 40 THEN greatest(4, least(48 - greatest(1, round_even((by1 - by0) * s, 0)) - 4, round_even(48 * 0.305 - (ay - by0) * s, 0))) ELSE floor((48 - greatest(1, round_even((by1 - by0) * s, 0))) / 2) END AS INTEGER) AS placed_y
FROM cell c JOIN box ON box.k = c.k AND box.f = c.f JOIN body ON body.k = c.k AND body.f = c.f JOIN sc ON sc.k = c.k
""")
def sheet_normalisation(t):
    """Sheets from keying to placement: grid, cells, boxes, anchors, scale and place of every frame."""
    pixels, all_sheets = sheets(t)
    clean = sheet.keyed_out(pixels)
    grids = cut(sheet.grid(clean, all_sheets))  # a row for each sheet, and one for each frame
    done = sheet.placed(cut(sheet.frames(clean, grids)), 64, 48).join(grids.select("sheet_id", "mode"), "sheet_id")
    boxes = {"x0": "cell.x0", "y0": "cell.y0", "x1": "cell.x1", "y1": "cell.y1", "bx0": "bbox.x0", "by0": "bbox.y0", "bx1": "bbox.x1", "by1": "bbox.y1"}
    place = {n: F.get("placed", F.lit(i)) for i, n in enumerate(("placed_x", "placed_y", "placed_w", "placed_h"))}
    return done.select(F.col("sheet_id").alias("k"), "frame", "mode", *(F.col(v).alias(n) for n, v in boxes.items()), F.round("anchor.x", 6).alias("ax"), F.round("anchor.y", 6).alias("ay"), F.round("scale", 6).alias("scale"), *(v.alias(n) for n, v in place.items()))


@query(GRID + """SELECT k, 6 AS n_frames, CAST(xb[2] AS INTEGER) AS second_bound, '[64,48]' AS size, '[192,96]' AS sheet_size, '[32.0,14.64]' AS anchor FROM gr""")
def sheet_manifests(t):
    """One manifest for each sheet."""
    pixels, all_sheets = sheets(t)
    made = sheet.manifests(pixels, all_sheets, 64, 48, "now")
    return made.select(F.col("sheet_id").alias("k"), F.size("frameBboxes").alias("n_frames"), F.get("gridDetection.xBounds", F.lit(1)).alias("second_bound"), F.to_json("frameSize").alias("size"), F.to_json("sheetSize").alias("sheet_size"), F.to_json(F.get("rootAnchors", F.lit(0))).alias("anchor"))


# --- state over time ------------------------------------------------------------------------------


def sessions(t, event: Column) -> DataFrame:
    return t("events").select(F.col("user_id").cast("string").alias("session_id"), F.struct("ts", "event_id").alias("seq"), F.to_json(event).alias("event"))


EVENTS = "e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), u AS (SELECT DISTINCT session_id FROM e)"


def state(field: str, kind: str) -> Column:
    return F.get_json_object("state", f"$.{field}").cast(kind).alias(field.split(".")[-1])


@query(f"""
WITH RECURSIVE {EVENTS}, f AS (SELECT session_id, CAST(0 AS BIGINT) AS i, 100.0::DOUBLE AS x, 0.0::DOUBLE AS camera FROM u
  UNION ALL SELECT f.session_id, e.i, round(least(greatest(x + CASE WHEN event_id % 5 = 0 THEN -1 ELSE 1 END * 0.12 * least(50, event_id % 14 * 5), 0), 3776), 2), round(least(greatest(least(greatest(x + CASE WHEN event_id % 5 = 0 THEN -1 ELSE 1 END * 0.12 * least(50, event_id % 14 * 5), 0), 3776) + 32 - 537.6, 0), 2560), 2)
  FROM f JOIN e ON e.session_id = f.session_id AND e.i = f.i + 1)
SELECT session_id, arg_max(x, i) AS x, arg_max(camera, i) AS camera, max(i) AS n_events FROM f GROUP BY session_id
""")
def walk_steps(t):
    """Players moved by held keys, and the camera behind them."""
    k = F.col("event_id")
    rows = sessions(t, F.struct(F.when(k % 5 == 0, "left").otherwise("right").alias("kind"), (k % 14 * 5).alias("ms")))
    return reducers.fold(rows, "walk", start={"x": 100.0, "width": 64.0}).select("session_id", state("x", "double"), state("camera", "double"), "n_events")


@query(f"""
WITH RECURSIVE {EVENTS}, f AS (SELECT session_id, CAST(0 AS BIGINT) AS i, 500.0::DOUBLE AS x, 'approaching' AS phase FROM u
  UNION ALL SELECT f.session_id, e.i, CASE WHEN phase = 'approaching' AND event_id % 3 > 0 THEN round(greatest(50, x - 0.33 * least(50, event_id % 11 * 10)), 2) ELSE x END,
    CASE WHEN phase = 'approaching' AND event_id % 3 > 0 AND abs(greatest(50, x - 0.33 * least(50, event_id % 11 * 10)) - 50) < 3 THEN 'ready' WHEN phase = 'ready' AND event_id % 3 = 0 THEN 'boarded' ELSE phase END FROM f JOIN e ON e.session_id = f.session_id AND e.i = f.i + 1)
SELECT session_id, arg_max(x, i) AS x, arg_max(phase, i) AS phase FROM f GROUP BY session_id
""")
def vehicle_approach(t):
    """Vehicles that come, wait and are boarded."""
    k = F.col("event_id")
    rows = sessions(t, F.struct(F.when(k % 3 == 0, "board").otherwise("tick").alias("kind"), (k % 11 * 10).alias("ms")))
    return reducers.fold(rows, "approach", start={"x": 500.0, "target": 50.0}).select("session_id", state("x", "double"), state("phase", "string"))


def history_sql(reset: str, keep: str) -> str:
    """Undo and redo as lists, step by step: kind, value and the scene (or cards) of each event as ``s``."""
    return f"""
WITH RECURSIVE {EVENTS}, v AS (SELECT *, CASE event_id % 6 WHEN 0 THEN 'undo' WHEN 1 THEN 'redo' WHEN 2 THEN 'motion' ELSE 'change' END AS kind, CAST(event_id % 4 AS VARCHAR) AS value, CASE WHEN event_id % 40 = 3 THEN 'b' WHEN event_id % 40 = 23 THEN 'a' END AS s FROM e),
f AS (SELECT session_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS scene, CAST(NULL AS VARCHAR) AS now, CAST([] AS VARCHAR[]) AS past, CAST([] AS VARCHAR[]) AS future FROM u
  UNION ALL SELECT f.session_id, v.i, CASE WHEN {reset} THEN {keep} ELSE scene END,
    CASE WHEN {reset} THEN value WHEN kind = 'undo' THEN CASE WHEN len(past) > 0 THEN past[-1] ELSE now END WHEN kind = 'redo' THEN CASE WHEN len(future) > 0 THEN future[1] ELSE now END ELSE value END,
    CASE WHEN {reset} THEN [] WHEN kind = 'undo' THEN past[:-2] WHEN kind = 'redo' THEN CASE WHEN len(future) > 0 THEN list_append(past, now)[-80:] ELSE past END WHEN value = now OR kind = 'motion' THEN past ELSE list_append(past, now)[-80:] END,
    CASE WHEN {reset} THEN [] WHEN kind = 'undo' THEN CASE WHEN len(past) > 0 THEN list_prepend(now, future)[:80] ELSE future END WHEN kind = 'redo' THEN future[2:] WHEN value = now OR kind = 'motion' THEN future ELSE [] END
  FROM f JOIN v ON v.session_id = f.session_id AND v.i = f.i + 1)
SELECT session_id, arg_max(scene, i) AS scene, arg_max(now, i) AS now, arg_max(array_to_string(past, ','), i) AS past, arg_max(array_to_string(future, ','), i) AS future FROM f GROUP BY session_id
"""


def history(t, machine: str, field: str) -> DataFrame:
    k = F.col("event_id")
    kind = F.when(k % 6 == 0, "undo").when(k % 6 == 1, "redo").when(k % 6 == 2, "motion").otherwise("change")
    other = F.when(k % 40 == 3, "b").when(k % 40 == 23, "a")
    done = reducers.fold(sessions(t, F.struct(kind.alias("kind"), (k % 4).cast("string").alias("target"), other.alias(field))), machine)
    many = lambda n: F.array_join(F.from_json(F.get_json_object("state", f"$.{n}"), "array<string>"), ",").alias(n)
    kept = "scene" if machine == "history" else "cards"
    return done.select("session_id", F.get_json_object("state", f"$.{kept}").alias("scene"), state("now", "string"), many("past"), many("future"))


@query(history_sql("scene IS NULL OR (kind IN ('change', 'motion') AND s <> scene)", "coalesce(s, value)"))
def scene_history(t):
    """Undo and redo of scenes: another scene begins anew, motion isn't recorded."""
    return history(t, "history", "scene")


@query(f"""
WITH {EVENTS}, v AS (SELECT *, event_id % 5 AS k FROM e),
a AS (SELECT session_id, max(CASE WHEN k = 0 THEN i END) AS picked, count(*) AS n, max(i) AS last FROM v GROUP BY session_id),
s AS (SELECT a.session_id, count(*) FILTER (WHERE k = 1 AND (picked IS NULL OR i > picked)) AS toggles, picked IS NOT NULL AS had, arg_max(event_id, i) FILTER (WHERE k = 2) AS set_by, arg_max(event_id, i) FILTER (WHERE k = 3) AS linked, arg_max(event_id, i) AS last FROM a JOIN v ON v.session_id = a.session_id GROUP BY a.session_id, picked)
SELECT session_id, (NOT had) = (toggles % 2 = 0) AS visible, CASE WHEN had THEN 'true' END AS old_key, CASE WHEN set_by % 2 = 0 THEN '16.0' WHEN set_by IS NOT NULL THEN 'on' END AS the_prompt, CASE WHEN linked IS NULL THEN 's1' ELSE 's2' END AS current, 'Said ' || last AS message FROM s
""")
def interaction_fold(t):
    """Pickups, toggles, states, links and animations without a clip, one after another."""
    k = F.col("event_id")
    action = F.element_at(F.array(*map(F.lit, ("pickup-item", "toggle-layer", "set-state", "scene-link", "play-animation"))), (k % 5 + 1).cast("int"))
    value = F.when(k % 2 == 0, "0x10").otherwise("on")
    i = F.struct(action.alias("actionType"), F.concat(F.lit("Said "), k.cast("string")).alias("subtitle"), F.lit("The Prompt!").alias("promptText"), value.alias("setStateValue"), F.lit("s2").alias("targetSceneId"))
    start = {"layers": {"key": {"name": "Old Key!", "visible": True}}, "scenes": ["s2"], "current": "s1"}
    done = reducers.fold(sessions(t, F.struct(F.lit("key").alias("target"), i.alias("interaction"))), "interaction", start=start)
    return done.select("session_id", state("layers.key.visible", "boolean"), state("values.old_key", "string"), state("values.the_prompt", "string"), state("current", "string"), state("message", "string"))


@query(history_sql("(s IS NOT NULL AND s IS DISTINCT FROM scene) OR f.i = 0", "coalesce(s, scene)"))
def layout_history(t):
    """Undo and redo of card layouts: another set of cards begins anew."""
    return history(t, "layout", "cards")


@query(f"""
WITH {EVENTS}, v AS (SELECT *, event_id % 4 AS k, max(CASE WHEN event_id % 4 = 0 THEN i END) OVER (PARTITION BY session_id ORDER BY i) AS copied FROM e),
p AS (SELECT session_id, i, k, row_number() OVER (PARTITION BY session_id, copied ORDER BY i) AS turn FROM v WHERE k = 1 AND copied IS NOT NULL)
SELECT u.session_id, CAST(3 + (SELECT count(*) FROM p WHERE p.session_id = u.session_id) + (SELECT count(*) FROM v WHERE k = 2 AND v.session_id = u.session_id) AS INTEGER) AS n_layers,
  CAST(5 + (SELECT count(*) FROM p WHERE p.session_id = u.session_id) + (SELECT count(*) FROM v WHERE k = 2 AND v.session_id = u.session_id) AS INTEGER) AS top_z, (SELECT CAST(36 * turn AS INTEGER) FROM p WHERE p.session_id = u.session_id ORDER BY i DESC LIMIT 1) AS pasted_x FROM u
""")
def clipboard_fold(t):
    """Layers copied, pasted and duplicated; locked ones and backgrounds aren't cut."""
    k = F.col("event_id")
    kind = F.when(k % 4 == 0, "copy").when(k % 4 == 1, "paste").when(k % 4 == 2, "duplicate").otherwise("cut")
    target = F.when(k % 4 == 3, F.when(k % 8 == 3, "locked").otherwise("bg")).otherwise("a")
    layers = [{"id": "a", "name": "A", "type": "sprite", "x": 0, "y": 0, "z": 5}, {"id": "locked", "name": "L", "type": "sprite", "locked": True, "x": 1, "y": 1, "z": 1}, {"id": "bg", "name": "B", "type": "background", "x": 0, "y": 9, "z": 0}]
    done = reducers.fold(sessions(t, F.struct(kind.alias("kind"), target.alias("target"), F.concat(kind, F.lit("-"), k.cast("string")).alias("new_id"))), "clipboard", start={"layers": layers})
    made = F.from_json(F.get_json_object("state", "$.layers"), "array<struct<id: string, x: double, z: double>>")
    rows = done.select("session_id", made.alias("l"))
    pasted = F.try_element_at(F.filter("l", lambda x: x["id"].startswith("paste")), F.lit(-1))["x"]
    return rows.select("session_id", F.size("l").alias("n_layers"), F.array_max(F.transform("l", lambda x: x["z"])).cast("int").alias("top_z"), pasted.cast("int").alias("pasted_x"))


@query("""
SELECT page_id, page_id % 3 <> 2 AND page_id % 5 <> 0 AS export, page_id % 2 = 0 OR page_id % 7 = 0 AS prompt, page_id % 4 <> 0 AS asset FROM pages
""")
def request_checks(t):
    """Requests and records that can be taken."""
    k = F.col("page_id")
    kind = F.when(k % 3 == 0, "gif").when(k % 3 == 1, "video").otherwise("png")
    rows = t("pages").select("page_id", kind.alias("format"), F.when(k % 5 == 0, "").otherwise("u").alias("sourceUrl"), F.when(k % 2 == 0, "p").alias("prompt"), F.when(k % 7 == 0, "i").otherwise("").alias("referenceImage"), F.when(k % 8 == 0, "").when(k % 8 != 4, "a").alias("id"), F.struct(F.array(F.lit("f")).alias("frames")).alias("sprite"))
    taken = rows.select("page_id")
    for name, check in (("export", library.checked_exports), ("prompt", library.checked_prompts), ("asset", library.checked_assets)):
        good, bad = check(rows)
        marked = good.select("page_id", F.lit(True).alias(name)).unionByName(bad.select("page_id", F.lit(False).alias(name)))
        taken = taken.join(marked, "page_id")
    return taken
