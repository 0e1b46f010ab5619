"""Changes of scene records: functions over columns of layers (arrays of structs) and over single rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..functions.numbers import clamp, fixed, layer_scale, lit, or_default, round_half_up, text_or
from ..sources import builtin
from .lookup import VISUAL_TYPES, first_match, priority_clip

# Fixed values of the editor.
INTERACTION_TAGS = ("interactable", "interaction-trigger", "inspect-hotspot")
BUILT_IN_PREFIX = "asset_scene_"
INTERACTION_DEFAULTS = {
    "enabled": True, "preset": "inspect", "triggerMode": "near-click", "actionType": "subtitle", "promptKey": "", "promptText": "Inspect",
    "subtitle": "There is something worth inspecting here.", "failSubtitle": "Nothing happens.", "showText": False, "fontSize": 11.0, "promptScale": 0.88, "promptStyle": "horror",
    "triggerRadius": 180.0, "offsetX": 0.0, "offsetY": -34.0, "zoneOffsetX": 0.0, "zoneOffsetY": 0.0, "hideLayerOnPickup": True, "hotspotVisible": True,
}
HISTORY = 80


def is_visual(layer: Column) -> Column:
    return layer["type"].isin(*VISUAL_TYPES)


def is_transformable(layer: Column) -> Column:
    return is_visual(layer) | (layer["type"] == "background")


def patched(record: Column, patch: dict[str, Column]) -> Column:
    for name, value in patch.items():
        record = record.withField(name, value(record) if callable(value) and not isinstance(value, Column) else lit(value))
    return record


def patch_layer(layers: Column, layer_id, patch: dict, only=None) -> Column:
    """``patch`` (field: value, or a function of the layer) on the layer with that id; ``only`` guards it."""
    def one(x):
        hit = x["id"] == lit(layer_id)
        return F.when(hit & only(x) if only else hit, patched(x, patch)).otherwise(x)

    return F.transform(layers, one)


def patch_unlocked(layers: Column, layer_id, patch: dict) -> Column:
    """Lighting, shadow and interaction changes: locked layers and those that aren't drawn stay as they are."""
    return patch_layer(layers, layer_id, patch, lambda x: ~F.coalesce(x["locked"], F.lit(False)) & is_visual(x))


def without_built_ins(layers: Column, ids: list[str]) -> Column:
    """Without layers that show a built-in asset; those without an asset stay."""
    return F.filter(layers, lambda x: x["assetId"].isNull() | (x["assetId"] == "") | ~x["assetId"].isin(*ids))


def normalised(scene: Column) -> Column:
    """Layers of a scene with backgrounds completed: sizes of 0 and missing ones are the scene's, old full frames stand on its lower edge."""
    def one(x):
        width = F.when(x["width"] > 0, x["width"]).otherwise(scene["width"])
        height = F.when(x["height"] > 0, x["height"]).otherwise(scene["height"])
        old = (or_default(x["width"], 0.0) == 0) & (or_default(x["height"], 0.0) == 0) & (x["y"] == 0)
        finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
        done = patched(x, {
            "locked": F.lit(False), "x": F.when(finite(x["x"]), x["x"]).otherwise(0.0), "y": F.when(old, height).when(finite(x["y"]), x["y"]).otherwise(height),
            "scale": or_default(x["scale"], 1.0), "zIndex": F.coalesce(x["zIndex"], F.lit(0.0)), "opacity": F.coalesce(x["opacity"], F.lit(1.0)), "parallax": F.coalesce(x["parallax"], F.lit(1.0)),
            "width": width, "height": height, "fit": text_or(x["fit"], "stretch"), "position": text_or(x["position"], "left center"),
        })
        return F.when(x["type"] == "background", done).otherwise(x)

    return F.transform(scene["layers"], one)


def resized(scenes: DataFrame, width: Column, height: Column, fallback: float = 1280.0) -> DataFrame:
    """Scenes grown to a viewport: the camera stays inside and backgrounds of the world's size (within two pixels) follow it."""
    want_w, want_h = or_default(width, or_default(F.col("viewportWidth"), fallback)), or_default(height, or_default(F.col("viewportHeight"), F.col("height")))
    new_w, new_h = F.greatest("width", want_w), F.greatest("height", want_h)

    def one(x):
        wide = (or_default(x["width"], 0.0) == 0) | (F.abs(x["width"] - F.col("width")) <= 2)
        high = (or_default(x["height"], 0.0) == 0) | (F.abs(x["height"] - F.col("height")) <= 2)
        done = patched(x, {"width": F.when(wide, new_w).otherwise(x["width"]), "height": F.when(high, new_h).otherwise(x["height"]), "y": F.when(high & (F.abs(x["y"] - F.col("height")) <= 2), new_h).otherwise(x["y"])})
        return F.when(x["type"] == "background", done).otherwise(x)

    view_w = F.least(want_w, new_w)
    # Layers first, in a step of their own: inside a lambda, names would mean the new columns of the same step.
    return scenes.withColumn("layers", F.transform("layers", one)).withColumns({"cameraX": clamp(F.col("cameraX"), 0.0, F.greatest(F.lit(0.0), new_w - view_w)), "viewportWidth": view_w, "viewportHeight": want_h, "width": new_w, "height": new_h})


def interaction_of(layer: Column, asset: Column) -> Column:
    """The layer's interaction over what its asset gives over the defaults; null where neither is interactive."""
    tagged = F.coalesce(F.arrays_overlap(asset["tags"], F.array(*map(F.lit, INTERACTION_TAGS))), F.lit(False))
    label = F.when(asset["id"].isNull(), INTERACTION_DEFAULTS["promptText"]).when(asset["binding"]["actionName"] == "interact", "Interact").otherwise(asset["name"])
    derived = {"promptKey": text.key_label(asset["binding"]["triggerValue"]), "promptText": label}
    own = layer["interaction"]
    values = [F.coalesce(own[n], *([derived[n]] if n in derived else []), *([F.lit(d)] if d is not None else [])).alias(n) for n, d in (INTERACTION_DEFAULTS | {k: None for k in ("zoneWidth", "zoneHeight", "targetLayerId", "targetSceneId", "targetAnimationId", "itemId", "conditionStateKey", "conditionStateValue", "setStateKey", "setStateValue")}).items()]
    return F.when(tagged | own.isNotNull(), F.struct(*values))


def with_preset(interaction: Column, preset: Column, bounds: Column, layer_name: Column) -> Column:
    """A preset's fields over an interaction's. A zone that neither gives is the layer's box, or 160 by 120; what is picked up or set is named after the layer."""
    names = ("preset", "triggerMode", "actionType", "promptText", "subtitle", "failSubtitle", "showText", "hideLayerOnPickup")
    key = text.safe_name(text.text_or(layer_name, preset["label"]))
    side = lambda own, box, least: or_default(own, round_half_up(or_default(box, least)).cast("double"))
    named = {"itemId": "pickup", "setStateKey": "conditional"}
    changes = {n: F.coalesce(preset[n], interaction[n]) for n in names} | {n: F.when(preset["preset"] == kind, text.text_or(interaction[n], key)).otherwise(interaction[n]) for n, kind in named.items()}
    zone = {"zoneWidth": side(interaction["zoneWidth"], bounds["width"], 160.0), "zoneHeight": side(interaction["zoneHeight"], bounds["height"], 120.0)}
    return patched(interaction, changes | zone | {"enabled": F.lit(True)})


def light_filter(light: Column) -> Column:
    parts = [F.concat(F.lit(f"{n}("), text.number_text(light[n]), F.lit(")")) for n in ("brightness", "contrast", "saturate")]
    return F.when(light["preset"] == "none", "none").otherwise(F.concat_ws(" ", *parts))


def layer_filter(light: Column) -> Column:
    glow = lambda x, y, blur, side: F.concat(F.lit(f"drop-shadow({x}px {y} {blur}px "), text.rgba(light[f"{side}LightColor"], light[f"{side}LightOpacity"]), F.lit(")"))
    return F.when(light["preset"] == "none", "none").otherwise(F.concat_ws(" ", light_filter(light), F.lit("sepia(0.08)"), glow(-5, 0, 8, "rim"), glow(7, 0, 10, "edge"), F.lit("drop-shadow(0 14px 18px rgba(4, 0, 12, 0.5))")))


def render_filter(scene_light: Column, layer_light: Column, role: Column, default_light: Column) -> Column:
    """Players are always lit, others only by a light of their own."""
    own = F.when(layer_light.isNotNull(), layer_filter(layer_light)).when(role == "player", layer_filter(default_light))
    return text.filter_text(light_filter(scene_light), own)


def copied_layer(layer: Column, label: str, turn, z, layer_id) -> Column:
    """A copy a step further right and down for each turn, visible and unlocked."""
    return patched(layer, {"id": layer_id, "name": F.concat(layer["name"], F.lit(f" {label}")), "visible": F.lit(True), "locked": F.lit(False), "x": fixed(layer["x"] + lit(turn) * 36), "y": fixed(layer["y"] + lit(turn) * 24), "zIndex": z})


def background_from(target: Column, source: Column) -> Column:
    return patched(source, {"id": target["id"], "name": target["name"], "type": F.lit("background"), "locked": target["locked"], "visible": F.lit(True), "zIndex": target["zIndex"]})


def cleared_background(layer: Column) -> Column:
    return patched(layer, {"name": F.lit("Black Background"), "visible": F.lit(True), "imageUrl": F.lit(None).cast("string"), "color": F.lit("#000000"), "opacity": F.lit(1.0), "fit": F.lit("stretch"), "position": F.lit("center center")})


def without_interaction(layer: Column) -> Column:
    return layer.withField("interaction", F.when(layer["interaction"].isNotNull(), layer["interaction"].withField("enabled", F.lit(False))))


def deleted(layers: Column, layer_id, zone_only=False) -> Column:
    """Backgrounds are cleared, not removed; locked layers stay; a zone's deletion only switches its interaction off."""
    hit = lambda x: (x["id"] == lit(layer_id)) & ~F.coalesce(x["locked"], F.lit(False))
    if zone_only:
        return F.transform(layers, lambda x: F.when(hit(x), without_interaction(x)).otherwise(x))
    cleared = F.transform(layers, lambda x: F.when(hit(x) & (x["type"] == "background"), cleared_background(x)).otherwise(x))
    return F.filter(cleared, lambda x: ~hit(x) | (x["type"] == "background"))


def reordered(rows: DataFrame, scene: str, source: str, target: str, z: str = "zIndex", key: str = "id", ordinal: str = "ordinal") -> DataFrame:
    """Rows of scenes (array positions in ``ordinal``) with the source layer moved to the target's place, top first; z in steps of 10.

    Where either is missing or both are the same, the scene stays.
    """
    from pyspark.sql import Window

    down = Window.partitionBy(scene).orderBy(F.desc(z), ordinal)
    every = Window.partitionBy(scene)
    ranked = rows.withColumn("_p", F.row_number().over(down) - 1).withColumn("_n", F.count("*").over(every))
    ranked = ranked.withColumn("_s", F.min(F.when(F.col(key) == source, F.col("_p"))).over(every)).withColumn("_t", F.min(F.when(F.col(key) == target, F.col("_p"))).over(every))
    p, s, t = F.col("_p"), F.col("_s"), F.col("_t")
    moved = F.when(p == s, t).when((p > s) & (p <= t), p - 1).when((p < s) & (p >= t), p + 1).otherwise(p)
    changes = s.isNotNull() & t.isNotNull() & F.lit(source != target)
    return ranked.withColumn(z, F.when(changes, ((F.col("_n") - moved) * 10).cast(rows.schema[z].dataType)).otherwise(F.col(z))).drop("_p", "_n", "_s", "_t")


def patched_clip(asset: Column, clip_id, patch: dict, binding_patch: dict) -> Column:
    """One clip changed; sprite and binding of the asset follow its default clip."""
    def one(c):
        return F.when(c["id"] == lit(clip_id), patched(c, patch).withField("binding", patched(c["binding"], binding_patch)) if binding_patch else patched(c, patch)).otherwise(c)

    clips = F.transform(asset["animations"], one)
    default = F.coalesce(first_match(clips, lambda c: c["id"] == asset["defaultAnimationId"]), F.try_element_at(clips, F.lit(1)))
    done = patched(asset, {"animations": clips, "sprite": F.coalesce(default["sprite"], asset["sprite"]), "binding": F.coalesce(default["binding"], asset["binding"])})
    return F.when(F.coalesce(F.array_size(asset["animations"]), F.lit(0)) == 0, asset).otherwise(done)


def replaced_sprite(asset: Column, sprite_id, sprite: Column) -> Column:
    """A sprite replaced wherever the asset shows it."""
    clips = F.transform(asset["animations"], lambda c: F.when(c["sprite"]["id"] == lit(sprite_id), c.withField("sprite", sprite)).otherwise(c))
    return patched(asset, {"animations": clips, "sprite": F.when(asset["sprite"]["id"] == lit(sprite_id), sprite).otherwise(asset["sprite"])})


def new_asset(sprite: Column, role, binding: Column, tags: Column, now: Column, stamp) -> Column:
    """An asset of a sprite; clock and id stamp are parameters."""
    title, action = sprite["characterName"], binding["actionName"]
    return F.struct(
        F.concat_ws("_", F.lit("asset"), text.safe_name(title), text.safe_name(action), lit(stamp).cast("string")).alias("id"), F.concat(title, F.lit(" / "), action).alias("name"), lit(role).alias("role"),
        F.lit(True).alias("confirmed"), now.alias("savedTime"), now.alias("updatedTime"), sprite.alias("sprite"), binding.alias("binding"), text.split_tags(tags).alias("tags"),
    )


def static_asset(url: Column, file_name: Column, width: Column, height: Column, now: Column, stamp) -> Column:
    """An asset of one uploaded picture, a prop that keeps its size."""
    base = text.text_or(text.without_extension(file_name), "Uploaded Object")
    key, stamp, pair = text.safe_name(base), lit(stamp).cast("string"), F.array(width.cast("double"), height.cast("double"))
    picture = F.concat(F.lit('<img src="'), url, F.lit('" alt="'), text.escape_markup(base), F.lit('" draggable="false" />'))
    sprite = F.struct(
        F.concat_ws("_", F.lit("sprite_static"), key, stamp).alias("id"), base.alias("characterName"), F.concat(F.lit("Static uploaded object from "), text.text_or(file_name, "image file"), F.lit(".")).alias("description"), F.lit(1).alias("frameCount"),
        F.array(picture).alias("frames"), url.alias("spritesheetPng"), url.alias("rawSpritesheetPng"), pair.alias("frameSize"), pair.alias("sheetSize"), F.lit(None).cast("double").alias("cellSize"), F.lit("uploaded-static-object").alias("generationMode"),
    )
    binding = F.struct(F.lit("static").alias("actionName"), F.lit("auto").alias("triggerType"), F.lit("auto").alias("triggerValue"), F.concat(F.lit("static."), key).alias("gameState"))
    return F.struct(F.concat_ws("_", F.lit("asset_static"), key, stamp).alias("id"), base.alias("name"), F.lit("prop").alias("role"), F.lit(True).alias("confirmed"), now.alias("savedTime"), now.alias("updatedTime"), sprite.alias("sprite"), binding.alias("binding"), F.array(F.lit("uploaded"), F.lit("static-object")).alias("tags"))


def imported_asset(name: Column, action: Column, role, kind: Column, trigger: Column, state: Column, tags: Column, sheet: Column, loop: Column, now: Column, stamp) -> Column:
    """An asset of an imported sheet with one clip; ``sheet``: url, frameWidth, frameHeight, frameCount, columns, width, height, fps."""
    stamp, n = lit(stamp).cast("string"), sheet["frameCount"]
    note = F.when((kind == "auto") & loop, "Imported spritesheet loops continuously while it is visible in the scene.").otherwise("Imported spritesheet action with configurable trigger metadata.")
    binding = F.struct(action.alias("actionName"), kind.alias("triggerType"), text.text_or(F.trim(trigger), text.default_trigger_value(kind)).alias("triggerValue"), text.text_or(F.trim(state), text.default_game_state(kind, action)).alias("gameState"), note.alias("notes"))
    pair = lambda w, h: F.array(sheet[w].cast("double"), sheet[h].cast("double"))
    grid = F.format_string("%d columns, %d rows, %d active frames.", sheet["columns"], F.ceil(n / sheet["columns"]), n)
    sprite = F.struct(
        F.concat_ws("_", F.lit("sprite_import"), text.safe_name(name), stamp).alias("id"), name.alias("characterName"), n.alias("frameCount"), sheet["url"].alias("spritesheetPng"), sheet["fps"].alias("fps"), sheet["columns"].cast("double").alias("gridColumns"),
        pair("frameWidth", "frameHeight").alias("frameSize"), pair("width", "height").alias("sheetSize"), F.lit(None).cast("double").alias("cellSize"), F.lit("uploaded-spritesheet").alias("generationMode"), grid.alias("adaptiveFramePolicy"),
    )
    clip = F.struct(F.concat_ws("_", F.lit("clip"), text.safe_name(action), stamp).alias("id"), action.alias("name"), action.alias("actionName"), F.lit("none").alias("direction"), sprite.alias("sprite"), binding.alias("binding"), loop.alias("loop"), sheet["fps"].alias("fps"))
    asset = new_asset(sprite, role, binding, tags, now, stamp)
    return patched(asset, {"animations": F.array(clip), "defaultAnimationId": clip["id"]})


def inserted_layer(asset: Column, scene: Column, stamp) -> Column:
    """A layer that shows an asset in the middle of a scene, as high as its role asks."""
    clip = priority_clip(asset["animations"], F.lit(None).cast("string"), asset["defaultAnimationId"])
    sprite = F.coalesce(clip["sprite"], asset["sprite"])
    height = F.when(sprite.isNull(), 256.0).otherwise(geometry.frame_size(sprite)["height"])
    effect = asset["role"] == "effect"
    want = F.when(effect, 150.0).when(asset["role"] == "player", 300.0).otherwise(220.0)
    action = text.text_or(asset["binding"]["actionName"], asset["name"])
    return F.struct(
        F.concat_ws("_", F.lit("layer"), text.safe_name(action), lit(stamp).cast("string")).alias("id"), asset["name"].alias("name"), F.when(effect, "effect").otherwise("sprite").alias("type"), F.lit(True).alias("visible"), asset["id"].alias("assetId"),
        text.text_or(asset["defaultAnimationId"], F.try_element_at(asset["animations"], F.lit(1))["id"]).alias("activeAnimationId"), round_half_up(scene["width"] * 0.45).cast("double").alias("x"), (scene["groundY"] + 2).alias("y"),
        layer_scale(want / F.greatest(F.lit(1.0), height)).alias("scale"), F.when(effect, 42.0).otherwise(30.0).alias("zIndex"), F.lit(1.0).alias("opacity"), F.lit(1.0).alias("parallax"),
    )


def default_scene() -> Column:
    """The scene that an empty editor shows; its layers are a background and a hidden ground."""
    names = ("id", "name", "type", "visible", "locked", "x", "y", "scale", "zIndex", "opacity", "parallax", "width", "height", "color", "fit", "position")
    values = (
        ("layer_sky", "Background", "background", True, False, 0.0, 720.0, 1.0, 0.0, 1.0, 1.0, 3840.0, 720.0, "#08070d", "stretch", "left center"),
        ("layer_ground", "Ground", "ground", False, True, 0.0, 520.0, 1.0, 10.0, 0.45, 1.0, None, None, "#f0b14a", None, None),
    )
    kinds = dict.fromkeys(("width", "height"), "double") | dict.fromkeys(("fit", "position"), "string")
    layers = F.array(*(F.struct(*((F.lit(v).cast(kinds[n]) if n in kinds else F.lit(v)).alias(n) for n, v in zip(names, row))) for row in values))
    state = F.create_map(*(F.lit(x) for k in ("has_key", "radio_on", "door_open", "visited_bedroom") for x in (k, "false")))
    fixed_values = {"id": "scene_side_scroller_demo", "name": "Side Scroller Scene", "width": 3840.0, "height": 720.0, "viewportWidth": 1280.0, "viewportHeight": 720.0, "viewportPreset": "desktop", "cameraX": 0.0, "groundY": 520.0}
    return F.struct(*(F.lit(v).alias(k) for k, v in fixed_values.items()), layers.alias("layers"), state.alias("state"))


def new_scene(players: Column, n_saved: Column, stamp) -> Column:
    """A default scene with the players of the current one side by side; ``players`` are layers of the default scene's type."""
    base, stamp = default_scene(), lit(stamp).cast("string")

    def beside(x, k):
        return patched(x, {"id": F.concat(F.lit("layer_player_scene_"), stamp, F.lit("_"), k.cast("string")), "name": text.text_or(x["name"], "Player"), "x": (420 + k * 36).cast("double"), "y": base["groundY"] + 2, "zIndex": F.greatest(x["zIndex"], F.lit(30.0)), "opacity": F.lit(1.0), "parallax": F.lit(1.0), "visible": F.lit(True)})

    return patched(base, {"id": F.concat(F.lit("scene_draft_"), stamp), "name": F.concat(F.lit("New Scene "), (n_saved + 1).cast("string")), "layers": F.concat(base["layers"], F.transform(players, beside))})


def rebuilt_grid(current: Column, patch: Column) -> Column:
    """struct(columns, rows, frameWidth, frameHeight, frameCount) of a sheet cut anew; null if the grid exceeds it.

    Both have frameWidth, frameHeight, frameCount and columns, of which null ones of ``patch`` stay; ``current`` also width and height.
    """
    n = {k: F.greatest(F.lit(1), round_half_up(F.coalesce(patch[k], current[k]))).cast("int") for k in ("frameWidth", "frameHeight", "frameCount", "columns")}
    rows = F.greatest(F.lit(1), F.ceil(n["frameCount"] / n["columns"])).cast("int")
    grid = F.struct(n["columns"].alias("columns"), rows.alias("rows"), n["frameWidth"].alias("frameWidth"), n["frameHeight"].alias("frameHeight"), n["frameCount"].alias("frameCount"))
    return F.when(geometry.grid_fits(n["columns"], rows, n["frameWidth"], n["frameHeight"], current["width"], current["height"]), grid)


def kit_light() -> Column:
    return F.struct(*(F.lit(v).alias(k) for k, v in builtin.KIT_LIGHT.items()))


def hotspot_layers(scenes: DataFrame, hotspots: DataFrame, scene_key: str = "id") -> DataFrame:
    """A layer for each scene and hotspot: it only carries an interaction and stands by the scene's ground."""
    s = scenes.select(F.col(scene_key).alias("scene"), "groundY")
    placed = s.join(F.broadcast(hotspots), F.lit(True))  # three rows
    fixed = {"type": "effect", "visible": True, "assetId": builtin.EYE, "activeAnimationId": "clip_eye_inspect_idle", "scale": 0.55, "zIndex": 82.0, "opacity": 0.75, "parallax": 1.0, "shadow": False}
    return placed.select("scene", "id", "name", *(F.lit(v).alias(k) for k, v in fixed.items()), "x", (F.col("groundY") + F.col("below")).alias("y"), kit_light().alias("lighting"), "promptText", "triggerRadius", "offsetY", "fontSize", "promptStyle")


def kit_layers(scenes: DataFrame, kit: DataFrame, scene_key: str = "id") -> DataFrame:
    """The scene kit's layers for each scene: places that a layer doesn't fix follow from the scene's camera, ground and size."""
    view = F.least(or_default(F.col("viewportWidth"), 1280.0), F.col("of_width"))
    s = scenes.select(F.col(scene_key).alias("scene"), F.col("width").alias("of_width"), F.col("height").alias("of_height"), "viewportWidth", "cameraX", "groundY")
    x = F.when(F.col("assetId") == builtin.EYE, round_half_up(F.col("cameraX") + view * 0.5).cast("double")).when(F.col("assetId") == builtin.TRAIN, F.col("cameraX") + view + 180)
    y = F.when(F.col("assetId") == builtin.EYE, F.col("groundY") - 10).when(F.col("assetId") == builtin.TICKET_MACHINE, F.col("groundY") + 3).when(F.col("assetId") == builtin.TRAIN, F.col("of_height") - 36)
    placed = s.join(F.broadcast(kit), F.lit(True)).withColumn("x", F.coalesce("x", x)).withColumn("y", F.coalesce("y", y))  # six rows
    return placed.select("scene", *kit.columns)


def completing_layers(scenes: DataFrame, scene_key: str = "id") -> DataFrame:
    """All that a scene is completed with: sign, machine, backpack, vehicle and the hotspots; fields that a layer doesn't have are null."""
    spark = scenes.sparkSession
    kit = kit_layers(scenes, builtin.kit_layers(spark).filter(F.col("assetId").isin(*builtin.KIT_COMPLETED)).drop("ordinal"), scene_key)
    kit = kit.withColumn("visible", F.lit(True)).withColumn("lighting", kit_light())
    return kit.unionByName(hotspot_layers(scenes, builtin.hotspots(spark), scene_key), allowMissingColumns=True)


def corrected_kit_layer(layer: Column) -> Column:
    """Kit layers of older scenes that are too large are put back to their place and size; machine, sign and vehicle lose their light at any size."""
    asset, scale = layer["assetId"], layer["scale"]
    hud = patched(layer, {"x": F.lit(1210.0), "y": F.lit(96.0), "scale": F.lit(0.18), "parallax": F.lit(0.0), "zIndex": F.greatest(layer["zIndex"], F.lit(120.0))})
    sign = {"x": F.lit(920.0), "y": F.lit(292.0), "scale": F.lit(0.36)}
    dark = lambda **change: patched(layer, {**change, "lighting": kit_light()})
    return (
        F.when((asset == builtin.BACKPACK) & (scale > 0.35), hud).when((asset == builtin.TICKET_MACHINE) & (scale > 0.3), dark(scale=F.lit(0.22)))
        .when((asset == builtin.SIGN) & (scale > 0.48), dark(**sign)).when(asset.isin(builtin.TICKET_MACHINE, builtin.SIGN, builtin.TRAIN), dark()).otherwise(layer)
    )


def flow_cards(scenes: DataFrame, current: str, most: int = 5) -> DataFrame:
    """Slot 0 is the current scene, the first saved others follow; placeholders fill up where no other is saved."""
    from pyspark.sql import Window

    others = scenes.filter(F.col("id") != current)
    card = lambda df: df.select("id", "name", F.size("layers").alias("layers"), text.viewport_ratio(F.col("viewportWidth"), F.col("viewportHeight")).alias("ratio"), "slot")
    first = others.orderBy("ordinal").limit(most).withColumn("slot", F.row_number().over(Window.orderBy("ordinal")))
    rows = card(scenes.filter(F.col("id") == current).withColumn("slot", F.lit(0))).unionByName(card(first))
    blanks = scenes.sparkSession.createDataFrame([(f"placeholder_{k}", "Empty", 0, "custom", k) for k in (1, 2)], "id string, name string, layers int, ratio string, slot int")
    none = others.limit(1).groupBy().count().filter("count = 0")
    return rows.unionByName(blanks.join(F.broadcast(none), F.lit(True), "left_semi"))
