"""Built-in tables: viewports, interaction presets, scene-kit assets and layers, preset sprites. All values are fixed values of the format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWPORTS = """
iphone-portrait|Phone Portrait|390|844|phone
phone-landscape|Phone Wide|844|390|phone
portrait-720p|Portrait 720p|720|1280|phone
portrait-1080p|Portrait 1080p|1080|1920|phone
ipad-portrait|iPad Portrait|768|1024|tablet
ipad-pro-portrait|iPad Pro Portrait|820|1180|tablet
ipad|iPad Wide|1024|768|tablet
ipad-wide|iPad Pro Wide|1180|820|tablet
desktop|Desktop 720p|1280|720|desktop
desktop-1080p|Desktop 1080p|1920|1080|desktop
wide|Ultrawide|1440|720|desktop
"""
INTERACTION_PRESETS = """
inspect|Inspect|subtitle|Inspect|There is something worth inspecting here.||false|
pickup|Pickup|pickup-item|Pick up|Picked up an item.||false|true
toggle|Toggle|toggle-layer|Use|Something changed.|||
scene-link|Door / Scene Link|scene-link|Enter|Moving to another scene.|||
animated|Animated Prop|play-animation|Activate|The object starts moving.|||
conditional|Conditional|set-state|Inspect|The condition is satisfied.|It does not seem ready yet.||
"""
# id, name, default clip, clip, action, trigger type, trigger value, game state, tags
KIT_ASSETS = """
asset_scene_e_trigger_point|Eye Inspect Hotspot / Reusable|clip_e_trigger_idle|clip_eye_inspect_idle|interact|mouse|click|hotspot.nearby|scene-kit,interaction-trigger,inspect-hotspot,hotspot,reusable
asset_scene_ticket_machine|Ruined Ticket Machine / Interact|clip_ticket_machine_idle|clip_ticket_machine_idle|interact|mouse|click|ticketMachine.nearby|scene-kit,interactable,inspectable,ticket-machine,reusable
asset_scene_backpack_ui|Backpack HUD / Inventory|clip_backpack_hud_idle|clip_backpack_hud_idle|inventory_hud|state|inventory.visible|ui.backpack|scene-kit,ui,backpack,reusable
asset_scene_backpack_panel|Open Backpack Inventory Panel / UI|clip_backpack_panel_open|clip_backpack_panel_open|inventory_open|state|inventory.open|ui.backpack.open|scene-kit,ui,backpack-panel,png,reusable
asset_scene_station_sign_13|Platform 13 Hanging Sign / Prop|clip_station_sign_13_idle|clip_station_sign_13_idle|station_sign|state|station.line13|scene.stationSign|scene-kit,station-sign,line-13,reusable
asset_scene_boarding_train|Arriving Subway Car / Board|clip_boarding_train_idle|clip_boarding_train_idle|board_vehicle|mouse|click|vehicle.readyToBoard|scene-kit,vehicle,boarding,interactable,inspectable,png,transparent-windows,side-view,reusable
"""
# asset, layer id, name, type, clip, x, y, scale, z, opacity, parallax, shadow; x and y that depend on the scene are empty
KIT_LAYERS = """
asset_scene_e_trigger_point|layer_scene_e_trigger_point|Eye Inspect Hotspot|effect|clip_eye_inspect_idle|||0.55|82|0.75|1|false
asset_scene_ticket_machine|layer_scene_ticket_machine|Ticket Machine|sprite|clip_ticket_machine_idle|720||0.22|24|1|1|true
asset_scene_backpack_ui|layer_scene_backpack_ui|Backpack HUD|foreground|clip_backpack_hud_idle|1210|96|0.18|120|1|0|false
asset_scene_backpack_panel|layer_scene_backpack_panel|Open Backpack Panel|foreground|clip_backpack_panel_open|258|572|0.72|118|1|0|false
asset_scene_boarding_train|layer_scene_boarding_train|Arriving Subway Car|sprite|clip_boarding_train_idle|||0.44|86|1|1|true
asset_scene_station_sign_13|layer_scene_station_sign_13|Platform 13 Hanging Sign|sprite|clip_station_sign_13_idle|920|292|0.36|12|0.92|1|false
"""
PRESET_SPRITES = """
preset_slime|Squishy Neon Slime|12|Vibrant Vector
preset_coin|Golden Arcade Coin|12|Shiny Vector Art
preset_bat|Midnight Twilight Bat|16|Clean Vector Profile
preset_fire|Cosmic Plasma Core|12|Dreamy Magic Vector
"""
# id, name, x, y below the ground, prompt, radius, offset, font size, prompt style; empty ones are the defaults of an interaction
HOTSPOTS = """
layer_scene_eye_hotspot_ticket_machine|Ticket Machine Eye Hotspot|738|-12|Use ticket machine|155|-42||
layer_scene_eye_hotspot_notice|Notice Board Eye Hotspot|390|-18|Inspect notice|145|-30|10|caption
layer_scene_eye_hotspot_platform_edge|Platform Edge Eye Hotspot|1480|-14|Wait for train|190|-30||
"""
# Lighting of kit layers: off, with the values that it has when it is put on.
KIT_LIGHT = {"preset": "none", "brightness": 0.64, "contrast": 0.98, "saturate": 0.74, "edgeLightColor": "#ff3e75", "edgeLightOpacity": 0.32, "rimLightColor": "#8e54ff", "rimLightOpacity": 0.24}
EYE, TICKET_MACHINE, BACKPACK, PANEL = "asset_scene_e_trigger_point", "asset_scene_ticket_machine", "asset_scene_backpack_ui", "asset_scene_backpack_panel"
SIGN, TRAIN = "asset_scene_station_sign_13", "asset_scene_boarding_train"
#: Those that a scene is completed with, beside the hotspots.
KIT_COMPLETED = (SIGN, TICKET_MACHINE, BACKPACK, TRAIN)
KIT_IDS = (EYE, TICKET_MACHINE, BACKPACK, PANEL, SIGN, TRAIN)


def cells(table: str) -> list[list[str | None]]:
    return [[x or None for x in row.split("|")] for row in table.strip().split("\n")]


def rows(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """A built-in table with its order in ``ordinal``; ``schema`` gives columns and types, texts are cast."""
    names = [f.split()[0] for f in schema.split(", ")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(cells(table))], "ordinal int, " + ", ".join(f"{n} string" for n in names))
    return df.selectExpr("ordinal", *(f"cast({f.split()[0]} as {f.split()[1]}) as {f.split()[0]}" for f in schema.split(", ")))


def viewports(spark: SparkSession) -> DataFrame:
    return rows(spark, VIEWPORTS, "id string, label string, width int, height int, icon string")


def interaction_presets(spark: SparkSession) -> DataFrame:
    return rows(spark, INTERACTION_PRESETS, "preset string, label string, actionType string, promptText string, subtitle string, failSubtitle string, showText boolean, hideLayerOnPickup boolean").selectExpr("*", "'near-click' AS triggerMode")


def kit_assets(spark: SparkSession) -> DataFrame:
    """Assets with one clip each, bound as they are; their role is ``prop``."""
    t = rows(spark, KIT_ASSETS, "id string, name string, defaultAnimationId string, clip string, actionName string, triggerType string, triggerValue string, gameState string, tags string")
    binding = "named_struct('actionName', actionName, 'triggerType', triggerType, 'triggerValue', triggerValue, 'gameState', gameState)"
    return t.selectExpr("ordinal", "id", "name", "'prop' AS role", "defaultAnimationId", f"array(named_struct('id', clip, 'actionName', actionName, 'direction', 'none', 'loop', false, 'binding', {binding})) AS animations", f"{binding} AS binding", "split(tags, ',') AS tags")


def kit_layers(spark: SparkSession) -> DataFrame:
    return rows(spark, KIT_LAYERS, "assetId string, id string, name string, type string, activeAnimationId string, x double, y double, scale double, zIndex double, opacity double, parallax double, shadow boolean")


def hotspots(spark: SparkSession) -> DataFrame:
    return rows(spark, HOTSPOTS, "id string, name string, x double, below double, promptText string, triggerRadius double, offsetY double, fontSize double, promptStyle string")


def preset_sprites(spark: SparkSession) -> DataFrame:
    return rows(spark, PRESET_SPRITES, "id string, characterName string, frameCount int, style string")
