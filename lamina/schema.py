"""Record types of the library: assets with clips and sprites, scenes with layers."""

SPRITE = (
    "STRUCT<id: STRING, characterName: STRING, description: STRING, frameCount: INT, style: STRING, prompt: STRING, frames: ARRAY<STRING>, createdTime: STRING, updatedTime: STRING, "
    "isPreset: BOOLEAN, spritesheetPng: STRING, rawSpritesheetPng: STRING, generationMode: STRING, fps: DOUBLE, gridColumns: DOUBLE, cellSize: DOUBLE, frameSize: ARRAY<DOUBLE>, sheetSize: ARRAY<DOUBLE>>"
)
BINDING = "STRUCT<actionName: STRING, triggerType: STRING, triggerValue: STRING, gameState: STRING, notes: STRING>"
CLIP = f"STRUCT<id: STRING, name: STRING, actionName: STRING, direction: STRING, sprite: {SPRITE}, binding: {BINDING}, loop: BOOLEAN, fps: DOUBLE>"
INTERACTION = (
    "STRUCT<enabled: BOOLEAN, preset: STRING, triggerMode: STRING, actionType: STRING, promptKey: STRING, promptText: STRING, subtitle: STRING, failSubtitle: STRING, showText: BOOLEAN, "
    "fontSize: DOUBLE, promptScale: DOUBLE, promptStyle: STRING, triggerRadius: DOUBLE, offsetX: DOUBLE, offsetY: DOUBLE, zoneWidth: DOUBLE, zoneHeight: DOUBLE, zoneOffsetX: DOUBLE, "
    "zoneOffsetY: DOUBLE, conditionStateKey: STRING, conditionStateValue: STRING, targetLayerId: STRING, targetSceneId: STRING, targetAnimationId: STRING, itemId: STRING, setStateKey: STRING, "
    "setStateValue: STRING, hideLayerOnPickup: BOOLEAN, hotspotVisible: BOOLEAN>"
)
SHADOW = "STRUCT<enabled: BOOLEAN, color: STRING, opacity: DOUBLE, blur: DOUBLE, width: DOUBLE, height: DOUBLE, offsetX: DOUBLE, offsetY: DOUBLE>"
LAYER_LIGHT = "STRUCT<preset: STRING, brightness: DOUBLE, contrast: DOUBLE, saturate: DOUBLE, edgeLightColor: STRING, edgeLightOpacity: DOUBLE, rimLightColor: STRING, rimLightOpacity: DOUBLE>"
SCENE_LIGHT = "STRUCT<preset: STRING, brightness: DOUBLE, contrast: DOUBLE, saturate: DOUBLE, ambience: DOUBLE, vignette: DOUBLE, glow: DOUBLE>"
LAYER = (
    "STRUCT<id: STRING, name: STRING, type: STRING, visible: BOOLEAN, locked: BOOLEAN, assetId: STRING, activeAnimationId: STRING, x: DOUBLE, y: DOUBLE, scale: DOUBLE, zIndex: DOUBLE, opacity: DOUBLE, "
    f"parallax: DOUBLE, width: DOUBLE, height: DOUBLE, color: STRING, imageUrl: STRING, fit: STRING, position: STRING, shadow: {SHADOW}, lighting: {LAYER_LIGHT}, interaction: {INTERACTION}>"
)
ASSET = f"STRUCT<id: STRING, name: STRING, role: STRING, confirmed: BOOLEAN, savedTime: STRING, updatedTime: STRING, sprite: {SPRITE}, animations: ARRAY<{CLIP}>, defaultAnimationId: STRING, binding: {BINDING}, tags: ARRAY<STRING>>"
SCENE = (
    "STRUCT<id: STRING, name: STRING, width: DOUBLE, height: DOUBLE, viewportWidth: DOUBLE, viewportHeight: DOUBLE, viewportPreset: STRING, cameraX: DOUBLE, groundY: DOUBLE, background: STRING, "
    f"layers: ARRAY<{LAYER}>, state: MAP<STRING, STRING>, lighting: {SCENE_LIGHT}, savedTime: STRING, updatedTime: STRING>"
)
LIBRARY = f"assets ARRAY<{ASSET}>, scenes ARRAY<{SCENE}>, updatedTime STRING"


def fields(struct: str) -> str:
    """Columns of a table whose rows are ``struct``."""
    return struct.removeprefix("STRUCT<").removesuffix(">")
