"""Keyed, priority and nearest lookups, and what depends on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side is broadcast up to so many bytes by Spark's own estimate; beyond that both sides are shuffled.
BROADCAST_BYTES = 64 << 20
# Layers that are drawn as sprites.
VISUAL_TYPES = ("sprite", "effect", "foreground")
# Fixed value: the asset that is a vehicle.
BOARDING_ASSET = "asset_scene_boarding_train"


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if the optimizer's size estimate is under the bound."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def last_wins(rows: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """One row for each key: that with the largest ordinal. A partial aggregate, so hot keys cost nothing."""
    every = F.struct(*(F.col(c) for c in rows.columns))
    return rows.groupBy(key).agg(F.max_by(every, ordinal).alias("x")).select("x.*")


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    every = F.struct(*(F.col(c) for c in rows.columns))
    return rows.groupBy(key).agg(F.min_by(every, F.struct(*order)).alias("x")).select("x.*")


def keyed(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", ordinal: str | None = None) -> DataFrame:
    """Rows with their entry of ``table``; with ``ordinal``, repeated keys of the table are resolved by the last."""
    return rows.join(small(last_wins(table, key, ordinal).drop(ordinal) if ordinal else table), key, how)


def first_match(array: Column, predicate) -> Column:
    """The first element in array order, or null."""
    return F.try_element_at(F.filter(array, predicate), F.lit(1))


def priority_clip(animations: Column, active: Column, default: Column) -> Column:
    """The active clip, else the default, else the first."""
    return F.coalesce(first_match(animations, lambda c: c["id"] == active), first_match(animations, lambda c: c["id"] == default), F.try_element_at(animations, F.lit(1)))


def priority_sprite(animations: Column, active: Column, default: Column, sprite: Column) -> Column:
    return F.coalesce(priority_clip(animations, active, default)["sprite"], sprite)


def priority_pick(rows: DataFrame, candidates: DataFrame, key: str, arms: list[Column], order: list[Column], value: Column, name: str = "picked") -> DataFrame:
    """For each row the first candidate (in ``order``) of the first of ``arms`` that has one; null without candidates."""
    rank = F.lit(len(arms))
    for k, arm in reversed(list(enumerate(arms))):
        rank = F.when(arm, k).otherwise(rank)
    best = candidates.groupBy(key).agg(F.min_by(F.struct(value.alias("value"), rank.alias("arm")), F.struct(rank, *order)).alias("x"))
    return rows.join(best.select(key, F.col("x.value").alias(name), F.col("x.arm").alias("arm")), key, "left")


def flatten_clips(layers: DataFrame, assets: DataFrame) -> DataFrame:
    """A row for each clip of each layer's asset; one with a null clip where there is none. Layers without an asset go."""
    a = assets.select(F.col("id").alias("assetId"), F.col("name").alias("assetName"), "animations", F.col("sprite").alias("assetSprite"))
    rows = layers.join(small(a), "assetId").select("*", F.explode_outer("animations").alias("clip")).drop("animations")
    return rows.withColumn("sprite", F.coalesce("clip.sprite", "assetSprite"))


def reachable(zones: DataFrame, asset_id: Column, phase: Column, vehicle: str = BOARDING_ASSET) -> DataFrame:
    """``zones`` without a vehicle that isn't ready to be boarded."""
    return zones.filter(~F.coalesce((asset_id == vehicle) & ~phase.eqNullSafe(F.lit("ready")), F.lit(False)))


def nearest_in_reach(points: DataFrame, boxes: DataFrame, point_key: str, distance: Column, reach: Column, order: list[str], block: Column) -> DataFrame:
    """The nearest box of each point, then only those within that box's own ``reach``: a farther one never steps in.

    ``block`` is a condition that holds for all that can meet (the same scene, a neighbouring tile): an equi-join.
    """
    pairs = small(points).join(boxes, block).withColumn("distance", distance).withColumn("reach", reach)
    every = F.struct(*(F.col(c) for c in pairs.columns if c != point_key))
    best = pairs.groupBy(point_key).agg(F.min_by(every, F.struct("distance", *order)).alias("x"))
    return best.select(point_key, "x.*").filter("distance <= reach")


def missing_rows(templates: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` and those ``templates`` whose key isn't among them.

    Both sides are shuffled: the optimizer takes rows that were exploded for as few as before, and would broadcast them.
    """
    return rows.unionByName(templates.join(rows.select(key).hint("merge"), key, "left_anti").select(*rows.columns))


def binding_match(layers: DataFrame, keys: DataFrame, assets: DataFrame) -> DataFrame:
    """(code) -> first visible drawn layer whose asset has a keyboard clip for it, letter case aside; else the first asset without clips that is bound to it.

    ``layers``: ordinal, layer_id, type, visible, animations; ``assets``: ordinal, id, animations, binding.
    """
    shown = layers.filter(F.col("visible") & F.col("type").isin(*VISUAL_TYPES))
    none = F.lit(None).cast("string")
    clips = shown.select("ordinal", "layer_id", F.posexplode("animations").alias("n", "clip")).filter("clip.binding.triggerType = 'keyboard'").select(F.lit(0).alias("tier"), "ordinal", "n", "layer_id", F.col("clip.id").alias("clip_id"), none.alias("asset_id"), F.lower("clip.binding.triggerValue").alias("k"))
    own = assets.filter((F.coalesce(F.array_size("animations"), F.lit(0)) == 0) & (F.col("binding.triggerType") == "keyboard")).select(F.lit(1).alias("tier"), "ordinal", F.lit(0).alias("n"), none.alias("layer_id"), none.alias("clip_id"), F.col("id").alias("asset_id"), F.lower("binding.triggerValue").alias("k"))
    met = keys.withColumn("k", F.lower("code")).join(clips.unionByName(own), "k")
    return met.groupBy("code").agg(F.min_by(F.struct("layer_id", "clip_id", "asset_id"), F.struct("tier", "ordinal", "n")).alias("x")).select("code", "x.*")


def owner_of_sprite(assets: DataFrame, sprite_id: str) -> DataFrame:
    """The first asset that shows a sprite, itself or in a clip."""
    has = (F.col("sprite.id") == sprite_id) | F.coalesce(F.exists("animations", lambda c: c["sprite"]["id"] == sprite_id), F.lit(False))
    every = F.struct(*(F.col(c) for c in assets.columns))
    return assets.filter(has).groupBy().agg(F.min_by(every, "ordinal").alias("x")).filter("x IS NOT NULL").select("x.*")


def linked_scenes(layers: DataFrame, scenes: DataFrame) -> DataFrame:
    """Scene links with their target; status says ``fail`` where it doesn't exist."""
    links = layers.filter("interaction.actionType = 'scene-link'").withColumn("target", F.col("interaction.targetSceneId"))
    named = scenes.select(F.col("id").alias("target"), F.col("name").alias("targetName"), F.lit("go").alias("status"))
    return links.join(small(named), "target", "left").withColumn("status", F.coalesce("status", F.lit("fail")))


def frame_count(layers: DataFrame, seed: int, shown: Column, frames: Column) -> DataFrame:
    """The largest frame count over shown layers, at least ``seed``."""
    return layers.agg(F.greatest(F.lit(seed), F.max(F.when(shown, frames))).alias("frames"))


def next_z(layers: DataFrame, source_z: float) -> DataFrame:
    return layers.agg((F.greatest(F.max("zIndex"), F.lit(source_z)) + 1).alias("zIndex"))
