"""Greedy dedupe over several keys: a row is rejected if any of its keys was taken, and rejected rows take none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut


def greedy(rows: DataFrame, ordinal: str, keys: list[Column]) -> DataFrame:
    """The accepted rows of ``rows``, as if they came one by one in order of the unique ``ordinal``.

    Rounds: an undecided row that is first for each of its keys is accepted; rows that share a key with an accepted one are
    rejected. Every round decides at least the first undecided row of each connected group. Keys that only one row has are
    dropped at once. Rounds are checkpointed in the shared folder; null keys are ignored, and rows without a key are accepted.
    """
    pairs = rows.select(F.col(ordinal).alias("o"), F.explode(F.array_distinct(F.filter(F.array(*(F.when(k.isNotNull(), F.concat(F.lit(f"{n}:"), k.cast("string"))) for n, k in enumerate(keys))), lambda k: k.isNotNull()))).alias("k"))
    shared = pairs.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k")
    left = cut(pairs.join(shared, "k"))
    rejected = None
    while not left.isEmpty():
        firsts = left.groupBy("k").agg(F.min("o").alias("first"))
        accepted = left.join(firsts, "k").groupBy("o").agg(F.bool_and(F.col("o") == F.col("first")).alias("all")).filter("all").select("o")
        taken = left.join(accepted, "o", "left_semi").select("k").distinct()
        out = cut(left.join(taken, "k", "left_semi").select("o").distinct().join(accepted, "o", "left_anti"))
        rejected = out if rejected is None else rejected.union(out)
        left = cut(left.join(accepted, "o", "left_anti").join(out, "o", "left_anti"))
    return rows if rejected is None else rows.join(rejected.withColumnRenamed("o", ordinal), ordinal, "left_anti")


def gallery_entries(assets: DataFrame, sprites: DataFrame, files: DataFrame) -> DataFrame:
    """One list of pictures: clips of assets (or their sprite), then sprites, then files, each picture once."""
    from ..functions.geometry import frame_total
    from ..functions.text import file_size, without_extension

    clips = F.when(F.coalesce(F.array_size("animations"), F.lit(0)) > 0, F.transform("animations", lambda c: F.struct(c["sprite"].alias("sprite"), F.coalesce(F.nullif(c["name"], F.lit("")), F.col("name")).alias("title")))).otherwise(F.array(F.struct(F.col("sprite").alias("sprite"), F.col("name").alias("title"))))
    of_assets = assets.select("ordinal", "role", F.posexplode(clips).alias("n", "x")).select(F.lit(0).alias("tier"), "ordinal", "n", "x.sprite", "x.title", F.concat(F.col("role"), F.lit(" / ")).alias("meta"))
    of_sprites = sprites.select(F.lit(1).alias("tier"), "ordinal", F.lit(0).alias("n"), F.struct(*(c for c in sprites.columns if c != "ordinal")).alias("sprite"), F.col("characterName").alias("title"), F.lit("").alias("meta"))
    drawn = of_assets.unionByName(of_sprites).filter(F.size("sprite.frames") > 0)
    source = F.coalesce(F.nullif("sprite.rawSpritesheetPng", F.lit("")), F.nullif("sprite.spritesheetPng", F.lit("")))
    drawn = drawn.select("tier", "ordinal", "n", F.concat(F.lit("sprite_"), "sprite.id").alias("key"), "title", F.concat("meta", frame_total(F.col("sprite")).cast("string"), F.lit(" frames")).alias("meta"), source.alias("url"), F.col("sprite.id").alias("sprite_id"))
    shown = files.select(F.lit(2).alias("tier"), "ordinal", F.lit(0).alias("n"), F.concat(F.lit("file_"), "name").alias("key"), without_extension(F.col("name")).alias("title"), F.concat(F.upper("extension"), F.lit(" / "), file_size(F.col("size"))).alias("meta"), "url", F.lit(None).cast("string").alias("sprite_id"))
    every = drawn.unionByName(shown).withColumn("place", F.struct("tier", "ordinal", "n"))
    return greedy(every, "place", [F.col("sprite_id"), F.col("url")])
