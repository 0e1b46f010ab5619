"""Reading and writing libraries, manifests and image listings, and the changes that their users make."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..plans.lineage import cut
from ..schema import ASSET, LIBRARY, SCENE


def read_library(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """One row: assets, scenes, updatedTime. A missing or broken document is an empty library, a wrong list an empty list."""
    empty = spark.range(1).select(F.lit(None).cast("string").alias("value"))
    try:
        raw = spark.read.text(path, wholetext=True).union(empty).agg(F.max("value").alias("value"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = empty
    return parsed_library(raw, now)


def parsed_library(raw: DataFrame, now: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Column value (text of a document) as a library row beside ``keep``; each list is parsed by itself, so one broken list leaves the other whole."""
    body = F.regexp_replace("value", "^﻿", "")

    def part(name: str, kind: str) -> Column:
        own = F.get_json_object(body, f"$.{name}")  # an object would be read as a list of one
        return F.coalesce(F.from_json(F.when(own.startswith("["), own), kind), F.array().cast(kind))

    return raw.select(
        *keep, part("assets", f"ARRAY<{ASSET}>").alias("assets"), part("scenes", f"ARRAY<{SCENE}>").alias("scenes"),
        numbers.text_or(F.get_json_object(body, "$.updatedTime"), numbers.iso_time(now)).alias("updatedTime"),
    )


def write_library(library: DataFrame, path: str, now: Column) -> None:
    """The whole document anew, with its time."""
    library.withColumn("updatedTime", numbers.iso_time(now)).coalesce(1).write.mode("overwrite").json(path)


def read_libraries(spark: SparkSession, path: str) -> DataFrame:
    """A row for each line: libraries at scale are JSON lines with the schema given."""
    return spark.read.schema(LIBRARY).json(path)


def rows_of(library: DataFrame, name: str) -> DataFrame:
    """A row for each element of a list, with its position: order is data."""
    return library.select(F.posexplode(name).alias("ordinal", "x")).select("ordinal", "x.*")


def latest(candidates: DataFrame) -> DataFrame:
    """(priority, manifest, readable): the manifest of the first candidate; null if that one can't be read."""
    return candidates.groupBy().agg(F.min_by(F.struct("manifest", "readable"), "priority").alias("x")).select(F.when(F.col("x.readable"), F.col("x.manifest")).alias("manifest"))


def list_images(spark: SparkSession, path: str, base_url: str = "/generated/") -> DataFrame:
    """``image_listing`` of a folder. Contents aren't read."""
    return image_listing(spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime"), base_url)


def image_listing(files: DataFrame, base_url: str = "/generated/") -> DataFrame:
    """(path, length, modificationTime) -> name, url, extension, size, updatedTime of image files: newest first, then by name."""
    name = F.try_url_decode(F.regexp_extract("path", "([^/]*)$", 1))
    rows = files.select(name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), F.col("length").alias("size"), numbers.iso_time(F.col("modificationTime")).alias("updatedTime"))
    return by_time_and_name(rows.filter(F.col("extension").isin(*text.IMAGE_EXTENSIONS)).select("name", F.concat(F.lit(base_url), F.url_encode("name")).alias("url"), "extension", "size", "updatedTime"))


def by_time_and_name(rows: DataFrame, time: str = "updatedTime", name: str = "name") -> DataFrame:
    return rows.orderBy(F.desc(time), F.collate(name, "UNICODE"))


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """sheet_id, x, y, r, g, b, a of image files; needs an image library on the executors."""

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np
        from PIL import Image

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                p = np.asarray(Image.open(io.BytesIO(content)).convert("RGBA"))
                for y in range(p.shape[0]):  # a row of the image at a time
                    yield pd.DataFrame({"sheet_id": name, "x": range(p.shape[1]), "y": y, **{c: p[y, :, k].astype("int32") for k, c in enumerate("rgba")}})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decoded, "sheet_id string, x int, y int, r int, g int, b int, a int")


def write_manifests(manifests: DataFrame, path: str) -> None:
    manifests.write.mode("overwrite").json(path)


def with_data_urls(images: DataFrame) -> DataFrame:
    """path, content -> url: the image inline, for upload."""
    kind = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    return images.select("path", F.concat(F.lit("data:image/"), F.when(kind == "jpg", "jpeg").otherwise(kind), F.lit(";base64,"), F.regexp_replace(F.base64("content"), r"\s", "")).alias("url"))


def checked_assets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets that can be stored, and those that lack an id or their sprite's frames."""
    good = F.coalesce((F.col("id") != "") & F.col("sprite.frames").isNotNull(), F.lit(False))
    return rows.filter(good), rows.filter(~good)


def checked_scenes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = F.coalesce((F.col("id") != "") & F.col("layers").isNotNull(), F.lit(False))
    return rows.filter(good), rows.filter(~good)


def checked_exports(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (format, sourceUrl) for a medium that can be made of a source, and the others."""
    good = F.coalesce(F.col("format").isin("gif", "video") & (F.col("sourceUrl") != ""), F.lit(False))
    return rows.filter(good), rows.filter(~good)


def checked_prompts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (prompt, referenceImage) that say or show something, and the others."""
    good = (text.text_or(F.col("prompt"), "") != "") | (text.text_or(F.col("referenceImage"), "") != "")
    return rows.filter(good), rows.filter(~good)


def upsert(base: DataFrame, incoming: DataFrame, key: str, now: Column | None = None, **fixed: Column) -> DataFrame:
    """``incoming`` rows first, then those of ``base`` with other keys; both have ``ordinal``.

    savedTime is the incoming one or ``now``, updatedTime is ``now``; ``fixed`` columns are set on incoming rows.
    """
    new = incoming
    if now is not None:
        new = new.withColumn("savedTime", numbers.text_or(F.col("savedTime"), numbers.iso_time(now))).withColumn("updatedTime", numbers.iso_time(now))
    new = new.withColumns(fixed).withColumn("side", F.lit(0)) if fixed else new.withColumn("side", F.lit(0))
    old = base.join(incoming.select(key), key, "left_anti").select(*base.columns).withColumn("side", F.lit(1))
    return new.unionByName(old)


def renumbered(rows: DataFrame, *order: str) -> DataFrame:
    """``ordinal`` from 0 in ``order``: rows are sorted in ranges and counted by range, so no single task has them all."""
    marked = cut(rows.drop("ordinal").orderBy(*order).withColumn("mark", F.monotonically_increasing_id()))
    part = F.shiftright("mark", 33)
    counts = marked.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", before.alias("offset"))
    return marked.join(F.broadcast(offsets), part == F.col("part")).withColumn("ordinal", F.col("offset") + F.col("mark").bitwiseAND((1 << 33) - 1)).drop("mark", "part", "offset")


def delete_asset(assets: DataFrame, scenes: DataFrame, asset_id: str) -> tuple[DataFrame, DataFrame]:
    """Without the asset and every layer that shows it; layers without an asset stay. An unknown id changes nothing."""
    kept = F.filter(F.coalesce("layers", F.array().cast(scenes.schema["layers"].dataType)), lambda x: ~x["assetId"].eqNullSafe(F.lit(asset_id)))
    return assets.filter(~F.col("id").eqNullSafe(F.lit(asset_id))), scenes.withColumn("layers", kept)


def delete_scene(scenes: DataFrame, scene_id: str) -> DataFrame:
    """Without the scene; links to it stay. An unknown id is an error."""
    known = scenes.agg(F.max((F.col("id") == scene_id).cast("int")).alias("known"))
    missing = F.when(F.coalesce("known", F.lit(0)) == 0, F.raise_error(F.lit("Scene not found")))
    return scenes.crossJoin(F.broadcast(known.select(missing.cast("int").alias("missing")))).filter("missing IS NULL").filter(~F.col("id").eqNullSafe(F.lit(scene_id))).drop("missing")
