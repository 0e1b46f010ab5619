"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame operations only.

Sources in order of code points (null last) have the weights of ``pattern``, repeating. They share
``share`` times the corpus size by weight; a target stops at ``most`` times its source's size and what
is above goes to the others by weight. That has a closed form: with sources ordered by cap to weight
ratio, the level that the open sources reach is what is left over the weight that is left.

A source of size S and target T takes floor(T / S) complete epochs, then T mod S by sampling without
replacement: document keys -ln(u) / w are sorted in the source and their sizes summed up; documents
are taken whole while their midpoint is inside, so a source misses its target by at most half a document.
u is a hash of the document's id and size: reruns agree.

Scale: rows without their text are written once and read by each step. Sorting a source isn't left to one task: keys fall in bins of ``BINS`` to the octave,
which are counted, and a bin of many documents is split evenly, so a bucket has about ``BUCKET_ROWS`` documents whatever their weights. Sums of
buckets are prefix-summed first (a row for each bucket), then documents inside their bucket.
Defined results: null or blank texts have size 0 and take 0; a corpus of size 0 has targets 0;
null ids and repeated rows are rows like any other; an empty table gives an empty result; a null or
negative quality weight counts as 1; extra columns pass through ``keep``, under any names but the results'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a bucket, about, and bins to an octave of keys.
BUCKET_ROWS, BINS = 2_000, 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, pattern: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n_rows -> the same with target. One row for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*(F.lit(float(w)) for w in pattern))
    s = sizes.withColumn("weight", F.element_at(weights, ((F.row_number().over(by_name) - 1) % len(pattern) + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    all_rows = Window.partitionBy()
    from_here = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("budget", share * F.sum("source_size").over(all_rows))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(from_here))
    # Levels rise with the ratio up to the first source that stays under its cap and fall after it: its level holds.
    s = s.withColumn("open_level", F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).over(all_rows))
    target = F.when((F.col("ratio") <= F.col("open_level")) | F.col("open_level").isNull(), F.col("cap")).otherwise(F.col("open_level") * F.col("weight"))
    return s.select("source", "source_size", "n_rows", target.alias("target"))


def bucketed(rows: DataFrame) -> DataFrame:
    """``rows`` (source, place, bin) with ``bucket``: struct(bin, split) in the order of keys."""
    bins = written(rows.groupBy("source", "bin").agg(F.count("*").alias("in_bin")), "mixing-bins").withColumnsRenamed({"source": "s", "bin": "b"})
    split = F.floor((F.col("place") - F.col("bin")) * F.ceil(F.col("in_bin") / BUCKET_ROWS)).cast("long")
    return rows.join(bins, rows["source"].eqNullSafe(bins["s"]) & (rows["bin"] == bins["b"])).withColumn("bucket", F.struct("bin", split.alias("split"))).drop("s", "b", "in_bin")


def mix(
    docs: DataFrame, quality: Column | None = None, size: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    keep: tuple[str, ...] = (), pattern: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and ``keep`` for every row; ``quality`` and ``size`` (words, else counted) are columns of ``docs``."""
    weight = F.lit(1.0) if quality is None else F.when(quality > 0, quality.cast("double")).otherwise(1.0)
    rows = docs.select(*(F.col(c).alias(f"keep_{c}") for c in keep), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), (n_words(F.col(text_col)) if size is None else size).alias("size"), weight.alias("w"))
    digest = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("size").cast("string")))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    rows = rows.withColumn("key", -F.log(u) / F.col("w")).withColumn("place", F.log2("key") * BINS)
    rows = written(rows, "mixing-rows").withColumn("bin", F.floor("place"))  # words are counted once
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    targets = source_targets(sizes, pattern, share, most)
    rows = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rows = bucketed(rows)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ordered = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("bucket_size").over(ordered), F.lit(0)).alias("offset"))
    rows = rows.join(sums, rows["source"].eqNullSafe(sums["s"]) & (rows["bucket"] == sums["b"])).drop("s", "b")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    through = F.col("offset") + F.sum("size").over(inside)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    rows = rows.withColumn("epochs", epochs).withColumn("part", through - F.col("size") / 2 < rest)
    rows = rows.withColumn("copies", (F.col("epochs") + F.when(F.col("part"), 1).otherwise(0)).cast("long"))
    result = ("doc_id", "size", "source_size", "target", "taken", "copies")
    return rows.select(*(F.col(f"keep_{c}").alias(c) for c in keep if c not in result), "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
