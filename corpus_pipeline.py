"""From raw documents to balanced shards: five stages, each a table that the next one reads.

All stages take null ids, texts and labels, empty and very long texts, repeated rows, ties and an empty table; what
becomes of them is in each docstring. A row is carried as one value, so columns of any other names pass through and can't clash with
those of a stage; stages but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm import decontamination, language_id, mixing, sharding, wide_simhash
from lamina.llm.ctw import training_remainder
from lamina.llm.queries import quality_weight, with_quality
from lamina.llm.storage import deleted, fresh_path, scratch, written

#: A text is rejected if no language has this share of its n-grams, and if one has that much more of them than its label's;
#: texts of fewer characters have too few n-grams to tell.
LEAST_KNOWN, CONTRADICTED, FEW = 0.2, 0.3, 40


def whole_rows(docs: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole_row")


def same_row(*parts: str) -> Column:
    """One number for rows that agree in ``parts``, null or not."""
    return F.xxhash64(F.struct(*parts))


def by_the_rest(docs: DataFrame) -> Column:
    """A number that orders rows of one id and text by their other columns, so that which is first is the same in every run."""
    return F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")))).alias("rest")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a known language, their own if they name one.

    Each half of the documents is judged by the filter that the other half's labels teach, so none vouches for itself. Rejected
    are null texts and those without a letter and, from ``FEW`` characters on, those of whose n-grams no language has
    ``LEAST_KNOWN``, and those labelled with a known language of whose n-grams another has ``CONTRADICTED`` more. Documents without
    a label or with one that wasn't learned are judged by their text alone; a null id counts as an empty one for its half;
    repeated rows are judged each. Where the other half teaches nothing only letters are asked for.
    """
    half, kept = training_remainder("doc_id", 2), []
    for k in (0, 1):
        known = language_id.learn(docs.filter(half != k))
        rows = docs.filter(half == k).select(whole_rows(docs), "text", F.col("lang").alias("labelled"))
        found = language_id.identify(rows, known, keep=("whole_row", "labelled"), names=("predicted", "score", "shares"))
        best, own = F.try_element_at("shares", F.col("predicted")), F.coalesce(F.try_element_at("shares", F.col("labelled")), F.lit(1.0))
        if known.languages:
            told = (best >= LEAST_KNOWN) & (best - own < CONTRADICTED)
            found = found.filter((F.col("predicted") != language_id.UNDETERMINED) & (told | (F.length("whole_row.text") < FEW)))
        else:
            found = found.filter(F.col("whole_row.text").rlike(r"\p{L}"))
        kept.append(found.select("whole_row.*"))
    return kept[0].unionByName(kept[1])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, five-word shingles and a similarity of 0.8: that with the smallest id.

    Texts without words are one group, as are texts of the same few words; null ids come last; of rows with the
    same id and text the one whose other columns hash least stays, of an id with several texts in a group the text with the least hash.
    """
    groups = wide_simhash.near_duplicates(docs)
    chosen = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("x"))
    chosen = chosen.select(same_row("x.doc_id", "x.text_hash").alias("chosen"))
    rows = docs.select(whole_rows(docs), "doc_id", F.xxhash64("text").alias("text_hash"), by_the_rest(docs))
    rows = rows.select("whole_row", "rest", same_row("doc_id", "text_hash").alias("same"))
    kept = rows.join(chosen, rows["same"] == chosen["chosen"], "left_semi")
    return kept.groupBy("same").agg(F.min_by("whole_row", "rest").alias("x")).select("x.*")  # repeated rows are one before the shuffle


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark; null texts and those without words have none and stay, repeated rows too."""
    return decontamination.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is one like any other and comes last; texts without words have size 0 and are taken in whole epochs; rows
    that agree in id, text and source share their copies: each takes the least, and the first of them by their other columns what is over.
    """
    narrow = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("words"), F.xxhash64("text").alias("text_hash"))
    mixed = mixing.mix(with_quality(narrow, spark.read.parquet(f"{sf_dir}/labels.parquet")), quality_weight(), F.col("words"), keep=("text_hash", "source"))
    least, times = F.min("copies"), F.count("*")
    taken = mixed.groupBy(same_row("doc_id", "text_hash", "source").alias("taken")).agg(least.alias("least"), (F.sum("copies") - least * times).alias("over"))
    taken = written(taken.filter("least + over > 0"), "mixed")
    rows = docs.select(whole_rows(docs), "doc_id", F.xxhash64("text").alias("text_hash"), "source", by_the_rest(docs))
    rows = rows.select("whole_row", "rest", same_row("doc_id", "text_hash", "source").alias("same"))
    found = rows.join(taken, rows["same"] == taken["taken"])
    turn = F.row_number().over(Window.partitionBy("same").orderBy("rest"))
    found = found.withColumn("copies", F.col("least") + F.when(turn <= F.col("over"), 1).otherwise(0)).filter("copies > 0")
    return found.select("whole_row", F.explode(F.expr("sequence(1, copies)")).alias("copy")).select("whole_row.*")


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with size, text_crc32, law, shard, slot and grown_shard; copies of a text share a shard.

    A null text is a group of its own, null ids and repeated rows have slots like any other. Columns of ``docs`` with one of
    these six names are replaced.
    """
    result = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    sharded = sharding.shard(docs.select(whole_rows(docs), "doc_id", "text"), 40, keep=("whole_row",))
    return sharded.select(*(F.col("whole_row").getField(c).alias(c) for c in docs.columns if c not in result), *result)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("sharding", assign_shards),
]

#: Language ID and fingerprints aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. Tables of a stage go when its result is written, results when the next one is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, "pipeline-" + name.replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            deleted(spark, before)
        before = path
    return docs
