"""Filter interaction audit: what each filter of a cascade removes, in every order of the filters, by relational counting.

Words are exploded, counted by (document, word) and then by document for totals and distinct words; the other flags are joined to that, and
32 conditional counts for each part (one for each set of failed filters) hold all that any order can ask: what an order of
the filters keeps, removes or meets again is a sum of some of the 32. So documents are read once, not once for each of the 120 orders.

Filters: A under 100 words; B distinct words under 80 % of words; C capital letters A-Z over 10 % of code points; D holds
one of ``#$%&*|``; E the text of a smaller id, anywhere in the table.

Scale: rows are numbered and written once, dealt by their number, so both word counts run where the words are. Copies are found by
hash: only texts that occur twice have a row to join, and that table is written, so a hot text's rows can be split. Counts by part are summed before
the shuffle; the 600 rows of a part are made of its one row.
Defined results: a null text is empty; an empty text fails A only, and E if a smaller id has none either; a null id is smaller than none and
larger than none, so it fails no E and makes no other fail it; rows of the same id aren't copies of one another; repeated rows count each; a null
part is the empty string; labels of an id are united (any 1 counts), labels without a document ignored; an empty table has no parts
and gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import dropped, written_once

FILTERS = "ABCDE"
SPACES = r"[\x20\x09-\x0D]+"
#: A: fewer words; B: distinct words in a hundred; C: capitals in a hundred code points.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
MASKS = range(1 << len(FILTERS))


def word_totals(rows: DataFrame) -> DataFrame:
    """row, text -> of, words, distinct for rows that have words."""
    words = rows.repartition("row").select("row", F.explode(F.split("text", SPACES)).alias("word")).filter("word <> ''")
    each = words.groupBy("row", "word").agg(F.count("*").alias("n"))
    return each.groupBy(F.col("row").alias("of")).agg(F.sum("n").alias("words"), F.count("*").alias("distinct"))


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, mask for each row: bit k of the mask is set if filter k fails it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    capitals = F.octet_length("text") - F.octet_length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    rows = written_once(rows.withColumns({"digest": F.unhex(F.md5(F.col("text").cast("binary"))), "c": 100 * capitals > MOST_CAPITALS * F.length("text"), "d": F.translate("text", "#$%&*|", "") != F.col("text")}), "audit-rows")
    totals = word_totals(rows.select("row", "text"))
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    copies = written_once(copies.select(F.col("digest").alias("copied"), "first"), "audit-copies")
    flags = rows.drop("text").join(totals, F.col("row") == F.col("of"), "left")
    flags = flags.join(copies, F.col("digest") == F.col("copied"), "left")
    words, distinct = (F.coalesce(c, F.lit(0)) for c in ("words", "distinct"))
    fails = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, F.col("c"), F.col("d"), F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)))
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))
    out = written_once(flags.select("doc_id", "part", mask.alias("mask")), "audit-masks")
    dropped(rows)
    dropped(copies)
    return out


def counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part and arrays n, good, toxic: documents of each mask, of them good and toxic."""
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = masks.join(known, F.col("doc_id") == F.col("labelled"), "left")
    sets = [F.count_if((F.col("mask") == m) & also).alias(f"{name}{m}") for name, also in (("n", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic"))) for m in MASKS]
    return rows.groupBy("part").agg(*sets).select("part", *(F.array(*(f"{name}{m}" for m in MASKS)).alias(name) for name in ("n", "good", "toxic")))


def audit(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: for each part all orders, each with its steps."""
    orders = ["".join(o) for o in itertools.permutations(FILTERS)]
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    steps = [{"filter_order": o, "step": s + 1, "own": bit[f], "before": sum(bit[x] for x in o[:s])} for o in orders for s, f in enumerate(o)]
    steps = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, own: int, before: int>>")
    rows = counts(masks, labels).select("*", F.explode(steps).alias("s")).select("part", "n", "good", "toxic", "s.*")

    def total(name: str, among) -> Column:
        """Sum of the counts whose mask fulfils ``among``."""
        some = F.filter(F.transform(name, lambda x, m: F.when(among(m), x)), lambda x: x.isNotNull())
        return F.aggregate(some, F.lit(0).cast("long"), lambda acc, x: acc + x)

    own, before = F.col("own"), F.col("before")
    has = lambda m, bits: m.bitwiseAND(bits) != 0
    removed = lambda m: has(m, own) & ~has(m, before)
    # The first filter of a document's failures removes it: of the orders of all filters a share of one in its failures.
    share = F.aggregate(F.transform("n", lambda x, m: F.when(has(m, own), x * F.lit(len(orders)) / F.bit_count(m)).otherwise(0)), F.lit(0.0), lambda acc, x: acc + x)
    return rows.select(
        "part", "filter_order", "step", total("n", lambda m: ~has(m, own) & ~has(m, before)).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda m: has(m, own) & has(m, before)).alias("redundant"), total("n", lambda m: m == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), F.round(share).cast("long").alias("shapley"),
    )
