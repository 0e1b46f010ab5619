"""Operators for which order is data: runs, boundaries, ranks, positions and bounded ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def projection_runs(counts: DataFrame, keys: list[str], index: str, value: str, threshold: Column, merge_gap: Column, min_size: Column) -> DataFrame:
    """``keys``, start, end (half open) of maximal runs above ``threshold``; close ones are merged, and only then short ones dropped.

    Indices are dense or missing ones count as 0. Windows run over one axis of one sheet.
    """
    above = counts.filter(F.col(value) > threshold).select(*keys, F.col(index).alias("i"), merge_gap.alias("gap"), min_size.alias("least"))
    ordered = Window.partitionBy(*keys).orderBy("i")
    islands = above.withColumn("island", F.col("i") - F.row_number().over(ordered)).groupBy(*keys, "island").agg(F.min("i").alias("a"), (F.max("i") + 1).alias("b"), F.first("gap").alias("gap"), F.first("least").alias("least"))
    ordered = Window.partitionBy(*keys).orderBy("a")
    opens = F.when(F.col("a") - F.lag("b").over(ordered) <= F.col("gap"), 0).otherwise(1)
    merged = islands.withColumn("opens", opens).withColumn("run", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return merged.groupBy(*keys, "run").agg(F.min("a").alias("start"), F.max("b").alias("end"), F.first("least").alias("least")).filter("end - start >= least").select(*keys, "start", "end")


def run_bounds(runs: Column, expected: Column, size: Column) -> Column:
    """Cell bounds from an ordered array of runs (start, end): midpoints between centres, half a median step outside.

    Null if the number of runs isn't the expected one or the bounds don't rise.
    """
    centres = F.transform(runs, lambda r: (r["start"] + r["end"]) / 2)
    n = F.size(runs)
    steps = F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get(centres, i) - F.get(centres, i - 1)))
    m = F.size(steps)
    middle = (F.get(steps, F.floor((m - 1) / 2).cast("int")) + F.get(steps, F.floor(m / 2).cast("int"))) / 2
    inner = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.bround((F.get(centres, i - 1) + F.get(centres, i)) / 2).cast("int"))
    first = F.greatest(F.lit(0), F.bround(F.get(centres, F.lit(0)) - middle / 2).cast("int"))
    last = F.least(size.cast("int"), F.bround(F.get(centres, n - 1) + middle / 2).cast("int"))
    bounds = F.concat(F.array(first), inner, F.array(last))
    rising = F.forall(F.sequence(F.lit(1), F.size(bounds) - 1), lambda i: F.get(bounds, i) > F.get(bounds, i - 1))
    return F.when((n != expected) | (n == 0), None).when(n == 1, F.array(F.lit(0), size.cast("int"))).when((middle > 0) & rising, bounds)


def reordered_positions(rows: DataFrame, order: list[Column], source: Column, target: Column, parts: list[str]) -> DataFrame:
    """Positions after the source row moved to the target's place; ``rank_value`` falls from the top in steps of 10. Windows run within ``parts``."""
    every = Window.partitionBy(*parts)
    r = rows.withColumn("p", F.row_number().over(every.orderBy(*order)) - 1).withColumn("n", F.count("*").over(every))
    r = r.withColumn("s", F.min(F.when(source, F.col("p"))).over(every)).withColumn("t", F.min(F.when(target, F.col("p"))).over(every))
    p, s, t = F.col("p"), F.col("s"), F.col("t")
    moved = F.when(s.isNull() | t.isNull(), p).when(p == s, t).when((p > s) & (p <= t), p - 1).when((p < s) & (p >= t), p + 1).otherwise(p)
    return r.withColumn("position", moved.cast("long")).withColumn("rank_value", ((F.col("n") - moved) * 10).cast("long")).drop("p", "n", "s", "t")


def first_free_name(taken: DataFrame, name: str, base: str) -> DataFrame:
    """(free) "base Copy", or with the smallest number from 2 that isn't taken."""
    stem = f"{base or 'Scene'} Copy"
    used = taken.select(F.when(F.col(name) == stem, 1).otherwise(F.regexp_extract(name, f"^\\Q{stem}\\E ([2-9]|[1-9]\\d+)$", 1).try_cast("long")).alias("k")).filter("k IS NOT NULL").distinct()
    # The smallest number missing from 1, 2, ...: one above a used one, or 1.
    after = used.select((F.col("k") + 1).alias("k")).union(taken.sparkSession.range(1).select(F.lit(1).cast("long"))).join(used, "k", "left_anti")
    return after.agg(F.min("k").alias("k")).select(F.when(F.col("k") == 1, stem).otherwise(F.concat(F.lit(stem + " "), F.col("k").cast("string"))).alias("free"))


def zipped(rows: DataFrame, order: list[Column], slots: DataFrame, start: int = 1) -> DataFrame:
    """The i-th row beside slot i + ``start`` of ``slots`` (slot, ...); rows beyond the slots go. As many rows as slots are sorted out first."""
    n = slots.count()
    first = rows.orderBy(*order).limit(n)
    return first.withColumn("slot", F.row_number().over(Window.orderBy(*order)) - 1 + start).join(slots, "slot")


def top_by_z(rows: DataFrame, key: str, z: str = "zIndex", ordinal: str = "ordinal") -> DataFrame:
    """The row with the largest z of each key, first in order on ties."""
    every = F.struct(*(F.col(c) for c in rows.columns))
    return rows.groupBy(key).agg(F.max_by(every, F.struct(F.col(z), -F.col(ordinal))).alias("x")).select("x.*")


def tail(array: Column, n: int) -> Column:
    """The last ``n`` elements, all if there are fewer."""
    return F.slice(array, F.greatest(F.size(array) - (n - 1), F.lit(1)), n)


def ends(rows: DataFrame, key: str, order: list[Column], value: Column, n: int, last: bool = False) -> DataFrame:
    """``key``, values: the first (or last) ``n`` values of each key, in order. Rows are ranked first, so only ``n`` of a key are gathered."""
    turned = [F.struct(*order).desc()] if last else [F.struct(*order).asc()]
    ranked = rows.select(key, F.struct(*order).alias("at"), value.alias("v"), F.row_number().over(Window.partitionBy(key).orderBy(*turned)).alias("rank")).filter(F.col("rank") <= n)
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("s")).select(key, F.transform("s", lambda x: x["v"]).alias("values"))


def head_and_more(array: Column, n: int) -> Column:
    return F.struct(F.slice(array, 1, n).alias("shown"), F.greatest(F.lit(0), F.size(array) - n).alias("more"))


def padded(array: Column, n: Column) -> Column:
    """Cut to ``n`` or its last element repeated up to ``n``; null if there is nothing to repeat."""
    return F.when(F.size(array) > 0, F.concat(F.slice(array, F.lit(1), n), F.array_repeat(F.try_element_at(array, F.lit(-1)), F.greatest(F.lit(0), n - F.size(array)))))


def median_gap(rows: DataFrame, key: str, at: Column) -> DataFrame:
    """``key``, median_gap: the exact median distance between neighbours."""
    ordered = Window.partitionBy(key).orderBy(at)
    return rows.withColumn("gap", at - F.lag(at).over(ordered)).groupBy(key).agg(F.median("gap").alias("median_gap"))
