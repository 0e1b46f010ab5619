"""As-of and overlap joins over time, without a group being held in one task.

As-of: both sides are put in one order and the last right row is carried forward. A key's rows are split by ranges of time, each range is
carried by itself, and what a range ends with is carried to the next ones over one row a range, so a hot key is spread.

Overlap: spans meet in buckets of time as wide as a power of two: a span lies in at most two buckets of the first width that is no smaller, and looks for the
others' in every width that the other side has. A pair is given out once, by the bucket that holds the later start of the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: Column, slice_width: float, order: Column | None = None) -> DataFrame:
    """``left`` with ``found``: ``value`` of the right row of its key that is last at or before its time; of equal times the greatest ``order``.

    ``at`` is a number in both (microseconds, say), ``slice_width`` the width of a range. Left rows with a null key or time find nothing and stay; right ones are left out.
    """
    last = F.struct(F.col(at).alias("a"), (order if order is not None else F.lit(0)).alias("o"), value.alias("value"))
    r = right.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("k"), F.col(at).alias("t"), F.floor(F.col(at) / slice_width).alias("slice"), last.alias("last"), F.lit(None).cast(left_row(left)).alias("row"), F.lit(0).alias("side"))
    rows = F.struct(*left.columns)
    every = left.select(F.col(key).alias("k"), F.col(at).alias("t"), F.floor(F.col(at) / slice_width).alias("slice"), F.lit(None).cast(r.schema["last"].dataType).alias("last"), rows.alias("row"), F.lit(1).alias("side"))
    ends = r.groupBy("k", "slice").agg(F.max("last").alias("end"))
    every_slice = ends.unionByName(every.filter("k IS NOT NULL AND t IS NOT NULL").select("k", "slice").distinct().withColumn("end", F.lit(None).cast(r.schema["last"].dataType)))
    before = Window.partitionBy("k").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = every_slice.groupBy("k", "slice").agg(F.max("end").alias("end")).withColumn("carry", F.last("end", ignorenulls=True).over(before))
    carried = carried.filter("carry IS NOT NULL").select("k", "slice", F.lit(None).cast("double").alias("t"), F.col("carry").alias("last"), F.lit(None).cast(left_row(left)).alias("row"), F.lit(-1).alias("side"))
    both = r.unionByName(every.filter("k IS NOT NULL AND t IS NOT NULL")).withColumn("t", F.col("t").cast("double")).unionByName(carried)
    inside = Window.partitionBy("k", "slice").orderBy("side_first", "t", "side", "last.o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = both.withColumn("side_first", F.when(F.col("side") == -1, 0).otherwise(1)).withColumn("found", F.last("last", ignorenulls=True).over(inside)).filter("side = 1")
    without = every.filter("k IS NULL OR t IS NULL").select("row.*", F.lit(None).cast(r.schema["last"].dataType["value"].dataType).alias("found"))
    return filled.select("row.*", F.col("found.value").alias("found")).unionByName(without)


def left_row(left: DataFrame) -> str:
    return left.schema.simpleString()


def overlaps(a: DataFrame, b: DataFrame, key: str, start: str, end: str, least_width: int = 1) -> DataFrame:
    """Pairs (struct a, struct b) of one key whose spans [start, end) share a moment; spans that are empty or have a null meet nothing.

    Times are whole numbers; ``least_width`` is the narrowest bucket.
    """

    def placed(df: DataFrame, name: str) -> DataFrame:
        ok = df.filter(F.col(key).isNotNull() & (F.col(start) < F.col(end)))
        units = F.floor((F.col(end) - F.col(start) - 1) / least_width).cast("long")
        return ok.select(F.col(key).alias("k"), F.col(start).cast("long").alias(f"{name}_start"), F.col(end).cast("long").alias(f"{name}_end"), F.when(units > 0, F.length(F.bin(units))).otherwise(0).alias(f"{name}_level"), F.struct(*df.columns).alias(name))

    def dealt(rows: DataFrame, name: str, other: list[int], own: list[str], wider: str) -> DataFrame:
        """A row for each bucket and role: at its own width a span has the roles ``own``, at wider ones that the other side has the role ``wider``."""
        level = F.col(f"{name}_level")
        above = F.filter(F.array(*map(F.lit, other)).cast("array<int>"), lambda x: x > level)
        at = lambda x, role: F.struct(x.cast("int").alias("level"), role.alias("role"))
        places = F.concat(F.array(*(at(level, F.lit(r)) for r in own)), F.transform(above, lambda x: at(x, F.lit(wider))))
        rows = rows.withColumn("p", F.explode(places)).select("*", "p.*").drop("p")
        width = F.lit(least_width).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
        buckets = F.sequence(F.floor(F.col(f"{name}_start") / width).cast("long"), F.floor((F.col(f"{name}_end") - 1) / width).cast("long"))
        return rows.withColumn("width", width).withColumn("bucket", F.explode(buckets))

    x, y = placed(a, "a"), placed(b, "b")
    used = lambda df, name: sorted(r[0] for r in df.select(f"{name}_level").distinct().collect())  # noqa: E731  at most 63 widths
    # The wider span sets the width: a's own with all of b that are no wider, and b's own with those of a that are narrower.
    left, right = dealt(x, "a", used(y, "b"), ["a"], "b"), dealt(y, "b", used(x, "a"), ["a", "b"], "a").drop("width")
    later = F.greatest("a_start", "b_start")
    return left.join(right, ["k", "level", "role", "bucket"]).filter((later < F.least("a_end", "b_end")) & (F.floor(later / F.col("width")) == F.col("bucket"))).select("a", "b")
