"""Sharding by longest processing time: equal texts stay together and shard sizes come out nearly equal.

Groups (equal texts) are totalled in Spark. Every group, largest first, goes to the least-loaded shard (ties: the lowest),
which a heap on the driver decides. Groups of equal size are alike to it, so it is given each size with the number
of its groups: d different sizes add up to at least d * (d + 1) / 2 bytes, so there are at most sqrt(2 * bytes) of them,
whatever the number of groups. A size with many groups is dealt at once: of the loads that the shards would show
if each got one group after another, the lowest are taken, which is what the heap would do. Groups are numbered
within their size, and the numbers dealt to a shard are a range.

Slots number a shard's rows from 0 without gaps: rows are dealt to slices by a hash of the id, counted
per slice, and numbered inside a slice, so neither a shard nor a hot group has to fit one task.
Defined results: a null text is a group of its own with size 16 and CRC 0; null ids and repeated rows get
slots like any other row; an empty table gives no rows; extra columns pass through ``keep``, under any names but the results'.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: Bytes that each row adds to its text's, rows of a slice (about), and ranges of groups that are broadcast.
ROW_BYTES, SLICE_ROWS, RANGES = 16, 2_000, 1 << 20
#: Groups of one size for each shard up to which they are dealt one by one.
FEW = 4


def dealt_at_once(loads: np.ndarray, size: int, n: int) -> np.ndarray:
    """How many of ``n`` groups of one size each shard gets: the ``n`` lowest of the loads that they would meet."""
    met = lambda level: np.maximum(0, -((loads - level) // size))  # noqa: E731  loads under ``level`` that each shard would show
    low, high = int(loads.min()), int(loads.max()) + size * (n // len(loads) + 2)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if met(middle).sum() <= n else (low, middle)
    counts = met(low)
    ties = np.flatnonzero(loads + counts * size == low)[: n - int(counts.sum())]
    counts[ties] += 1
    return counts


def longest_first(sizes: list[int], counts: list[int], shards: int) -> tuple[list[int], list[int], list[int]]:
    """(size, shard, first): of ``counts`` groups of each of ``sizes``, a shard gets those numbered from ``first`` to the next range's."""
    heap = [(0, k) for k in range(shards)]
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    for size, n in sorted(zip(sizes, counts), reverse=True):
        if n <= FEW * shards:
            got: dict[int, int] = {}
            for _ in range(n):
                load, k = heap[0]
                heapq.heapreplace(heap, (load + size, k))
                got[k] = got.get(k, 0) + 1
        else:
            loads = np.array([load for load, _ in sorted(heap, key=lambda x: x[1])])
            each = dealt_at_once(loads, size, n)
            heap = list(zip((loads + each * size).tolist(), range(shards)))
            heapq.heapify(heap)
            got = {k: x for k, x in enumerate(each.tolist()) if x}
        first = 0
        for k, x in sorted(got.items()):
            for column, value in zip(out, (size, k, first)):
                column.append(value)
            first += x
    return out


def numbered(rows: DataFrame, part: str, slices: Column, *order: str) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, ... without gaps in each value of ``part``."""
    rows = rows.withColumn("slice", slices)
    counts = rows.groupBy(part, "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy(part).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(part).alias("p"), F.col("slice").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = rows.join(offsets, (F.col(part) == F.col("p")) & (F.col("slice") == F.col("s")))
    inside = Window.partitionBy(part, "slice").orderBy(*order)
    return rows.withColumn("slot", (F.col("offset") + F.row_number().over(inside) - 1).cast("long")).drop("p", "s", "slice", "offset")


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law) and ``keep`` for every row."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        *(F.col(c).alias(f"keep_{c}") for c in keep), F.col(id_col).alias("doc_id"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.coalesce(F.unhex(F.md5(F.col(text_col).cast("binary"))), F.lit(b"null")).alias("same"),
    )
    groups = written(rows.groupBy("same").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    n_groups, n_rows = (x or 0 for x in groups.agg(F.count("*"), F.sum("n")).first())
    classes = groups.groupBy("bytes").agg(F.count("*").alias("groups")).toArrow()  # at most sqrt(2 * bytes) rows
    ranges = longest_first(classes["bytes"].to_pylist(), classes["groups"].to_pylist(), shards)
    given = spark.createDataFrame(pa.table([pa.array(x, pa.int64()) for x in ranges], names=["of_size", "shard", "first"]))
    given = written(given.groupBy("of_size").agg(F.array_sort(F.collect_list(F.struct("first", "shard"))).alias("ranges")), "shard-ranges")  # at most one for each shard
    slices = F.pmod(F.xxhash64("same"), F.lit(max(1, n_groups // SLICE_ROWS)))
    placed = numbered(groups.select("same", "bytes"), "bytes", slices, "same")
    placed = placed.join(F.broadcast(given) if len(ranges[0]) <= RANGES else given, placed["bytes"] == given["of_size"])
    shard_of = F.expr("int(element_at(filter(ranges, r -> r.first <= slot), -1).shard)")
    placed = written(placed.select(F.col("same").alias("placed"), shard_of.alias("shard")), "shard-placed")
    rows = rows.join(placed, rows["same"] == placed["placed"]).drop("same", "placed")
    slices = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(max(1, n_rows // shards // SLICE_ROWS)))
    rows = numbered(rows, "shard", slices, "doc_id", "text_crc32", "size")
    taken = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    return rows.select(*(F.col(f"keep_{c}").alias(c) for c in keep if c not in taken), "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
