"""Exact top-k search for binary codes by incremental multi-index hashing.

A code of 64 bits is cut into four segments of 16. The index holds a row (segment, value, code) for each
distinct code. Round r probes, for every query still open, all segment values at exactly r differing bits.
After it every code within 4 * (r + 1) - 1 bits has been met: one of its segments differs in at most r.
A query closes when its k-th verified distance is within that, or when it has met all rows.

A code carries its k + 1 smallest ids only: more can't be among k results, so copies of one code cost nothing.
Defined results: equal distances are ordered by id; a query doesn't return its own id; a null array or null id
is neither indexed nor asked; missing elements count as not positive; repeated (id, code) rows count once;
fewer than k others give fewer rows; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import dropped, written

SEGMENTS, SEGMENT_BITS = 4, 16


def sign_code(vector: Column, dims: int = 64) -> Column:
    """Bit i is set if element i is positive."""
    bits = [F.when(F.get(vector, F.lit(i)) > 0, F.lit((1 << i) - (1 << 64) * (i == 63))).otherwise(F.lit(0)) for i in range(dims)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return F.when(vector.isNotNull(), out.cast("long"))


def segment(code: Column, k: int) -> Column:
    return F.shiftrightunsigned(code, SEGMENT_BITS * k).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)).cast("int")


def nearest(df: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy("distance", "id")
    return df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, distance, rank (from 1) of the ``k`` nearest rows for each query; both tables have id and code."""
    known = rows.filter("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct()
    first = Window.partitionBy("code").orderBy("id")
    codes = written(known.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1).groupBy("code").agg(F.collect_list("id").alias("ids")), "codes")
    n_rows = codes.agg(F.sum(F.size("ids"))).first()[0] or 0
    parts = F.array(*(F.struct(F.lit(s).alias("segment"), segment(F.col("code"), s).alias("value")) for s in range(SEGMENTS)))
    index = written(codes.select("code", F.inline(parts)), "segment-index")
    asked = queries.filter("id IS NOT NULL AND code IS NOT NULL").select(F.col("id").alias("query_id"), "code").distinct()
    id_kind = asked.schema["query_id"].dataType.simpleString()
    # A row for each query code: its k + 1 nearest so far, and whether they are proven. Each round writes it once.
    none = F.array().cast(f"array<struct<distance: int, id: {id_kind}>>")
    state = written(asked.select(F.col("code").alias("query")).distinct().select("query", none.alias("near"), F.lit(False).alias("closed")), "nearest")
    for radius in range(SEGMENT_BITS + 1):
        opened, last = state.filter("NOT closed"), state
        masks = [sum(1 << b for b in c) for c in combinations(range(SEGMENT_BITS), radius)]
        mask = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<int>")
        each = F.array(*(F.struct(F.lit(s).alias("segment"), segment(F.col("query"), s).alias("own")) for s in range(SEGMENTS)))
        probes = opened.select("query", F.inline(each)).select("query", "segment", "own", F.explode(mask).alias("mask")).select("query", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        # Probes outgrow the size that the optimizer expects of them: they are never broadcast.
        met = probes.join(index.hint("merge"), ["segment", "value"]).select("query", "code").distinct()
        met = met.withColumn("distance", F.bit_count(F.col("query").bitwiseXOR(F.col("code"))))
        # A few of the nearest codes hold the nearest ids; ids are attached only to those.
        by_code = Window.partitionBy("query").orderBy("distance")
        met = met.withColumn("d", F.rank().over(by_code)).filter(F.col("d") <= k + 1).join(codes, "code").select("query", F.explode("ids").alias("id"), "distance")
        found = nearest(met.unionByName(opened.select("query", F.inline("near"))).distinct(), k + 1)
        lists = found.groupBy(F.col("query").alias("of")).agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("now"))  # at most k + 1
        near = F.coalesce("now", "near")
        covered = SEGMENTS * (radius + 1) - 1
        proven = ((F.size(near) > k) & (F.try_element_at(near, F.lit(-1))["distance"] <= covered)) | (F.size(near) >= n_rows)
        state = state.join(lists, state["query"] == lists["of"], "left").select("query", near.alias("near"), (F.col("closed") | F.coalesce(proven, F.lit(False))).alias("closed"))
        state = written(state, "nearest")
        dropped(last)
        if state.filter("NOT closed").isEmpty():
            break
    # The lists are one row a code: many ids that ask with one code share it, and are dealt anew where they are many.
    rows = asked.join(state.select("query", "near"), asked["code"] == F.col("query"))
    others = rows.select("query_id", F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k).alias("near"))
    return others.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", "x.id", "x.distance", (F.col("rank") + 1).alias("rank"))
