import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lamina.llm import mixing
from lamina.llm.mixing import mix


def targets(sizes, pattern=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: pattern[k % len(pattern)] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def test_targets_and_taken(edge, edge_rows, empty):
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, _, s, *_ in edge_rows:
        sizes[s] += n(t)
    want = targets(dict(sizes))
    clashing = edge.withColumns({"target": F.lit("t"), "taken": F.lit("k")})
    got = mix(clashing, keep=("source", "size", "target", "taken")).collect()
    assert got[0].__fields__ == ["source", "doc_id", "size", "source_size", "target", "taken", "copies"]
    assert len(got) == len(edge_rows) and mix(empty).count() == 0
    taken = defaultdict(int)
    for r in got:
        assert r.taken <= 2 * r.size
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(n(t) for _, t, _, x, *_ in edge_rows if x == s)


def test_epochs_come_first_and_reruns_agree(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    one, two = (sorted(map(tuple, mix(docs.repartition(k)).collect())) for k in (3, 8))
    assert one == two
    for _, size, source_size, target, taken, copies in one:
        assert copies in (target // source_size, target // source_size + 1) and taken == copies * size


def test_quality_raises_the_share(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("only").alias("source"), F.lit("a b c").alias("text"), (F.col("id") % 2).alias("good"))
    got = mix(docs, F.when(F.col("good") == 1, 3.0).otherwise(1.0), keep=("good",), share=0.5).groupBy("good").agg(F.sum("copies").alias("n")).collect()
    n = {r.good: r.n for r in got}
    assert n[1] > 1.7 * n[0] and n[0] + n[1] == 10_000


def test_all_empty(spark):
    got = mix(spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id int, text string, source string")).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_buckets_are_even_for_any_weights(spark):
    """Weights of 0.01 to 100, and one that most have, leave no bucket above ten times its size."""
    u = (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) + 0.5) / (1 << 40)
    for weight in (F.lit(0.01), F.pow(F.lit(10.0), F.pmod("id", F.lit(5)) - 2), F.when(F.col("id") % 3 == 0, 0.05).otherwise(100.0)):
        rows = spark.range(200_000).select(F.lit("only").alias("source"), (F.log2(-F.log(u) / weight) * mixing.BINS).alias("place")).withColumn("bin", F.floor("place"))
        sizes = [r["count"] for r in mixing.bucketed(rows).groupBy("bucket").count().collect()]
        assert sum(sizes) == 200_000 and max(sizes) < 2 * mixing.BUCKET_ROWS
