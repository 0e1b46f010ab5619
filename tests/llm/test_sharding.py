import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lamina.llm import sharding


def test_edge_rows(edge, edge_rows, empty):
    got = sharding.shard(edge, 3, keep=("text",)).collect()
    assert len(got) == len(edge_rows) and sharding.shard(empty, 3).count() == 0
    shards, slots = defaultdict(set), defaultdict(list)
    for r in got:
        b = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 16, zlib.crc32(b), "bytes", None)
        shards[r.text].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def brute(sizes, shards):
    """Loads and the groups by (size, shard), one group after another."""
    loads, got = [0] * shards, Counter()
    for x in sorted(sizes, reverse=True):
        k = min(range(shards), key=lambda s: (loads[s], s))
        loads[k] += x
        got[x, k] += 1
    return loads, got


def test_longest_first_is_the_plain_loop():
    r = random.Random(3)
    for shards in (1, 2, 7, 40):
        for _ in range(25):
            sizes = [r.choice((17, 18, 20, r.randrange(16, 4000), r.randrange(16, 40))) for _ in range(r.choice((0, 1, 30, 900)))]
            counts = Counter(sizes)
            ranges = sharding.longest_first(list(counts), list(counts.values()), shards)
            got, rows = Counter(), list(zip(*ranges))
            for k, (size, shard, first) in enumerate(rows):
                follows = rows[k + 1][2] if k + 1 < len(rows) and rows[k + 1][0] == size else counts[size]
                got[size, shard] += follows - first
            assert got == brute(sizes, shards)[1]


def test_sizes_are_near_equal_and_equal_texts_stay_together(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLICE_ROWS", 50)
    monkeypatch.setattr(sharding, "RANGES", 10)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("t"), (F.col("id") % 4000).cast("string")), (F.col("id") % 4000 % 37 + 1).cast("int")).alias("text"))
    rows = sharding.shard(docs, 8).cache()
    texts = Counter(r.text for r in docs.collect())
    want, _ = brute([n * (len(t) + 16) for t, n in texts.items()], 8)
    assert sorted(r.n for r in rows.groupBy("shard").agg(F.sum("size").alias("n")).collect()) == sorted(want)
    assert rows.groupBy("text_crc32").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0
    assert rows.groupBy("shard").agg((F.max("slot") + 1 - F.count("*")).alias("x"), F.countDistinct("slot").alias("d"), F.count("*").alias("n")).filter("x <> 0 OR d <> n").count() == 0


def test_names_of_the_result_win_over_kept_ones(edge):
    got = sharding.shard(edge, 3, keep=("size", "shard", "lang"))
    assert len(set(got.columns)) == len(got.columns) and dict(got.dtypes)["size"] == "bigint" and "lang" in got.columns
