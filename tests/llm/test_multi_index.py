import random

from pyspark.sql import functions as F

from lamina.llm import multi_index


def brute(rows, queries, k):
    out = []
    known = {(i, c) for i, c in rows if i is not None and c is not None}
    for q, c in {(i, c) for i, c in queries if i is not None and c is not None}:
        near = sorted((((c ^ d) & (1 << 64) - 1).bit_count(), i) for i, d in known if i != q)[:k]
        out += [(q, i, d, r) for r, (d, i) in enumerate(near, 1)]
    return sorted(out)


def test_by_brute_force(spark):
    r = random.Random(11)
    code = lambda: r.getrandbits(64) - (1 << 63)
    hot = code()
    rows = [(k, code()) for k in range(250)] + [(k, hot) for k in range(250, 400)] + [(k, hot ^ (1 << r.randrange(63))) for k in range(400, 430)]
    rows += [(None, hot), (900, None), rows[5]]
    queries = [x for x in rows if x[0] is not None and x[0] % 50 == 0]
    df = lambda x: spark.createDataFrame(x, "id bigint, code bigint")
    got = multi_index.search(df(rows), df(queries), 4).collect()
    assert sorted((x.query_id, x.id, x.distance, x.rank) for x in got) == brute(rows, queries, 4)


def test_few_rows_and_empty(spark):
    df = lambda x: spark.createDataFrame(x, "id bigint, code bigint")
    rows = [(1, 0), (2, -1), (3, 7)]
    got = multi_index.search(df(rows), df(rows), 10).collect()
    assert sorted((x.query_id, x.id, x.distance, x.rank) for x in got) == brute(rows, rows, 10)
    assert multi_index.search(df([]), df([]), 3).count() == 0
    assert multi_index.search(df([]), df(rows), 3).count() == 0


def test_sign_code(spark):
    rows = [([1.0] * 64,), ([-1.0] * 63 + [2.0],), ([0.5, -0.5],), (None,), ([None, 1.0] + [0.0] * 62,)]
    got = [x[0] for x in spark.createDataFrame(rows, "v array<float>").select(multi_index.sign_code(F.col("v"))).collect()]
    assert got == [-1, -(1 << 63), 1, None, 2]
