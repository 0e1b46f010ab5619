import random
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from lamina.llm import simhash
from lamina.llm.components import connected_components


def plain_fingerprint(text, words=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + words]), 42) for k in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    root = {x: x for x in nodes}
    top = lambda x: x if root[x] == x else top(root[x])
    for a, b in linked:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return {x: top(x) for x in nodes}


def test_edge_rows(edge, edge_rows, empty):
    texts = [t for _, t, *_ in edge_rows if len(t or "") < 50_000] + [t for _, t, *_ in edge_rows if len(t or "") >= 50_000]
    fps = {t: plain_fingerprint(t) for t in texts}
    root = components(set(fps.values()), [(a, b) for a, b in combinations(set(fps.values()), 2) if (a ^ b).bit_count() <= 2])
    least = {}
    for d, t, *_ in edge_rows:
        if d is not None:
            least[root[fps[t]]] = min(d, least.get(root[fps[t]], d))
    want = sorted((repr(d), f"{fps[t]:016x}", least.get(root[fps[t]])) for d, t, *_ in edge_rows)
    got = simhash.near_duplicates(edge)
    assert sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in got.collect()) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("long", "bits"), [(2048, 2), (8, 2), (8, 1), (8, 3)])
def test_links_lose_none(spark, monkeypatch, long, bits):
    """All links of the brute force and no others connect, by tallied lists and by split ones."""
    monkeypatch.setattr(simhash, "LONG", long)
    r = random.Random(7)
    fps = set()
    for _ in range(40):  # families of close fingerprints, long chains among them
        x = r.getrandbits(64)
        for _ in range(40):
            fps.add(x)
            x ^= sum(1 << b for b in r.sample(range(64), r.choice((1, 2, 2, 3))))
    x = r.getrandbits(64)
    fps |= {x ^ (1 << a) ^ (1 << b) for a, b in combinations(range(16), 2)}  # one full posting list
    fps = [simhash.signed(x) for x in fps]
    mask = (1 << 64) - 1
    want = components(fps, [(a, b) for a, b in combinations(fps, 2) if ((a ^ b) & mask).bit_count() <= bits])
    found = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp bigint"), bits).collect()
    assert all(p.a != p.b and want[p.a] == want[p.b] for p in found)
    assert components(fps, [(p.a, p.b) for p in found]) == want


def test_connected_components_of_chains_and_stars(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(-5, -9), (7, 7)] + [(r.randrange(5000, 5200), r.randrange(5000, 5200)) for _ in range(150)]
    want = components({x for e in edges for x in e}, edges)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got.get(x, x) == want[x] for x in want)


def test_fingerprint_in_steps(monkeypatch):
    text = " ".join(map(str, range(5000)))
    monkeypatch.setattr(simhash, "TALLY", 100)
    assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == plain_fingerprint(text)


def test_tally_of_shared_bytes(spark):
    r = random.Random(2)
    rows = [(simhash.signed(x), simhash.signed(x ^ r.getrandbits(64) & r.getrandbits(64) & r.getrandbits(64))) for x in (r.getrandbits(64) for _ in range(200))]
    got = spark.createDataFrame(rows, "a bigint, b bigint").select("a", "b", simhash.shared_bytes(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(x.n == sum((x.a >> 8 * p) & 255 == (x.b >> 8 * p) & 255 for p in range(8)) for x in got)
