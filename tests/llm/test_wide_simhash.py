import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from lamina.llm import wide_simhash

from .test_simhash import components


def edited(words, share, r):
    return [r.choice(("alpha", "beta", "gamma")) + str(r.randrange(10**6)) if r.random() < share else w for w in words]


def families(seed, n, copies):
    """Unrelated texts, each with lightly edited copies."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randrange(150, 400))]
        out += [" ".join(base)] + [" ".join(edited(base, 0.015, r)) for _ in range(copies)]
    return out


def jaccard(a, b, words=5):
    a, b = ({" ".join(t.split()[k : k + words]) for k in range(max(1, len(t.split()) - words + 1))} for t in (a, b))
    return len(a & b) / len(a | b)


def groups_of(rows):
    return {r.doc_id: r.component_id for r in rows}


def fingerprint(text):
    return wide_simhash.wide_fingerprint(wide_simhash.shingle_set(pa.scalar(text), 5))


@pytest.mark.parametrize("block", [4096, 5])
def test_clusters_of_all_candidates_in_lists(spark, monkeypatch, block):
    monkeypatch.setattr(wide_simhash, "BLOCK", block)
    texts = families(1, 12, 6) + families(2, 1, 60)
    fps = {k: fingerprint(t).tobytes() for k, t in enumerate(texts)}
    whole = {k: int.from_bytes(f, "little") for k, f in fps.items()}
    shared = lambda a, b: any(fps[a][p] == fps[b][p] and fps[a][(p + lag) % 32] == fps[b][(p + lag) % 32] for p in range(32) for lag in wide_simhash.LAGS)
    linked = [(a, b) for a, b in combinations(fps, 2) if (whole[a] ^ whole[b]).bit_count() <= wide_simhash.MAX_BITS and shared(a, b)]
    rows = spark.createDataFrame([(k, *np.frombuffer(f, np.int64).tolist()) for k, f in fps.items()], "node bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint")
    got = {r.node: r.root for r in wide_simhash.candidate_clusters(rows).collect()}
    want = components(fps, linked)
    assert {k: got.get(k, k) for k in fps} == want


@pytest.mark.parametrize(("members", "columns"), [(256, 4096), (4, 64)])
def test_verified_links_by_brute_force(spark, monkeypatch, members, columns):
    """Inside a cluster all pairs that are alike are linked and no others, in one block or many."""
    monkeypatch.setattr(wide_simhash, "MEMBERS", members)
    monkeypatch.setattr(wide_simhash, "COLUMNS", columns)
    texts = families(8, 3, 14) + [" ".join(edited(families(8, 1, 0)[0].split(), 0.03, random.Random(k))) for k in range(20)]
    blocks = -(-len(texts) // members)
    docs = spark.createDataFrame([(1, blocks, k, t) for k, t in enumerate(texts)] * 2, "cluster bigint, blocks bigint, node bigint, text string")
    found = [(r.a, r.b) for r in wide_simhash.verified_links(wide_simhash.shingle_sets(docs, 5), 0.8).collect()]
    close = [(a, b) for a, b in combinations(range(len(texts)), 2) if jaccard(texts[a], texts[b]) >= 0.8]
    assert components(range(len(texts)), found) == components(range(len(texts)), close) and close


def test_near_copies_are_found_and_unrelated_texts_left(spark):
    texts = families(5, 60, 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = groups_of(wide_simhash.near_duplicates(docs).collect())
    close = [(a, b) for a, b in combinations(range(len(texts)), 2) if a // 3 == b // 3 and jaccard(texts[a], texts[b]) >= 0.8]
    assert len(close) > 40 and sum(got[a] == got[b] for a, b in close) >= 0.95 * len(close)
    assert all(got[k] // 3 == k // 3 for k in got)


def test_edge_rows(spark, edge, edge_rows, empty):
    got = wide_simhash.near_duplicates(edge).collect()
    assert len(got) == len(edge_rows) and wide_simhash.near_duplicates(empty).count() == 0
    blank = {d for d, t, *_ in edge_rows if not (t or "").split()}
    assert len({r.component for r in got if r.doc_id in blank and r.doc_id is not None}) <= 1


def test_short_texts_stay_apart(spark):
    texts = ["", "one two three", "one two four", "a b c d e f", "a b c d e g", "h i j k l m n", "o p q r s t u v"]
    got = groups_of(wide_simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect())
    assert len(set(got.values())) == len(texts)


def test_recall_of_isolated_near_copies_at_the_similarity(spark):
    """Pairs just at 0.8, each alone among unrelated texts: the least favourable case."""
    r, texts = random.Random(11), []
    while len(texts) < 300:
        base = [f"w{r.randrange(3000)}" for _ in range(300)]
        pair = [" ".join(base), " ".join(edited(base, 0.021, r))]
        if 0.8 <= jaccard(*pair) < 0.84:
            texts += pair
    got = groups_of(wide_simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect())
    assert sum(got[k] == got[k + 1] for k in range(0, len(texts), 2)) >= 0.96 * len(texts) / 2


def test_pipeline_keeps_texts_below_the_similarity_and_drops_those_above(spark):
    import corpus_pipeline

    r, texts = random.Random(12), []
    for _ in range(80):
        base = [f"w{r.randrange(3000)}" for _ in range(200)]
        texts += [" ".join(base), " ".join(edited(base, r.choice((0.015, 0.03, 0.045)), r))]
    docs = spark.createDataFrame([*enumerate(texts), (len(texts), texts[0]), (3, texts[3])], "doc_id bigint, text string")
    alike = {k: jaccard(texts[k], texts[k + 1]) for k in range(0, len(texts), 2)}
    assert sum(0.6 <= j < 0.8 for j in alike.values()) > 15 and sum(j >= 0.8 for j in alike.values()) > 15
    kept = sorted(x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert kept == sorted([*alike, *(k + 1 for k, j in alike.items() if j < 0.8)])
