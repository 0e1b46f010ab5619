import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import ctw
from lamina.llm.storage import written


def test_base_and_counts_by_brute_force(edge, edge_rows, empty):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    words = lambda t: (t or "").encode().lower().split()
    c = Counter(w for d, t, *_ in edge_rows if not held(d) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    want = sorted((d is None, d or 0, held(d), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), None]), 6)) for d, t, *_ in edge_rows)
    for hot in (3, 1000):  # most words by the join, or none
        got = ctw.score(edge, ctw.training_remainder("doc_id", 10) != 0, hot_words=hot).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert ctw.score(empty, ctw.training_remainder("doc_id", 10) != 0).count() == 0


def table_of(spark, texts):
    """log10 probability by run, of a model of ``texts``; the second of each pair says whether it teaches."""
    docs = spark.createDataFrame([(t.decode("latin-1"), y) for t, y in texts], "text string, learns boolean")
    return {r.run: r.log_p for r in ctw.run_scores(written(ctw.subtrees(ctw.run_counts(docs, "text", F.col("learns"))), "trees")).collect()}


def by_recursion(runs, run):
    """log10 probability of the run's byte: the ratio of the root's weighted probabilities with and without one more bit.

    ``runs``: training count by run. The whole tree over all contexts, without any of the module's code.
    """
    raw, want = run.to_bytes(ctw.DEPTH + 1, "big"), 0.0

    def log_pw(counts, context, depth):
        a, b = counts.get(context, (0, 0))
        kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if depth == ctw.DEPTH:
            return kt
        below = sum(log_pw(counts, c, depth + 1) for c in counts if len(c) == depth + 1 and c.endswith(context))
        return np.logaddexp(kt, below) - math.log(2)

    for level in range(8):
        prefix, bit, counts = raw[-1] >> (8 - level), raw[-1] >> (7 - level) & 1, {}
        for r, k in runs.items():
            other = r.to_bytes(ctw.DEPTH + 1, "big")
            if k and other[-1] >> (8 - level) == prefix:
                for d in range(ctw.DEPTH + 1):
                    counts.setdefault(other[ctw.DEPTH - d : ctw.DEPTH], [0, 0])[other[-1] >> (7 - level) & 1] += k
        before = log_pw(counts, b"", 0)
        for d in range(ctw.DEPTH + 1):
            counts.setdefault(raw[ctw.DEPTH - d : ctw.DEPTH], [0, 0])[bit] += 1
        want += (log_pw(counts, b"", 0) - before) / math.log(10)
    return want


def training_runs(texts):
    return Counter(x for r, _ in ctw.pieces(texts) for x in r.tolist())


@pytest.mark.parametrize("together", [1 << 18, 5])
def test_table_by_the_recursion(spark, monkeypatch, together):
    monkeypatch.setattr(ctw, "TOGETHER", together)
    text, other = b"abracadabra abracadabra cadabra bar", b"abrac zebra"
    got = table_of(spark, [(text, True), (other, False)])
    known, all_runs = training_runs([text]), training_runs([text, other])
    assert set(got) == set(all_runs)
    for run in list(all_runs)[::7] + [r for r in all_runs if r not in known]:
        assert got[run] == pytest.approx(by_recursion(known, run), abs=1e-6)


def test_scores_end_to_end_by_the_recursion(spark):
    """With all runs broadcast, some and (nearly) none the score is that of the plain recursion."""
    texts = ["the cat sat", "the cat ran", None, "", "a Cat", "the dog sat", "zzz", "the cat sat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    teaches = [k % 3 != 0 for k in range(len(texts))]
    low = [(t or "").encode().lower() for t in texts]
    known = training_runs([t for t, y in zip(low, teaches) if y])
    cost = {r: by_recursion(known, r) for r in training_runs(low)}
    want = [sum(cost[r] * n for r, n in training_runs([t]).items()) for t in low]
    for hot in (1 << 20, 20, 1):
        got = {r.doc_id: r.score for r in ctw.score(docs, F.col("doc_id") % 3 != 0, hot_runs=hot, hot_words=2).collect()}
        assert [got[k] for k in range(len(texts))] == pytest.approx(want, abs=1e-6)


def test_probabilities_of_all_bytes_add_up_to_one(spark):
    taught = [(b"the cat sat on the mat", True), (b"the dog sat", True)]
    asked = [(context + bytes([b]), False) for context in (b"the c", b"at on", b"zzzzz") for b in range(1, 128) if not 65 <= b <= 90]
    got = table_of(spark, taught + asked)
    known = training_runs([t for t, _ in taught])
    for context in (b"the c", b"at on", b"zzzzz"):
        seen = {b: got[int.from_bytes(context + bytes([b]), "big")] for b in range(1, 128) if not 65 <= b <= 90}
        rest = sum(10 ** by_recursion(known, int.from_bytes(context + bytes([b]), "big")) for b in range(256) if b not in seen)
        assert sum(10**x for x in seen.values()) + rest == pytest.approx(1, abs=1e-6)


def test_steps_change_nothing(monkeypatch):
    texts = [b"", b"ab", b"abcdefgh" * 40, b"x" * 31]
    whole = [np.concatenate(x) for x in zip(*ctw.pieces(texts))]
    monkeypatch.setattr(ctw, "STEP", 16)
    for a, b in zip(whole, [np.concatenate(x) for x in zip(*ctw.pieces(texts))]):
        assert a.tolist() == b.tolist()
    assert np.bincount(whole[1]).tolist() == [len(t) + 1 for t in texts]


def test_training_lowers_code_length_on_held_out_text(spark):
    import random

    r = random.Random(5)
    vocabulary = ["".join(r.choice(["an", "bel", "cor", "dun"]) for _ in range(r.randint(2, 4))) for _ in range(400)]
    docs = spark.createDataFrame([(k, " ".join(r.choice(vocabulary) for _ in range(120))) for k in range(400)], "doc_id int, text string")
    got = [x for x in ctw.score(docs, ctw.training_remainder("doc_id", 10) != 0).collect() if x.held_out]
    assert -sum(x.score for x in got) * math.log2(10) / sum(x.n_bytes for x in got) < 2
