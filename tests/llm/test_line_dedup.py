from collections import defaultdict

import numpy as np
import pytest

from lamina.llm import line_dedup
from lamina.llm.line_dedup import CuckooFilter, LineIndex, line_key

WHITE = " \t\n\x0b\x0c\r"


def brute(rows):
    order = lambda d: (d is None, d or 0)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda x: x.strip(WHITE).translate(lower)
    docs = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                docs[key(x)].add(order(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(docs[key(x)]) < 2 or min(docs[key(x)]) == order(d)]
        out.append((repr(d), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def result(index, docs):
    return sorted((repr(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in index.dedup(docs).collect())


def tables(index):
    return [sorted(map(tuple, df.collect()), key=repr) for df in (index.refs, index.counts)]


def members(index, which):
    return sum(int(np.count_nonzero(x)) for r in index.filters.collect() for x in CuckooFilter.load(r[which]).layers)


def test_edge_rows(spark, edge, edge_rows, empty):
    index = LineIndex.empty(spark).insert(edge)
    assert result(index, edge) == brute([(d, t) for d, t, *_ in edge_rows])
    nothing = LineIndex.empty(spark).insert(empty)
    assert result(nothing, empty) == [] and tables(nothing.insert(edge)) == tables(index)


def test_the_largest_id_and_null_ids_stay_apart(spark):
    rows = [(2**63 - 1, "a line of their own\nanother line here"), (None, "a line of their own"), (None, "another line here\nonly for those without id"), (None, "only for those without id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(LineIndex.empty(spark).insert(docs), docs) == brute(rows)


@pytest.mark.parametrize("shard_keys", [20, 250_000])
def test_insertions_and_deletions_are_reversible(spark, monkeypatch, shard_keys):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard_keys)
    line = lambda k: f"a line of number {k}"
    rows = [(d, "\n".join(line(k) for k in range(d % 5, d % 5 + 4)) + f"\nshort\n{d} only here, really") for d in range(60)] + [(None, line(3)), (None, "without an id, both\n" + line(90))]
    df = lambda x: spark.createDataFrame(x, "doc_id bigint, text string")
    first = LineIndex.empty(spark).insert(df(rows[:25]))
    both = first.insert(df(rows[25:]))
    assert result(both, df(rows)) == brute(rows)
    assert tables(both) == tables(LineIndex.empty(spark).insert(df(rows)))
    gone = [0, 1, 2, 30, 31, None]
    left = [r for r in rows if r[0] not in gone]
    less = both.delete(df([(g, None) for g in gone]))
    assert result(less, df(left)) == brute(left) and tables(less) == tables(LineIndex.empty(spark).insert(df(left)))
    back = both.delete(df([(r[0], None) for r in rows[25:]]))
    assert result(back, df(rows[:25])) == result(first, df(rows[:25])) and tables(back) == tables(first)
    for which, least in (("known", 1), ("repeated", 2)):
        for index in (first, both, less, back):
            assert members(index, which) == index.counts.filter(f"n >= {least}").count()


def test_filters_gate_insertion(spark):
    """Keys that the filter doesn't know never reach the exact counts."""
    df = lambda x: spark.createDataFrame(x, "doc_id bigint, text string")
    first = LineIndex.empty(spark).insert(df([(1, "\n".join(f"known line {k}" for k in range(500)))]))
    came = line_dedup.counted(line_dedup.references(df([(2, "\n".join(f"known line {k}\nnew line of {k}" for k in range(500)))]), "doc_id", "text", 10))
    held = first._probed(came, "known").filter("held").count()
    assert 500 <= held < 520


def test_hot_shards_and_hot_lines_are_split(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PART_ROWS", 20)
    monkeypatch.setattr(line_dedup, "HOT", 50)
    rows = [(d, "one very common line\n" + f"line number {d // 2} of two") for d in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(LineIndex.empty(spark).insert(docs), docs) == brute(rows)
    monkeypatch.setattr(line_dedup, "NARROW", 0)
    assert result(LineIndex.empty(spark).insert(docs), docs) == brute(rows)


def test_cuckoo_filter():
    r = np.random.default_rng(1)
    hi, lo = r.integers(-(1 << 62), 1 << 62, (2, 5000))
    f = CuckooFilter()
    for k in range(0, 5000, 700):
        f.insert(hi[k : k + 700], lo[k : k + 700])
    f = CuckooFilter.load(f.dump())
    assert f.contains(hi, lo).all()
    assert f.contains(*r.integers(-(1 << 62), 1 << 62, (2, 5000))).mean() < 0.01
    f.delete(hi[:2500], lo[:2500])
    assert f.contains(hi[2500:], lo[2500:]).all() and f.contains(hi[:2500], lo[:2500]).mean() < 0.01


def test_line_key():
    assert line_key(b"  ABCDEFGHIJ\r") == b"abcdefghij"
    assert line_key("éééééééééé".encode()) and line_key("ééééééééé".encode()) is None and line_key(b"123456789") is None
