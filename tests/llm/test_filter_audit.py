import itertools
import re

import pytest
from pyspark.sql import functions as F

from lamina.llm.filter_audit import audit, failures

LABELS = "doc_id bigint, quality int, toxic int, part string"


def failed(rows):
    out = []
    for doc_id, text, lang, *_ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x, *_ in rows)
        out.append((doc_id, lang or "", {f for f, bad in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), copy)) if bad}))
    return out


def expected(rows, labels):
    """Each order's cascade, document by document."""
    known = lambda i, k: any(r[0] == i and r[k] == 1 for r in labels) if i is not None else False
    docs, out, total = failed(rows), {}, {}
    for part in {p for _, p, _ in docs}:
        own = [(i, f) for i, p, f in docs if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone, kept = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                fails = [d for d in own if f in d[1]]
                out[part, order, step] = (len(kept), len(gone), len(fails) - len(gone), sum(d[1] == {f} for d in fails), sum(known(i, 1) for i, _ in gone), sum(known(i, 2) for i, _ in gone))
                total[part, f] = total.get((part, f), 0) + len(gone)
                left = kept
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(spark, docs, labels):
    rows = audit(failures(docs), spark.createDataFrame(labels, LABELS)).collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def rows(edge_rows):
    many = " ".join(f"w{k}" for k in range(120))
    texts = [many, many, many + " #", many.upper(), "A" + many, "same " * 150, many + " $ " + "B" * 100, "x" * 30_000 + " " + many]
    return [*edge_rows, *((100 + k, t, "en", None, None, None, None, None, None, None) for k, t in enumerate(texts + texts[::-1]))]


def test_audit_is_every_cascade(spark, rows):
    labels = [(k, k % 2, k // 2 % 2, "x") for k in range(0, 116) if k % 3] + [(100, 1, None, None), (100, 0, 1, None), (None, 1, 1, None), (9999, 1, 1, None), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, mask string, row string, digest string, n string")
    assert result(spark, docs.repartition(7), labels) == expected(rows, labels)


def test_without_labels_or_documents(spark, empty, rows):
    assert audit(failures(empty), spark.createDataFrame([], LABELS)).count() == 0
    docs = spark.createDataFrame([(1, None, None), (2, "", None), (3, "Ab|", None)], "doc_id int, text string, lang string")
    assert result(spark, docs, []) == expected([(1, None, None), (2, "", None), (3, "Ab|", None)], [])


def test_a_hot_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.concat(F.lit("own "), "id")).alias("text"), F.lit("en").alias("lang"))
    got = result(spark, docs, [])
    assert got["en", "EABCD", 1][:2] == (2001, 999) and got["en", "AEBCD", 2][:4] == (0, 0, 999, 0)
