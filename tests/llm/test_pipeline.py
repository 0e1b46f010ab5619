import os
import random
import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import language_id, queries

from .conftest import SCHEMA


def tables(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "the passage that the benchmark asks about is this one and no other")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(3, 1, 0), (7, 0, 0), (None, 1, None), (3, 0, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def half(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 2


def grams(t):
    return [x for v, _ in language_id.steps([language_id.letters(t or "")]) for x in v.tolist()]


def in_a_language(rows):
    """The language stage by plain sets in place of filters."""
    kept = []
    for k in (0, 1):
        sets = {}
        for d, t, lang, *_ in rows:
            if half(d) != k and lang is not None:
                sets.setdefault(lang, set()).update(grams(t))
        for r in rows:
            d, t, lang = r[:3]
            if half(d) == k and any(map(str.isalpha, t or "")):
                share = {x: sum(g in s for g in grams(t)) / max(1, len(grams(t))) for x, s in sets.items()}
                best = max(share.values(), default=0)
                if not sets or len(t) < corpus_pipeline.FEW or best >= corpus_pipeline.LEAST_KNOWN and best - share.get(lang, 1) < corpus_pipeline.CONTRADICTED:
                    kept.append(r)
    return kept


def test_each_stage_keeps_what_it_should(spark, edge, edge_rows, empty, tmp_path):
    from .conftest import prose

    leak = "so the PASSAGE that the benchmark asks about is this one, and no other"
    rows = list(edge_rows) + [(50, leak, "en", "b", None, None, None, None, None, None)]
    d = tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    lettered = corpus_pipeline.identify_language(spark, docs, d)
    want = in_a_language(rows)
    assert lettered.columns == docs.columns and sorted(map(repr, (tuple(r) for r in lettered.collect()))) == sorted(map(repr, want)) and 5 < len(want) < len(rows)
    single = corpus_pipeline.drop_near_duplicates(spark, docs, d)
    texts = [r["text"] for r in single.collect()]
    assert single.columns == docs.columns and texts.count(prose(60, 1)) == 1 and prose(60, 3) in texts
    clean = corpus_pipeline.decontaminate(spark, docs, d)
    assert clean.columns == docs.columns and clean.count() == len(rows) - 1
    mixed = corpus_pipeline.mix_sources(spark, docs, d)
    assert mixed.columns == docs.columns
    sharded = corpus_pipeline.assign_shards(spark, docs, d)
    assert sharded.count() == len(rows) and len(set(sharded.columns)) == len(sharded.columns)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), d).count() == 0
    out = corpus_pipeline.run(spark, d)
    assert 0 < out.count() and out.filter("doc_id = 50").count() == 0


def test_language_stage_rejects_what_is_in_no_language_or_not_in_its_own(spark):
    r = random.Random(3)
    text = lambda syllables: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(60))
    ka, sch = ["ka", "to", "mi", "ru", "sen"], ["sch", "ung", "ein", "vor", "keit"]
    rows = [(k, text(ka if k % 2 else sch), "ka" if k % 2 else "sch") for k in range(200)]
    noise = "".join(r.choice("qwxzjvpy") for _ in range(400))
    rows += [(500, text(ka), "sch"), (501, noise, "ka"), (502, noise, None), (503, text(sch), None), (504, text(sch), "other"), (505, None, "ka"), (506, "12345 !!", "ka"), (507, "mi", "sch")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    kept = {x.doc_id for x in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert kept == set(range(200)) | {503, 504, 507}


def test_columns_of_any_name_pass_through(spark, edge, edge_rows, tmp_path):
    d = tables(spark, tmp_path, edge_rows)
    names = ["whole_row", "same", "turn", "chosen", "taken", "least", "over", "copies", "copy", "labelled", "predicted", "shares", "slot", "law", "text_hash", "words", "_scan_text", "component", "node", "text of the row", "a.b"]
    docs = edge.select("*", *(F.lit(n).alias(n) for n in names)).coalesce(2)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        kept = [n for n in names if n in out.columns and n not in ("slot", "law")]
        assert len(kept) == len(names) - 2 and len(set(out.columns)) == len(out.columns)
        assert all(r[n] == n for r in out.collect() for n in kept) and out.count() > 0


def test_names_and_oracles():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and len(queries.QUERIES) == 14
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID"


def test_oracles_on_the_smallest_tables(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    for name, sql in queries.ORACLE_SQL.items():
        c = duckdb.connect()
        for t in os.listdir(sf):
            c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
        want = c.sql(sql)
        order = sorted(want.columns)
        norm = lambda rows: sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)
        got = queries.QUERIES[name](spark, sf).select(*order).collect()
        assert norm(map(tuple, got)) == norm(c.sql(f"SELECT {', '.join(order)} FROM ({sql})").fetchall()), name


def test_survivors_of_equal_rows_do_not_depend_on_their_order(spark, tmp_path):
    from .conftest import prose

    rows = [(1, prose(40, 5), lang, source, None, None, None, None, None, None) for lang in ("en", "de", None) for source in ("a", "b", None)] * 3 + [(2, prose(40, 9), "en", "c", None, None, None, None, None, None)] * 4
    d = tables(spark, tmp_path, rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    backwards = spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.mix_sources):
        a, b = (sorted(map(repr, (tuple(r) for r in stage(spark, x, d).collect()))) for x in (docs, backwards))
        assert a == b and a, stage
    assert corpus_pipeline.drop_near_duplicates(spark, docs, d).count() == 2
