import random

import numpy as np
from pyspark.sql import functions as F

from lamina.llm import language_id
from lamina.llm.ctw import training_remainder

SYLLABLES = {"aa": ["ka", "to", "mi", "ru", "sen"], "bb": ["sch", "ung", "ein", "vor", "keit"], "cc": ["ción", "los", "que", "ado", "ñe"]}


def text(lang, r, n=60):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy(spark):
    r = random.Random(2)
    rows = [(k, text(lang, r, r.randint(3, 80)), lang) for k in range(600) for lang in [r.choice(list(SYLLABLES))]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = language_id.learn(docs.filter(training_remainder("doc_id", 4) != 2))
    got = language_id.identify(docs, learned, keep=("doc_id", "lang")).filter(training_remainder("doc_id", 4) == 2).collect()
    assert np.mean([x.lang == x.lang_pred for x in got]) > 0.98 and all(0 <= x.score <= 1 for x in got)


def test_edge_rows(edge, edge_rows, empty):
    learned = language_id.learn(edge)
    assert learned.languages == ["en", "fr"]
    got = language_id.identify(edge, learned, keep=("doc_id",)).collect()
    want = sorted((repr(d), not any(c.isalpha() for c in t or "")) for d, t, *_ in edge_rows)
    assert sorted((repr(x.doc_id), x.lang_pred == "und") for x in got) == want
    nothing = language_id.learn(empty)
    assert {(x.lang_pred, x.score) for x in language_id.identify(edge, nothing).collect()} == {("und", 0.0)}
    assert language_id.identify(empty, learned).count() == 0


def test_filter_returns_all_languages_of_a_gram_and_few_others(spark):
    """No n-gram is left out, however rare, in any of 70 languages; what the filter gives by chance is within its fill rate."""
    r = random.Random(4)
    sets = {f"l{k:02}": {"".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(60)} for k in range(70)}
    docs = spark.createDataFrame([(g, lang) for lang, of in sets.items() for g in of] + [("abcde " * 50, "l00")], "text string, lang string")
    (f,) = language_id.learn(docs).filters()
    assert f.languages == sorted(sets) and f.planes.shape[0] == 2
    grams_of = {lang: {x for t in of for v, _ in language_id.steps([language_id.letters(t)]) for x in v.tolist()} for lang, of in sets.items()}
    value = np.array(sorted(set().union(*grams_of.values())), np.int64)
    wrong = 0
    for k, lang in enumerate(f.languages):
        hit = np.ones(len(value), bool)
        for s in language_id.slots(value, f.n_slots):
            hit &= (f.planes[k // 64][s] >> np.uint64(k % 64) & np.uint64(1)).astype(bool)
        own = np.isin(value, list(grams_of[lang]))
        assert hit[own].all()
        wrong += hit[~own].sum()
    assert wrong / (70 * len(value)) < 0.02


def test_prediction_by_brute_force(spark):
    """With sets in place of the filter the same language wins, as chance hits are few."""
    r = random.Random(6)
    rows = [(k, text(lang, r, r.randint(1, 40)), lang) for k in range(300) for lang in [r.choice(list(SYLLABLES))]]
    (f,) = language_id.learn(spark.createDataFrame(rows[:150], "doc_id bigint, text string, lang string")).filters()
    grams_of = lambda t: [x for v, _ in language_id.steps([language_id.letters(t)]) for x in v.tolist()]
    sets = {x: {g for _, t, lang in rows[:150] if lang == x for g in grams_of(t)} for x in f.languages}
    shares = [{x: sum(g in sets[x] for g in grams_of(t)) / max(1, len(grams_of(t))) for x in sets} for _, t, _ in rows[150:]]
    names, scores, rates = f.predict([t for _, t, _ in rows[150:]])
    for (_, t, _), name, share, rate in zip(rows[150:], names, shares, rates):
        few = 0.02 + 2 / max(1, len(grams_of(t)))  # hits by chance
        assert share[name] >= max(share.values()) - few and all(-0.02 < rate[x] - share[x] < few for x in share)


def test_ties_go_to_the_language_with_more_text(spark):
    docs = spark.createDataFrame([("same words here", "aa"), ("same words here", "bb"), ("same words here", "bb")], "text string, lang string")
    (f,) = language_id.learn(docs).filters()
    assert f.predict(["same words", "zzzzzzzz"])[0] == ["bb", "bb"]


def test_steps_change_nothing(monkeypatch):
    texts = [b" ab ", b" abcdefgh " * 9, b"", b" a "]
    whole = [np.concatenate(x).tolist() for x in zip(*language_id.steps(texts))]
    monkeypatch.setattr(language_id, "STEP", 8)
    assert [np.concatenate(x).tolist() for x in zip(*language_id.steps(texts))] == whole


def test_a_bound_of_a_few_kilobytes_changes_no_prediction(spark, monkeypatch):
    """Over many small filters the languages are those of plain sets, as with one large filter."""
    r = random.Random(8)
    words = {x: ["".join(r.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(4000)] for x in ("aa", "bb", "cc")}
    rows = [(k, " ".join(r.choice(words[x]) for _ in range(r.randint(5, 60))), x) for k in range(900) for x in [r.choice(list(words))]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    grams_of = lambda t: [x for v, _ in language_id.steps([language_id.letters(t)]) for x in v.tolist()]
    sets = {x: {g for _, t, lang in rows[:700] if lang == x for g in grams_of(t)} for x in words}
    share = lambda t, x: sum(g in sets[x] for g in grams_of(t)) / max(1, len(grams_of(t)))
    found = {}
    for most in (128 << 20, language_id.BLOCK):
        monkeypatch.setattr(language_id, "FILTER_BYTES", most)
        known = language_id.learn(df.filter("doc_id < 700"))
        got = language_id.identify(df.filter("doc_id >= 700"), known, keep=("doc_id",), names=("lang_pred", "score", "shares")).collect()
        found[most] = known.parts
        assert len(got) == 200
        for x in got:
            t = rows[x.doc_id][1]
            assert x.lang_pred == max(sets, key=lambda k: share(t, k)) and all(abs(x.shares[k] - share(t, k)) < 0.03 for k in sets)
    assert found[128 << 20] == 1 and found[language_id.BLOCK] > 20


def test_kept_columns_with_names_of_the_result(spark):
    df = spark.createDataFrame([(1, "ka to mi", "x", 7)], "doc_id bigint, text string, lang_pred string, score int")
    (r,) = language_id.identify(df, language_id.learn(df.withColumn("lang", F.lit("aa"))), keep=("doc_id", "lang_pred", "score")).collect()
    assert r.asDict() == {"doc_id": 1, "lang_pred": "aa", "score": 1.0}
