import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, fp string, score string, shard string, spans string"


def prose(n, seed, words=("the", "red", "fox", "ran", "over", "Hill", "and", "saw", "Été", "naïve", "stone", "9", "river", "wide")):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank and very long texts, ties, repeated rows, null and repeated ids."""
    base = prose(60, 1)
    long = prose(30_000, 2)
    texts = [
        None, "", " \t\n", base, base, base.upper(), base + " end", prose(60, 3), long, long + " tail", "x" * 40_000, "12345 67890 !!", "a b", "word",
        "one shared line here\nown line number one\n\n  ONE shared line HERE  ", "one shared line here\nown line number two", "été été été\r\nété", "日本語の文章です。" * 30,
    ]
    rows = [(k, t, ("en", "fr", None)[k % 3], ("a", "b", None)[k % 3], None, "s", "f", "c", "h", "p") for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base, "en", "a", 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (7, "another text under an old id", "en", "a", None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    """Rows as dicts in an order of their own."""
    return sorted((r.asDict() for r in df.collect()), key=repr)
