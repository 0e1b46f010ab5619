import hashlib
import re

from lamina.llm import decontamination as d

ITEM = "item_id bigint, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(rows, items):
    out = []
    for doc, t in rows:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(10, len(v))
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    if item is not None:
                        found.add(str(item))
        out.append((repr(doc), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def items():
    long = "what is the Capital of the old country that lies by the sea and has a wall"
    return [(1, long), (2, long + " of stone"), (10, "tiny one"), (3, None), (4, "!!"), (None, "nameless item of more than ten words that has no number at all"), (1, long), (5, "été à la mer")]


def docs():
    long = "what is the capital of the old country that lies by the sea and has a wall"
    return [(0, None), (1, ""), (2, f"x {long.upper()} y"), (3, "a tiny, ONE b"), (4, "what is the capital of the old country that"), (5, f"{long} {long}-of stone"), (6, "Été à la mer"), (7, "tiny tiny one one tiny one"), (None, "nameless item of more than ten words that has no number"), (2, "tiny one"), (2, "tiny one"), (8, "z " * 50_000 + long)]


def run(spark, rows, of, **options):
    scanned = d.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(of, ITEM), keep=("doc_id",), **options)
    return sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in d.report(scanned, "doc_id").collect())


def test_by_brute_force(spark, edge_rows):
    assert run(spark, docs(), items()) == brute(docs(), items())
    rows = [(r[0], r[1]) for r in edge_rows]
    own = [(k, t[3:900]) for k, t in rows if t and k is not None]
    assert run(spark, rows, own) == brute(rows, own)
    assert run(spark, docs(), []) == brute(docs(), []) and run(spark, [], items()) == []


def test_blocks_give_the_same(spark):
    assert run(spark, docs(), items(), block=2) == brute(docs(), items())


def test_removal(spark, edge):
    table = spark.createDataFrame(items(), ITEM)
    rows = spark.createDataFrame([(1, "Keep this. What IS the capital of the old country that lies by the sea! And this.", "x"), (2, "clean text", "y"), (3, None, "z")], "doc_id int, text string, spans string")
    assert sorted(map(tuple, d.remove_documents(rows, table).collect())) == [(2, "clean text", "y"), (3, None, "z")]
    assert sorted(map(tuple, d.remove_spans(rows, table).collect())) == [(1, "Keep this.  this.", "x"), (2, "clean text", "y"), (3, None, "z")]
    assert d.remove_documents(edge, table).columns == edge.columns


def test_columns_of_any_name_pass_through_removal(spark):
    table = spark.createDataFrame(items(), ITEM)
    rows = spark.createDataFrame([("What is the capital of the old country that lies by the sea!", 1, "x", "y"), ("clean", 2, None, "z")], "text string, _scan_text int, row string, body string")
    for out in (d.remove_documents(rows, table), d.remove_spans(rows, table)):
        assert out.columns == rows.columns and ("clean", 2, None, "z") in [tuple(r) for r in out.collect()]
    assert [r.text for r in d.remove_spans(rows, table).filter("_scan_text = 1").collect()] == ["!"]


def test_twenty_blocks_have_one_python_stage(spark):
    """A pass for each block: however many there are, a plan has one Python stage, so a worker holds one block's set."""
    many = [(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(20)]
    rows = [(k, f"start {t} end") for k, t in many] + [(100, None), (101, "clean text of no item")] + [(200 + k, " ".join(x for _, x in many[k : k + 5])) for k in range(4)]
    df, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(many, ITEM)
    scanned = d.scan(df, bench, keep=("doc_id",), block=3)
    assert scanned._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in d.report(scanned, "doc_id").collect())
    assert got == brute(rows, many)
