import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lamina.llm import queries, warc
from lamina.llm.storage import fresh_path

SEGMENT = "origin string, warc_type string, target_uri string, payload_sha1 string, number int, total bigint, body binary"
PAGES = "page_id bigint, url string, html string, sha1 string"


def pages(spark):
    big = "<p>" + "é" * 60_000
    rows = [(k, f"http://h/{k % 2} x\n", t, "clash") for k, t in enumerate([None, "", "small", "small", "a" * 999, "a" * 999, "b" * 1000, "b" * 1000, "b" * 1000, big, big, "c\r\n\r\nWARC/1.1\r\n" * 400])]
    return rows + [rows[8], rows[9], (None, None, "b" * 1000, None), (None, None, "d" * 70_000, None), (20, None, "e" * 70_000, None), (20, None, "e" * 70_000, None)]


@pytest.mark.parametrize("narrow", [warc.NARROW, 0])
def test_round_trip(spark, tmp_path, monkeypatch, narrow):
    monkeypatch.setattr(warc, "NARROW", narrow)
    rows = pages(spark)
    spark.createDataFrame(rows, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    holder = {}
    for p, _, t, _ in rows:
        if p is not None and len((t or "").encode()) >= 1000:
            holder[t] = max(p, holder.get(t, p))
    want = []
    for p, _, t, _ in rows:
        b, h = (t or "").encode(), holder.get(t) if len((t or "").encode()) >= 1000 else None
        revisit = h is not None and (p is None or p < h)
        want.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", h if revisit else None, True))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.whole) for r in queries.op2_warc(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_payloads_come_back_and_empty_table(spark):
    path = fresh_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([(1, "u", "x" * 100_000, None)], PAGES), path, segment_bytes=1000)
    (r,) = warc.read_archives(spark, path).collect()
    assert bytes(r.payload) == b"x" * 100_000 and r.status == "ok" and r.target_uri == "u"
    path = fresh_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc.read_archives(spark, path).count() == 0


def test_broken_segments_are_reported(spark):
    seg = lambda o, k, total, body: (o, "response" if k == 1 else "continuation", None, None, k, total, body)
    rows = [seg("ok", 2, 12, b"cd"), seg("ok", 1, None, b"H: x\r\n\r\nab"), seg("head", 1, None, b"no"), seg("head", 2, 6, b"head"), seg("gap", 1, None, b"a"), seg("gap", 3, 2, b"b"), seg("short", 1, None, b"a"), seg("short", 2, 9, b"b"), seg("open", 1, None, b"a"), seg("headless", 2, 1, b"b")]
    got = {r.record_id: (r.status, r.payload and bytes(r.payload)) for r in warc.reassembled(spark.createDataFrame(rows, SEGMENT)).collect()}
    assert got == {"ok": ("ok", b"abcd"), "head": ("bad framing", None), "gap": ("missing segment", None), "short": ("bad length", None), "open": ("missing segment", None), "headless": ("missing segment", None)}


def test_chunked_framing():
    for body in (b"", b"a", b"ab\r\n" * 5000):
        assert warc.unchunked(warc.chunked(body, 7)) == body
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    assert warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n") is None and warc.unchunked(b"zz") is None


def test_archives_are_bounded_by_bytes(spark):
    path = fresh_path(spark, "warc-test")
    docs = spark.createDataFrame([(k, "u", f"{k} " * (20_000 if k == 77 else 100), None) for k in range(300)], PAGES).coalesce(2)
    warc.write_archives(docs, path, archive_bytes=10_000)
    sizes = [len(gzip.decompress(f.read_bytes())) for f in Path(path.removeprefix("file:")).rglob("*.gz")]
    assert len(sizes) > 10 and all(n < 10_000 + 17_500 for n in sizes) and len(list(Path(path.removeprefix("file:")).iterdir())) >= len(sizes)
    assert sorted(bytes(r.payload) for r in warc.read_archives(spark, path).collect()) == sorted(r.html.encode() for r in docs.collect())


def test_many_equal_large_records_come_back(spark):
    """3000 equal rows of a megabyte are counted in one segment table and come back as 3000 rows."""
    body = F.concat(F.lit("H: x\r\n\r\n"), F.repeat(F.lit("y"), 1_000_000)).cast("binary")
    segments = spark.range(3000).select(
        F.lit("same").alias("origin"), F.lit("response").alias("warc_type"), F.lit(None).cast("string").alias("target_uri"), F.lit(None).cast("string").alias("payload_sha1"),
        F.lit(1).alias("number"), F.lit(1_000_008).cast("long").alias("total"), body.alias("body"),
    )
    found = warc.reassembled(segments).groupBy("record_id", "status", F.length("payload").alias("n")).count().collect()
    assert [tuple(r) for r in found] == [("same", "ok", 1_000_000, 3000)]
