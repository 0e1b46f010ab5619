"""WARC archives: writing with segmentation and revisits, and reading with segment reassembly.

Written records are one-to-one with rows. A response's HTTP message is framed in chunks
(``Transfer-Encoding: chunked``); a content block longer than ``segment_bytes`` goes out as a first
record with ``WARC-Segment-Number: 1`` and continuations that name it in ``WARC-Segment-Origin-ID``,
the last one with ``WARC-Segment-Total-Length``. Among records of equal payload of at least
``revisit_bytes``, that with the largest id is the response and the others are revisits.

Reading parses each archive file once, by ``Content-Length``, groups segments by origin, orders them by
number, checks that none is missing and that the lengths add up to the stated total, and only then
decodes the chunked framing. A record that fails keeps its row with a null payload and says why in
``status``. Groups hold one record's segments only. An archive file ends with the record that reaches
``archive_bytes`` (before compression), so what reads it holds that much and one record, whatever the pages.

Defined results: a null payload is an empty one; a null URL becomes ``urn:page:<id>``; a null id is
written as ``null`` and read back as null, and never becomes the response that others refer to; repeated
rows give equal records, which are read back as many times; an empty table gives no archive rows;
columns besides the three named aren't read. A record of over 2 GB doesn't fit a Spark cell and is an error.
All files pass through Spark's own writers and readers.
"""

from __future__ import annotations

import base64
import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import bounded_batches, written

SEGMENT_BYTES, CHUNK_BYTES, REVISIT_BYTES, ARCHIVE_BYTES = 16_384, 4_096, 1_000, 64 << 20
#: Rows of the table of repeated payloads that is broadcast; a larger one is shuffled.
NARROW = 1 << 18
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the WARC 1.1 and HTTP 1.1 formats.
VERSION = b"WARC/1.1"
END = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("record_id", "warc_type", "target_uri", "payload_sha1", "refers_to", "status")] + [T.StructField("payload", T.BinaryType())]
)
#: A parsed record: a segment has a number, a whole record none and its payload in place of the content block.
PARSED = T.StructType(RECORD.fields[:6] + [T.StructField("number", T.IntegerType()), T.StructField("total", T.LongType()), T.StructField("body", T.BinaryType())])


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP chunked framing."""
    parts = [payload[k : k + size] for k in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload under chunked framing, trailers dropped; None where the framing is broken."""
    out, at = [], 0
    while True:
        stop = body.find(END, at)
        if stop < 0:
            return None
        try:
            n = int(body[at:stop].split(b";")[0], 16)
        except ValueError:
            return None
        at = stop + 2
        if n == 0:
            return b"".join(out)
        if n < 0 or body[at + n : at + n + 2] != END:
            return None
        out.append(body[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes | None:
    """The payload of an HTTP message, unframed if it is chunked."""
    head, found, body = block.partition(END + END)
    if not found:
        return None
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:[^\r]*\bchunked\b", head) else body


def record_bytes(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record without its last line end, which Spark's text writer adds as the separator."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return VERSION + END + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + END


def record_id(page: str, sha1: str) -> str:
    return f"<urn:page:{page}:{sha1}>"


def uri(url: str | None, page: str) -> str:
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page}"


def row_records(page: str, url: str | None, payload: bytes, sha1: str, refers: int | None, segment: int) -> list[bytes]:
    """The records of one row: a revisit, a whole response, or a response's segments."""
    me = record_id(page, sha1)
    common = [("WARC-Target-URI", uri(url, page)), ("WARC-Date", DATE), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()), ("Content-Type", "application/http;msgtype=response")]
    if refers is not None:
        return [record_bytes([("WARC-Type", "revisit"), ("WARC-Record-ID", me), ("WARC-Refers-To", record_id(str(refers), sha1)), ("WARC-Profile", REVISIT_PROFILE), *common], HTTP_HEAD)]
    block = HTTP_HEAD + chunked(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", me), *common]
    if len(block) <= segment:
        return [record_bytes(first, block)]
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    out = [record_bytes([*first, ("WARC-Segment-Number", "1")], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{me[:-1]}:{k}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", str(k))]
        out.append(record_bytes(fields + [("WARC-Segment-Total-Length", str(len(block)))] * (k == len(parts)), part))
    return out


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = REVISIT_BYTES) -> DataFrame:
    """page, url, payload, sha1, refers: the id of the response that holds the payload, null for responses."""
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")).withColumn("sha1", F.sha1("payload"))
    long = F.length("payload") >= least
    kept = rows.filter(long).groupBy("sha1").agg(F.max("page").alias("holder"), F.count("*").alias("n")).filter("n > 1 AND holder IS NOT NULL").select(F.col("sha1").alias("same"), "holder")
    kept = written(kept, "repeated-payloads")
    refers = F.expr("CASE WHEN page IS NULL OR page < holder THEN holder END").alias("refers")
    if kept.count() <= NARROW:
        return rows.join(F.broadcast(kept), long & (rows["sha1"] == kept["same"]), "left").select("page", "url", "payload", "sha1", refers)
    # Short payloads never refer to another: they stay out of the shuffle.
    found = rows.filter(long).join(kept, rows["sha1"] == kept["same"], "left").select("page", "url", "payload", "sha1", refers)
    return found.unionByName(rows.filter(~long).withColumn("refers", F.lit(None).cast(pages.schema[id_col].dataType)))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    segment_bytes: int = SEGMENT_BYTES, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, compression: str = "gzip",
) -> None:
    """Writes archive files under ``path``, one or more records for each row."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, filled = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            out, archives = [], []
            for page, url, payload, sha1, refers in zip(*(batch.column(k).to_pylist() for k in range(5))):
                for record in row_records("null" if page is None else str(page), url, payload, sha1, refers, segment_bytes):
                    out.append(record)
                    archives.append(f"{task}-{number}")
                    filled += len(record)
                    if filled >= archive_bytes:
                        number, filled = number + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(archives, pa.string()), pa.array(out, pa.binary())], names=["archive", "record"])

    spark = pages.sparkSession
    bounded_batches(spark)
    rows = with_revisits(pages, id_col, url_col, payload_col, revisit_bytes).select("page", "url", "payload", "sha1", "refers")
    records = rows.mapInArrow(of_batches, "archive string, record binary").select("archive", F.col("record").cast("string").alias("value"))
    # A task's archives come one after the other: its files are open side by side, and nothing is sorted.
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, "0")
    spark.conf.set(key, "64")
    try:
        records.write.partitionBy("archive").option("lineSep", "\r\n").option("compression", compression).text(path)
    finally:
        spark.conf.set(key, before)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and content block of each record of an archive."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)  # members, one or many
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record begins at byte {at}")
        stop = data.find(END + END, at)
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(fields["content-length"])
        yield fields, data[stop + 4 : stop + 4 + n]
        at = stop + 4 + n
        while data[at : at + 2] == END:
            at += 2


def hex_digest(fields: dict[str, str]) -> str | None:
    kind, _, value = fields.get("warc-payload-digest", "").partition(":")
    return base64.b32decode(value).hex() if kind == "sha1" else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row (``RECORD``) for each record under ``path`` that isn't a continuation, with its whole payload."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for f, block in parsed(content.as_py()):
                    names = f["warc-type"], f.get("warc-target-uri"), hex_digest(f)
                    if "warc-segment-number" in f:
                        total = f.get("warc-segment-total-length")
                        rows.append((f.get("warc-segment-origin-id", f.get("warc-record-id")), *names, None, None, int(f["warc-segment-number"]), int(total) if total else None, block))
                    else:
                        body = http_payload(block) if f["warc-type"] == "response" else None
                        status = "ok" if body is not None or f["warc-type"] != "response" else "bad framing"
                        rows.append((f.get("warc-record-id"), *names, f.get("warc-refers-to"), status, None, None, body))
                    held += len(block)
                    if held > 16 << 20:
                        yield of_rows(rows, PARSED)
                        rows, held = [], 0
                yield of_rows(rows, PARSED)

    records = written(files.mapInArrow(of_files, PARSED), "warc-parsed")  # parsed once, read by both branches
    whole = records.filter("number IS NULL").select(*RECORD.names[:6], F.col("body").alias("payload"))
    return whole.unionByName(reassembled(records.filter("number IS NOT NULL").withColumnRenamed("record_id", "origin")))


def of_rows(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[f.dataType.simpleString()]) for k, f in enumerate(schema)], names=schema.names)


def reassembled(segments: DataFrame) -> DataFrame:
    """``RECORD`` rows whose payload is the joined content block: grouped by origin, ordered, checked."""
    # Equal records have equal segments: one of each is kept, with how often it came.
    single = segments.groupBy("origin", "number").agg(
        F.count("*").alias("copies"), F.max("total").alias("total"), F.first("body").alias("body"),
        *(F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in ("warc_type", "target_uri", "payload_sha1")),
    )
    records = single.groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("number", "body"))).alias("parts"), F.max("total").alias("total"),
        F.min("copies").alias("copies"), F.max("copies").alias("most"), *(F.max(c).alias(c) for c in ("warc_type", "target_uri", "payload_sha1")),
    )
    length = F.expr("aggregate(parts, 0L, (n, p) -> n + length(p.body))")
    status = (
        F.when((F.expr("parts[size(parts) - 1].number") != F.size("parts")) | (F.expr("parts[0].number") != 1) | F.col("total").isNull() | (F.col("copies") != F.col("most")), "missing segment")
        .when(length != F.col("total"), "bad length").otherwise("ok")
    )
    kind = F.coalesce("warc_type", F.lit("continuation")).alias("warc_type")
    parts = records.select(F.col("origin").alias("record_id"), kind, "target_uri", "payload_sha1", status.alias("status"), F.expr("transform(parts, p -> p.body)").alias("parts"), "copies")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for *names, status, bodies, copies in zip(*(batch.column(k).to_pylist() for k in range(7))):
                payload = http_payload(b"".join(bodies)) if status == "ok" else None
                rows.append((*names, None, "bad framing" if status == "ok" and payload is None else status, payload, copies))
            yield of_rows(rows, counted)

    counted = T.StructType([*RECORD.fields, T.StructField("copies", T.LongType())])
    # A row for each copy is made of the one that a worker gives, so its batches don't grow with the copies.
    return parts.mapInArrow(joined, counted).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies")
