"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, ctw, decontamination, filter_audit, imatch, language_id, line_dedup, mixing, multi_index, sharding, simhash, token_counts, warc
from .storage import fresh_path, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = warc.read_archives(spark, path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+):", 1).try_cast("long")
    read = written(records.select("record_id", "warc_type", "payload_sha1", "refers_to", "status", F.length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1")), "warc-read")
    # Only revisits are joined: rows without a key would all meet in one task. The holders are written, so a hot one can be split.
    held = written(read.filter("warc_type = 'response' AND status = 'ok'").groupBy(F.col("record_id").alias("holder")).agg(F.max("n").alias("held_n"), F.max("sha1").alias("held_sha1")), "warc-holders")
    own, revisits = read.filter("refers_to IS NULL"), read.filter("refers_to IS NOT NULL").drop("n", "sha1")
    found = revisits.join(held, revisits["refers_to"] == held["holder"], "left").withColumnsRenamed({"held_n": "n", "held_sha1": "sha1"}).drop("holder")
    return own.unionByName(found).select(
        page(F.col("record_id")).alias("page_id"), F.col("n").alias("payload_bytes"), F.col("sha1").alias("payload_digest"),
        F.col("warc_type").alias("record_type"), page(F.col("refers_to")).alias("refers_to"), (F.col("status") == "ok").alias("whole"),
    )


def quality_weight() -> Column:
    """Of column quality: documents labelled good weigh 2, bad 0.5, others 1."""
    return F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)


def with_quality(rows: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("quality"))
    return rows.join(known, rows["doc_id"] == known["labelled"], "left").drop("labelled")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("words"))
    return mixing.mix(with_quality(narrow, table(spark, sf_dir, "labels")), quality_weight(), F.col("words"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op5_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"), ctw.training_remainder("doc_id", 10) != 0)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=2).drop("text_hash")


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), multi_index.sign_code(F.col("embedding")).alias("code"))
    return multi_index.search(rows, rows.filter("id % 100 = 0"), 10)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = line_dedup.LineIndex.empty(spark).insert(docs).dedup(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = ctw.training_remainder("doc_id", 4) == 2
    return language_id.identify(docs, language_id.learn(docs.filter(~held_out)), keep=("doc_id", held_out.alias("held_out")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=("doc_id",))
    return decontamination.report(scanned, "doc_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op12_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"), thinned=True)  # as its SQL has it


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(rows), rows)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_warc, op3_mixing, op4_sharding, op5_ctw, op6_simhash, op7_multi_index, op8_line_dedup, op9_language_id, op10_decontamination, op11_filter_audit, op12_imatch, op13_conversation_repair, pipeline)
}

_OP2 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages
), h AS (SELECT d, max(page_id) AS holder FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id < holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < holder THEN holder END AS refers_to, TRUE AS whole
FROM p LEFT JOIN h USING (d)
"""

_OP3 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source
), b AS (SELECT 1.5 * sum(source_size) AS budget FROM s
), fill AS (
  SELECT 0 AS step, 0.0::DOUBLE AS level
  UNION ALL
  SELECT step + 1, (SELECT (max(budget) - coalesce(sum(CASE WHEN 2 * source_size <= fill.level * weight THEN 2 * source_size END), 0)) / nullif(sum(CASE WHEN 2 * source_size > fill.level * weight THEN weight END), 0) FROM s, b)::DOUBLE
  FROM fill WHERE step < 40 AND level IS NOT NULL
), t AS (
  SELECT source, source_size, least(2.0 * source_size, weight * coalesce((SELECT max(level) FROM fill), 1e18)) AS target FROM s
), k AS (
  SELECT d.*, t.source_size, t.target,
    -ln((CAST('0x' || substr(md5(d.doc_id || ':' || size), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0) / CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS key
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN q ON d.doc_id = q.doc_id
), c AS (
  SELECT *, floor(target / source_size) AS epochs, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS through FROM k
), e AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN epochs ELSE 0 END + CASE WHEN through - size / 2.0 < target - epochs * source_size THEN 1 ELSE 0 END AS BIGINT) AS copies FROM c
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM e
"""

_OP7 = """
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS code FROM embeddings),
q AS (SELECT id AS query_id, code AS asked FROM v WHERE id % 100 = 0),
x AS (SELECT query_id, id, CAST(list_sum(list_transform(list_zip(asked, code), lambda z: abs(z[1] - z[2]))) AS INTEGER) AS distance FROM q, v WHERE id <> query_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM x)
SELECT query_id, id, distance, rank FROM r WHERE rank <= 10
"""

_OP8 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), o AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (SELECT k.*, owner IS NOT NULL AND doc_id <> owner AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_OP10 = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM iw WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), dg AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (SELECT doc_id, item_id, i, dg.n FROM dg JOIN win USING (n, g)
), hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1
), hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

_OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE)] AS fails FROM d
), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), x AS (SELECT part, fails, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic FROM f LEFT JOIN l USING (doc_id)
), g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM x GROUP BY 1, 2
), v AS (SELECT unnest([1, 2, 3, 4, 5]) AS k
), o AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM v a, v b, v c, v d, v e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), s AS (
  SELECT array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') AS filter_order, CAST(v.k AS INTEGER) AS step, o[v.k] AS own, o[1 : v.k - 1] AS before FROM o, v
), r AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS fail, len(list_filter(before, lambda k: fails[k])) > 0 AS gone, len(list_filter(fails, lambda b: b)) = 1 AS lone FROM g, s
), c AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT fail AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fail AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fail AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fail AND lone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fail AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fail AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM r GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM c
"""

# Families of subsets: hashes (key * a + b) % (2^31 - 1), a and b from the MD5 of the family's number.
_OP12 = r"""
WITH d AS (
  SELECT *, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(t)) AS i, length(t) AS n FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), e AS (
  SELECT d.*, x.t AS next, left(d.t, d.n - d.n // 3) || left(x.t, d.n // 3) AS edited, x.i AS j FROM d JOIN d x ON x.i = CASE WHEN d.i = (SELECT max(i) FROM d) THEN 1 ELSE d.i + 1 END
), v AS (SELECT i, TRUE AS own, t AS t FROM e UNION ALL SELECT i, FALSE, edited FROM e
), w AS (
  SELECT i, own, t, list_filter(list_distinct(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')), lambda x: x <> '') AS terms FROM v
), k AS (
  SELECT i, own, list_transform(CASE WHEN len(terms) > 0 THEN terms ELSE [t] END, lambda x: CAST('0x' || substr(md5(x), 1, 15) AS BIGINT)) AS keys FROM w
), f AS (SELECT key, count(*) AS docs FROM (SELECT unnest(keys) AS key FROM k WHERE own) GROUP BY 1
), c AS (
  SELECT i, own, CASE WHEN len(part) > 0 THEN part ELSE keys END AS keys
  FROM (SELECT *, list_filter(keys, lambda x: len(keys) < 128 OR x % CAST(power(4, greatest(0, (length(bin(len(keys))) - 6) // 2)) AS BIGINT) = 0) AS part FROM k)
), u AS (SELECT i, own, unnest(keys) AS key FROM c
), g AS (SELECT u.*, coalesce(docs BETWEEN 2 AND greatest(2, 0.02 * (SELECT count(*) FROM d)), FALSE) AS known FROM u LEFT JOIN f USING (key)
), r AS (SELECT i, own, key FROM (SELECT *, bool_or(known) OVER (PARTITION BY i, own) AS any_known FROM g) WHERE known OR NOT any_known
), p AS (
  SELECT z AS family, 1 + CAST('0x' || substr(md5(CAST(z AS VARCHAR)), 1, 7) AS BIGINT) AS a, CAST('0x' || substr(md5(CAST(z AS VARCHAR)), 8, 7) AS BIGINT) AS b FROM range(16) t(z)
), h AS (SELECT i, own, family, key, ((key % 2147483647) * a + b) % 2147483647 AS h FROM r, p
), m AS (SELECT *, h < CAST(power(2, length(bin(min(h) OVER (PARTITION BY i, own, family)))) AS BIGINT) AS inside FROM h
), s AS (
  SELECT i, own, family, substr(md5(string_agg(CAST(key AS VARCHAR), ',' ORDER BY key)), 1, 8) AS s FROM m WHERE inside GROUP BY 1, 2, 3
), l AS (SELECT i, own, list(s ORDER BY family) AS l FROM s GROUP BY 1, 2
)
SELECT e.doc_id, e.n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(o.l, '') AS fingerprint, array_to_string(x.l, '') AS edited_fingerprint,
  len(list_filter(range(1, 17), lambda q: o.l[q] = x.l[q])) / 16.0::DOUBLE AS near_edited, len(list_filter(range(1, 17), lambda q: o.l[q] = y.l[q])) / 16.0::DOUBLE AS near_next
FROM e JOIN l o ON o.i = e.i AND o.own JOIN l x ON x.i = e.i AND NOT x.own JOIN l y ON y.i = e.j AND y.own
"""

# State: the least (cost, audit, repaired text) in which a conversation's turns so far end at start, system, user, assistant.
_OP13 = r"""
WITH RECURSIVE b AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
      lambda c, x: xor(c >> 8, b.t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind FROM conversations, b
), d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS again FROM k WHERE kind <> 0
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), again) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS seen FROM d
), f AS (
  SELECT *, CASE WHEN seen = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(seen, 1) IN ('.', '!', '?') THEN '' ELSE 't' END AS fault,
    role[1] AS o, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au') AS illegal FROM n
), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {'c': CAST(0 AS BIGINT), 'a': '', 'r': ''} AS z, {'c': CAST(1e15 AS BIGINT), 'a': '', 'r': ''} AS s, {'c': CAST(1e15 AS BIGINT), 'a': '', 'r': ''} AS u, {'c': CAST(1e15 AS BIGINT), 'a': '', 'r': ''} AS a
  FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT conv_id, i,
    {'c': z.c + 3, 'a': z.a || 'D', 'r': z.r},
    list_min([{'c': s.c + 3, 'a': s.a || 'D', 'r': s.r}, {'c': z.c + stay + CASE WHEN o = 's' THEN 0 ELSE 1e15::BIGINT END, 'a': z.a || 'K', 'r': z.r || own || chr(10)}]),
    list_min(list_concat([{'c': u.c + 3, 'a': u.a || 'D', 'r': u.r}], list_transform([z, s, a], lambda p: {'c': p.c + stay + CASE WHEN o = 'u' THEN 0 ELSE 2 END, 'a': p.a || CASE WHEN o = 'u' THEN 'K' ELSE 'R' END, 'r': p.r || CASE WHEN o = 'u' THEN own ELSE 'user:' || text END || chr(10)}))),
    list_min([{'c': a.c + 3, 'a': a.a || 'D', 'r': a.r}, {'c': u.c + stay + CASE WHEN o = 'a' THEN 0 ELSE 2 END, 'a': u.a || CASE WHEN o = 'a' THEN 'K' ELSE 'R' END, 'r': u.r || CASE WHEN o = 'a' THEN own ELSE 'assistant:' || text END || chr(10)}])
  FROM (
    SELECT w.conv_id, f.i, f.o, f.text, f.role || ':' || f.text AS own, CASE WHEN fault IN ('b', 'd') THEN CAST(1e15 AS BIGINT) WHEN fault = 't' THEN 1 ELSE 0 END AS stay, z, s,
      list_min([u, {'c': z.c + 2, 'a': z.a || 'I', 'r': z.r || 'user:' || chr(10)}, {'c': s.c + 2, 'a': s.a || 'I', 'r': s.r || 'user:' || chr(10)}, {'c': a.c + 2, 'a': a.a || 'I', 'r': a.r || 'user:' || chr(10)}]) AS u,
      list_min([a, {'c': u.c + 2, 'a': u.a || 'I', 'r': u.r || 'assistant:' || chr(10)}, {'c': z.c + 4, 'a': z.a || 'II', 'r': z.r || 'user:' || chr(10) || 'assistant:' || chr(10)}, {'c': s.c + 4, 'a': s.a || 'II', 'r': s.r || 'user:' || chr(10) || 'assistant:' || chr(10)}]) AS a
    FROM walk w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1
  )
), e AS (
  SELECT conv_id, list_min([z, a, {'c': u.c + 2, 'a': u.a || 'I', 'r': u.r || 'assistant:' || chr(10)}, {'c': z.c + 4, 'a': z.a || 'II', 'r': z.r || 'user:' || chr(10) || 'assistant:' || chr(10)}, {'c': s.c + 4, 'a': s.a || 'II', 'r': s.r || 'user:' || chr(10) || 'assistant:' || chr(10)}]) AS x
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM walk) WHERE back = 1
), t AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM f GROUP BY 1
)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(x.c, 0) AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(CASE WHEN x.r <> '' THEN left(x.r, CAST(length(x.r) - 1 AS BIGINT)) END, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN t ON i.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN e ON i.conv_id IS NOT DISTINCT FROM e.conv_id
"""

ORACLE_SQL: dict[str, str] = {"op2_warc": _OP2, "op3_mixing": _OP3, "op7_multi_index": _OP7, "op8_line_dedup": _OP8, "op10_decontamination": _OP10, "op11_filter_audit": _OP11, "op12_imatch": _OP12, "op13_conversation_repair": _OP13}
