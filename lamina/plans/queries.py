"""The record operators over the driver's tables, each beside SQL with the same columns and rows.

A query applies an operator by shape: orders stand for layers, customers for assets, events for input events.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, numbers, text
from ..operators import dedupe, frames, lookup, ordered, sheet
from ..sources import library
from ..streaming import reducers
from .registry import query

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey")


# --- lookups and joins ---------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def keyed_lookup_inner(t):
    customers = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return lookup.keyed(t("orders"), customers, "o_custkey").select("o_orderkey", "c_name", "c_mktsegment", "o_totalprice")


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem)
SELECT o_orderkey, l_partkey, l_quantity FROM orders LEFT JOIN l ON l_orderkey = o_orderkey AND rn = 1
""")
def keyed_lookup_left(t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity", F.struct(*LINE_ORDER).alias("place"))
    return lookup.keyed(t("orders"), lines, "o_orderkey", "left", "place").select("o_orderkey", "l_partkey", "l_quantity")


@query("""
WITH r AS (
  SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber = 3 THEN 0 WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS arm,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber = 3 THEN 0 WHEN l_returnflag = 'R' THEN 1 ELSE 2 END, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem)
SELECT o_orderkey, l_partkey AS picked, arm FROM orders LEFT JOIN r ON l_orderkey = o_orderkey AND rn = 1
""")
def priority_pick(t):
    lines = t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return lookup.priority_pick(t("orders").select("o_orderkey"), lines, "o_orderkey", [F.col("l_linenumber") == 3, F.col("l_returnflag") == "R"], [F.col(c) for c in LINE_ORDER], F.col("l_partkey"))


@query("SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def flatten_outer(t):
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(*LINE_ORDER)).alias("lines"))  # lines of one order
    return t("orders").join(lines, "o_orderkey", "left").select("o_orderkey", F.explode_outer("lines").alias("l")).select("o_orderkey", "l.*")


@query("""
WITH p AS (
  SELECT a.s_suppkey, b.s_suppkey AS near, round(abs(a.s_acctbal - b.s_acctbal), 2) AS distance, CASE WHEN b.s_nationkey % 2 = 0 THEN 20 ELSE 200 END AS reach,
    row_number() OVER (PARTITION BY a.s_suppkey ORDER BY abs(a.s_acctbal - b.s_acctbal), b.s_suppkey) AS rn
  FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey)
SELECT s_suppkey, near, distance, CAST(reach AS DOUBLE) AS reach FROM p WHERE rn = 1 AND distance <= reach
""")
def nearest_in_radius(t):
    """On a line only the neighbours in order can be nearest, so no pairs are formed; neighbours across ranges come from the ranges' ends."""
    s = t("supplier").select("s_suppkey", "s_acctbal", F.when(F.col("s_nationkey") % 2 == 0, 20.0).otherwise(200.0).alias("reach"))
    least_two = s.groupBy("s_acctbal").agg(F.min("s_suppkey").alias("one"))
    second = s.join(least_two, "s_acctbal").filter("s_suppkey > one").groupBy("s_acctbal").agg(F.min("s_suppkey").alias("two"))
    values = s.groupBy("s_acctbal").agg(F.min_by(F.struct("s_suppkey", "reach"), "s_suppkey").alias("first")).withColumn("range", F.floor(F.col("s_acctbal") / 50))
    point = F.struct("s_acctbal", "first")
    ends = values.groupBy("range").agg(F.min_by(point, "s_acctbal").alias("low"), F.max_by(point, "s_acctbal").alias("high"))
    across = Window.orderBy("range")  # a row for each range of values
    ends = ends.select("range", F.lag("high").over(across).alias("before"), F.lead("low").over(across).alias("after"))
    line = Window.partitionBy("range").orderBy("s_acctbal")
    beside = values.select("s_acctbal", "range", F.lag(point).over(line).alias("l"), F.lead(point).over(line).alias("r")).join(F.broadcast(ends), "range")
    beside = beside.select("s_acctbal", F.coalesce("l", "before").alias("l"), F.coalesce("r", "after").alias("r"))
    # Of those with the same value the least other one is nearest.
    twins = least_two.join(second, "s_acctbal").join(s.select(F.col("s_suppkey").alias("one"), F.col("reach").alias("reach_one")), "one").join(s.select(F.col("s_suppkey").alias("two"), F.col("reach").alias("reach_two")), "two")
    rows = s.drop("reach").join(beside, "s_acctbal").join(twins, "s_acctbal", "left")
    option = lambda near, d: F.when(near.isNotNull(), F.struct(d.alias("distance"), near["s_suppkey"].alias("near"), near["reach"].alias("reach")))
    left, right = option(F.col("l.first"), F.col("s_acctbal") - F.col("l.s_acctbal")), option(F.col("r.first"), F.col("r.s_acctbal") - F.col("s_acctbal"))
    own = F.col("s_suppkey") == F.col("one")
    same = F.when(F.col("one").isNotNull(), F.struct(F.lit(0.0).alias("distance"), F.when(own, F.col("two")).otherwise(F.col("one")).alias("near"), F.when(own, F.col("reach_two")).otherwise(F.col("reach_one")).alias("reach")))
    best = F.array_min(F.filter(F.array(left, right, same), lambda x: x.isNotNull()))
    return rows.select("s_suppkey", best.alias("x")).select("s_suppkey", "x.near", F.round("x.distance", 2).alias("distance"), "x.reach").filter("distance <= reach")


@query("""
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
UNION ALL SELECT o_orderkey, 1, 0.0 FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
""")
def anti_append(t):
    templates = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("l_quantity"))
    return lookup.missing_rows(templates, t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey")


@query("""
WITH c AS (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey FROM orders SEMI JOIN c USING (o_orderkey)
""")
def semi_exists(t):
    return t("orders").join(t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey")


@query("""
SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'fail' ELSE 'go' END AS status, c_name AS target
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey
""")
def link_lookup(t):
    targets = t("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("target"), F.lit("go").alias("status"))
    return lookup.keyed(t("orders"), targets, "o_custkey", "left").select("o_orderkey", F.coalesce("status", F.lit("fail")).alias("status"), "target")


@query("""
WITH m AS (SELECT n_nationkey, p_partkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY p_partkey) AS rn FROM nation JOIN part ON lower(substr(n_name, 1, 1)) = lower(substr(p_name, 1, 1)))
SELECT n_nationkey, p_partkey FROM m WHERE rn = 1
""")
def binding_match(t):
    keys = t("nation").select("n_nationkey", F.lower(F.substring("n_name", 1, 1)).alias("k"))
    first = t("part").groupBy(F.lower(F.substring("p_name", 1, 1)).alias("k")).agg(F.min("p_partkey").alias("p_partkey"))
    return keys.join(first, "k").select("n_nationkey", "p_partkey")


@query("SELECT min(l_orderkey) AS l_orderkey, count(*) AS n FROM lineitem WHERE l_partkey = 10")
def reverse_lookup(t):
    return t("lineitem").filter("l_partkey = 10").agg(F.min("l_orderkey").alias("l_orderkey"), F.count("*").alias("n"))


# --- upserts and deletes -------------------------------------------------------------------------


@query("""
WITH i AS (SELECT p_partkey, p_name, p_retailprice * 2 AS p_retailprice FROM part WHERE p_size = 7 UNION ALL SELECT p_partkey + 1000000, p_name, p_retailprice FROM part WHERE p_size = 8)
SELECT p_partkey, p_name, p_retailprice, 0 AS side FROM i
UNION ALL SELECT p_partkey, p_name, p_retailprice, 1 FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM i)
""")
def upsert_prepend(t):
    base = t("part").select("p_partkey", "p_name", "p_retailprice")
    changed = t("part").filter("p_size = 7").select("p_partkey", "p_name", (F.col("p_retailprice") * 2).alias("p_retailprice"))
    new = t("part").filter("p_size = 8").select((F.col("p_partkey") + 1_000_000).alias("p_partkey"), "p_name", "p_retailprice")
    return library.upsert(base, changed.unionByName(new), "p_partkey")


@query("""
SELECT o_orderkey, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_custkey <> (SELECT min(c_custkey) + 6 FROM customer) GROUP BY o_orderkey
""")
def cascade_delete(t):
    gone = t("customer").agg((F.min("c_custkey") + 6).alias("o_custkey"))
    kept = t("orders").join(gone, "o_custkey", "left_anti")
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return kept.join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"))


@query("SELECT 'part' AS kind, p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def bag_union(t):
    return t("part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).unionByName(t("supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query()
def greedy_multikey_dedupe(t):
    """No SQL: whether a row counts depends on all decisions before it. Tests hold it against a plain loop."""
    docs = t("documents").select("doc_id", F.md5("text").alias("same_text"), F.concat_ws("/", "source", "n_chars").alias("same_size"))
    return dedupe.greedy(docs, "doc_id", [F.col("same_text"), F.col("same_size")]).select("doc_id")


# --- aggregates ----------------------------------------------------------------------------------


@query("SELECT greatest(45.0, max(l_quantity) FILTER (WHERE l_returnflag = 'R' AND l_discount > 0.05)) AS frames FROM lineitem")
def filtered_max_seed(t):
    return lookup.frame_count(t("lineitem"), 45, (F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05), F.col("l_quantity"))


@query("SELECT greatest(max(p_size), 33) + 1.0 AS \"zIndex\" FROM part")
def next_position(t):
    return lookup.next_z(t("part").withColumn("zIndex", F.col("p_size").cast("double")), 33.0)


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_custkey <> 7) AS after FROM orders")
def counts(t):
    return t("orders").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.count_if(F.col("o_custkey") != 7).alias("after"))


@query("""
SELECT 'x' AS axis, CAST(hour(ts) AS INTEGER) AS i, count(*) FILTER (WHERE value > 24) AS n FROM events GROUP BY 2
UNION ALL SELECT 'y', CAST(minute(ts) AS INTEGER), count(*) FILTER (WHERE value > 24) FROM events GROUP BY 2
""")
def axis_histogram(t):
    line = lambda axis, i: t("events").groupBy(i.alias("i")).agg(F.count_if(F.col("value") > 24).alias("n")).select(F.lit(axis).alias("axis"), "i", "n")
    return line("x", F.hour("ts")).unionByName(line("y", F.minute("ts")))


@query("""
WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)
SELECT user_id, median(gap) AS median_gap FROM g GROUP BY user_id
""")
def median_gap(t):
    return ordered.median_gap(t("events"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")))


@query("""
SELECT event_type, round(coalesce(sum(hour(ts) * value) FILTER (WHERE value > 24) / nullif(sum(value) FILTER (WHERE value > 24), 0), 12.0), 6) AS centre FROM events GROUP BY event_type
""")
def weighted_centroid(t):
    seen, w = F.col("value") > 24, F.col("value")
    total = F.sum(F.when(seen, w))
    return t("events").groupBy("event_type").agg(F.round(F.coalesce(F.sum(F.when(seen, F.hour("ts") * w)) / F.nullif(total, F.lit(0.0)), F.lit(12.0)), 6).alias("centre"))


@query("SELECT p_partkey, round(p_size * (SELECT least(500.0 / max(p_size), 9000.0 / max(p_retailprice)) FROM part), 6) AS scaled FROM part")
def uniform_scale(t):
    scale = t("part").agg(F.least(500.0 / F.max("p_size"), 9000.0 / F.max("p_retailprice")).alias("s"))
    return t("part").join(F.broadcast(scale), F.lit(True)).select("p_partkey", F.round(F.col("p_size") * F.col("s"), 6).alias("scaled"))


@query("""
SELECT n_nationkey, min(c_acctbal) AS low, max(c_acctbal) AS high, count(c_custkey) AS n FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) ON c_nationkey = n_nationkey GROUP BY 1
""")
def bounding_box(t):
    boxes = t("customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"), F.count("*").alias("n"))
    return t("nation").select("n_nationkey").join(boxes, "n_nationkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("SELECT DISTINCT p_brand, p_size FROM part")
def distinct_set(t):
    return t("part").select("p_brand", "p_size").distinct()


# --- order ---------------------------------------------------------------------------------------


def hourly(t) -> DataFrame:
    """Events of each hour; hours are numbered through all days."""
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    return t("events").groupBy(hour.alias("i")).agg(F.count("*").alias("n"), F.lit(0).alias("axis"))


RUNS = """
WITH h AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS i, count(*) AS n FROM events GROUP BY 1),
above AS (SELECT i, i - row_number() OVER (ORDER BY i) AS island FROM h WHERE n > 14),
raw AS (SELECT min(i) AS a, max(i) + 1 AS b FROM above GROUP BY island),
marked AS (SELECT a, b, CASE WHEN a - lag(b) OVER (ORDER BY a) <= 1 THEN 0 ELSE 1 END AS opens FROM raw),
numbered AS (SELECT a, b, sum(opens) OVER (ORDER BY a ROWS UNBOUNDED PRECEDING) AS run FROM marked),
runs AS (SELECT min(a) AS s, max(b) AS e FROM numbered GROUP BY run HAVING max(b) - min(a) >= 3)
"""


@query(RUNS + 'SELECT 0 AS axis, s AS start, e AS "end" FROM runs')
def projection_runs(t):
    return ordered.projection_runs(hourly(t), ["axis"], "i", "n", F.lit(14), F.lit(1), F.lit(3))


def daily_runs(t) -> DataFrame:
    rows = t("events").groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("i")).agg(F.count("*").alias("n"))
    runs = ordered.projection_runs(rows, ["day"], "i", "n", F.lit(15), F.lit(0), F.lit(2))
    return runs.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))


@query("""
WITH h AS (SELECT CAST(ts AS DATE) AS day, hour(ts) AS i, count(*) AS n FROM events GROUP BY 1, 2),
above AS (SELECT day, i, i - row_number() OVER (PARTITION BY day ORDER BY i) AS island FROM h WHERE n > 15),
runs AS (SELECT day, min(i) AS a, max(i) + 1 AS b FROM above GROUP BY day, island HAVING count(*) >= 2),
c AS (SELECT day, list((a + b) / 2.0 ORDER BY a) AS c FROM runs GROUP BY day HAVING count(*) = 2),
m AS (SELECT day, greatest(0, round_even(c[1] - (c[2] - c[1]) / 2, 0)) AS p, round_even((c[1] + c[2]) / 2, 0) AS q, least(24, round_even(c[2] + (c[2] - c[1]) / 2, 0)) AS r FROM c)
SELECT CAST(day AS VARCHAR) AS day, CAST(p AS INTEGER) AS b0, CAST(q AS INTEGER) AS b1, CAST(r AS INTEGER) AS b2 FROM m WHERE p < q AND q < r
""")
def run_boundaries(t):
    bounds = ordered.run_bounds(F.col("runs"), F.lit(2), F.lit(24))
    return daily_runs(t).select("day", bounds.alias("b")).filter("b IS NOT NULL").select(F.col("day").cast("string").alias("day"), *(F.get("b", F.lit(k)).alias(f"b{k}") for k in range(3)))


@query("""
WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) - 1 AS p, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
s AS (SELECT *, min(CASE WHEN p_partkey % 40 = 7 THEN p END) OVER (PARTITION BY p_brand) AS s, min(CASE WHEN p_partkey % 40 = 23 THEN p END) OVER (PARTITION BY p_brand) AS t FROM r),
m AS (SELECT *, CASE WHEN s IS NULL OR t IS NULL THEN p WHEN p = s THEN t WHEN p > s AND p <= t THEN p - 1 WHEN p < s AND p >= t THEN p + 1 ELSE p END AS position FROM s)
SELECT p_partkey, position, (n - position) * 10 AS rank_value FROM m
""")
def reorder_rank(t):
    rows = t("part").select("p_partkey", "p_brand", "p_size")
    moved = ordered.reordered_positions(rows, [F.desc("p_size"), F.asc("p_partkey")], F.col("p_partkey") % 40 == 7, F.col("p_partkey") % 40 == 23, ["p_brand"])
    return moved.select("p_partkey", "position", "rank_value")


@query("SELECT p_partkey, p_partkey % 4 AS \"column\", p_partkey // 4 AS row, (p_partkey % 4) * 256 AS x, (p_partkey // 4) * 256 AS y FROM part")
def grid_position(t):
    cell = geometry.grid_cell(F.col("p_partkey"), 4)
    return t("part").select("p_partkey", cell.alias("c")).select("p_partkey", "c.*", (F.col("c.column") * 256).alias("x"), (F.col("c.row") * 256).alias("y"))


@query("""
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS slot FROM orders)
SELECT o_orderkey, CAST(slot AS INTEGER) AS slot, r_name FROM o JOIN region ON slot = r_regionkey + 1
""")
def positional_zip(t):
    slots = t("region").select((F.col("r_regionkey") + 1).alias("slot"), "r_name")
    return ordered.zipped(t("orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.asc("o_orderkey")], slots).select("o_orderkey", "slot", "r_name")


@query("""
WITH k AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 97 <> 0), n AS (SELECT min(k + 1) AS free FROM k WHERE k + 1 NOT IN (SELECT k FROM k))
SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM k WHERE k = 1) THEN 'Scene Copy' ELSE 'Scene Copy ' || free END AS free FROM n
""")
def first_free_suffix(t):
    names = t("customer").filter("c_custkey % 97 <> 0").select(F.when(F.col("c_custkey") == 1, "Scene Copy").otherwise(F.concat(F.lit("Scene Copy "), F.col("c_custkey").cast("string"))).alias("name"))
    return ordered.first_free_name(names, "name", "Scene")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 24")
def two_key_topk(t):
    return t("orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(24)


@query("SELECT p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS draw_order FROM part")
def stable_z_order(t):
    return t("part").select("p_partkey", "p_size", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")).cast("long").alias("draw_order"))


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE rn = 1
""")
def top_by_z(t):
    return ordered.top_by_z(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey")


EVENT_ORDER = ("ts", "event_id")


@query("""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rn DESC) AS last_events FROM r WHERE rn <= 80 GROUP BY user_id
""")
def bounded_tail(t):
    kept = ordered.ends(t("events"), "user_id", [F.col(c) for c in EVENT_ORDER], F.col("event_id").cast("string"), reducers.HISTORY, last=True)
    return kept.select("user_id", F.array_join(ordered.tail(F.col("values"), reducers.HISTORY), ",").alias("last_events"))


@query("SELECT user_id, arg_min(event_id, ts) AS first_purchase FROM events WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY user_id")
def first_match(t):
    last_type = t("events").agg(F.max("event_type").alias("event_type"))
    return t("events").join(F.broadcast(last_type), "event_type").groupBy("user_id").agg(F.min_by("event_id", "ts").alias("first_purchase"))


# --- texts ---------------------------------------------------------------------------------------

NAME = "p_name || ' / ' || p_brand || '#' || p_type"


def part_names(t) -> DataFrame:
    return t("part").select("p_partkey", F.concat("p_name", F.lit(" / "), "p_brand", F.lit("#"), "p_type").alias("raw"))


@query(f"""
SELECT p_partkey, coalesce(nullif(lower(regexp_replace(regexp_replace({NAME}, '[^a-zA-Z0-9一-龥]+', '_', 'g'), '^_+|_+$', '', 'g')), ''), 'sprite') AS safe,
  coalesce(nullif(regexp_replace(regexp_replace(lower(trim({NAME})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'spritesheet') AS file FROM part
""")
def safe_names(t):
    return part_names(t).select("p_partkey", text.safe_name(F.col("raw")).alias("safe"), text.safe_filename(F.col("raw")).alias("file"))


@query(r"""
WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1), '[<>:"/\\|?*\x00-\x1f]+', '_', 'g'), '\s+', '_', 'g'), '_+', '_', 'g') AS raw FROM pages),
c AS (SELECT page_id, coalesce(nullif(regexp_replace(raw, '^_+|_+$', '', 'g'), ''), 'spritesheet_export.gif') AS safe FROM b)
SELECT page_id, CASE WHEN lower(safe) LIKE '%.gif' THEN safe ELSE regexp_replace(safe, '\.[^.]+$', '') || '.gif' END AS filename FROM c
""")
def download_filenames(t):
    return t("pages").select("page_id", text.download_filename(F.col("url"), "gif").alias("filename"))


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[,\s]+'), lambda x: x <> '')) AS INTEGER) AS n_tags FROM documents")
def split_tags(t):
    return t("documents").select("doc_id", F.size(text.split_tags(F.col("text"))).alias("n_tags"))


@query("SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM pages")
def escape_markup(t):
    return t("pages").select("page_id", F.md5(text.escape_markup(F.col("html"))).alias("escaped"))


@query("""
WITH a AS (SELECT page_id, trim(html, ' ') AS s FROM pages),
b AS (SELECT page_id, CASE WHEN strpos(s, '<body') > 0 THEN substr(s, strpos(s, '<body')) ELSE '<body>' || s || '</body>' END AS s FROM a)
SELECT page_id, md5(CASE WHEN strpos(reverse(s), '>ydob/<') > 0 THEN substr(s, 1, length(s) - strpos(reverse(s), '>ydob/<') + 1) ELSE s END) AS body FROM b
""")
def markup_trim(t):
    return t("pages").select("page_id", F.md5(text.trim_markup(F.col("html"), "body", "<body>")).alias("body"))


@query("""
SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'slime|jelly|blob|squish|bounce') THEN 'slime' WHEN regexp_matches(lower(text), 'coin|spin|rotate|orb|globe') THEN 'coin' WHEN regexp_matches(lower(text), 'fire|flame|burn|plasma|spark|explosion|hot') THEN 'fire'
  WHEN regexp_matches(lower(text), 'sword|slash|blade|strike|cut|impact') THEN 'slash' WHEN regexp_matches(lower(text), 'bird|bat|wing|fly|flight|ghost|hover') THEN 'flyer' ELSE 'astral' END AS family,
  CASE WHEN regexp_matches(lower(text), 'walk|run|走|跑') THEN 'walk' WHEN regexp_matches(lower(text), 'attack|slash|hit|攻击|挥|砍') THEN 'attack' WHEN regexp_matches(lower(text), 'jump|跳') THEN 'jump'
  WHEN regexp_matches(lower(text), 'magic|spell|cast|fire|glow|spark|魔法|施法|火|光|粒子') THEN 'magic' ELSE 'idle' END AS motion FROM documents
""")
def keyword_family(t):
    return t("documents").select("doc_id", text.animation_family(F.col("text")).alias("family"), text.motion(F.col("text")).alias("motion"))


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'auto' WHEN 'F' THEN 'click' ELSE 'KeyF' END AS trigger_value,
  CASE o_orderstatus WHEN 'O' THEN 'scene.' || a || '.loop' WHEN 'F' THEN 'scene.' || a || '.clicked' ELSE 'input.' || a END AS game_state
FROM (SELECT *, lower(regexp_replace(regexp_replace(o_orderpriority, '[^a-zA-Z0-9一-龥]+', '_', 'g'), '^_+|_+$', '', 'g')) AS a FROM orders)
""")
def binding_defaults(t):
    kind = F.when(F.col("o_orderstatus") == "O", "auto").when(F.col("o_orderstatus") == "F", "mouse").otherwise("keyboard")
    return t("orders").select("o_orderkey", text.default_trigger_value(kind).alias("trigger_value"), text.default_game_state(kind, F.col("o_orderpriority")).alias("game_state"))


@query("""
SELECT doc_id, CASE WHEN n_chars <= 0 THEN '0 KB' WHEN n_chars * 700 < 1048576 THEN greatest(1, CAST(floor(n_chars * 700 / 1024.0 + 0.5) AS BIGINT)) || ' KB' ELSE printf('%.1f', n_chars * 700 / 1048576.0) || ' MB' END AS size FROM documents
""")
def file_sizes(t):
    return t("documents").select("doc_id", text.file_size(F.col("n_chars") * 700).alias("size"))


@query("""
SELECT p_partkey, CASE WHEN p_size >= 20 THEN printf('%.2f', p_size / 20.0) || ':1' ELSE '1:' || printf('%.2f', 20.0 / p_size) END AS ratio,
  'rgba(' || p_size || ', ' || (p_partkey % 256) || ', 255, 0.5)' AS colour FROM part
""")
def formatters(t):
    colour = F.format_string("#%02x%02xff", F.col("p_size"), F.col("p_partkey") % 256)
    return t("part").select("p_partkey", text.viewport_ratio(F.col("p_size"), F.lit(20)).alias("ratio"), text.rgba(colour, F.lit(0.5)).alias("colour"))


@query("SELECT page_id, regexp_replace(url, '\\.[^.]+$', '') AS stem, 'url(\"' || url || '\")' AS css FROM pages")
def url_texts(t):
    return t("pages").select("page_id", text.without_extension(F.col("url")).alias("stem"), text.css_url(F.col("url")).alias("css"))


@query("""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 400 ELSE 200 END AS status, CASE WHEN page_id % 3 <> 0 THEN 'sheets/' || page_id || ' a.png' END AS path FROM pages
""")
def guarded_paths(t):
    ending = F.concat(F.col("page_id").cast("string"), F.lit("%20a.png?v=1#x"))
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/generated/a/../../"), ending)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/generated/sheets/"), ending)).otherwise(F.concat(F.lit("https://host.example/generated/sheets/"), ending))
    return t("pages").select("page_id", text.guarded_path(url).alias("x")).select("page_id", "x.*")


@query("SELECT page_id, 'jpg' AS extension, md5(html) AS content FROM pages")
def data_urls(t):
    url = F.concat(F.lit("data:image/jpeg;base64,"), F.regexp_replace(F.base64(F.col("html").cast("binary")), r"\s", ""))
    return t("pages").select("page_id", text.data_url(url).alias("x")).select("page_id", "x.extension", F.md5("x.content").alias("content"))


# --- numbers and states --------------------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice / 8 + 0.5) AS BIGINT) AS half_up, CAST(round_even(l_quantity / 2, 0) AS DOUBLE) AS half_even,
  least(2.5, greatest(0.05, l_discount * 40)) AS clamped FROM lineitem
""")
def rounding(t):
    return t("lineitem").select("l_orderkey", *LINE_ORDER, numbers.round_half_up(F.col("l_extendedprice") / 8).alias("half_up"), F.bround(F.col("l_quantity") / 2, 0).alias("half_even"), numbers.layer_scale(F.col("l_discount") * 40).alias("clamped"))


@query("""
WITH v AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'x' WHEN 3 THEN '1e2' WHEN 4 THEN '2.5' ELSE CAST(o_totalprice AS VARCHAR) END AS v FROM orders),
n AS (SELECT o_orderkey, CASE WHEN v IS NULL THEN 8 WHEN v = '' THEN 0 ELSE try_cast(v AS DOUBLE) END AS n FROM v)
SELECT o_orderkey, CAST(CASE WHEN n IS NULL THEN 8 ELSE greatest(1, least(60, floor(n + 0.5))) END AS INTEGER) AS fps FROM n
""")
def bounded_integers(t):
    k = F.col("o_orderkey") % 6
    value = F.when(k == 1, "").when(k == 2, "x").when(k == 3, "1e2").when(k == 4, "2.5").when(k == 5, F.col("o_totalprice").cast("string"))
    return t("orders").select("o_orderkey", numbers.bounded_integer(value, 8, 1, 60).alias("fps"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'boolean' WHEN 1 THEN 'number' WHEN 2 THEN 'text' ELSE 'number' END AS kind,
  CASE o_orderkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN CAST(o_custkey AS VARCHAR) WHEN 2 THEN o_orderpriority ELSE '16' END AS value,
  o_orderkey % 4 = 3 AS is_sixteen FROM orders WHERE o_custkey <> 16
""")
def state_values(t):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, " true ").when(k == 1, F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).when(k == 2, F.col("o_orderpriority")).otherwise("0x10")
    rows = t("orders").filter("o_custkey <> 16").select("o_orderkey", numbers.state_value(raw).alias("v"))
    return rows.select("o_orderkey", "v.*", numbers.state_matches(F.col("v.kind"), F.col("v.value"), F.lit("1.6e1")).alias("is_sixteen"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS iso, strftime(o_orderdate, '%b %d, %I:%M %p') AS label FROM orders")
def time_texts(t):
    return t("orders").select("o_orderkey", numbers.iso_time(F.date_trunc("second", "o_orderdate")).alias("iso"), numbers.time_label(F.col("o_orderdate")).alias("label"))


@query("""
SELECT p_partkey, array_to_string(list_transform(range(0, 5), lambda i: CAST(round_even(i * (p_size + 1000) / 4.0, 0) AS INTEGER)), ',') AS bounds FROM part
""")
def proportional_bounds(t):
    return t("part").select("p_partkey", F.array_join(F.transform(geometry.proportional_bounds(F.col("p_size") + 1000, F.lit(4)), lambda b: b.cast("string")), ",").alias("bounds"))


@query("""
WITH i AS (SELECT p_partkey, p_size * 7 AS w, CAST(greatest(1, round_even(p_size * 7 * 0.01, 0)) AS INTEGER) AS k FROM part)
SELECT p_partkey, least(w, k) AS x0, greatest(least(w, k) + 1, w - k) AS x1 FROM i
""")
def inset_cells(t):
    w = F.col("p_size") * 7
    return t("part").select("p_partkey", geometry.inset_cell(F.lit(0), F.lit(0), w, w).alias("c")).select("p_partkey", "c.x0", "c.x1")


@query(f"""
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST((l_partkey * 7 + l_linenumber * 31) % 256 AS INTEGER) AS r, CAST((l_suppkey * 37 + l_orderkey) % 256 AS INTEGER) AS g, CAST((l_orderkey * 11 + l_partkey) % 256 AS INTEGER) AS b, CAST(l_quantity AS INTEGER) * 5 AS a FROM lineitem),
s AS (SELECT *, g - greatest(r, b) AS gs, least(r, b) - g AS ms, least(g, b) - r AS cs FROM p),
k AS (SELECT *, CASE WHEN g > 130 AND gs > 35 THEN CASE WHEN gs > 82 THEN 0 ELSE 2 END WHEN r > 120 AND b > 120 AND g < 170 AND ms > 18 THEN CASE WHEN ms > 34 THEN 0 ELSE 3 END
  WHEN a > 0 AND r > 55 AND b > 55 AND g < 115 AND ms > 12 THEN CASE WHEN greatest(r, b) > 150 AND ms > 28 THEN 0 ELSE 4 END WHEN g > 135 AND b > 135 AND r < 130 AND cs > 38 THEN CASE WHEN cs > 72 THEN 0 ELSE 5 END ELSE 1 END AS rule FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE rule WHEN 3 THEN greatest(g + 4, least(r, b)) WHEN 4 THEN greatest(0, least(g + 10, least(r, b) - 36)) ELSE r END AS r,
  CASE rule WHEN 2 THEN least(g, greatest(r, b) + 8) WHEN 5 THEN greatest(0, least(r + 8, least(g, b) - 24)) ELSE g END AS g,
  CASE rule WHEN 3 THEN greatest(g + 4, least(r, b)) WHEN 4 THEN greatest(0, least(g + 10, least(r, b) - 36)) WHEN 5 THEN greatest(0, least(r + 8, least(g, b) - 24)) ELSE b END AS b,
  CAST(CASE rule WHEN 0 THEN 0 WHEN 2 THEN 255 - least(255, trunc((gs - 35) / 47.0 * 255)) WHEN 3 THEN 255 - least(255, trunc((ms - 18) / 16.0 * 255)) WHEN 5 THEN 255 - least(255, trunc((cs - 38) / 34.0 * 255)) ELSE a END AS INTEGER) AS a FROM k
""")
def chroma_key(t):
    part, supp, order = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    values = {"r": (part * 7 + F.col("l_linenumber") * 31) % 256, "g": (supp * 37 + order) % 256, "b": (order * 11 + part) % 256, "a": F.col("l_quantity").cast("int") * 5}
    return sheet.keyed_out(t("lineitem").select("l_orderkey", *LINE_ORDER, *(v.cast("int").alias(k) for k, v in values.items())))


@query("""
SELECT p_partkey, CAST(CASE WHEN p_size <= 22 THEN greatest(4, least(30 - p_size - 4, round_even(15.0 - p_size / 3.0, 0))) ELSE floor((30 - p_size) / 2.0) END AS INTEGER) AS local_x FROM part
""")
def anchor_placement(t):
    return t("part").select("p_partkey", geometry.anchored(F.lit(30), F.col("p_size"), F.col("p_size") / 3, F.lit(15.0)).alias("local_x"))


@query("""
SELECT p_partkey, round(abs(sin(t * 2 * pi())) * -9, 6) AS y, round(cos(t * 2 * pi()) * 3, 6) AS x, round(1 - abs(sin(t * 2 * pi())) * 0.025, 6) AS "scaleY" FROM (SELECT p_partkey, (p_size % 12) / 12.0 AS t FROM part)
""")
def harmonic_motion(t):
    m = geometry.harmonic(F.lit("walk"), F.col("p_size") % 12, 12)
    return t("part").select("p_partkey", m.alias("m")).select("p_partkey", F.round("m.y", 6).alias("y"), F.round("m.x", 6).alias("x"), F.round("m.scaleY", 6).alias("scaleY"))


@query("""
WITH s AS (SELECT p_partkey, CAST(p_retailprice AS BIGINT) AS w, CAST(p_size * 20 AS BIGINT) AS h FROM part), n AS (SELECT *, greatest(1, CAST(floor(greatest(w, h) / CAST(least(w, h) AS DOUBLE) + 0.5) AS BIGINT)) AS n FROM s)
SELECT p_partkey, CASE WHEN w >= h THEN greatest(1, w // n) ELSE w END AS width, CASE WHEN w >= h THEN h ELSE greatest(1, h // n) END AS height FROM n
""")
def frame_inference(t):
    w, h = F.bround(F.col("p_retailprice")).cast("long"), (F.col("p_size") * 20).cast("long")
    return t("part").select("p_partkey", geometry.inferred_frame(w, h).alias("f")).select("p_partkey", "f.*")


# --- generators and states over time -------------------------------------------------------------


@query("SELECT r_regionkey, CAST(i AS INTEGER) AS frame, round(i * 2 * pi() / 12, 6) AS phase FROM region, range(0, 12) t(i)")
def procedural_frames(t):
    return frames.procedural(t("region"), "r_name", F.lit(12)).select("r_regionkey", "frame", F.round("phase", 6).alias("phase"))


@query("SELECT n_nationkey, CAST(i AS INTEGER) AS frame, i % 4 * 64 AS x, i // 4 * 48 AS y FROM nation, range(0, 16) t(i) WHERE i < 12 + n_nationkey % 2 * 4")
def frame_windows(t):
    count = frames.generation_size(F.when(F.col("n_nationkey") % 2 == 1, 16).otherwise(11))
    return frames.windows(t("nation"), count, F.lit(4), F.lit(64), F.lit(48)).select("n_nationkey", "frame", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


@query("""
WITH e AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS v FROM events GROUP BY 1)
SELECT user_id, array_to_string(CASE WHEN len(v) >= 16 THEN v[1:16] ELSE list_concat(v, list_transform(range(0, 16 - len(v)), lambda i: v[-1])) END, ',') AS padded FROM e
""")
def padded_frames(t):
    kept = ordered.ends(t("events"), "user_id", [F.col(c) for c in EVENT_ORDER], F.col("event_type"), 16)
    return kept.select("user_id", F.array_join(ordered.padded(F.col("values"), F.lit(16)), ",").alias("padded"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, value - 100 AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, 0 AS i, 0.0::DOUBLE AS acc FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT f.user_id, e.i, least(500.0, greatest(0.0, acc + d)) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, round(arg_max(acc, i), 4) AS position FROM f GROUP BY user_id
""")
def clamped_fold(t):
    return reducers.clamped_fold(t("events"), "user_id", list(EVENT_ORDER), F.col("value") - 100, 0, 500).select("user_id", F.round("position", 4).alias("position"))


@query("SELECT event_id, CAST(floor(value * 12 / 1000) % 16 AS INTEGER) AS frame FROM events")
def frame_ticker(t):
    return t("events").select("event_id", frames.ticker(F.col("value"), F.lit(12), 16).alias("frame"))


@query("""
SELECT event_id, CAST(least(ts + INTERVAL 1800 MILLISECONDS, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts), ts + INTERVAL 1800 MILLISECONDS)) AS TIMESTAMP) AS until FROM events
""")
def message_expiry(t):
    return reducers.shown_until(t("events"), "user_id", "ts").select("event_id", "until")


def commands(t) -> DataFrame:
    kinds = ["undo", "redo", "change", "change", "motion"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.pmod(F.xxhash64("event_id"), F.lit(len(kinds))) + 1).cast("int"))
    event = F.to_json(F.struct(kind.alias("kind"), F.col("event_type").alias("target"), F.lit("s").alias("scene")))
    return t("events").select(F.col("user_id").cast("string").alias("session_id"), F.struct("ts", "event_id").alias("seq"), event.alias("event"))


@query()
def undo_redo(t):
    """No SQL: two stacks. Tests hold it against a plain loop."""
    return reducers.fold(commands(t), "history")


@query()
def walk_fold(t):
    """No SQL: rounding and clamping at every step. Tests hold it against a plain loop."""
    event = F.to_json(F.struct(F.when(F.col("value") > 60, "left").otherwise("right").alias("kind"), (F.col("value") / 2).alias("ms")))
    rows = t("events").select(F.col("user_id").cast("string").alias("session_id"), F.struct("ts", "event_id").alias("seq"), event.alias("event"))
    return reducers.fold(rows, "walk", start=json.loads('{"x": 100.0, "width": 64.0}'))


@query("""
WITH r AS (SELECT o_orderkey, o_orderdate, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, o_orderdate, c_name, o_totalprice FROM r ORDER BY o_orderdate DESC, o_orderkey LIMIT 100
""")
def flagship(t):
    """Lookup, derive, stable order: the newest orders with their customers."""
    customers = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    found = lookup.keyed(t("orders"), customers, "o_custkey").select("o_orderkey", "o_orderdate", "c_name", "o_totalprice")
    return found.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)
