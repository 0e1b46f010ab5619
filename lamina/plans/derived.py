"""Queries over differences of versions, typed states, links, grouping sets and sketches, each beside SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import variant
from ..operators import difference, reach, sketches
from .lineage import fresh_path
from .registry import query
from .scenes import WITH, nested

CHANGED, GONE = "scene % 3 <> 2 AND scene % 11 <> 0", "scene % 11 = 0"


@query(WITH + f""", s AS (SELECT DISTINCT scene FROM l), kept AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY ordinal) AS rn, count(*) OVER (PARTITION BY scene) AS n FROM l WHERE {CHANGED} AND part % 7 <> 0),
placed AS (SELECT *, CASE WHEN scene % 10 = 0 THEN n - rn + 1 ELSE rn END AS place FROM kept), size AS (SELECT scene, count(*) FILTER (WHERE part % 7 <> 0) AS n FROM l WHERE {CHANGED} GROUP BY scene)
SELECT scene, NULL AS list, NULL AS id, CAST(NULL AS INTEGER) AS occurrence, 'deleted' AS change, FALSE AS moved, '' AS paths, CAST(NULL AS INTEGER) AS was, CAST(NULL AS INTEGER) AS now FROM s WHERE {GONE}
UNION ALL SELECT -scene - 1, NULL, NULL, NULL, 'inserted', FALSE, '', NULL, NULL FROM s WHERE {GONE}
UNION ALL SELECT scene, NULL, NULL, NULL, 'changed', FALSE, 'cameraX', NULL, NULL FROM s WHERE {CHANGED} AND scene % 4 = 1
UNION ALL SELECT scene, 'layers', scene || '-' || ordinal, 1, 'deleted', FALSE, '', ordinal, NULL FROM l WHERE {CHANGED} AND part % 7 = 0
UNION ALL SELECT scene, 'layers', scene || '-new', 1, 'inserted', FALSE, '', NULL, CAST(n AS INTEGER) FROM size WHERE scene % 4 = 1
UNION ALL SELECT scene, 'layers', scene || '-' || ordinal, 1, CASE WHEN part % 5 = 1 THEN 'changed' END, place <> rn, CASE WHEN part % 5 = 1 THEN 'name,opacity' ELSE '' END, ordinal, CAST(place - 1 AS INTEGER) FROM placed WHERE part % 5 = 1 OR place <> rn
""")
def library_differences(t):
    """A library against its next version: scenes that come, go and change, layers that are inserted, deleted, changed and moved; every third scene stays."""
    old = nested(t)
    layers = F.transform(F.filter("layers", lambda x: x["part"] % 7 != 0), lambda x: F.when(x["part"] % 5 == 1, x.withField("opacity", F.lit(0.25)).withField("name", F.concat(x["name"], F.lit("!")))).otherwise(x))
    layers = F.when(F.col("scene") % 10 == 0, F.reverse(layers)).otherwise(layers)
    added = F.get("layers", F.lit(0)).withField("id", F.concat(F.col("scene").cast("string"), F.lit("-new")))
    layers = F.when(F.col("scene") % 4 == 1, F.concat(layers, F.array(added))).otherwise(layers)
    altered = F.expr(CHANGED)
    new = old.withColumn("layers", F.when(altered, layers).otherwise(F.col("layers")))
    new = new.withColumn("cameraX", F.when(altered & (F.col("scene") % 4 == 1), F.col("cameraX") + 1).otherwise(F.col("cameraX")))
    new = new.withColumn("scene", F.when(F.expr(GONE), -F.col("scene") - 1).otherwise(F.col("scene")))
    return difference.changes(old, new, "scene", {"layers": "id"}).withColumn("paths", F.array_join("paths", ","))


@query("""
WITH a AS (SELECT l_partkey, l_suppkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL), b AS (SELECT l_partkey, l_suppkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
SELECT l_partkey, l_suppkey, l_returnflag, CAST(coalesce(b.n, 0) - coalesce(a.n, 0) AS BIGINT) AS more FROM a FULL JOIN b USING (l_partkey, l_suppkey, l_returnflag) WHERE coalesce(b.n, 0) <> coalesce(a.n, 0)
""")
def line_bag_difference(t):
    """Of which lines there are more, and how many more, among the finished than among the open ones."""
    rows = lambda status: t("lineitem").filter(F.col("l_linestatus") == status).select("l_partkey", "l_suppkey", "l_returnflag")
    return difference.bag_difference(rows("O"), rows("F"))


def states(t):
    """Each order's state: texts of all kinds."""
    text = lambda c: F.col(c).cast("string")
    pairs = {"status": text("o_orderstatus"), "total": F.concat(F.lit(" "), (F.col("o_orderkey") % 1000 + 0.5).cast("string")), "door.open": F.when(F.col("o_orderkey") % 2 == 0, "true").otherwise("false"), "key": text("o_orderkey"), "blank": F.lit("")}
    return t("orders").select("o_orderkey", F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))).alias("state"))


@query("""
SELECT o_orderkey, o_orderkey % 1000 + 0.5 AS total, o_orderkey % 2 = 0 AS open, o_orderstatus AS status, o_orderkey + 1 AS next_key, 'boolean,number,text,number,text' AS kinds, 6 AS n_keys,
  o_orderkey % 2 = 0 AS open_holds, o_orderkey % 1000 = 7 AS total_is, o_orderstatus = 'F' AS status_is, FALSE AS blank_holds, FALSE AS nothing_holds, o_orderkey % 1000 || '.5' AS total_text FROM orders
""")
def typed_states(t):
    """States as VARIANT objects: values keep their kinds through an upsert and a round trip by JSON."""
    rows = states(t).select("o_orderkey", variant.typed_state(F.col("state")).alias("v"))
    rows = rows.withColumn("v", variant.put(variant.put(F.col("v"), "key", (F.col("o_orderkey") + 1).cast("variant")), "seen", F.lit(True).cast("variant")))
    rows = rows.withColumn("v", F.parse_json(F.to_json("v"))).withColumn("e", variant.entries(F.col("v")))
    at = lambda key: variant.get(F.col("e"), key)
    kinds = F.concat_ws(",", *(variant.kind(at(k)) for k in ("door.open", "total", "status", "key", "blank")))
    return rows.select(
        "o_orderkey", F.try_variant_get(at("total"), "$", "double").alias("total"), F.try_variant_get(at("door.open"), "$", "boolean").alias("open"), F.try_variant_get(at("status"), "$", "string").alias("status"),
        F.try_variant_get(at("key"), "$", "bigint").alias("next_key"), kinds.alias("kinds"), F.size("e").alias("n_keys"), variant.matches(at("door.open"), F.lit("")).alias("open_holds"),
        variant.matches(at("total"), F.lit("7.50")).alias("total_is"), variant.matches(at("status"), F.lit(" F ")).alias("status_is"), variant.matches(at("blank"), F.lit("")).alias("blank_holds"),
        variant.matches(at("none"), F.lit(None).cast("string")).alias("nothing_holds"), variant.text(at("total")).alias("total_text"),
    )


@query("""SELECT o_orderstatus, 'OBJECT<blank: STRING, `door.open`: BOOLEAN, key: BIGINT, status: STRING, total: DOUBLE>' AS kind, count(*) AS n FROM orders GROUP BY o_orderstatus""")
def state_schemas(t):
    """The one schema of all states of each order status."""
    rows = states(t).join(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey").select("o_orderstatus", variant.typed_state(F.col("state")).alias("v"))
    return rows.groupBy("o_orderstatus").agg(F.schema_of_variant_agg("v").alias("kind"), F.count("*").alias("n"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b, l_returnflag AS f FROM lineitem),
r(node, steps) USING KEY (node) AS (SELECT p_partkey, CAST(0 AS INTEGER) FROM part WHERE p_size = 1 UNION SELECT DISTINCT e.b, r.steps + 1 FROM r JOIN e ON e.a = r.node WHERE e.b IS NOT NULL AND e.f = 'R' AND NOT EXISTS (SELECT 1 FROM recurring.r AS q WHERE q.node = e.b))
SELECT node, steps FROM r
""")
def reachable_parts(t):
    """Parts as scenes, linked from a returned line to the next line of its order: which are reached from the smallest parts, and by how many links."""
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    links = t("lineitem").select(F.col("l_partkey").alias("source"), following.alias("target"), "l_returnflag").filter("l_returnflag = 'R'")
    return reach.reachable(links, t("part").filter("p_size = 1").select("p_partkey"))


@query("""
SELECT l_returnflag, l_linestatus, year(l_shipdate) AS ship_year, CAST(grouping(l_returnflag) * 4 + grouping(l_linestatus) * 2 + grouping(year(l_shipdate)) AS BIGINT) AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity, max(l_extendedprice) AS dearest
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, year(l_shipdate))
""")
def line_cube(t):
    """Lines by flag, status and year, and every total of these, by one aggregation."""
    rows = t("lineitem").withColumn("ship_year", F.year("l_shipdate").cast("long"))
    return rows.cube("l_returnflag", "l_linestatus", "ship_year").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.max("l_extendedprice").alias("dearest"))


@query("""
SELECT CAST(date_trunc('month', ts) AS DATE) AS month, event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(value) AS least, max(value) AS most, TRUE AS users_near, TRUE AS quantiles_near
FROM events WHERE ts IS NOT NULL GROUP BY ALL
""", paths=True)
def event_sketches(spark, d):
    """Sketches of each day's events, stored and then put together to months, beside what the events themselves say: counts of users within five standard errors, quantiles within the rank error."""
    events, path, by = spark.read.parquet(f"{d}/events.parquet"), fresh_path(spark, "sketches"), ["event_type"]
    sketches.daily(events, "ts", by, F.col("user_id"), F.col("value")).write.parquet(path)
    ranks = (0.1, 0.5, 0.9, 0.99)
    months = sketches.merged(spark.read.parquet(path), "month", by).select(F.col("day").alias("month"), "event_type", "n", "least", "most", sketches.distinct_estimate().alias("estimate"), F.array(*map(sketches.quantile, ranks)).alias("q"))
    own = events.filter("ts IS NOT NULL").withColumn("month", F.trunc(F.to_date("ts"), "month"))
    exact = own.groupBy("month", "event_type").agg(F.count_distinct("user_id").alias("users"))
    # The rank of a quantile: how many numbers are below it, and how many are at most it.
    met = own.filter("value IS NOT NULL AND NOT isnan(value)").select("month", "event_type", "value").join(months.select("month", "event_type", "q"), ["month", "event_type"])
    below = met.groupBy("month", "event_type").agg(F.count("*").alias("k"), *(F.count_if(F.col("value") < F.get("q", F.lit(i))).alias(f"b{i}") for i in range(len(ranks))), *(F.count_if(F.col("value") <= F.get("q", F.lit(i))).alias(f"m{i}") for i in range(len(ranks))))
    near = F.lit(True)
    for i, r in enumerate(ranks):
        near = near & (F.col(f"b{i}") / F.col("k") <= r + sketches.RANK_ERROR) & (F.col(f"m{i}") / F.col("k") >= r - sketches.RANK_ERROR)
    done = months.join(exact, ["month", "event_type"]).join(below, ["month", "event_type"], "left")
    return done.select("month", "event_type", "n", "users", "least", "most", (F.abs(F.col("estimate") - F.col("users")) <= F.greatest(F.lit(1.0), 5 * sketches.STANDARD_ERROR * F.col("users"))).alias("users_near"), F.coalesce(near, F.lit(True)).alias("quantiles_near"))
