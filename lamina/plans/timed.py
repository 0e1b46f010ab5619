"""Queries over event time, versions and space, each beside SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, spatial
from ..sources.versions import VersionedTable
from ..streaming import timed
from .lineage import fresh_path
from .registry import query

#: Events stand about seven hours apart; so many times as fast, messages are replaced or run out about equally often.
FASTER = 15_000


@query(f"""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) // {FASTER} AS tm FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL AND event_id IS NOT NULL),
n AS (SELECT *, lead(tm) OVER (PARTITION BY user_id ORDER BY tm, event_id) AS following FROM e),
u AS (SELECT event_id, CAST(user_id AS VARCHAR) AS who, tm, least(tm + 1800000, coalesce(following, tm + 1800000)) AS until, coalesce(following < tm + 1800000, FALSE) AS replaced FROM n)
SELECT event_id, who, make_timestamp(tm) AS shown, make_timestamp(until) AS until, replaced FROM u WHERE until <= (SELECT max(tm) // 1000 * 1000 - 10000000 FROM e)
""", paths=True)
def stream_message_expiry(spark, d):
    """Events as a stream of messages: each goes after 1.8 seconds by a timer, or when the user's next one comes. Those that the watermark hasn't passed yet are still shown."""
    events = timed.file_stream(spark, f"{d}/events.parquet", None).withColumn("at", F.expr(f"timestamp_micros(unix_micros(CAST(ts AS TIMESTAMP)) div {FASTER})"))
    gone = timed.drained(timed.messages(timed.in_time(events, "user_id", "at", "event_id", F.lit("{}"), "10 seconds")), "messages")
    return gone.select(F.col("number").alias("event_id"), F.col("key").alias("who"), F.col("shown").cast("timestamp_ntz").alias("shown"), F.col("until").cast("timestamp_ntz").alias("until"), "replaced")


@query("""
WITH e AS (SELECT *, coalesce(ts > lag(ts) OVER w + INTERVAL 6 HOURS, TRUE) AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(starts::INT) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM e)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOURS AS ended, count(*) AS n, round(sum(value), 4) AS total FROM r GROUP BY user_id, run
""")
def user_sessions(t):
    """Runs of a user's events without a pause of six hours."""
    return timed.sessions(t("events"), "user_id", "ts", "6 hours", sum=F.sum("value")).withColumn("total", F.round("sum", 4)).drop("sum")


LINE = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double"


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS rn FROM lineitem WHERE l_orderkey IS NOT NULL)
SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, CAST(l_partkey AS BIGINT) AS l_partkey, CAST(l_suppkey AS BIGINT) AS l_suppkey, CAST(l_quantity AS DOUBLE) AS l_quantity
FROM l WHERE rn = 1 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IS NOT NULL)
""", paths=True)
def versioned_upserts(spark, d):
    """Lines as a stream into a versioned table, the last of each order; finished orders are taken out by a batch, which is sent twice, as is the stream."""
    table = VersionedTable(spark, fresh_path(spark, "library"), "l_orderkey", LINE)
    names = [f.split()[0] for f in LINE.split(", ")]
    lines = timed.file_stream(spark, f"{d}/lineitem.parquet", None).select(*(F.col(f.split()[0]).cast(f.split()[1]) for f in LINE.split(", ")))
    checkpoint = fresh_path(spark, "library-checkpoint")
    for _ in range(2):  # started again it has nothing to do
        table.write_stream(lines, checkpoint, "lines", ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).awaitTermination()
    done = spark.read.parquet(f"{d}/orders.parquet").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), *(F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in LINE.split(", ")[1:]))
    for _ in range(2):  # the second time it is known
        table.upsert(done, 0, "finished", delete=F.lit(True))
    return table.read().select(*names)


@query("""
WITH e AS (SELECT event_id, user_id AS k, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 80 + epoch_us(TIMESTAMP '1992-01-01') AS tm FROM events),
o AS (SELECT o_custkey AS k, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS tm, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2)
SELECT event_id, o_orderkey FROM e ASOF LEFT JOIN o ON e.k = o.k AND e.tm >= o.tm
""")
def events_as_of_orders(t):
    """Each event with its user's last order at that time: the clock of events runs eighty times as fast, from the first year of orders on."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    begin = lambda text: F.unix_micros(F.lit(text).cast("timestamp"))
    events = t("events").select("event_id", F.col("user_id").alias("k"), ((micros("ts") - begin("2024-01-01")) * 80 + begin("1992-01-01")).alias("tm"))
    orders = t("orders").select(F.col("o_custkey").alias("k"), micros("o_orderdate").alias("tm"), "o_orderkey")
    return intervals.as_of(events, orders, "k", "tm", F.col("o_orderkey"), 200 * 86_400e6, F.col("o_orderkey")).select("event_id", F.col("found").alias("o_orderkey"))


@query("""
WITH s AS (SELECT o_orderkey, o_custkey, o_orderstatus, epoch_us(CAST(o_orderdate AS TIMESTAMP)) // 86400000000 AS a, epoch_us(CAST(o_orderdate AS TIMESTAMP)) // 86400000000 + o_orderkey % 90 AS b FROM orders)
SELECT x.o_orderkey AS open_order, y.o_orderkey AS done_order, greatest(x.a, y.a) AS first_day, least(x.b, y.b) AS end_day
FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.a < x.b AND y.a < y.b AND x.a < y.b AND y.a < x.b WHERE x.o_orderstatus = 'O' AND y.o_orderstatus <> 'O'
""")
def overlapping_orders(t):
    """Open and other orders of a customer whose days overlap; an order takes 0 to 89 days."""
    day = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000)
    spans = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", day.alias("a"), (day + F.col("o_orderkey") % 90).alias("b"))
    met = intervals.overlaps(spans.filter("o_orderstatus = 'O'"), spans.filter("o_orderstatus <> 'O'"), "o_custkey", "a", "b")
    return met.select(F.col("a.o_orderkey").alias("open_order"), F.col("b.o_orderkey").alias("done_order"), F.greatest("a.a", "b.a").alias("first_day"), F.least("a.b", "b.b").alias("end_day"))


_BOX = "CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey % 25 + 1 END AS grp, l_orderkey * 16 + l_linenumber AS box, CAST(l_partkey * 37 % 9973 AS DOUBLE) AS x, CAST((l_orderkey * 53 + l_suppkey) % 4001 AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS w"
_POINT = "c_custkey AS point, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_nationkey + 1 END AS grp, CAST(c_custkey * 101 % 9973 AS DOUBLE) AS px, CAST(c_custkey * 67 % 6007 AS DOUBLE) AS py"


@query(f"""
WITH b AS (SELECT {_BOX} FROM lineitem), p AS (SELECT {_POINT} FROM customer),
d AS (SELECT point, box, round(sqrt(pow(greatest(x - px, px - x - w, 0), 2) + pow(greatest(y - py, py - y - w / 2, 0), 2)), 6) AS distance FROM p JOIN b USING (grp)),
r AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY distance, box) AS rn FROM d)
SELECT point, box, distance FROM r WHERE rn = 1
""")
def nearest_boxes(t):
    """Each customer's nearest line, as boxes in scenes of which one has a third of all."""
    boxes = t("lineitem").selectExpr(*_split(_BOX)).selectExpr("grp", "box", "x AS left", "y AS top", "x + w AS right", "y + w / 2 AS bottom")
    found = spatial.nearest_boxes(t("customer").selectExpr(*_split(_POINT)), boxes, 32.0)
    return found.select("point", "box", F.round("distance", 6).alias("distance"))


def _split(columns: str) -> list[str]:
    """The expressions of a select list without commas inside."""
    return [x.strip() for x in columns.split(", ")]
