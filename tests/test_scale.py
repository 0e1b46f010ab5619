"""What must hold for large tables, seen on small ones: plans, counts of rows and of calls."""

from pyspark.sql import functions as F

from lamina.operators import lookup


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_missing_rows_broadcasts_no_exploded_rows(spark):
    rows = spark.range(50).select(F.explode(F.sequence(F.lit(0), F.lit(9))).alias("n"), "id").select((F.col("id") * 10 + F.col("n")).alias("k"))
    got = lookup.missing_rows(spark.range(600).withColumnRenamed("id", "k"), rows, "k")
    assert "BroadcastHashJoin" not in plan_of(got) and got.count() == got.distinct().count() == 600


def test_far_points_read_few_boxes_of_a_cloud(spark, monkeypatch):
    from lamina.operators import spatial

    rows, plain = [], spatial.cut

    def counted(df):
        out = plain(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(spatial, "cut", counted)
    h = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("double")
    boxes = spark.range(2000).select(F.col("id").alias("box"), F.lit("a").alias("grp"), h(1, 100).alias("left"), h(2, 100).alias("top")).withColumns({"right": F.col("left") + 1, "bottom": F.col("top") + 1})
    points = spark.range(200).select(F.col("id").alias("point"), F.lit("a").alias("grp"), (h(3, 100) + 5000).alias("px"), h(4, 100).alias("py"))
    got = {(r.point, r.box) for r in spatial.nearest_boxes(points, boxes, 1.0).collect()}
    distance = F.hypot(F.greatest(F.col("left") - F.col("px"), F.col("px") - F.col("right"), F.lit(0.0)), F.greatest(F.col("top") - F.col("py"), F.col("py") - F.col("bottom"), F.lit(0.0)))
    want = points.join(boxes, "grp").groupBy("point").agg(F.min(F.struct(distance.alias("d"), "box")).alias("b")).select("point", "b.box")
    assert got == {tuple(r) for r in want.collect()} and sum(rows) < 22_000


def test_boxes_are_dealt_twice_and_nothing_else_stays(spark):
    import os

    from lamina.operators import spatial
    from lamina.plans.lineage import shared_dir

    def shuffled():
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return sum(x.totalShuffleWrite() for x in (store.apply(k) for store in [spark._jsc.sc().statusStore().executorList(False)] for k in range(store.size())))

    def kept():
        return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(shared_dir(spark).removeprefix("file:")) for f in names)

    # About 90 boxes over each point.
    h = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("double")
    boxes = spark.range(40_000).select(F.col("id").alias("box"), F.lit(1).alias("grp"), h(1, 400).alias("left"), h(2, 400).alias("top"), h(3, 30).alias("w")).withColumns({"right": F.col("left") + F.col("w"), "bottom": F.col("top") + F.col("w")})
    points = spark.range(1_000).select(F.col("id").alias("point"), F.lit(1).alias("grp"), h(4, 400).alias("px"), h(5, 600).alias("py"))
    before, files = shuffled(), kept()
    found = spatial.nearest_boxes(points, boxes, 32.0)
    most, left = shuffled() - before, kept() - files
    assert found.count() == 1_000
    before = shuffled()
    boxes.select("grp", "box", *spatial.SIDES).repartition("left", "top").write.format("noop").mode("overwrite").save()
    assert most < 3 * (shuffled() - before) and left < 200_000


def test_numbers_and_markup_come_from_a_table_of_kinds(spark):
    from lamina.operators import frames, pictures

    rows = spark.createDataFrame([(k, ("slime", "a coin", None)[k % 3], (12, 16)[k % 2]) for k in range(12)], "id int, p string, n int")
    drawn = frames.procedural(rows, "p", F.col("n"), lambda x: pictures.drawn(x, pictures.templates(spark, pictures.GENERATED)))
    looped = frames.loops(rows.withColumn("f", F.when(F.col("id") < 9, "bat")), "f")
    for got, n in ((drawn, 6 * 12 + 6 * 16), (looped, 9 * 16)):
        assert "BroadcastHashJoin" in plan_of(got) and got.count() == got.select("id", "frame").distinct().count() == n
    assert drawn.columns == ["id", "p", "n", "family", "frame", "phase", "parameters", "markup"]


def test_many_counts_are_computed_for_each_row(spark, monkeypatch):
    from lamina.operators import frames

    rows = spark.createDataFrame([(k, "slime", 10 + k) for k in range(5)], "id int, p string, n int")
    want = frames.procedural(rows, "p", F.col("n")).orderBy("id", "frame").collect()
    monkeypatch.setattr(frames, "KINDS", 3)
    assert frames.procedural(rows, "p", F.col("n")).select(*want[0].asDict()).orderBy("id", "frame").collect() == want


def test_whole_sheets_are_those_of_cells_without_a_shuffle_of_them(spark):
    from lamina.operators import pictures

    said = ("stand", "Walking", None, "attack", "magic spell", "burning flame", "jump")
    rows = spark.createDataFrame([(k, said[k % 7], ("a<b", None, "c")[k % 3], (None, "Pixel")[k % 2]) for k in range(42)], "k int, p string, i string, s string")
    cells = pictures.reference_sheets(pictures.reference_cells(rows, "p", "i", "s", F.lit(12), F.lit(4)), "k", 4)
    whole = pictures.whole_sheets(rows, "p", "i", "s", F.lit(12), 4).select("k", "error", "sheet")
    assert sorted(whole.collect()) == sorted(cells.collect())


def test_lists_are_compared_without_further_shuffles(spark):
    from lamina.operators import difference

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        old = spark.range(40).select(F.col("id").alias("k"), F.lit(1).alias("n"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda e: F.struct(e.cast("string").alias("name"), (e + F.col("id")).alias("v"))).alias("parts"))
        new = old.withColumn("parts", F.reverse("parts"))
        got = difference.changes(old, new, "k", {"parts": "name"})
        assert plan_of(got).count("Exchange") <= 4 and got.filter("moved").count() == got.count() == 160
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_state_takes_a_few_calls_for_a_key(monkeypatch):
    from unittest.mock import MagicMock

    import pandas as pd

    from lamina.streaming import timed

    kept = {"waiting": []}
    handle, waiting, held = MagicMock(), MagicMock(), MagicMock()
    handle.getListState.return_value, handle.getValueState.return_value = waiting, held
    waiting.get.side_effect = lambda: iter(kept["waiting"])
    waiting.appendList.side_effect = lambda rows: kept["waiting"].extend(rows)
    waiting.put.side_effect = lambda rows: kept.update(waiting=list(rows))
    waiting.clear.side_effect = lambda: kept.update(waiting=[])
    held.get.side_effect = lambda: kept.get("held")
    held.update.side_effect = lambda row: kept.update(held=row)
    machine, clock = timed.Messages(1800), MagicMock()
    machine.init(handle)
    clock.getCurrentWatermarkInMs.return_value = 0
    events = pd.DataFrame({"at_micros": [k * 1_000_000 + 1 for k in range(100)], "number": range(100), "event": ["{}"] * 100})
    assert not list(machine.handleInputRows(("u",), iter([events]), clock))
    clock.getCurrentWatermarkInMs.return_value = 90_000
    out = pd.concat(machine.handleExpiredTimer(("u",), clock, None))
    assert list(out["number"]) == list(range(89)) and [e[1] for e in kept["waiting"]] == list(range(90, 100))
    assert len(waiting.method_calls) + len(held.method_calls) < 10
