"""State machines: steps, folds in batch and in a stream."""

import json
import random

from pyspark.sql import functions as F

from lamina.streaming import reducers as r


def fold(step, events, state=None):
    for e in events:
        state = step(state or {}, e)
    return state


def test_history():
    change = lambda v: {"kind": "change", "target": v, "scene": "s"}
    s = fold(r.history_step, [change(k) for k in range(82)])
    assert len(s["past"]) == 80 and s["past"][0] == 1 and s["now"] == 81
    back = fold(r.history_step, [{"kind": "undo"}] * 5 + [{"kind": "redo"}] * 5, s)
    assert back == s  # undo and redo are inverse
    cleared = fold(r.history_step, [{"kind": "undo"}, change("x")], s)
    assert cleared["future"] == [] and cleared["past"][-1] == 80
    assert fold(r.history_step, [change(81)], s) == s and fold(r.history_step, [{"kind": "motion", "target": 5}], s)["past"] == s["past"]
    assert fold(r.history_step, [{"kind": "open", "target": 0, "scene": "t"}], s) == {"scene": "t", "now": 0, "past": [], "future": []}
    moved = fold(r.history_step, [{"kind": "change", "target": "z", "scene": "t"}], s)
    assert moved == {"scene": "t", "now": "z", "past": [], "future": []} and fold(r.history_step, [{"kind": "change", "target": "z", "scene": "s"}], s)["past"][-1] == 81
    a = fold(r.layout_step, [{"kind": "change", "target": k, "cards": ["a"]} for k in range(3)])
    assert len(a["past"]) == 2 and fold(r.layout_step, [{"kind": "change", "target": 9, "cards": ["a", "b"]}], a)["past"] == []


def test_walk_and_approach():
    s = fold(r.walk_step, [{"kind": "left", "ms": 500}] * 3, {"x": 10.0})
    assert s["x"] == 0 and s["camera"] == 0
    assert fold(r.walk_step, [{"kind": "right", "ms": 500}], {"x": 10.0})["x"] == 16  # 0.05 seconds at most
    assert fold(r.walk_step, [{"kind": "right", "ms": 50}] * 3, {"x": 3830.0, "width": 10.0})["x"] == 3830
    tick = {"kind": "tick", "ms": 50}
    s = fold(r.approach_step, [tick, {"kind": "board"}], {"x": 40.0, "target": 10.0})
    assert s["phase"] == "approaching" and fold(r.approach_step, [tick], s)["phase"] == "ready" and fold(r.approach_step, [tick, {"kind": "board"}], s)["phase"] == "boarded"


def test_interactions():
    scene = {"layers": {"d": {"visible": True, "clip": "c0", "clips": ["c0", "c1"], "default": "c1"}, "k": {"visible": True}}, "values": {"n": 1.0}, "scenes": ["s2"], "current": "s1"}
    do = lambda target="d", **i: fold(r.interaction_step, [{"target": target, "interaction": i}], scene)
    assert do(conditionStateKey="n", conditionStateValue="2", failSubtitle="no")["message"] == "no" and do(conditionStateKey="n", conditionStateValue="1")["message"] == "d"
    picked = do("k", actionType="pickup-item", itemId="key")
    assert picked["values"]["key"] is True and not picked["layers"]["k"]["visible"] and do("k", actionType="pickup-item", hideLayerOnPickup=False)["layers"]["k"]["visible"]
    assert not do("k", actionType="toggle-layer", targetLayerId="d")["layers"]["d"]["visible"]
    assert do(actionType="play-animation", targetAnimationId="c0")["layers"]["d"]["clip"] == "c0" and do(actionType="play-animation")["layers"]["d"]["clip"] == "c1"
    assert do("k", actionType="play-animation", subtitle="said")["message"] == "said"  # nothing to play
    assert do(actionType="scene-link", targetSceneId="s2")["current"] == "s2" and do(actionType="scene-link", targetSceneId="x")["current"] == "s1"
    assert do(actionType="set-state", setStateKey="a", setStateValue="0x10")["values"]["a"] == 16
    named = fold(r.interaction_step, [{"target": "k", "interaction": {"actionType": "pickup-item"}}, {"target": "k", "interaction": {"actionType": "set-state", "promptText": "The Door!"}}], {"layers": {"k": {"name": "Old Key!", "visible": True}}})
    assert named["values"] == {"old_key": True, "the_door": True} and fold(r.interaction_step, [{"target": "k", "interaction": {}}], {"layers": {"k": {"name": "Old Key!"}}})["message"] == "Old Key!"
    lost = do("d", actionType="play-animation", targetLayerId="nowhere", subtitle="plays")
    assert lost["message"] == "plays" and lost["layers"] == scene["layers"]
    train = {"layers": {"t": {"asset": r.BOARDING_ASSET, "z": 86}, "p": {"role": "player", "opacity": 1}, "o": {"z": 1}}}
    aboard = fold(r.interaction_step, [{"target": "t", "interaction": {}}], train)
    assert (aboard["phase"], aboard["layers"]["p"]["opacity"], aboard["layers"]["t"]["z"], aboard["layers"]["o"]) == ("boarded", 0.18, 92, {"z": 1})


def test_clamped_fold_in_chunks(spark):
    rand = random.Random(1)
    rows = [(u, k, rand.uniform(-9, 9)) for u in ("a", "b") for k in range(50)]
    df = spark.createDataFrame(rows, "u string, k int, d double")
    for chunk in (1, 7, 1000):
        got = {x.u: x.position for x in r.clamped_fold(df, "u", ["k"], F.col("d"), 0, 10, 3, chunk).collect()}
        for u in ("a", "b"):
            at = 3.0
            for _, _, d in sorted(x for x in rows if x[0] == u):
                at = min(10.0, max(0.0, at + d))
            assert abs(got[u] - at) < 1e-9


def test_clipboard():
    layers = [{"id": "a", "name": "A", "type": "sprite", "x": 0, "y": 0, "z": 5}, {"id": "bg", "name": "B", "type": "background", "x": 0, "y": 9, "z": 0, "locked": False}, {"id": "l", "name": "L", "type": "sprite", "locked": True, "x": 1, "y": 1, "z": 1}]
    e = lambda kind, target=None, new=None: {"kind": kind, "target": target, "new_id": new}
    s = fold(r.clipboard_step, [e("copy", "a"), e("paste", new="p1"), e("paste", new="p2")], {"layers": layers})
    assert [(x["id"], x["x"], x["y"], x["z"]) for x in s["layers"][3:]] == [("p1", 36, 24, 6), ("p2", 72, 48, 7)]
    s = fold(r.clipboard_step, [e("cut", "l"), e("cut", "bg"), e("cut", "a"), e("paste", new="n")], {"layers": layers})
    assert [x["id"] for x in s["layers"]] == ["bg", "l", "n"]
    s = fold(r.clipboard_step, [e("copy", "bg"), e("paste")], {"layers": [layers[0], {**layers[1], "id": "other", "y": 1, "name": "O"}], "held": {**layers[1]}})
    assert s["layers"][1]["y"] == 9 and s["layers"][1]["id"] == "other"
    assert len(fold(r.clipboard_step, [e("duplicate", "l"), e("duplicate", "a", "d")], {"layers": layers})["layers"]) == 4


def events(spark, n=400):
    rnd = random.Random(3)
    rows = [(f"u{rnd.randrange(9)}", k, json.dumps({"kind": rnd.choice(["change", "undo", "redo"]), "target": rnd.randrange(4), "scene": "s"})) for k in range(n)]
    want = {}
    for s, _, e in rows:
        want[s] = r.history_step(want.get(s, {}), json.loads(e))
    return spark.createDataFrame(rows, "session_id string, seq long, event string"), want


def test_batch_fold(spark):
    df, want = events(spark)
    got = r.fold(df.repartition(5), "history").collect()
    assert {x.session_id: json.loads(x.state) for x in got} == want and sum(x.n_events for x in got) == 400


def test_stream_fold(spark, tmp_path):
    df, want = events(spark)
    for k in range(2):
        df.filter(F.floor(F.col("seq") / 200) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = r.fold_stream(stream, "history").writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for x in sorted(spark.table("states").collect(), key=lambda x: x.n_events):
        last[x.session_id] = json.loads(x.state)
    assert last == want


def test_saturating_sum_and_expiry(spark):
    df = spark.createDataFrame([([60.0, 60.0, -30.0],)], "d array<double>")
    assert df.select(r.clamped_sum(F.col("d"), 0, 100)).first()[0] == 70
    m = spark.createDataFrame([("s", "2024-01-01 00:00:00"), ("s", "2024-01-01 00:00:01")], "s string, t string").select("s", F.col("t").cast("timestamp").alias("t"))
    assert [str(x.until)[11:21] for x in r.shown_until(m, "s", "t").orderBy("t").collect()] == ["00:00:01", "00:00:02.8"]
