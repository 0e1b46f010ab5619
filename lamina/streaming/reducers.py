"""Ordered state: one step function for each machine, folded over a session's events in batch or in a stream.

A session's events are folded in order of ``seq``. In batch they are read sorted in Arrow batches, so a session's state
is held, not its events; in a stream the state is kept by Spark between batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HISTORY = 80
# The vehicle that can be boarded, and how its scene looks once it is.
BOARDING_ASSET, BOARDED_OPACITY, BOARDED_Z = "asset_scene_boarding_train", 0.18, 92
# Fixed texts of the messages.
BLOCKED, NO_SCENE, BOARDED = "It does not seem ready yet.", "No target scene is assigned yet.", "Boarded the subway car"
Step = Callable[[dict, dict], dict]


def clamped_sum(deltas: Column, low: float, high: float, start: float = 0.0) -> Column:
    """The sum of an ordered array that saturates at every step; a plain sum clamped at the end is another thing."""
    return F.aggregate(deltas, F.lit(float(start)), lambda acc, d: F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), acc + d)))


def clamped_fold(rows: DataFrame, key: str, order: list[str], delta: Column, low: float, high: float, start: float = 0.0, chunk: int = 10_000) -> DataFrame:
    """``key``, position: the same for sessions of any length. No session is gathered: a chunk of ``chunk`` steps is one clamped shift, and the shifts of chunks are clamped in turn."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    chunks = rows.select(key, *order, delta.alias("d")).withColumn("n", place).groupBy(key, F.floor((F.col("n") - 1) / chunk).alias("chunk"))
    steps = chunks.agg(F.array_sort(F.collect_list(F.struct("n", "d"))).alias("steps"))
    clamp = lambda x: F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))
    none = F.struct(F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.lit(0.0).alias("shift"))
    step = lambda acc, x: F.struct(clamp(acc["low"] + x["d"]).alias("low"), clamp(acc["high"] + x["d"]).alias("high"), (acc["shift"] + x["d"]).alias("shift"))
    maps = steps.select(key, F.struct("chunk", F.aggregate("steps", none, step).alias("m")).alias("m")).groupBy(key).agg(F.array_sort(F.collect_list("m")).alias("maps"))
    applied = F.aggregate("maps", F.lit(float(start)), lambda x, m: F.least(m["m"]["high"], F.greatest(m["m"]["low"], x + m["m"]["shift"])))
    return maps.select(key, applied.alias("position"))


def walk_step(state: dict, event: dict) -> dict:
    """A held key moves the player and the camera behind it; a step is at most 0.05 seconds, positions have two digits."""
    s = {"x": 0.0, "camera": 0.0, "width": 0.0, "world": 3840.0, "view": 1280.0, "speed": 120.0} | state
    seconds = min(0.05, event["ms"] / 1000)
    x = min(max(s["x"] + (-1 if event["kind"] == "left" else 1) * s["speed"] * seconds, 0.0), max(0.0, s["world"] - s["width"]))
    camera = min(max(x + s["width"] / 2 - s["view"] * 0.42, 0.0), max(0.0, s["world"] - s["view"]))
    return s | {"x": round(x, 2), "camera": round(camera, 2)}


def approach_step(state: dict, event: dict) -> dict:
    """A vehicle comes from the right until it stands before its target, then waits to be boarded."""
    s = {"phase": "approaching", "x": 0.0, "target": 0.0, "speed": 330.0} | state
    if s["phase"] == "approaching" and event["kind"] == "tick":
        x = max(s["target"], s["x"] - s["speed"] * min(0.05, event["ms"] / 1000))
        return s | {"x": round(x, 2), "phase": "ready" if abs(x - s["target"]) < 3 else "approaching"}
    return s | {"phase": "boarded"} if s["phase"] == "ready" and event["kind"] == "board" else s


def history_step(state: dict, event: dict) -> dict:
    """Undo and redo: a change clears what could be redone, at most ``HISTORY`` are kept, another scene begins anew.

    Automatic motion and changes to an equal value aren't recorded.
    """
    s = {"scene": None, "now": None, "past": [], "future": []} | state
    kind, value = event["kind"], event.get("target")
    moved = kind in ("change", "motion") and event.get("scene") not in (None, s["scene"])
    if kind == "open" or s["scene"] is None or moved:
        return {"scene": event.get("scene") or value, "now": value, "past": [], "future": []}
    if kind == "undo":
        return s if not s["past"] else s | {"now": s["past"][-1], "past": s["past"][:-1], "future": [s["now"], *s["future"]][:HISTORY]}
    if kind == "redo":
        return s if not s["future"] else s | {"now": s["future"][0], "future": s["future"][1:], "past": [*s["past"], s["now"]][-HISTORY:]}
    if value == s["now"]:
        return s
    return s | {"now": value} if kind == "motion" else s | {"now": value, "past": [*s["past"], s["now"]][-HISTORY:], "future": []}


def layout_step(state: dict, event: dict) -> dict:
    """The same for positions of cards; it begins anew when the set of cards changes."""
    cards = event.get("cards")
    if cards is not None and cards != state.get("cards"):
        return history_step({}, event | {"kind": "open"}) | {"cards": cards}
    return history_step(state, event) | {"cards": state.get("cards")}


def state_value(text: str | None):
    t = (text or "").strip()
    if t in ("true", "false"):
        return t == "true"
    try:
        return float(int(t, 16)) if t.lower().startswith("0x") else float(t) if t and t.lower().lstrip("+-") not in ("nan", "inf", "infinity") and "_" not in t else t
    except ValueError:
        return t


def shown(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return "undefined" if value is None else str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def state_matches(actual, expected: str | None) -> bool:
    t = (expected or "").strip()
    return shown(actual) == shown(state_value(t)) if t else bool(actual)


def safe_name(text: str) -> str:
    return re.sub("[^a-zA-Z0-9一-龥]+", "_", text).strip("_").lower() or "sprite"


def interaction_step(state: dict, event: dict) -> dict:
    """An interaction on a scene: boarding a vehicle, blocked by its condition, or one of six actions.

    State: layers {id: {name, visible, clip, clips, default, asset, role, opacity, z}}, values, scenes, current, message.
    """
    s = {"layers": {}, "values": {}, "scenes": [], "current": None, "message": None} | state
    i = event.get("interaction") or {}
    layer = event.get("target")
    own = s["layers"].get(layer, {})
    name = own.get("name") or event.get("name") or layer
    if own.get("asset") == BOARDING_ASSET:
        looks = {k: {**x, "opacity": BOARDED_OPACITY} if x.get("role") == "player" else {**x, "z": max(x.get("z", 0), BOARDED_Z)} if x.get("asset") == BOARDING_ASSET else x for k, x in s["layers"].items()}
        return s | {"layers": looks, "phase": "boarded", "message": BOARDED}
    prompt = i.get("promptText") or name
    key = (i.get("conditionStateKey") or "").strip()
    if key and not state_matches(s["values"].get(key), i.get("conditionStateValue")):
        return s | {"message": i.get("failSubtitle") or BLOCKED}
    action, said = i.get("actionType") or "subtitle", i.get("subtitle") or prompt
    other = i.get("targetLayerId") or layer
    at = lambda name, **change: {**s["layers"], name: {**s["layers"][name], **change}} if name in s["layers"] else s["layers"]
    if action == "pickup-item":
        item = (i.get("itemId") or safe_name(name)).strip()
        return s | {"values": {**s["values"], item: True}, "layers": at(layer, visible=False) if i.get("hideLayerOnPickup") is not False else s["layers"], "message": said}
    if action == "toggle-layer":
        return s | {"layers": at(other, visible=not s["layers"].get(other, {}).get("visible")), "message": said}
    plays = s["layers"].get(other, own)  # an unknown target plays what the source has, and no layer shows it
    if action == "play-animation" and (clips := plays.get("clips")):
        want = [i.get("targetAnimationId"), plays.get("default"), clips[0]]
        return s | {"layers": at(other, clip=next(c for c in want if c in clips)), "message": said}
    if action == "scene-link":
        found = i.get("targetSceneId") in s["scenes"]
        return s | ({"current": i["targetSceneId"], "message": said} if found else {"message": i.get("failSubtitle") or NO_SCENE})
    if action == "set-state":
        return s | {"values": {**s["values"], (i.get("setStateKey") or key or safe_name(prompt)).strip(): state_value(i.get("setStateValue") or "true")}, "message": said}
    return s | {"message": said}  # a subtitle, and what had nothing to play


def clipboard_step(state: dict, event: dict) -> dict:
    """Copy, cut, paste and duplicate; each paste goes a step further, backgrounds only pass on their settings.

    State: layers (list of {id, name, type, locked, x, y, z}), held, pastes. New ids come with the event.
    """
    s = {"layers": [], "held": None, "pastes": 0} | state
    kind, new_id = event["kind"], event.get("new_id")
    own = next((x for x in s["layers"] if x["id"] == event.get("target")), None)
    usable = own is not None and own["type"] in ("background", "sprite", "effect", "foreground")
    placed = lambda x, word, n: {**x, "id": new_id, "name": f"{x['name']} {word}", "locked": False, "visible": True, "x": round(x["x"] + 36 * n, 2), "y": round(x["y"] + 24 * n, 2), "z": max([x["z"], *(y["z"] for y in s["layers"])]) + 1}
    if kind == "copy" and usable:
        return s | {"held": own, "pastes": 0}
    if kind == "cut" and usable and not own.get("locked") and own["type"] != "background":
        return s | {"held": own, "pastes": 0, "layers": [x for x in s["layers"] if x is not own]}
    if kind == "duplicate" and usable and not own.get("locked") and own["type"] != "background":
        return s | {"layers": [*s["layers"], placed(own, "copy", 1)]}
    if kind == "paste" and s["held"]:
        if s["held"]["type"] == "background":
            to = next((x for x in s["layers"] if x["type"] == "background"), None)
            if to is None or to.get("locked"):
                return s
            kept = {k: to.get(k) for k in ("id", "name", "locked", "z")}
            return s | {"layers": [{**s["held"], **kept, "visible": True} if x is to else x for x in s["layers"]]}
        return s | {"layers": [*s["layers"], placed(s["held"], "paste", s["pastes"] + 1)], "pastes": s["pastes"] + 1}
    return s


STEPS: dict[str, Step] = {"walk": walk_step, "approach": approach_step, "history": history_step, "layout": layout_step, "interaction": interaction_step, "clipboard": clipboard_step}


def fold(events: DataFrame, machine: str, session: str = "session_id", order: str = "seq", start: dict | None = None) -> DataFrame:
    """``session``, state (JSON), n_events after all events. ``events`` has ``session`` (text), ``order`` and event (JSON)."""
    step, first = STEPS[machine], start or {}

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, n = None, None, 0
        for batch in batches:
            done = []
            for s, e in zip(batch[session], batch["event"]):
                if n and s != now:
                    done.append((now, json.dumps(state), n))
                if not n or s != now:
                    now, state, n = s, dict(first), 0
                state, n = step(state, json.loads(e)), n + 1
            if done:
                yield pd.DataFrame(done, columns=[session, "state", "n_events"])
        if n:
            yield pd.DataFrame([(now, json.dumps(state), n)], columns=[session, "state", "n_events"])

    dealt = events.select(session, order, "event").repartition(session).sortWithinPartitions(session, order).select(session, "event")
    return dealt.mapInPandas(folded, f"{session} string, state string, n_events bigint")


def fold_stream(events: DataFrame, machine: str, session: str = "session_id", order: str = "seq", start: dict | None = None) -> DataFrame:
    """The same for a stream: a row with the new state for each session that a batch touches."""
    step, first = STEPS[machine], start or {}

    def folded(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, n = (json.loads(held.get[0]), held.get[1]) if held.exists else (dict(first), 0)
        for e in pd.concat(batches).sort_values(order)["event"]:
            state, n = step(state, json.loads(e)), n + 1
        held.update((json.dumps(state), n))
        yield pd.DataFrame([(key[0], json.dumps(state), n)], columns=[session, "state", "n_events"])

    return events.groupBy(session).applyInPandasWithState(folded, f"{session} string, state string, n_events bigint", "state string, n bigint", "update", GroupStateTimeout.NoTimeout)


def shown_until(messages: DataFrame, session: str, at: str, milliseconds: int = 1800) -> DataFrame:
    """When each message goes: after its time, or when the next one comes."""
    following = F.lead(at).over(Window.partitionBy(session).orderBy(at))
    ends = F.col(at) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(milliseconds / 1000).cast("decimal(18,6)"))
    return messages.withColumn("until", F.least(ends, following))
