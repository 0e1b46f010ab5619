import json
import random

import pytest

from lamina.operators.difference import bag_difference, changes, tree

LAYER = "struct<id: string, x: double, tags: map<string,string>, pos: struct<a: int, b: string>>"
SCENE = f"key string, name string, state map<string,string>, layers array<{LAYER}>"


def scene(r, key):
    layers = [(r.choice([*"abcdefgh", None]), r.choice([1.0, 2.0, None]), r.choice([None, {}, {"p": "1", "q": "2"}, {"q": "2", "p": "1"}, {"p": "3"}]), r.choice([None, (1, "u"), (1, None)])) for _ in range(r.randrange(7))]
    return key, r.choice(["n", None]), r.choice([None, {"d": "1"}, {"d": "2", "e": "x"}]), r.choice([None, layers, layers])


def plain(x):
    """Null fields are absent, maps have an order."""
    if isinstance(x, tuple):
        return tuple(plain(v) for v in x)
    if isinstance(x, list):
        return [plain(v) for v in x]
    return tuple(sorted(x.items())) if isinstance(x, dict) else x


def by_occurrence(layers):
    seen, out = {}, {}
    for at, layer in enumerate(layers or []):
        seen[layer[0]] = seen.get(layer[0], 0) + 1
        out[(layer[0], seen[layer[0]])] = (at, plain(layer))
    return out


def brute(old, new):
    a, b, out = {s[0]: s for s in old if s[0] is not None}, {s[0]: s for s in new if s[0] is not None}, set()
    for k in a.keys() | b.keys():
        if k not in a or k not in b:
            out.add((k, None, None, None, "inserted" if k not in a else "deleted", False, None, None))
            continue
        if plain(a[k][1:3]) != plain(b[k][1:3]):
            out.add((k, None, None, None, "changed", False, None, None))
        x, y = by_occurrence(a[k][3]), by_occurrence(b[k][3])
        shared = x.keys() & y.keys()
        was, now = (sorted(shared, key=lambda e: side[e][0]) for side in (x, y))
        for e in x.keys() | y.keys():
            moved = e in shared and was.index(e) != now.index(e)
            change = "inserted" if e not in x else "deleted" if e not in y else "changed" if x[e][1] != y[e][1] else None
            if change or moved:
                out.add((k, "layers", *e, change, moved, x[e][0] if e in x else None, y[e][0] if e in y else None))
    return out


def test_changes_are_those_of_a_plain_comparison(spark):
    r = random.Random(3)
    old = [scene(r, f"s{k}") for k in range(60)] + [(None, "n", None, None)]
    new = []
    for s in old[5:60]:
        layers = s[3] and [x if r.random() < 0.6 else (x[0], 9.0, *x[2:]) for x in s[3] if r.random() < 0.8]
        if layers and r.random() < 0.4:
            r.shuffle(layers)
        new.append(s if r.random() < 0.3 else (s[0], s[1] if r.random() < 0.7 else "other", s[2], layers))
    new += [scene(r, f"t{k}") for k in range(5)] + [(None, "m", None, None)]
    got = changes(spark.createDataFrame(old, SCENE), spark.createDataFrame(new, SCENE), "key", {"layers": "id"}).collect()
    rows = [(x.key, x.list, x.id, x.occurrence, x.change, x.moved, x.was, x.now) for x in got]
    assert len(rows) == len(set(rows)) and set(rows) == brute(old, new) and {x[4] for x in rows} == {"inserted", "deleted", "changed", None}


def test_paths_name_what_differs(spark):
    layer = ("a", 1.0, {"p": "1", "q": "2"}, (1, "u"))
    old = [("k", "n", {"d": "1", "e": "2"}, [layer, ("b", None, None, None)])]
    new = [("k", None, {"e": "2", "f": "3"}, [("a", 2.0, {"q": "2", "p": "9"}, (1, "v")), ("b", None, {}, (None, None))])]
    got = {x.id: x.paths for x in changes(spark.createDataFrame(old, SCENE), spark.createDataFrame(new, SCENE), "key", {"layers": "id"}).collect()}
    assert got == {None: ["name", "state.d", "state.f"], "a": ["x", "tags.p", "pos.b"], "b": ["pos"]}


def test_equal_versions_explode_nothing_and_maps_have_no_order(spark):
    old = spark.createDataFrame([("k", "n", {"d": "1", "e": "2"}, None)], SCENE)
    new = spark.createDataFrame([("k", "n", {"e": "2", "d": "1"}, [])], SCENE)
    assert changes(old, new, "key", {"layers": "id"}).count() == 0
    assert changes(old.limit(0), new.limit(0), "key", {"layers": "id"}).count() == 0
    assert tree(old, "key", ("layers",)).first().root == tree(new, "key", ("layers",)).first().root


def test_records_without_lists_and_clashing_names(spark):
    kind = "key int, record string, list string, root int"
    old, new = spark.createDataFrame([(1, "a", None, 1), (2, "b", "x", 2)], kind), spark.createDataFrame([(1, "a", "y", 1), (2, "b", "x", 2)], kind)
    assert [(x.key, x.change, x.paths) for x in changes(old, new, "key").collect()] == [(1, "changed", ["list"])]


@pytest.mark.parametrize("n", [0, 1, 500])
def test_bags_differ_by_counts(spark, n):
    r = random.Random(n)
    draw = lambda: [(r.choice([None, 1, 2]), r.choice([None, "x", "y"]), r.choice([None, {"k": "v"}])) for _ in range(n)]
    old, new = draw() + [(7, "hot", None)] * 50, draw() + [(7, "hot", None)] * 80
    want = {}
    for rows, sign in ((old, -1), (new, 1)):
        for row in rows:
            key = json.dumps(row)
            want[key] = want.get(key, 0) + sign
    kind = "a int, b string, m map<string,string>"
    got = bag_difference(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind)).collect()
    assert {json.dumps((x.a, x.b, x.m)): x.more for x in got} == {k: v for k, v in want.items() if v} and len(got) == len({json.dumps((x.a, x.b, x.m)) for x in got})
