import hashlib
import itertools
import random
import re
import zlib

import pytest

from lamina.llm.conversations import damage, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, part string, best string"
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    """(turn, role, text) by conversation, in order."""
    out = {}
    for conv, turn, role, text, *_ in rows:
        out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {k: sorted(v, key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(t[2].encode()).hexdigest())) for k, v in out.items()}


def flags(turns):
    seen, out = set(), []
    for _, role, text in turns:
        found = VISIBLE.findall(text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns, kinds):
    """Every edit of every turn, by search over (turns read, text made so far); no states of the grammar."""
    legal = re.compile(r"(s?(ua)+)?")
    starts = re.compile(r"s?(ua)*u?")
    best = {("", ""): 0}
    for (_, role, text), kind in zip(turns, kinds):
        grown = {}
        for (audit, made), cost in best.items():
            for n in range(3):
                for add in itertools.product("ua", repeat=n):
                    a, m, c = audit + "I" * n, made + "".join(add), cost + 2 * n
                    extra = kind == "truncated"
                    moves = [("D", "", 3)] + ([] if kind in ("blank", "duplicate") else [("K", role[:1], extra), ("R", "u", 2 + extra), ("R", "a", 2 + extra)])
                    for letter, initial, price in moves:
                        if letter == "K" and initial not in ("s", "u", "a"):
                            continue
                        if starts.fullmatch(m + initial):
                            key = (a + letter, m + initial)
                            grown[key] = min(grown.get(key, 1 << 60), c + price)
        ends = {}
        for (a, m), c in grown.items():  # of equal ends of the text the cheapest and least; further turns see no more of it
            end = m[-1:]
            if end not in ends or (c, a) < ends[end][:2]:
                ends[end] = (c, a, m)
        best = {(a, m): c for c, a, m in ends.values()}
    whole = [(c + 2 * n, a + "I" * n, m + "".join(add)) for (a, m), c in best.items() for n in range(3) for add in itertools.product("ua", repeat=n) if legal.fullmatch(m + "".join(add))]
    return min(whole)


def expected(rows):
    out = {}
    for conv, turns in damaged(rows).items():
        kinds = flags(turns)
        cost, audit, made = cheapest(turns, kinds)
        lines, k, n = [], 0, 0
        for letter in audit:
            if letter == "I":
                lines.append({"u": "user:", "a": "assistant:"}[made[n]])
            elif letter != "D":
                _, role, text = turns[k]
                lines.append((role if letter == "K" else {"u": "user", "a": "assistant"}[made[n]]) + ":" + text)
            n += letter != "D"
            k += letter != "I"
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(turns, turns[1:]))
        out[conv] = (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def rows_for(seed, conversations, turns):
    r, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(r.randrange(turns)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"]) if r.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = r.choice(["", " \t", None, "same words.", "Cut off", "Why? ", "é!\n", f"own {turn}.", f"own {conv} {turn}"])
            rows.append((conv, r.choice([turn, turn, turn, None, turn // 2, 3 * turn]), role, text, "c", "p", "b"))
    return rows


def result(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    out = {r.conv_id: tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def rows():
    long = [(900, t % 37, ("user", "assistant", "assistant", "user", "system")[t % 5], f"words {t % 50}" + "." * (t % 3 > 0), None, None, None) for t in range(120)]
    hot = [(901, 5, "user", "again.", None, None, None)] * 60
    ids = [(None, 1, "user", "No id.", None, None, None), (None, None, None, None, None, None, None), (902, None, "assistant", "x", None, None, None)]
    return rows_for(1, 60, 9) + long + hot + ids


@pytest.mark.parametrize("chunk, fan", [(256, 64), (3, 2), (7, 3)])
def test_repair_is_that_of_a_search(spark, rows, chunk, fan):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(repair(damage(df), df, chunk_rows=chunk, fan=fan)) == expected(rows)


def test_chunks_end_at_bytes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(repair(damage(df), df, chunk_bytes=40)) == expected(rows)


def test_long_texts_and_an_empty_table(spark):
    rows = [(1, 0, "user", "word " * 100_000 + ".", None, None, None), (1, 1, "assistant", "x" * 300_000, None, None, None), (2, 0, "system", "Only.", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(repair(damage(df), df)) == expected(rows)
    none = spark.createDataFrame([], SCHEMA)
    assert repair(damage(none), none).count() == 0


def test_nothing_left(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Gone.", None, None, None)], SCHEMA)
    assert result(repair(damage(df), df)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
