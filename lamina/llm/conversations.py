"""Conversation structure repair: the cheapest edits that leave an optional system turn and then pairs of user and assistant.

Turns are ordered by number (null first), then role and MD5 of the text. Faults come from windows: a turn is blank, or repeats a role and
text seen earlier, or is cut off (its last visible character ends no sentence); the first that holds counts. A fold then reads
the turns: aggregate() carries four (cost, audit) structs, one for each state that the grammar ``(s?(ua)+)?`` can be in (start,
after the system turn, after a user, after an assistant), and takes the least of what each edit makes of them. Edits are K(eep) 0,
R(erole to user or assistant) 2, D(elete) 3 (the only one for blank and repeated turns) and I(nsert an empty turn) 2; a cut-off
turn that isn't deleted adds 1. Of equal costs the least audit by code points is taken. Two audits of the same turns and cost are never
a prefix of one another (each turn has one letter that isn't I, and an I costs 2), so what is least before a turn stays least after it,
and the roles follow from the audit.

Scale: all turns are dealt to ranges of (conversation, turn), so a conversation that holds a third of all rows is spread
over tasks. Inside a range turns are gathered in chunks of bounded rows and bytes. A conversation of one chunk is repaired there.
The chunks of others become 4 x 4 matrices of (cost, audit, path), which compose as the fold's steps do; ``fan`` of them at a time become
one, level by level, until a conversation has at most ``fan``. The path holds the state after each chunk, from which each chunk gets
its own edits. The SHA-256 of a long repaired conversation is a stream through one worker that holds a chunk, as that hash is sequential.
A border between ranges cuts at most one conversation, so those that are cut are fewer than ranges: they are broadcast.

Defined results: a null role or text is one space; a null id is a conversation like any other; null turns come first and count for no gap;
repeated rows are turns of their own; a conversation without turns has zeros, an empty audit and the hash of an empty text; an
empty table gives no rows; other columns are ignored, whatever their names. Ids may be of any type, turns of any number type.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import bounded_batches, written

SPACE = " \t\n\x0b\x0c\r"
CHUNK_ROWS, CHUNK_BYTES, FAN = 256, 4 << 20, 64
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: More than any cost.
NEVER = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
LEGAL = ("su", "ua", "au")


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text with faults put in by crc32(``conv:turn``) % 20: 0 drops a turn, 1 empties it, 2 removes its stops, 3 repeats it, 4 makes it the user's."""
    space = F.lit(" ")
    named = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, space).alias("role"), F.coalesce(text_col, space).alias("text"))
    of = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(of("conv"), F.lit(":"), of("turn")).cast("binary")) % 20
    named = named.withColumn("kind", kind).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return named.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("again")).drop("again")


def flagged(turns: DataFrame, chunk_rows: int, chunk_bytes: int) -> DataFrame:
    """A row for each chunk of a conversation's turns: codes (place, initial, fault, digest), roles, texts and sums of faults.

    part and chunk order the chunks of a conversation; ``alone``: its part has no other. Windows see a part, so repetition of an earlier part's turn isn't a fault yet.
    """
    order = ("turn", "role", "digest", "mark")
    dealt = turns.withColumns({"mark": F.monotonically_increasing_id(), "digest": F.md5(F.col("text").cast("binary"))})
    dealt = dealt.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id())
    ordered = Window.partitionBy("part", "conv").orderBy(*order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = dealt.withColumns({"place": F.row_number().over(ordered), "bytes": F.sum(F.octet_length("text").cast("long")).over(so_far), "before": F.lag("role").over(ordered), "turn_before": F.lag("turn").over(ordered)})
    rows = rows.withColumn("size", F.count("*").over(Window.partitionBy("part", "conv")))
    rows = rows.withColumn("seen", F.row_number().over(Window.partitionBy("part", "conv", "role", "digest").orderBy("place")) > 1)
    chunk = (F.floor((F.col("place") - 1) / chunk_rows) + F.floor(F.col("bytes") / chunk_bytes)).cast("long")  # rises with either
    visible = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(visible == "", BLANK).when(F.col("seen"), DUPLICATE).when(F.substring(visible, -1, 1).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    first = lambda c: F.substring(c, 1, 1)
    rows = rows.withColumns({
        "fault": fault, "initial": first("role"), "chunk": chunk,
        "illegal": (~F.concat(first("before"), first("role")).isin(*LEGAL)).cast("long"), "new_turn": (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))).cast("long"),
    })
    gathered = F.array_sort(F.collect_list(F.struct("place", "initial", "fault", "digest", "role", "text")))
    ends = [F.min_by("initial", "place").alias("first_initial"), F.max_by("initial", "place").alias("last_initial"), F.min_by("turn", "place").alias("first_turn"), F.max_by("turn", "place").alias("last_turn")]
    lone = F.max((F.col("place") == F.col("size")).cast("int")) + F.max((F.col("place") == 1).cast("int")) == 2
    sums = [F.coalesce(F.sum("illegal"), F.lit(0)).alias("illegal"), F.sum("new_turn").alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high"), lone.alias("alone")]
    chunks = rows.groupBy("part", "conv", "chunk").agg(gathered.alias("x"), *ends, *sums)
    code = F.transform("x", lambda t: F.struct(t["place"].alias("place"), t["initial"].alias("initial"), t["fault"].alias("fault"), t["digest"].alias("digest"), t["role"].alias("role")))
    return chunks.select("part", "conv", "chunk", code.alias("codes"), F.transform("x", lambda t: t["text"]).alias("texts"), "first_initial", "last_initial", "first_turn", "last_turn", "illegal", "turns", "low", "high", "alone")


def state(cost: Column, audit: Column, path: Column | None = None) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"), *([path.alias("path")] if path is not None else []))


def after(s: Column, cost: Column | int, letters: str) -> Column:
    return state(s["cost"] + cost, F.concat(s["audit"], F.lit(letters)))


def vector(states: list[Column]) -> Column:
    return F.struct(*(s.alias(f"s{k}") for k, s in enumerate(states)))


def states_of(v: Column) -> list[Column]:
    return [v[f"s{k}"] for k in range(4)]


def starting(at: int, path: bool = False) -> Column:
    none = F.lit("")
    return vector([state(F.lit(0 if k == at else NEVER), none, none if path else None) for k in range(4)])


def edited(v: Column, turn: Column) -> Column:
    """The four states after one more turn: turns may be inserted before it, then it is kept, given another role or deleted."""
    s = states_of(v)
    user = F.least(s[USER], after(s[START], 2, "I"), after(s[SYSTEM], 2, "I"), after(s[ASSISTANT], 2, "I"))
    assistant = F.least(s[ASSISTANT], after(s[USER], 2, "I"), after(s[START], 4, "II"), after(s[SYSTEM], 4, "II"))
    c = [s[START], s[SYSTEM], user, assistant]
    stays = F.when(turn["fault"].isin(BLANK, DUPLICATE), NEVER).when(turn["fault"] == TRUNCATED, 1).otherwise(0)
    gone = [after(x, 3, "D") for x in c]

    def placed(x: Column, initial: str, rerole: bool = True) -> list[Column]:
        keep = after(x, stays + F.when(turn["initial"] == initial, 0).otherwise(NEVER), "K")
        return [keep, after(x, stays + 2, "R")] if rerole else [keep]

    return vector([
        gone[START], F.least(gone[SYSTEM], *placed(c[START], "s", False)),
        F.least(gone[USER], *placed(c[START], "u"), *placed(c[SYSTEM], "u"), *placed(c[ASSISTANT], "u")), F.least(gone[ASSISTANT], *placed(c[USER], "a")),
    ])


def folded(codes: Column, at: int) -> Column:
    """The four states after all turns of a chunk that starts in state ``at``; paths hold the state in which each ends."""
    return F.aggregate(codes, starting(at), edited, lambda v: vector([state(s["cost"], s["audit"], F.lit(str(k))) for k, s in enumerate(states_of(v))]))


def ended(v: Column) -> Column:
    """The least of what the four states become where the grammar allows the end; ``tail``: turns inserted there."""
    s = states_of(v)
    whole = [(s[START], 0, ""), (s[ASSISTANT], 0, ""), (s[USER], 2, "I"), (s[START], 4, "II"), (s[SYSTEM], 4, "II")]
    return F.least(*(F.struct((x["cost"] + cost).alias("cost"), F.concat(x["audit"], F.lit(tail)).alias("audit"), x["path"].alias("path"), F.lit(tail).alias("tail")) for x, cost, tail in whole))


def composed(v: Column, m: Column) -> Column:
    """The four states after a chunk whose matrix ``m`` is an array of rows."""
    s = states_of(v)
    joined = lambda p, q: state(s[p]["cost"] + m[p][f"s{q}"]["cost"], F.concat(s[p]["audit"], m[p][f"s{q}"]["audit"]), F.concat(s[p]["path"], m[p][f"s{q}"]["path"]))
    return vector([F.least(*(joined(p, q) for p in range(4))) for q in range(4)])


def repaired(audit: Column, at: Column, codes: Column, texts: Column) -> Column:
    """Array of ``role:text`` that ``audit`` makes of the turns, from state ``at`` (a text, as in paths)."""
    letters = F.filter(F.split(audit, ""), lambda x: x != "")
    start = F.struct(F.when(at == "3", "a").when(at == "2", "u").when(at == "1", "s").otherwise("").alias("last"), F.lit(0).alias("n"), F.array().cast("array<struct<letter:string,role:string,n:int>>").alias("out"))

    def step(acc: Column, letter: Column) -> Column:
        n = acc["n"] + F.when(letter == "I", 0).otherwise(1)
        role = F.when(letter == "D", acc["last"]).when(letter == "K", F.element_at(codes, n)["initial"]).when(acc["last"] == "u", "a").otherwise("u")
        return F.struct(role.alias("last"), n.alias("n"), F.concat(acc["out"], F.array(F.struct(letter.alias("letter"), role.alias("role"), n.alias("n")))).alias("out"))

    def shown(x: Column) -> Column:
        role = F.when(x["letter"] == "K", F.element_at(codes, x["n"])["role"]).when(x["role"] == "u", "user").otherwise("assistant")
        return F.concat(role, F.lit(":"), F.when(x["letter"] == "I", "").otherwise(F.element_at(texts, x["n"])))

    kept = F.filter(F.aggregate(letters, start, step)["out"], lambda x: x["letter"] != "D")
    return F.transform(kept, shown)


def faults(kind: int) -> Column:
    return F.size(F.filter("codes", lambda t: t["fault"] == kind)).cast("long")


def hashed(chunks: DataFrame, kind: str) -> DataFrame:
    """conv, sha: SHA-256 of a conversation's chunk texts, joined by newlines; chunks come sorted and none is held."""

    def streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha = None, None
        for batch in batches:
            done: list[tuple] = []
            for conv, body in zip(batch["conv_key"], batch["body"]):
                if sha is None or conv != now:
                    if sha is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha, any_yet = conv, hashlib.sha256(), False
                if body is not None:
                    sha.update((("\n" if any_yet else "") + body).encode())
                    any_yet = True
            if done:
                yield pd.DataFrame(done, columns=["conv_key", "sha"])
        if sha is not None:
            yield pd.DataFrame([(now, sha.hexdigest())], columns=["conv_key", "sha"])

    bounded_batches(chunks.sparkSession)
    sorted_ = chunks.repartition("conv_key").sortWithinPartitions("conv_key", "n").select("conv_key", "body")
    return sorted_.mapInPandas(streamed, "conv_key string, sha string").select(F.from_json("conv_key", f"conv {kind}").getField("conv").alias("conv"), "sha")


def repair(turns: DataFrame, conversations: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES, fan: int = FAN, conv_col: str = "conv_id") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each id of ``conversations``; ``turns``: conv, turn, role, text."""
    chunks = written(flagged(turns, chunk_rows, chunk_bytes), "conversation-chunks")
    cut = chunks.groupBy("conv").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a < b").select(F.col("conv").alias("cut"))
    cut = F.broadcast(written(cut, "conversation-cut"))  # fewer than ranges
    same = F.col("conv").eqNullSafe(F.col("cut"))
    counts = {"blank": faults(BLANK), "duplicate": faults(DUPLICATE), "truncated": faults(TRUNCATED)}

    single = chunks.filter("alone").join(cut, same, "left_anti").withColumn("v", folded(F.col("codes"), START)).withColumn("best", ended(F.col("v")))
    body = F.array_join(repaired(F.col("best.audit"), F.lit("0"), F.col("codes"), F.col("texts")), "\n")
    single = single.select("conv", "turns", "low", "high", "illegal", *(v.alias(k) for k, v in counts.items()), F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), F.sha2(body, 256).alias("sha"))

    crossing = chunks.join(cut, same, "left_semi")
    long = chunks.filter("NOT alone").join(cut, same, "left_anti").withColumn("again", F.array().cast("array<int>")).unionByName(with_earlier_turns(crossing))
    repeat = lambda t: F.when((t["fault"] != BLANK) & F.array_contains("again", t["place"]), DUPLICATE).otherwise(t["fault"])
    long = long.withColumn("codes", F.transform("codes", lambda t: t.withField("fault", repeat(t)))).drop("again")
    matrix = F.array(*(folded(F.col("codes"), k) for k in range(4)))
    in_order = Window.partitionBy("conv").orderBy("part", "chunk")
    long = long.withColumns({"n": F.row_number().over(in_order), "initial_before": F.lag("last_initial").over(in_order), "turn_before": F.lag("last_turn").over(in_order), "part_before": F.lag("part").over(in_order)})
    entered = F.col("part") != F.col("part_before")
    long = long.withColumns({
        "illegal": F.col("illegal") + F.when(entered & ~F.concat("initial_before", "first_initial").isin(*LEGAL), 1).otherwise(0),
        "turns": F.col("turns") - F.when(entered & (F.col("turn_before") == F.col("first_turn")), 1).otherwise(0), "m": matrix, **counts,
    })
    long = written(long.drop("initial_before", "turn_before", "part_before", "part", "chunk", "first_initial", "last_initial", "first_turn", "last_turn"), "conversation-long")
    best = written(paths_of(long.select("conv", "n", "m"), fan), "conversation-paths")
    total = long.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("turns", "illegal", *counts)), F.min("low").alias("low"), F.max("high").alias("high"))
    steps = best.select(F.col("conv").alias("of"), "best.tail", F.length("best.path").alias("last"), F.posexplode(F.filter(F.split(F.col("best.path"), ""), lambda x: x != "")).alias("k", "to"), F.col("best.path").alias("path"))
    steps = steps.select("of", (F.col("k") + 1).alias("k"), "to", F.when(F.col("k") == 0, "0").otherwise(F.substring(F.col("path"), F.col("k"), F.lit(1))).alias("at"), F.when(F.col("k") + 1 == F.col("last"), F.col("tail")).otherwise("").alias("tail"))
    pieces = long.select("conv", "n", "codes", "texts", "m").join(steps, F.col("conv").eqNullSafe(F.col("of")) & (F.col("n") == F.col("k")))
    chosen = F.element_at("m", F.col("at").cast("int") + 1)
    audit = F.concat(F.coalesce(*(F.when(F.col("to") == str(q), chosen[f"s{q}"]["audit"]) for q in range(4))), "tail")
    lines = repaired(audit, F.col("at"), F.col("codes"), F.col("texts"))
    key = F.to_json(F.struct("conv")).alias("conv_key")
    bodies = pieces.select(key, "n", lines.alias("lines")).select("conv_key", "n", F.when(F.size("lines") > 0, F.array_join("lines", "\n")).alias("body"))
    sha = hashed(bodies, chunks.schema["conv"].dataType.simpleString())
    by = lambda other, name: F.col("conv").eqNullSafe(F.col(name))
    done = total.join(best.select(F.col("conv").alias("b"), "best.cost", "best.audit"), by(best, "b")).join(sha.withColumnRenamed("conv", "h"), by(sha, "h"))
    known = single.unionByName(done.select(*single.columns))

    ids = conversations.select(F.col(conv_col).alias("id")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    gaps = zero(F.col("high") - F.col("low") + 1 - F.col("turns"))
    return ids.join(known, F.col("id").eqNullSafe(F.col("conv")), "left").select(
        F.col("id").alias(conv_col), gaps.alias("gaps"), *(zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(EMPTY_SHA256)).alias("repaired_sha256"),
    )


def with_earlier_turns(chunks: DataFrame) -> DataFrame:
    """Chunks of conversations in several parts, with ``again``: places of turns whose role and text an earlier part has."""
    turns = chunks.select("part", "conv", "chunk", F.explode("codes").alias("t")).filter(~F.col("t.fault").isin(BLANK, DUPLICATE))
    turns = turns.select("part", "conv", "chunk", "t.place", F.struct("conv", "t.role", "t.digest").alias("key"))  # one of each part
    earliest = Window.partitionBy("key").orderBy("part")
    later = turns.withColumn("nth", F.row_number().over(earliest)).filter("nth > 1").groupBy(F.struct("part", "conv", "chunk").alias("at")).agg(F.collect_list("place").alias("again"))
    return chunks.join(later, F.struct("part", "conv", "chunk").eqNullSafe(F.col("at")), "left").drop("at").withColumn("again", F.coalesce("again", F.array().cast("array<int>")))


def paths_of(matrices: DataFrame, fan: int) -> DataFrame:
    """conv, best (cost, audit, path, tail) from matrices numbered from 1."""
    gathered = F.array_sort(F.collect_list(F.struct("n", "m")))
    compose: Callable[[Column, Column], Column] = lambda v, x: composed(v, x["m"])
    while (matrices.agg(F.max("n")).first()[0] or 0) > fan:
        groups = matrices.groupBy("conv", F.floor((F.col("n") - 1) / fan).alias("g")).agg(gathered.alias("x"))
        rows = F.array(*(F.aggregate("x", starting(k, True), compose) for k in range(4)))
        matrices = written(groups.select("conv", (F.col("g") + 1).alias("n"), rows.alias("m")), "conversation-level")
    return matrices.groupBy("conv").agg(gathered.alias("x")).select("conv", F.aggregate("x", starting(START, True), compose, ended).alias("best"))
