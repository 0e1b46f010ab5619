"""Language-model scores by context-tree weighting of binary-decomposed bytes, beside a unigram base.

Text is scored as its bytes (UTF-8, A-Z lower-cased) and one end symbol. A byte is eight binary choices,
each with its own context tree over the ``DEPTH`` bytes before it. At every node the Krichevsky-Trofimov (KT)
estimate of its counts is weighted one half against the product of its children, as in the recursion
P(s) = (KT(s) + product of P(child)) / 2; a bit's probability mixes the estimates of all depths on its path with
the weights that follow. A node without counts estimates one half, so bytes that never followed a context are
scored by the same tree, and probabilities of all bytes add up to one.

Nothing is left out, and the model is a table. Workers count runs of DEPTH + 1 bytes of all texts, with their training
count and their count anywhere; Spark sums them, dealt by the ``SPLIT`` bytes before the last. All nodes deeper
than that lie in one such group, of at most 256 ** (DEPTH - SPLIT + 1) runs, and are worked out there; nodes above are
sums and joins by (depth, context, binary node). The result is each run's log-probability, a row for every run.
The most frequent runs, a bounded number (``HOT_RUNS``), are broadcast; those left over in a text are joined to the
table, once for each document that has them. The table's route doesn't change a score.

The base needs a count for every token. Words whose count puts them among the ``HOT_WORDS`` most
frequent are broadcast (a bound by number; words longer than ``HOT_BYTES`` are never among them);
all others are joined to the vocabulary, once for each document that has them.
Defined results: a null or empty text has one token (the end); with no training rows N = V = 0 and
every count is 0 and every bit has probability one half; a null id counts as the empty text in the split; repeated
rows are scored each; an empty table gives no rows; columns besides id and text aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import bounded_batches, written

DEPTH, SPLIT = 5, 3
HOT_WORDS, HOT_BYTES, HOT_RUNS = 131_072, 64, 1 << 19
#: Bytes scored at a time, words and runs that a worker counts before it passes them on, and runs whose nodes are worked out together.
STEP, WORDS_HELD, RUNS_HELD, TOGETHER = 1 << 19, 100_000, 500_000, 1 << 16
#: Bytes of a batch: what a text's words and runs take in a worker is many times its length.
BATCH = 4 << 20
#: Begins and ends a text; no byte of UTF-8 has this value.
EDGE = 0xFF
ALPHA = 0.1


def training_remainder(id_col: str, mod: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of DEPTH + 1 bytes, one for each symbol of ``texts``, and the number of the text each belongs to, in steps."""
    held, numbers, n = [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, len(text) + 1, STEP):
            before = text[max(0, at - DEPTH) : at]
            part = text[at : at + STEP]
            data = bytes([EDGE]) * (DEPTH - len(before)) + before + part + bytes([EDGE]) * (at + STEP > len(text))
            held.append(data)
            numbers.append(k)
            n += len(data)
            if n >= STEP:
                yield runs(held, numbers)
                held, numbers, n = [], [], 0
    if held:
        yield runs(held, numbers)


def runs(held: list[bytes], numbers: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The byte is in the low 8 bits, the one before it in the next 8, and so on."""
    b = np.frombuffer(b"".join(held), np.uint8)
    run = b[DEPTH:].astype(np.int64)
    for k in range(1, DEPTH + 1):
        run |= b[DEPTH - k : -k].astype(np.int64) << 8 * k
    lengths = np.array([len(x) for x in held])
    starts = np.cumsum(lengths) - lengths
    keep = np.ones(len(b), bool)
    for j in range(DEPTH):  # the bytes before a piece only give its context
        keep[starts + j] = False
    return run[keep[DEPTH:]], np.repeat(numbers, lengths - DEPTH)


def run_counts(docs: DataFrame, text_col: str, training: Column) -> DataFrame:
    """stem (the run's ``SPLIT`` last context bytes), run, n in training texts and m in all of ``docs``."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            learns = batch.column(1).to_pylist()
            for teaches in (True, False):
                for run, _ in pieces([lowered(t) for t, y in zip(batch.column(0), learns) if y == teaches]):
                    value, m = np.unique(run, return_counts=True)
                    held.append((value, m * teaches, m))
                if len(held) >= 8:
                    held = [merged(held)]
                    if len(held[0][0]) > RUNS_HELD:
                        yield of_runs(*held.pop())
        if held:
            yield of_runs(*merged(held))

    return docs.select(text_col, training.alias("learns")).mapInArrow(of_batches, "stem int, run bigint, n bigint, m bigint")


def stem(run: np.ndarray) -> np.ndarray:
    return run >> 8 & (1 << 8 * SPLIT) - 1


def of_runs(run: np.ndarray, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(stem(run).astype(np.int32)), pa.array(run), pa.array(n), pa.array(m)], names=["stem", "run", "n", "m"])


def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    value, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return value, *(np.bincount(where, np.concatenate([p[k] for p in parts])).astype(np.int64) for k in (1, 2))


def lowered(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes().lower() if text.is_valid else b""


def log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - sum(np.log(x + k) for k in range(8))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    out = np.zeros(len(zeros))
    some = np.flatnonzero(zeros + ones)
    a, b = zeros[some], ones[some]
    out[some] = log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - math.log(math.pi)
    return out


class Subtree:
    """For one of the eight choices: the nodes of the runs' contexts at depth ``SPLIT``, worked out from the deepest ones up.

    A node's number is its context, shifted by 8, and the binary node: a one and the bits of the byte that are known.
    """

    def __init__(self, run: np.ndarray, n: np.ndarray, level: int):
        byte = run & 255
        bit = byte >> (7 - level) & 1
        self.bit = bit == 1
        node, where = np.unique(run >> 8 << 8 | 1 << level | byte >> (8 - level), return_inverse=True)
        zeros, ones = np.bincount(where, n * (1 - bit), len(node)), np.bincount(where, n * bit, len(node))
        below, self.p = log_kt(zeros, ones), ((ones + 0.5) / (zeros + ones + 1))[where]
        for depth in range(DEPTH - 1, SPLIT - 1, -1):
            node, up = np.unique((node >> 8 & (1 << 8 * depth) - 1) << 8 | node & 255, return_inverse=True)
            zeros, ones = np.bincount(up, zeros, len(node)), np.bincount(up, ones, len(node))
            here, split = log_kt(zeros, ones), np.bincount(up, below, len(node))
            stop = 1 / (1 + np.exp(np.clip(split - here, -700, 700)))
            below = np.logaddexp(split, here) - math.log(2)
            where = up[where]
            self.p = (stop * (ones + 0.5) / (zeros + ones + 1))[where] + (1 - stop)[where] * self.p
        self.node, self.zeros, self.ones, self.below = node, zeros, ones, below


def subtrees(counts: DataFrame) -> DataFrame:
    """A row for each stem: its runs with n and m, and its nodes (binary node, zeros, ones, below: log of the weighted probability)."""
    node_kind = pa.struct([("node", pa.int32()), ("zeros", pa.float64()), ("ones", pa.float64()), ("below", pa.float64())])

    def of_rows(stems: np.ndarray, run: np.ndarray, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        levels = [Subtree(run, n, level) for level in range(8)]
        node, zeros, ones, below = (np.concatenate([getattr(x, k) for x in levels]) for k in ("node", "zeros", "ones", "below"))
        order = np.argsort(node >> 8, kind="stable")
        run_order = np.argsort(stems, kind="stable")
        own, starts = np.unique(stems[run_order], return_index=True)
        run_ends = pa.array(np.append(starts, len(run)).astype(np.int32))
        node_ends = pa.array(np.append(np.searchsorted(node[order] >> 8, own), len(node)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(run_ends, pa.array(x[run_order])) for x in (run, n, m)]
        nodes = pa.StructArray.from_arrays([pa.array((node[order] & 255).astype(np.int32)), pa.array(zeros[order]), pa.array(ones[order]), pa.array(below[order])], fields=list(node_kind))
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *lists, pa.ListArray.from_arrays(node_ends, nodes)], names=["stem", "runs", "n", "m", "nodes"])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            rest.append(tuple(batch.column(k).to_numpy() for k in range(4)))
            held += batch.num_rows
            if held < TOGETHER:
                continue
            rows = tuple(map(np.concatenate, zip(*rest)))
            open_from = np.searchsorted(rows[0], rows[0][-1])  # the last stem may go on
            if open_from:
                yield of_rows(*(x[:open_from] for x in rows))
            rest, held = [tuple(x[open_from:] for x in rows)], len(rows[0]) - open_from
        if held:
            yield of_rows(*map(np.concatenate, zip(*rest)))

    of_list = "array<struct<node: int, zeros: double, ones: double, below: double>>"
    whole = counts.repartition("stem").groupBy("stem", "run").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).sortWithinPartitions("stem")
    return whole.select("stem", "run", "n", "m").mapInArrow(of_batches, f"stem int, runs array<bigint>, n array<bigint>, m array<bigint>, nodes {of_list}")


def log_gamma_of(x: Column) -> Column:
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    product = x
    for k in range(1, 8):
        product = product * (x + k)  # of counts up to 10**15, a double holds it
    return series - F.log(product)


def weighted_nodes(nodes: DataFrame, depth: int) -> DataFrame:
    """context, node, kt, stop (the weight of ending here) and zeros, ones, below, of the contexts of ``depth`` bytes over those one deeper."""
    sums = nodes.groupBy(F.col("context").bitwiseAND((1 << 8 * depth) - 1).alias("context"), "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("split"))
    z, o = F.col("zeros"), F.col("ones")
    here = F.when(z + o == 0, 0.0).otherwise(log_gamma_of(z + 0.5) + log_gamma_of(o + 0.5) - log_gamma_of(z + o + 1) - math.log(math.pi))
    apart = F.least(F.lit(700.0), F.greatest(F.lit(-700.0), F.col("split") - F.col("here")))
    both = F.greatest("split", "here") + F.log1p(F.exp(-F.abs(F.col("split") - F.col("here")))) - math.log(2)
    return sums.withColumn("here", here).select("context", "node", "zeros", "ones", both.alias("below"), ((o + 0.5) / (z + o + 1)).alias("kt"), (1 / (1 + F.exp(apart))).alias("stop"))


def upper_weights(trees: DataFrame) -> DataFrame:
    """context (of SPLIT - 1 bytes), node, share, rest: a one has probability share + rest * its probability further down."""
    nodes, levels = trees.select(F.col("stem").alias("context"), F.inline("nodes")), []
    for depth in range(SPLIT - 1, -1, -1):
        nodes = written(weighted_nodes(nodes, depth), f"ctw-depth-{depth}")
        levels.append(nodes.select("context", "node", "kt", "stop"))
    out = None
    for depth, level in enumerate(reversed(levels)):
        if out is None:
            share, rest = F.lit(0.0), F.lit(1.0)
        else:
            above = out.select(F.col("context").alias("up"), F.col("node").alias("same"), "share", "rest")
            level = level.join(above, (F.col("context").bitwiseAND((1 << 8 * (depth - 1)) - 1) == F.col("up")) & (F.col("node") == F.col("same")))
            share, rest = F.col("share"), F.col("rest")
        out = level.select("context", "node", (share + rest * F.col("stop") * F.col("kt")).alias("share"), (rest * (1 - F.col("stop"))).alias("rest"))
    return out


def run_scores(trees: DataFrame) -> DataFrame:
    """run, m and log10 of the run's byte after the bytes before it, for every run."""
    upper = upper_weights(trees).groupBy("context").agg(F.collect_list(F.struct("node", "share", "rest")).alias("upper"))  # at most 255 nodes
    context = F.col("stem").bitwiseAND((1 << 8 * (SPLIT - 1)) - 1)
    rows = trees.select("runs", "n", "m", context.alias("own")).join(upper, F.col("own") == upper["context"]).select("context", "upper", "runs", "n", "m")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            context, upper = batch.column(0).to_numpy().astype(np.int64), batch.column(1)
            run, n, m = (batch.column(k).flatten().to_numpy() for k in (2, 3, 4))
            lengths = np.diff(upper.offsets.to_numpy())
            node, share, rest = (upper.flatten().field(k).to_numpy() for k in range(3))
            key, first = np.unique(np.repeat(context, lengths) << 8 | node, return_index=True)
            share, rest, out = share[first], rest[first], np.zeros(len(run))
            for level in range(8):
                tree = Subtree(run, n.astype(np.float64), level)
                at = np.searchsorted(key, (run >> 8 & (1 << 8 * (SPLIT - 1)) - 1) << 8 | 1 << level | (run & 255) >> (8 - level))
                p = share[at] + rest[at] * tree.p
                out += np.log10(np.where(tree.bit, p, 1 - p))
            yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(m), pa.array(out)], names=["run", "m", "log_p"])

    return rows.mapInArrow(of_batches, "run bigint, m bigint, log_p double")


class Table:
    """Integers to numbers in an open-addressing hash table of numpy arrays."""

    FREE = -1

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys) - 1).bit_length())
        self.keys, self.values = np.full(1 << self.bits, self.FREE, np.int64), np.zeros(1 << self.bits)
        left, at = np.arange(len(keys)), self.place(keys)
        while len(left):
            empty = left[self.keys[at[left]] == self.FREE]
            _, first = np.unique(at[empty], return_index=True)
            placed = empty[first]
            self.keys[at[placed]], self.values[at[placed]] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            at[left] = at[left] + 1 & (1 << self.bits) - 1

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and the positions of keys that aren't in the table."""
        at = self.place(keys)
        found = self.keys[at]
        out, missing = self.values[at], []
        left = np.flatnonzero(found != keys)
        while len(left):
            free = self.keys[at[left]] == self.FREE
            missing.append(left[free])
            left = left[~free]
            at[left] = at[left] + 1 & (1 << self.bits) - 1
            hit = self.keys[at[left]] == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit]
        return out, np.concatenate(missing) if missing else left


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """word (binary), n over all of ``docs``; the end isn't among them."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                held.update(lowered(text).split())
                if len(held) > WORDS_HELD:
                    yield of_counter(held)
                    held.clear()
        yield of_counter(held)

    return docs.select(text_col).mapInArrow(of_batches, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def grouped(number: np.ndarray, run: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Runs by their text's number; ``number`` is sorted."""
    own, starts = np.unique(number, return_index=True)
    return own.tolist(), np.split(run, starts[1:]) if len(own) else []


def of_words(cold: list[list[tuple[bytes, int]]]) -> pa.ListArray:
    ends = pa.array(np.cumsum([0, *map(len, cold)]).astype(np.int32))
    flat = [pa.array([x[j] for own in cold for x in own], kind) for j, kind in enumerate((pa.binary(), pa.int64()))]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(flat, names=["word", "n"]))


def of_pairs(rare: list[tuple[np.ndarray, np.ndarray]]) -> pa.ListArray:
    ends = pa.array(np.cumsum([0, *(len(r) for r, _ in rare)]).astype(np.int32))
    run, k = (np.concatenate([r[j] for r in rare]) if rare else np.zeros(0, np.int64) for j in (0, 1))
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(run), pa.array(k)], names=["run", "k"]))


def of_counter(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def most_frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """Rows of at least the lowest count that leaves at most ``most`` of them."""
    step = F.floor(F.log2(n) * 16).cast("int")  # a bounded number of steps for counts of any size
    room, least = most, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    return counts.filter(F.lit(False) if least is None else step >= least)


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", hot_words: int = HOT_WORDS, hot_runs: int = HOT_RUNS) -> DataFrame:
    """``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score and n_bytes for every row of ``docs``.

    Training rows are those for which ``training`` is true.
    """
    spark = docs.sparkSession
    bounded_batches(spark, BATCH)
    training = F.coalesce(training, F.lit(False))
    learn = docs.filter(training)
    vocabulary = written(word_counts(learn, text_col), "ctw-words")
    words, distinct = vocabulary.agg(F.sum("n"), F.count("*")).first()
    ends = learn.count()
    total, kinds = (words or 0) + ends, distinct + (ends > 0)
    short = most_frequent(vocabulary.filter(F.length("word") <= HOT_BYTES), "n", hot_words).toArrow()
    floor = math.log10(total + ALPHA * (kinds + 1))
    hot = spark.sparkContext.broadcast({w: math.log10(n + ALPHA) - floor for w, n in zip(short["word"].to_pylist(), short["n"].to_pylist())})
    trees = written(subtrees(run_counts(docs, text_col, training)), "ctw-subtrees")
    scores = written(run_scores(trees), "ctw-runs")
    often = most_frequent(scores, "m", hot_runs).select("run", "log_p").toArrow()
    runs_known = spark.sparkContext.broadcast(Table(often["run"].to_numpy(), often["log_p"].to_numpy()))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, tree = hot.value, runs_known.value
        of_end = math.log10(ends + ALPHA) - floor
        for batch in batches:
            texts = [lowered(t) for t in batch.column(2)]
            scores, rare = np.zeros(len(texts)), [[] for _ in texts]
            for run, number in pieces(texts):
                log_p, missing = tree.get(run)
                log_p[missing] = 0
                scores += np.bincount(number, log_p, len(texts))
                order = missing[np.argsort(number[missing], kind="stable")]
                for k, part in zip(*grouped(number[order], run[order])):
                    rare[k].append(part)
            rare = [np.unique(np.concatenate(r), return_counts=True) if r else (np.zeros(0, np.int64),) * 2 for r in rare]
            rows = []
            for text in texts:
                all_words = text.split()
                seen = Counter(all_words)
                got, cold = of_end, []
                n_known = int(ends > 0)
                for w, n in seen.items():
                    if (x := logs.get(w)) is None:
                        cold.append((w, n))
                    else:
                        got += n * x
                        n_known += n
                rows.append((len(all_words) + 1, n_known, got, cold, len(text)))
            n_tokens, n_known, base, cold, n_bytes = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64()),
                 pa.array(n_bytes, pa.int64()), of_words(cold), of_pairs(rare)],
                names=["id", "held_out", "n_tokens", "known_hot", "base_hot", "score_hot", "n_bytes", "cold", "rare"],
            )

    kind = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())]))
    out = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("known_hot", T.LongType()),
         T.StructField("base_hot", T.DoubleType()), T.StructField("score_hot", T.DoubleType()), T.StructField("n_bytes", T.LongType()), T.StructField("cold", kind), T.StructField("rare", T.ArrayType(T.StructType([T.StructField("run", T.LongType()), T.StructField("k", T.LongType())])))]
    )
    rows = docs.select(F.col(id_col).alias("id"), (~training).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(of_batches, out)
    # The row's number is written with it, so both branches below see the same one.
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "ctw-scored")
    cold = rows.select("row", F.explode("cold").alias("x")).select("row", "x.word", F.col("x.n").alias("k"))
    c = F.coalesce("n", F.lit(0))
    sums = cold.join(vocabulary, "word", "left").groupBy("row").agg(F.sum(F.col("k") * (F.log10(c + ALPHA) - floor)).alias("base_cold"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("known_cold"))
    rare = rows.select("row", F.inline("rare"))
    tails = rare.join(scores.select("run", "log_p"), "run").groupBy("row").agg(F.sum(F.col("k") * F.col("log_p")).alias("score_rare"))
    return rows.drop("cold", "rare").join(sums, "row", "left").join(tails, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known_hot") + F.coalesce("known_cold", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_hot") + F.coalesce("base_cold", F.lit(0.0))).alias("base_score"), (F.col("score_hot") + F.coalesce("score_rare", F.lit(0.0))).alias("score"), "n_bytes",
    )
