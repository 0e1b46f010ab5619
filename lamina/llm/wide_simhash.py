"""SimHash near-duplicates at a Jaccard similarity of 0.8: fingerprints of 256 bits in a byte-position inverted index.

Sets of shingles with Jaccard similarity J have cosine 2J/(1+J), and each fingerprint bit differs with
probability acos(cosine)/pi: at J = 0.8, 38.8 bits of 256 on average, standard deviation 5.7. ``MAX_BITS`` is
that and 3.4 deviations: pairs within it are candidates. Unrelated texts differ in 128 +- 8 bits.

Index: 32 positional bytes, and a posting list for each of 96 pairs of positions and the bytes there (``LAGS``: the distances
of the two positions on a ring). Two texts meet if such a pair of bytes agrees. Bytes agree with probability 0.27 at
J = 0.8, and of the candidates at that similarity 0.99 meet by the formula; a pair that is more alike hardly ever fails.
Lists grow with the corpus (n / 65536 random members).

No list is capped and no pairs are written out. First, texts next to each other in an index sorted over a
few positions are linked, which collapses large groups. Then every list is compared in full, but
only candidates between different groups count; a list over ``BLOCK`` members is split into a grid of cells, in which only
members outside its largest group meet all others, so a hot group is not compared with itself.

Candidates make clusters, and links are verified inside them: the sets of shingles of a cluster's texts are
compared exactly, by counting what each two share. A large cluster is cut into blocks of ``MEMBERS`` texts or
``WEIGHT`` shingles, and each two blocks meet in a cell of their own; a cell passes on what connects its links.
A near copy below the similarity is thus no link, however many of them there are. Components are of verified links.

Nodes are XXH64 values of fingerprints. Defined results: a null, empty or blank text has fingerprint zero; a bit
tied among the shingles is that of their digests' sum, so sets of few shingles stay apart; null ids are kept and come
last; repeated rows share a component; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .simhash import TALLY, connected, of_links, shingle_digests
from .storage import bounded_batches, written, written_once

WORDS = ("w0", "w1", "w2", "w3")
BYTES = 8 * len(WORDS)
#: Fingerprints that differ in at most so many bits are candidates.
MAX_BITS = 58
#: Members of a list that are compared at a time.
BLOCK = 4096
#: Distances of two positions on the ring of 32.
LAGS = (1, 2, 3)
#: Positions whose sorted lists collapse large groups before all lists are compared.
COLLAPSING = range(0, BYTES, 4)
#: Texts, and shingles about, of a block in which links are verified; different shingles counted at a time.
MEMBERS, WEIGHT, COLUMNS = 256, 1 << 20, 4096
#: Rows of a narrow table that is broadcast; a larger one is shuffled.
NARROW = 1 << 20


def remixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64 bits of a digest (the SplitMix64 finaliser)."""
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingle_set(text: pa.Scalar, words: int) -> np.ndarray:
    """The different shingles of a text, as sorted XXH64 values."""
    return np.unique(np.frombuffer(b"".join(shingle_digests(text.as_buffer().to_pybytes() if text.is_valid else b"", words)), np.uint64))


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """Four signed 64-bit integers: the bits that most of the shingles have."""
    if not len(h):
        return np.zeros(len(WORDS), np.int64)
    tally = np.zeros(64 * len(WORDS), np.int64)
    for k in range(0, len(h), TALLY):
        part = np.stack([remixed(h[k : k + TALLY], w) for w in range(len(WORDS))], axis=1)
        tally += np.unpackbits(part.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    whole = h.sum(keepdims=True, dtype=np.uint64)
    tied = np.unpackbits(np.stack([remixed(whole, w) for w in range(len(WORDS))], axis=1).view(np.uint8))
    return np.packbits(2 * tally + tied > len(h)).view(np.int64)


def wide_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """id, text_hash (XXH64 of the text), n_shingles and the fingerprint's words for every row."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch.column(2)]
            table = np.array([wide_fingerprint(h) for h in sets], np.int64).reshape(-1, len(WORDS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, sets), pa.int64()), *(pa.array(c) for c in table.T)], names=["id", "text_hash", "n_shingles", *WORDS])

    fields = "".join(f", {w} bigint" for w in WORDS)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), text_col).mapInArrow(of_batches, f"id {docs.schema[id_col].dataType.simpleString()}, text_hash bigint, n_shingles bigint{fields}")


def postings(texts: DataFrame, positions: range = range(BYTES), lag: int = 1) -> DataFrame:
    """A row of ``texts`` for each of the positions, with ``list``: the position, the byte there and the one ``lag`` positions on."""
    byte = lambda i: F.shiftrightunsigned(F.col(WORDS[i % BYTES // 8]), i % 8 * 8).bitwiseAND(255)
    keys = [F.lit(((p << 5) + lag) << 16) + F.shiftleft(byte(p + lag), 8) + byte(p) for p in positions]
    return texts.select(F.explode(F.array(*keys)).alias("list"), *texts.columns)


def frequent_bytes(texts: DataFrame) -> list[int]:
    """Position and byte (in one number) that more than ``BLOCK`` texts have: only lists of two such may be long."""
    byte = lambda i: F.shiftrightunsigned(F.col(WORDS[i // 8]), i % 8 * 8).bitwiseAND(255)
    rows = texts.select(F.explode(F.array(*(byte(p) + (p << 8) for p in range(BYTES)))).alias("x"))
    return [r["x"] for r in rows.groupBy("x").count().filter(F.col("count") > BLOCK).collect()]  # at most 8192


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(w).to_numpy() for w in WORDS], axis=1).view(np.uint64)


def near(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= bits


def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    found = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def links_to_neighbours(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links of each row, in the order of lists, to the one before and to the list's first in the batch."""
    for batch in batches:
        lists, nodes, fps = batch.column("list").to_numpy(), batch.column("node").to_numpy(), matrix(batch)
        if not len(lists):
            continue
        first = np.maximum.accumulate(np.where(np.concatenate(([True], lists[1:] != lists[:-1])), np.arange(len(lists)), 0))
        here = np.flatnonzero(first < np.arange(len(lists)))
        for other in (here - 1, first[here]):
            good = near(fps[here], fps[other], bits)
            yield pairs(nodes[here[good]], nodes[other[good]])


def links_in_cells(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links between groups for all pairs of rows with the same cell; rows come sorted by cell."""

    def of_rows(cells: np.ndarray, roots: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        left, right = [], []
        here = np.arange(len(cells))
        for lag in range(1, len(cells)):
            here = here[here + lag < len(cells)]
            here = here[cells[here] == cells[here + lag]]
            if not len(here):
                break
            apart = here[roots[here] != roots[here + lag]]
            good = apart[near(fps[apart], fps[apart + lag], bits)]
            if len(good):
                left.append(roots[good])
                right.append(roots[good + lag])
        none = np.zeros(0, np.int64)
        return pairs(np.concatenate(left or [none]), np.concatenate(right or [none]))

    for rows in whole_groups(batches, "cell", lambda batch: (batch.column("cell").to_numpy(), batch.column("root").to_numpy(), matrix(batch))):
        yield of_rows(*rows)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, columns: Callable) -> Iterator[tuple]:
    """``columns`` (arrays, that of ``key`` first) of rows that come sorted by ``key``, so that no key is cut."""
    rest = None
    for batch in batches:
        rows = columns(batch)
        if rest is not None:
            rows = tuple(np.concatenate(x) for x in zip(rest, rows))
        if not len(rows[0]):
            continue
        open_from = np.searchsorted(rows[0], rows[0][-1])  # the last key may go on
        rest = tuple(x[open_from:] for x in rows)
        yield tuple(x[:open_from] for x in rows)
    if rest is not None:
        yield rest


def cells_of(texts: DataFrame, lag: int, frequent: list[int]) -> DataFrame:
    """cell, root and fingerprint: every two members of a list with different roots share a cell of bounded size."""
    rows = postings(texts.select("root", *WORDS), range(BYTES if 2 * lag < BYTES else lag), lag)
    if not frequent:
        return rows.withColumnRenamed("list", "cell")
    at = F.shiftright("list", 21)
    of_two = [F.shiftleft(at, 8) + F.col("list").bitwiseAND(255), F.shiftleft(F.pmod(at + lag, F.lit(BYTES)), 8) + F.shiftright("list", 8).bitwiseAND(255)]
    maybe = rows.filter(of_two[0].isin(frequent) & of_two[1].isin(frequent))
    long = written(maybe.groupBy("list").count().filter(F.col("count") > BLOCK).select(F.col("list").alias("long")), "long-lists")
    short = rows.join(long, rows["list"] == long["long"], "left_anti").select(F.xxhash64("list").alias("cell"), "root", *WORDS)
    hot = rows.join(long, rows["list"] == long["long"]).drop("long")
    sizes = hot.groupBy("list", "root").agg(F.count("*").alias("n")).groupBy(F.col("list").alias("long")).agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"))
    # Lists within one group need no comparison.
    sizes = written(sizes.filter("n > most.n").select("long", F.col("most.root").alias("main"), F.ceil(F.col("n") / BLOCK).alias("columns"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).alias("lines")), "long-list-sizes")
    found = hot.join(sizes, hot["list"] == sizes["long"]).withColumn("turn", F.xxhash64(*WORDS))
    across = found.withColumn("line", F.explode(F.expr("sequence(0, lines - 1)"))).withColumn("column", F.expr("pmod(turn, columns)"))
    down = found.filter("root != main").withColumn("column", F.explode(F.expr("sequence(0, columns - 1)"))).withColumn("line", F.expr("pmod(turn, lines)"))
    grid = across.unionByName(down).select(F.xxhash64("list", "line", "column").alias("cell"), "root", *WORDS)
    return short.unionByName(grid)


def links_between(texts: DataFrame, lags: Iterable[int], bits: int) -> DataFrame:
    """Links between different groups from the lists of pairs of positions, a round for each distance."""
    frequent, found = frequent_bytes(texts), []
    for lag in lags:
        cells = cells_of(texts, lag, frequent).repartition("cell").sortWithinPartitions("cell")
        found.append(written_once(cells.mapInArrow(lambda it: links_in_cells(it, bits), "a bigint, b bigint").distinct(), f"links-{lag}"))
    return reduce(DataFrame.union, found).distinct()


def candidate_clusters(texts: DataFrame, lags: Iterable[int] = LAGS, bits: int = MAX_BITS) -> DataFrame:
    """(node, root) of the components of all candidates that meet; texts without one aren't in it."""
    ordered = postings(texts.select("node", *WORDS), COLLAPSING).repartitionByRange("list", *WORDS).sortWithinPartitions("list", *WORDS)
    first = connected_components(ordered.mapInArrow(lambda it: links_to_neighbours(it, bits), "a bigint, b bigint").distinct())
    named = first.select(F.col("node").alias("member"), "root")
    grouped = written(texts.select("node", *WORDS).join(named, F.col("node") == F.col("member"), "left").select(F.coalesce("root", "node").alias("root"), *WORDS), "first-roots")
    # Links between groups, and the links inside them.
    return connected_components(links_between(grouped, lags, bits).union(first.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def narrow(df: DataFrame) -> DataFrame:
    """A written narrow table with a broadcast hint if it has at most ``NARROW`` rows."""
    return F.broadcast(df) if df.count() <= NARROW else df


def shingle_sets(members: DataFrame, words: int) -> DataFrame:
    """cluster, blocks, node and the set of its text's shingles."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words).view(np.int64) for t in batch.column(3)]
            ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))], names=["cluster", "blocks", "node", "shingles"])

    return members.select("cluster", "blocks", "node", "text").mapInArrow(of_batches, "cluster bigint, blocks bigint, node bigint, shingles array<bigint>")


def alike(sets: list[np.ndarray], block: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of sets (of different blocks, if there are two) with that Jaccard similarity; what they share is counted exactly."""
    sizes = np.array([len(x) for x in sets])
    value, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(column, kind="stable")
    order = order[times[column[order]] > 1]  # what one set alone has is never shared
    column, owner = column[order], owner[order]
    shared = np.zeros((len(sets), len(sets)))
    for at in range(0, len(value), COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        if a < b:
            used, own = np.unique(column[a:b], return_inverse=True)
            has = np.zeros((len(sets), len(used)), np.float32)
            has[owner[a:b], own] = 1
            shared += has @ has.T
    whole = np.maximum(1, sizes[:, None] + sizes[None, :] - shared)
    good = np.triu(shared / whole >= similarity, 1)
    if len(np.unique(block)) > 1:
        good &= block[:, None] != block[None, :]
    return np.nonzero(good)


def verified_links(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) that connect the texts of each cluster that are alike."""
    row, column = F.least("block", "other"), F.greatest("block", "other")
    dealt = sets.withColumn("block", F.expr("pmod(xxhash64(node), blocks)")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    dealt = dealt.select(F.xxhash64("cluster", row, column).alias("cell"), "block", "node", "shingles").repartition("cell").sortWithinPartitions("cell")

    def columns(batch: pa.RecordBatch) -> tuple:
        ends, values = batch.column("shingles").offsets.to_numpy(), batch.column("shingles").values.to_numpy()
        sets = np.empty(batch.num_rows, object)
        for k in range(batch.num_rows):
            sets[k] = values[ends[k] : ends[k + 1]]
        return batch.column("cell").to_numpy(), batch.column("block").to_numpy(), batch.column("node").to_numpy(), sets

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, block, node, sets in whole_groups(batches, "cell", columns):
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: len(cell)])
            found = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)]):
                own, at = np.unique(node[a:b], return_index=True)  # repeated rows of a text
                if len(own) > 1:
                    found.append(connected(own, *alike([sets[a + k] for k in at], block[a + at], similarity)))
            yield of_links(found)

    return dealt.mapInArrow(of_batches, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``id_col``, text_hash, component (a node) and component_id (its smallest id) for every row."""
    bounded_batches(docs.sparkSession)
    rows = written(wide_fingerprints(docs, id_col, text_col, words).withColumn("node", F.xxhash64(*WORDS)), "wide-fingerprints")
    sample = F.min(F.struct("id", "text_hash")).alias("sample")
    texts = written(rows.groupBy("node", *WORDS).agg(F.min("id").alias("least"), sample, F.max("n_shingles").alias("n_shingles")), "distinct-wide-fingerprints")
    clusters = candidate_clusters(texts).select(F.col("node").alias("member"), F.col("root").alias("cluster"))
    # A cluster's least node is its root and no member of it.
    clusters = written(clusters.union(clusters.select(F.col("cluster").alias("member"), "cluster").distinct()), "clusters")
    members = written(texts.join(clusters, texts["node"] == clusters["member"]).select("node", "cluster", "n_shingles", F.col("sample.id").alias("of_id"), F.col("sample.text_hash").alias("of_hash")), "cluster-members")
    blocks = F.ceil(F.greatest(F.count("*") / MEMBERS, F.sum("n_shingles") / WEIGHT)).cast("long")
    large = written(members.groupBy(F.col("cluster").alias("large")).agg(blocks.alias("blocks")).filter("blocks > 1"), "large-clusters")
    needed = members.join(narrow(large), F.col("cluster") == F.col("large"), "left").select("node", "cluster", F.coalesce("blocks", F.lit(1)).cast("long").alias("blocks"), "of_id", "of_hash")
    needed = narrow(written(needed, "texts-to-verify"))
    body = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    found = body.join(needed, body["id"].eqNullSafe(needed["of_id"]) & (body["text_hash"] == needed["of_hash"]))
    links = verified_links(shingle_sets(found, words), similarity)
    roots = connected_components(links).select(F.col("node").alias("member"), "root")
    roots = roots.union(roots.select(F.col("root").alias("member"), "root").distinct())
    linked = written(texts.select("node", "least").join(roots, F.col("node") == F.col("member")).select("node", "root", "least"), "linked")
    firsts = written(linked.groupBy(F.col("root").alias("component")).agg(F.min("least").alias("component_id")), "component-ids")
    named = linked.join(firsts, linked["root"] == firsts["component"]).select(F.col("node").alias("member"), "component", "component_id")
    labels = texts.join(named, texts["node"] == F.col("member"), "left")
    labels = written(labels.select("node", F.coalesce("component", "node").alias("component"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")), "wide-labels")
    return rows.join(labels, "node").select(F.col("id").alias(id_col), "text_hash", "component", "component_id")
