"""SimHash near-duplicates: fingerprints of word shingles, linked through a byte-position inverted index.

A fingerprint of 64 bits is eight positional bytes. Two fingerprints with at most r differing bits differ
in at most r bytes, so a pair must share at least 8 - r positional bytes: the guaranteed minimum of the
count filter. Postings of single bytes would be n / 256 long and meet nearly all pairs, so they are merged first:
the eight positions are four pairs of neighbours, of which such a pair shares 4 - r at least, and the index has a
list for every choice of 4 - r pairs and the bytes there (for r = 2: six lists of four bytes). In each list the
shared positional bytes of every pair of members are tallied, pairs reaching the minimum are retained, and these
are verified bit by bit. A list over ``LONG`` members is split by further positions, those that the minimum still
asks for, which leaves at most 256 ** r members in a part; they are verified by looking up the bit changes that
are left. No pair that reaches the minimum is lost, and no pairs are written out: a list passes on what connects its links.

Equal fingerprints count once in the index, so copies by the thousand cost one entry.
Defined results: a null, empty or blank text has fingerprint 0 and is linked like any other; fewer words
than a shingle make one shingle of all; null ids are kept and come last in a component (its id is null only
if all its ids are); repeated rows share a component; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import bounded_batches, written

SEED = 42
#: Shingles whose bits are tallied at a time; members of a list that are compared with each other; rows of such a comparison at a time.
TALLY, LONG, ROWS = 65_536, 2_048, 256


def shingle_digests(text: bytes, words: int) -> list[bytes]:
    """XXH64 of every run of ``words`` words (fewer words: of all of them; none: nothing)."""
    from xxhash import xxh64_digest

    tokens = text.lower().split()
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return [xxh64_digest(joined, SEED)] if tokens else []
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate(([0], ends[:-1]))[: len(tokens) - words + 1].tolist()
    return [xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]


def fingerprint(text: bytes, words: int = 3) -> int:
    """Bit set where more than half of the shingles' XXH64 have it; as a signed 64-bit integer."""
    digests = shingle_digests(text, words)
    if not digests:
        return 0
    tally = np.zeros(64, np.int64)
    for k in range(0, len(digests), TALLY):
        part = np.frombuffer(b"".join(digests[k : k + TALLY]), np.uint8).reshape(-1, 8)
        tally += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * tally > len(digests)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id, text_hash (XXH64 of the text) and fp for every row."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["id", "text_hash", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), text_col).mapInArrow(of_batches, f"id {docs.schema[id_col].dataType.simpleString()}, text_hash bigint, fp bigint")


def hexed(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def mask_of(positions: Iterable[int]) -> int:
    return signed(sum(0xFF << (8 * p) for p in positions))


def keys(bits: int) -> list[tuple[int, list[int]]]:
    """(mask, masks of its parts): the bytes of a list's key, and with those that a split list's parts have in common."""
    out = []
    for free in combinations(range(4), bits):
        left = [p for pair in free for p in (2 * pair, 2 * pair + 1)]
        held = [p for p in range(8) if p not in left]
        out.append((mask_of(held), [mask_of([*held, *(p for p in left if p not in loose)]) for loose in combinations(left, bits)]))
    return out


def shared_bytes(a: Column, b: Column) -> Column:
    """The tally of two fingerprints: positions with the same byte."""
    x, out = a.bitwiseXOR(b), F.lit(0)
    for p in range(8):
        out = out + F.when(F.shiftrightunsigned(x, 8 * p).bitwiseAND(255) == 0, 1).otherwise(0)
    return out


def links(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b) of the distinct values of column fp: pairs that connect whatever at most ``bits`` differing bits connect."""
    if not 0 < bits < 4:
        raise ValueError("bits is from 1 to 3")
    bounded_batches(distinct.sparkSession)
    masks = keys(bits)
    postings = distinct.select("fp", F.posexplode(F.array(*(F.lit(m) for m, _ in masks))).alias("key", "mask")).select("key", F.col("fp").bitwiseAND(F.col("mask")).alias("bytes"), "fp")
    lists = postings.groupBy("key", "bytes").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n")).filter("n > 1")
    lists = written(lists, "posting-lists")
    tallied = lists.filter("n = 2").filter(shared_bytes(F.col("a"), F.col("b")) >= 8 - bits)
    of_two = tallied.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select("a", "b")
    members = postings.join(lists.filter("n > 2").select("key", "bytes", (F.col("n") > LONG).alias("long")), ["key", "bytes"])
    members = written(members, "posting-members")
    short = members.filter("NOT long").groupBy("key", "bytes").agg(F.collect_list("fp").alias("fps"))  # at most LONG
    of_key = F.element_at(F.array(*(F.array(*map(F.lit, parts)) for _, parts in masks)), F.col("key") + 1)
    parts = members.filter("long").select("fp", F.explode(of_key).alias("mask")).groupBy("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bytes"))
    split = parts.agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)  # at most 256 ** bits

    def of_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield of_links([connected(np.array(fps, np.int64), *near_pairs(np.array(fps, np.int64), bits)) for fps in batch.column(0).to_pylist()])

    def of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for mask, fps in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                fps = np.sort(np.array(fps, np.int64))
                found.append(connected(fps, *changed_pairs(fps, ~mask, bits)))
            yield of_links(found)

    return of_two.union(short.select("fps").mapInArrow(of_short, "a bigint, b bigint")).union(split.select("mask", "fps").mapInArrow(of_parts, "a bigint, b bigint")).distinct()


def near_pairs(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs whose tally of shared bytes reaches the minimum, verified by their differing bits."""
    left, right = [], []
    for at in range(0, len(fps), ROWS):
        x = fps[at : at + ROWS, None] ^ fps[None, :]
        tally = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(2, dtype=np.uint8)
        i, j = np.nonzero(tally >= 8 - bits)
        good = (i + at < j) & (np.bitwise_count(x[i, j].view(np.uint64)) <= bits)
        left.append(i[good] + at)
        right.append(j[good])
    return np.concatenate(left), np.concatenate(right)


def changed_pairs(fps: np.ndarray, free: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for sorted fingerprints that differ in the ``free`` bits only: each bit change is looked up."""
    places = [1 << k for k in range(64) if free >> k & 1]
    left, right = [], []
    for change in (sum(c) for n in range(1, bits + 1) for c in combinations(places, n)):
        other = fps ^ np.int64(signed(change))
        at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
        i = np.flatnonzero((fps[at] == other) & (other > fps))
        left.append(i)
        right.append(at[i])
    return np.concatenate(left), np.concatenate(right)


def connected(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``nodes`` that the pairs of positions connect to another, with the first that it is connected to."""
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def of_links(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    none = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *(x[k] for x in found)])) for k in (0, 1)], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 2) -> DataFrame:
    """``id_col``, fingerprint (16 hex digits), component_id (its smallest id), component_fp and text_hash for every row."""
    rows = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = connected_components(links(distinct.select("fp"), bits))
    by_fp = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    by_fp = written(by_fp, "fingerprint-roots")
    least = written(by_fp.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")  # so a large component's rows can be split
    labels = by_fp.join(least, "root").select("fp", "component_id", hexed("root").alias("component_fp"))
    return rows.join(labels, "fp").select(F.col("id").alias(id_col), hexed("fp").alias("fingerprint"), "component_id", "component_fp", "text_hash")
