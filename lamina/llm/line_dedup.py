"""Reversible line dedup: exact reference-count tables with sharded cuckoo filters in front.

A line's key is the line stripped of white space with A-Z lower-cased; keys of at least ``LEAST`` code
points take part, as digests of 128 bits. The index has two exact tables: the references (key, document), from which
anything can be recovered, and the counts (key, number of documents, smallest document). Keys are dealt to shards by
digest, as many as keep ``SHARD_KEYS`` of them each, and a shard has two cuckoo filters: of all known keys, and of those
with two documents or more.

* Insertion: new keys pass the filter of known ones. What it doesn't let through is surely new and goes into the
  tables unseen; only the rest is joined to the exact counts, which also tell what the filter let through by mistake.
* Deletion: counts fall by what goes; a key without a document leaves both filters, one with a single document
  the second; where the smallest document goes, the next one comes from the references.
* Lookup: references pass the filter of repeated keys before they are joined to the exact counts.

Deleting what was inserted gives the tables as they were. Probing isn't one task per shard: a shard with many
rows is split into salted parts and its filter (about two bytes a key) goes to each part, where they stream past it.
Keys with over ``HOT`` documents are few (at most references / HOT) and joined by broadcast, so a hot line isn't dealt to one task.
Defined results: a null or empty text is one empty line; null ids are one document that comes after all
others (its rows' dropped lines are kept apart by text); rows with the same id are one document; repeated lines
of one document stay together; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import bounded_batches, written

LEAST, SHARD_KEYS, PART_ROWS, HOT = 10, 250_000, 100_000, 1_000
#: Rows of the hot keys' table that is broadcast; a larger one is shuffled.
NARROW = 1 << 20
SLOTS, KICKS, LOAD = 4, 500, 0.85
WHITE = b" \t\n\x0b\x0c\r"
#: ``part`` tells rows of the null document apart by their text, and is 0 for others.
REFS = "hi bigint, lo bigint, doc bigint, part bigint"
COUNTS = "hi bigint, lo bigint, n bigint, owner bigint"
FILTERS = "shard int, known binary, repeated binary"


def line_key(line: bytes, least: int = LEAST) -> bytes | None:
    """The key of a line of UTF-8; None if it is too short to take part."""
    key = line.strip(WHITE).lower()
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return key


class CuckooFilter:
    """16-bit tags of 128-bit digests, four to a bucket, in layers that double when one is full."""

    def __init__(self, layers: list[np.ndarray] | None = None):
        self.layers = layers or []

    @staticmethod
    def load(data: bytes | None) -> CuckooFilter:
        out, at = [], 0
        while data and at < len(data):
            n = int.from_bytes(data[at : at + 8], "little")
            out.append(np.frombuffer(data, np.uint16, n * SLOTS, at + 8).reshape(n, SLOTS).copy())
            at += 8 + 2 * n * SLOTS
        return CuckooFilter(out)

    def dump(self) -> bytes:
        return b"".join(len(x).to_bytes(8, "little") + x.tobytes() for x in self.layers)

    @staticmethod
    def places(hi: np.ndarray, lo: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tags and the two buckets of each key; each bucket follows from the other and the tag."""
        tag = np.maximum(lo.view(np.uint64) & np.uint64(0xFFFF), np.uint64(1))
        one = hi.view(np.uint64) & np.uint64(n - 1)
        return tag.astype(np.uint16), one.astype(np.int64), (one ^ CuckooFilter.turn(tag, n)).astype(np.int64)

    @staticmethod
    def turn(tag: np.ndarray, n: int) -> np.ndarray:
        return (tag.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & np.uint64(n - 1)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hi), bool)
        for layer in self.layers:
            tag, one, two = self.places(hi, lo, len(layer))
            found |= (layer[one] == tag[:, None]).any(1) | (layer[two] == tag[:, None]).any(1)
        return found

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Inserts keys that aren't members."""
        if not len(hi):
            return
        layer = self.layers[-1] if self.layers else None
        if layer is None or np.count_nonzero(layer) + len(hi) > LOAD * layer.size:
            n = 4
            while n * SLOTS * LOAD * 0.6 < len(hi) or layer is not None and n < 2 * len(layer):
                n *= 2
            layer = np.zeros((n, SLOTS), np.uint16)
            self.layers.append(layer)
        tag, one, two = self.places(hi, lo, len(layer))
        left = np.arange(len(hi))
        for where in (one, two):
            for slot in range(SLOTS):  # one key for each bucket at a time
                free = left[layer[where[left], slot] == 0]
                _, first = np.unique(where[free], return_index=True)
                layer[where[free[first]], slot] = tag[free[first]]
                left = np.setdiff1d(left, free[first], assume_unique=True)
        for i in left.tolist():
            self._kick(layer, tag[i], int(one[i]), i)

    def _kick(self, layer: np.ndarray, tag: np.uint16, bucket: int, turn: int) -> None:
        for step in range(KICKS):
            empty = np.flatnonzero(layer[bucket] == 0)
            if len(empty):
                layer[bucket, empty[0]] = tag
                return
            slot = (turn + step) % SLOTS
            layer[bucket, slot], tag = tag, layer[bucket, slot]
            bucket ^= int(self.turn(np.array([tag], np.uint64), len(layer))[0])
        # No place: an overflow layer of the same geometry takes the displaced tag at its bucket.
        spare = next((x for x in self.layers if len(x) == len(layer) and x is not layer), None)
        if spare is None or not (spare[bucket] == 0).any():
            spare = np.zeros_like(layer)
            self.layers.insert(0, spare)
        spare[bucket, np.flatnonzero(spare[bucket] == 0)[0]] = tag

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Deletes keys that are members, one of each bucket at a time."""
        left = np.arange(len(hi))
        for layer in reversed(self.layers):
            for _ in range(KICKS):
                tag, one, two = self.places(hi[left], lo[left], len(layer))
                bucket = np.where((layer[one] == tag[:, None]).any(1), one, two)
                match = layer[bucket] == tag[:, None]
                here = np.flatnonzero(match.any(1))
                if not len(here):
                    break
                _, first = np.unique(bucket[here], return_index=True)
                here = here[first]
                layer[bucket[here], match[here].argmax(1)] = 0
                left = np.delete(left, here)


def references(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """``REFS``: a row for each distinct key of each document."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            digests, of = [], []
            for k, text in enumerate(batch.column(2)):
                if text.is_valid:
                    found = {xxh3_128_digest(key) for line in text.as_buffer().to_pybytes().split(b"\n") if (key := line_key(line, least)) is not None}
                    digests += found
                    of += [k] * len(found)
            pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            of = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), batch.column(0).take(of), batch.column(1).take(of)], names=["hi", "lo", "doc", "part"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), part_of(F.col(id_col), F.col(text_col)).alias("part"), text_col).mapInArrow(of_batches, REFS).distinct()


def part_of(doc: Column, text: Column) -> Column:
    return F.when(doc.isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def counted(refs: DataFrame) -> DataFrame:
    """``COUNTS``: documents of each key (those without an id are one), and the smallest."""
    nulls = F.max(F.when(F.col("doc").isNull(), 1).otherwise(0))
    return refs.groupBy("hi", "lo").agg((F.count("doc") + nulls).cast("long").alias("n"), F.min("doc").alias("owner"))


def shard_of(shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned("hi", 40), F.lit(shards)).cast("int").alias("shard")


@dataclass(frozen=True)
class LineIndex:
    """One version of the index: its tables are written, and older versions stay as they were."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int = 0
    least: int = LEAST

    @staticmethod
    def empty(spark: SparkSession, least: int = LEAST) -> LineIndex:
        bounded_batches(spark)
        return LineIndex(*(spark.createDataFrame([], kind) for kind in (REFS, COUNTS, FILTERS)), 0, least)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index after the lines of ``docs`` came in; ids that it has already must be deleted first."""
        new = written(references(docs, id_col, text_col, self.least), "line-refs")
        came = written(counted(new), "line-came")
        if not self.shards:
            return LineIndex(self.refs.unionByName(new), came, self.filters, 0, self.least)._with_filters(came)
        maybe = written(self._probed(came.select("hi", "lo", "n", "owner"), "known"), "line-probed")
        old = self.counts.join(maybe.filter("held").select("hi", "lo"), ["hi", "lo"], "left_semi").select("hi", "lo", F.col("n").alias("old_n"), F.col("owner").alias("old_owner"))
        both = maybe.filter("held").join(old, ["hi", "lo"], "left").select("hi", "lo", "n", "owner", F.coalesce("old_n", F.lit(0).cast("long")).alias("old_n"), "old_owner")
        sure = maybe.filter("NOT held").select("hi", "lo", "n", "owner", F.lit(0).cast("long").alias("old_n"), F.lit(None).cast("long").alias("old_owner"))
        total = F.col("n") + F.col("old_n")
        changed = written(both.unionByName(sure).select("hi", "lo", total.alias("n"), F.least("owner", "old_owner").alias("owner"), "old_n"), "line-changed")
        counts = written(self.counts.join(changed.filter("old_n > 0"), ["hi", "lo"], "left_anti").unionByName(changed.drop("old_n")), "line-counts")
        return LineIndex(self.refs.unionByName(new), counts, self.filters, self.shards, self.least)._with_filters(changed)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """The index after the documents of ``ids`` went."""
        gone = written(ids.select(F.col(id_col).cast("long").alias("gone")).distinct(), "line-gone")
        same = F.col("doc").eqNullSafe(F.col("gone"))
        left = written(self.refs.join(gone, same, "left_anti"), "line-refs")
        went = counted(self.refs.join(gone, same, "left_semi")).withColumnsRenamed({"n": "old", "owner": "was"})
        touched = written(self.counts.join(went, ["hi", "lo"]).select("hi", "lo", F.col("n").alias("old_n"), (F.col("n") - F.col("old")).alias("n"), "owner", F.col("was").eqNullSafe(F.col("owner")).alias("lost")), "line-touched")
        # Only where the smallest document went are the references asked.
        orphans = touched.filter("n > 0 AND lost").select("hi", "lo")
        next_owner = left.join(orphans, ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.min("doc").alias("next"))
        changed = touched.join(next_owner, ["hi", "lo"], "left").select("hi", "lo", "n", F.when(F.col("lost"), F.col("next")).otherwise(F.col("owner")).alias("owner"), "old_n")
        changed = written(changed, "line-changed")
        counts = written(self.counts.join(changed, ["hi", "lo"], "left_anti").unionByName(changed.filter("n > 0").drop("old_n")), "line-counts")
        return LineIndex(left, counts, self.filters, self.shards, self.least)._with_filters(changed)

    def _with_filters(self, changed: DataFrame) -> LineIndex:
        """The filters after ``changed`` (``COUNTS`` and old_n); built anew from the counts where shards have grown too large."""
        n_keys = self.counts.count()
        shards = self.shards
        if n_keys > 2 * SHARD_KEYS * shards or not shards:
            shards, changed = max(1, -(-n_keys // SHARD_KEYS)), self.counts
            filters = None
        else:
            filters = self.filters
        if "old_n" not in changed.columns:
            changed = changed.withColumn("old_n", F.lit(0).cast("long"))
        keys = changed.select(shard_of(shards), "hi", "lo", "n", "old_n")

        def of_shard(old: pa.Table | None, new: pa.Table) -> pa.Table:
            held = {name: CuckooFilter.load(old[name][0].as_py() if old is not None and old.num_rows else None) for name in ("known", "repeated")}
            if new.num_rows:
                hi, lo, n, was = (new[c].to_numpy() for c in ("hi", "lo", "n", "old_n"))
                for f, least in zip(held.values(), (1, 2)):
                    leaves, enters = (was >= least) & (n < least), (was < least) & (n >= least)
                    f.delete(hi[leaves], lo[leaves])
                    f.insert(hi[enters], lo[enters])
            number = (new if new.num_rows else old)["shard"][0].as_py()
            return pa.table({"shard": pa.array([number], pa.int32()), **{name: pa.array([f.dump()], pa.binary()) for name, f in held.items()}})

        if filters is None:
            made = keys.groupBy("shard").applyInArrow(lambda new: of_shard(None, new), FILTERS)  # about SHARD_KEYS keys in a group
        else:
            made = filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(of_shard, FILTERS)
        return LineIndex(self.refs, self.counts, written(made, "line-filters"), shards, self.least)

    def _probed(self, keys: DataFrame, which: str) -> DataFrame:
        """``keys`` (hi, lo and others) with ``held``: whether their shard's filter of that name has them."""
        rows = keys.select("*", shard_of(self.shards))
        parts = written(rows.groupBy("shard").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")), "line-parts")
        turn = F.pmod(F.xxhash64(*keys.columns), F.col("parts")).alias("turn")
        rows = rows.join(F.broadcast(parts), "shard").select("shard", turn, F.lit(1).alias("kind"), *keys.columns, F.lit(None).cast("binary").alias("filter"))  # a row for each shard
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("turn")
        filters = self.filters.join(F.broadcast(parts), "shard").select("shard", each, F.lit(0).alias("kind"), *(F.lit(None).cast(keys.schema[c].dataType).alias(c) for c in keys.columns), F.col(which).alias("filter"))
        names = keys.columns

        def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, of = CuckooFilter(), None
            for batch in batches:
                shard, part, kind = (batch.column(k).to_numpy() for k in range(3))
                hi, lo = (batch.column(c).fill_null(0).to_numpy() for c in ("hi", "lo"))
                at = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1]))[: len(shard)])
                for a, b in zip(at.tolist(), [*at[1:].tolist(), len(shard)]):
                    if kind[a] == 0:
                        held, of = CuckooFilter.load(batch.column("filter")[a].as_py()), (shard[a], part[a])
                        continue
                    yes = held.contains(hi[a:b], lo[a:b]) if of == (shard[a], part[a]) else np.zeros(b - a, bool)
                    own = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names), pa.array(yes)], names=[*names, "held"])

        dealt = rows.unionByName(filters).repartition("shard", "turn").sortWithinPartitions("shard", "turn", "kind")
        return dealt.mapInArrow(of_batches, T.StructType([*keys.schema.fields, T.StructField("held", T.BooleanType())]))

    def candidates(self) -> DataFrame:
        """References whose key may repeat, by the filters."""
        return self._probed(self.refs, "repeated").filter("held").drop("held") if self.shards else self.refs

    def drops(self) -> DataFrame:
        """References (``REFS``) whose lines go: those of a key with two documents or more, but the smallest's."""
        maybe = written(self.candidates(), "line-candidates")
        repeated = self.counts.filter("n > 1").select(F.col("hi").alias("of_hi"), F.col("lo").alias("of_lo"), "n", "owner")
        hot = written(repeated.filter(F.col("n") > HOT), "hot-lines")
        n_hot = hot.count()
        same = (F.col("hi") == F.col("of_hi")) & (F.col("lo") == F.col("of_lo"))
        goes = ~F.col("doc").eqNullSafe(F.col("owner"))
        if not 0 < n_hot <= NARROW:
            return maybe.join(repeated, same).filter(goes).select(*maybe.columns)
        marked = maybe.join(F.broadcast(hot), same, "left")
        of_hot = marked.filter(F.col("n").isNotNull() & goes).select(*maybe.columns)
        others = maybe.join(F.broadcast(hot), same, "left_anti").join(repeated.filter(F.col("n") <= HOT), same)
        return of_hot.unionByName(others.filter(goes).select(*maybe.columns))

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``id_col``, n_lines, n_dropped, kept_text for rows of ``docs``, whose documents are in the index."""
        drops = self.drops().groupBy("doc", "part").agg(F.collect_list(F.struct("lo", "hi")).alias("drops"))  # lines of one document
        drops = drops.select(F.col("doc").alias("of_doc"), F.col("part").alias("of_part"), "drops")
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc"), part_of(F.col(id_col), F.col(text_col)).alias("part"))
        least = self.least

        def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from xxhash import xxh3_128_digest

            for batch in batches:
                n_lines, n_dropped, kept = [], [], []
                for text, gone in zip(batch.column(1), batch.column(2).to_pylist()):
                    lines = (text.as_buffer().to_pybytes() if text.is_valid else b"").split(b"\n")
                    n_lines.append(len(lines))
                    if gone:
                        gone = {g["hi"].to_bytes(8, "little", signed=True) + g["lo"].to_bytes(8, "little", signed=True) for g in gone}
                        lines = [x for x in lines if (k := line_key(x, least)) is None or xxh3_128_digest(k) not in gone]
                    n_dropped.append(n_lines[-1] - len(lines))
                    kept.append(b"\n".join(lines))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_lines", "n_dropped", "kept_text"])

        joined = rows.join(drops, F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("part") == F.col("of_part")), "left").select("id", "text", "drops")
        out = joined.mapInArrow(of_batches, f"id {docs.schema[id_col].dataType.simpleString()}, n_lines bigint, n_dropped bigint, kept_text string")
        return out.withColumnRenamed("id", id_col)
