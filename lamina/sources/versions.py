"""A library table with versions: upserts from a stream that count once, and every version readable by its number.

Rows lie in buckets by a hash of their key. A batch rewrites the buckets of its own keys and no others; then one small file, the commit, names the
folder of every bucket, the batch and the version. A commit's name is its number, and it is made by a rename that fails if the name is taken, so
a version is there whole or not at all. A batch whose number is in a commit was done: replayed after a failure, it changes nothing; what a failed
attempt has left is named by no commit and never read.

Of several rows of a batch with one key the one that is last in ``order`` counts; rows with a null key are left out, as no key can name them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



class VersionedTable:
    """``path`` in a store that all executors share; ``source`` tells streams apart that write to one table."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 16):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def commits(self) -> list[dict]:
        """All versions, oldest first: version, source, batch, folders (by bucket), and the batches done so far by source."""
        folder = self.hadoop.Path(f"{self.path}/commits")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        found = self.spark.read.text([f"{self.path}/commits/{n}" for n in names if n.endswith(".json")], wholetext=True) if any(n.endswith(".json") for n in names) else None
        return sorted((json.loads(r[0]) for r in found.collect()), key=lambda c: c["version"]) if found is not None else []  # one small row a version

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest if none is named."""
        known = self.commits()
        if version is not None and version not in [c["version"] for c in known]:
            raise ValueError(f"version {version} is unknown")
        own = [c for c in known if version in (None, c["version"])]
        folders = sorted(own[-1]["folders"].values()) if own else []
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def upsert(self, rows: DataFrame, batch: int, source: str = "batch", order: tuple[str, ...] = (), delete: Column | None = None) -> bool:
        """Puts ``rows`` (by key) in place of those there; with ``delete`` those for which it holds are taken out. False if the batch was done before."""
        known = self.commits()
        last = known[-1] if known else {"version": 0, "folders": {}, "done": {}}
        if batch <= last["done"].get(source, -1):
            return False
        names = self.spark.createDataFrame([], self.schema).columns
        place = F.struct(*(F.col(c) for c in order), *(F.col(c) for c in names if c not in order))
        gone = F.coalesce(delete, F.lit(False)) if delete is not None else F.lit(False)
        new = rows.filter(F.col(self.key).isNotNull()).withColumn("gone", gone).groupBy(F.col(self.key).alias("of")).agg(F.max_by(F.struct(*names, "gone"), place).alias("x"))
        new = new.select("x.*").withColumn("bucket", self.bucket()).persist()
        try:
            touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # at most one for each bucket
            folders, attempt = dict(last["folders"]), f"{self.path}/data/{last['version'] + 1}-{uuid.uuid4().hex}"
            if touched:
                before = [folders[str(b)] for b in touched if str(b) in folders]
                old = self.spark.read.schema(self.schema).parquet(*before) if before else self.spark.createDataFrame([], self.schema)
                kept = old.join(new.select(self.key), self.key, "left_anti").select(*names).withColumn("bucket", self.bucket())
                kept.unionByName(new.filter(~F.col("gone")).drop("gone")).repartition("bucket").write.partitionBy("bucket").parquet(attempt)
                there = {s.getPath().getName().partition("=")[2] for s in self.fs.listStatus(self.hadoop.Path(attempt)) if s.isDirectory()}
                folders |= {b: f"{attempt}/bucket={b}" for b in there}
                folders = {b: f for b, f in folders.items() if int(b) not in touched or b in there}
            self.commit({"version": last["version"] + 1, "source": source, "batch": batch, "folders": folders, "done": last["done"] | {source: batch}})
        finally:
            new.unpersist()
        return True

    def commit(self, what: dict) -> None:
        """Fails if another writer has made this version."""
        folder = f"{self.path}/commits"
        self.fs.mkdirs(self.hadoop.Path(folder))
        draft, name = self.hadoop.Path(f"{folder}/{uuid.uuid4().hex}.draft"), self.hadoop.Path(f"{folder}/{what['version']:012d}.json")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps(what, sort_keys=True).encode()))
        out.close()
        if self.fs.exists(name) or not self.fs.rename(draft, name):
            self.fs.delete(draft, False)
            raise RuntimeError(f"version {what['version']} was made by another writer")

    def write_stream(self, stream: DataFrame, checkpoint: str, source: str, order: tuple[str, ...] = (), delete: Column | None = None):
        """A stream's batches as versions, each once; started with all that is there."""
        each = lambda rows, batch: self.upsert(rows, batch, source, order, delete) and None
        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``key``, change (inserted, deleted, changed) and fields (names that differ) between two versions; each key is in a version once."""
    names = [c for c in old.columns if c != key]
    whole = lambda df: df.select(key, F.struct(*names).alias("row"), F.xxhash64(*names).alias("hash"))
    a, b = whole(old).withColumnsRenamed({"row": "old", "hash": "old_hash"}), whole(new).withColumnsRenamed({"row": "new", "hash": "new_hash"})
    both = a.join(b, key, "full").filter("old_hash IS DISTINCT FROM new_hash")
    fields = F.array_compact(F.array(*(F.when(~F.col("old")[c].eqNullSafe(F.col("new")[c]), F.lit(c)) for c in names)))
    kind = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "deleted").otherwise("changed")
    return both.select(key, kind.alias("change"), F.when(kind == "changed", fields).otherwise(F.array().cast("array<string>")).alias("fields"))
