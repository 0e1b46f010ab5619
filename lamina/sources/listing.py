"""A folder's image listing kept up to date: new files come by a stream that has seen what was there before, deleted and overwritten ones by comparing listings.

Contents are never read. The listing is a ``VersionedTable``, so every refresh that changes something is a version, and one that is repeated after a failure counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .library import image_listing
from .versions import VersionedTable

FILE = "path string, length bigint, modificationTime timestamp"


class FolderListing:
    """``folder`` holds the files, ``home`` the table and the stream's checkpoint, in a store that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, home: str):
        self.spark, self.folder, self.home = spark, folder, home.rstrip("/")
        self.table = VersionedTable(spark, f"{self.home}/table", "path", FILE)

    def there(self) -> DataFrame:
        return self.spark.read.format("binaryFile").load(self.folder).select("path", "length", "modificationTime")

    def refresh(self) -> dict[str, int]:
        """new, overwritten, deleted: how many files of each kind this refresh has found."""
        content = "path string, modificationTime timestamp, length bigint, content binary"
        before = self.table.read().count()
        stream = self.spark.readStream.format("binaryFile").schema(content).load(self.folder).select("path", "length", "modificationTime")
        self.table.write_stream(stream, f"{self.home}/checkpoint", "new").awaitTermination()
        known, now = self.table.read(), self.there()
        new = known.count() - before
        both = known.withColumnsRenamed({"length": "l", "modificationTime": "m"}).join(now, "path", "full")
        fate = F.when(F.col("l").isNotNull() & F.col("length").isNull(), "deleted").when(F.col("l").isNull() | (F.col("l") != F.col("length")) | (F.col("m") != F.col("modificationTime")), "overwritten")
        differing = both.withColumn("fate", fate).filter("fate IS NOT NULL").select("path", "length", "modificationTime", "fate").persist()
        try:
            counts = {r["fate"]: r["count"] for r in differing.groupBy("fate").count().collect()}
            if counts:
                batch = max((c["batch"] for c in self.table.commits() if c["source"] == "compared"), default=-1) + 1
                self.table.upsert(differing, batch, "compared", delete=F.col("fate") == "deleted")
        finally:
            differing.unpersist()
        return {"new": new, "overwritten": counts.get("overwritten", 0), "deleted": counts.get("deleted", 0)}

    def read(self, version: int | None = None) -> DataFrame:
        """The images as they were listed, newest first."""
        return image_listing(self.table.read(version))
