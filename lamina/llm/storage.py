"""Tables that cut a job's lineage, written to the folder which all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch that goes to a Python worker: rows may hold long lists or texts.
BATCH_BYTES = 16 << 20
#: Where new tables go, under the shared folder.
FOLDER: ContextVar[str] = ContextVar("FOLDER", default="lamina")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, a folder of our own in local mode (as in tests) and an error elsewhere."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="spark-lamina-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{FOLDER.get()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are made inside are deleted at its end, also by an error: what is to stay must have been written elsewhere by then.

    It may be nested. An operator's result reads its own tables, so nothing that was made inside may be run after it.
    """
    folder = f"{FOLDER.get()}/scratch-{uuid.uuid4().hex}"
    token = FOLDER.set(folder)
    try:
        yield
    finally:
        FOLDER.reset(token)
        deleted(spark, f"{shared_dir(spark)}/{folder}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, reread: lost executors cost no earlier stage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_once(df: DataFrame, name: str) -> DataFrame:
    """As ``written``, for a ``df`` that isn't run again: its shuffle files go as soon as the table is there."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        return written(df, name)
    finally:
        spark.conf.set(key, before)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made and no later result reads."""
    for file in df.inputFiles()[:1]:
        deleted(df.sparkSession, file.rsplit("/", 1)[0])


def deleted(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, on whichever store it is; one that isn't there is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Batches for Python workers end at ``most`` bytes too, not only at a number of rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
