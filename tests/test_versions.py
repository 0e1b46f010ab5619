import pytest
from pyspark.sql import functions as F

from lamina.sources.versions import VersionedTable, changes

SCHEMA = "id bigint, name string, seq bigint"


def rows(df):
    return sorted(map(tuple, df.select("id", "name", "seq").collect()))


def table(spark, path):
    return VersionedTable(spark, str(path), "id", SCHEMA, buckets=4)


def some(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def test_every_version_stays_readable(spark, tmp_path):
    t = table(spark, tmp_path)
    assert rows(t.read()) == [] and t.commits() == []
    assert t.upsert(some(spark, (1, "a", 1), (2, "b", 1), (None, "no key", 1)), 0)
    assert t.upsert(some(spark, (2, "c", 2), (3, "d", 2), (3, "e", 5), (3, "f", 4)), 1, order=("seq",))
    assert t.upsert(some(spark, (1, "gone", 3)), 2, delete=F.col("name") == "gone")
    assert rows(t.read(1)) == [(1, "a", 1), (2, "b", 1)]
    assert rows(t.read(2)) == [(1, "a", 1), (2, "c", 2), (3, "e", 5)]
    assert rows(t.read()) == [(2, "c", 2), (3, "e", 5)]
    with pytest.raises(ValueError, match="version 9"):
        t.read(9)


def test_a_batch_counts_once(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.upsert(some(spark, (1, "a", 1)), 7, "stream")
    assert not t.upsert(some(spark, (1, "again", 1)), 7, "stream") and not t.upsert(some(spark, (1, "older", 1)), 3, "stream")
    assert rows(t.read()) == [(1, "a", 1)] and len(t.commits()) == 1
    assert t.upsert(some(spark, (1, "other", 1)), 7, "another stream")
    assert not t.upsert(some(spark, (1, "again", 1)), 7, "stream")
    assert rows(t.read()) == [(1, "other", 1)]


def test_an_attempt_without_commit_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.upsert(some(spark, (1, "a", 1), (2, "b", 1)), 0)

    def fails(what):
        raise RuntimeError("lost before its commit")

    with monkeypatch.context() as m:
        m.setattr(t, "commit", fails)
        with pytest.raises(RuntimeError, match="lost"):
            t.upsert(some(spark, (1, "half", 2)), 1)
    assert rows(t.read()) == [(1, "a", 1), (2, "b", 1)]
    assert t.upsert(some(spark, (1, "half", 2)), 1)
    assert rows(t.read()) == [(1, "half", 2), (2, "b", 1)]


def test_two_writers_of_one_version(spark, tmp_path):
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    t.upsert(some(spark, (1, "a", 1)), 0)
    with pytest.raises(RuntimeError, match="another writer"):
        other.commit({"version": 1, "source": "x", "batch": 0, "folders": {}, "done": {}})
    assert rows(t.read()) == [(1, "a", 1)]


def test_a_stream_that_fails_and_goes_on(spark, tmp_path):
    source, t = str(tmp_path / "in"), table(spark, tmp_path / "table")
    for k in range(3):
        some(spark, (1, f"n{k}", k), (10 + k, "own", k)).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    own, failed = t.commit, []

    def after_commit(what):
        own(what)
        if what["batch"] == 1 and not failed:
            failed.append(1)
            raise RuntimeError("lost after its commit")

    t.commit = after_commit
    with pytest.raises(Exception, match="lost after"):
        t.write_stream(stream(), str(tmp_path / "checkpoint"), "s").awaitTermination()
    t.write_stream(stream(), str(tmp_path / "checkpoint"), "s").awaitTermination()
    assert failed and [c["batch"] for c in t.commits()] == [0, 1, 2]
    assert rows(t.read()) == [(1, "n2", 2), (10, "own", 0), (11, "own", 1), (12, "own", 2)]


def test_changes_between_versions(spark):
    old = some(spark, (1, "a", 1), (2, "b", None), (3, None, 3), (4, "d", 4))
    new = some(spark, (1, "a", 1), (2, "b", 2), (4, "x", 5), (5, "e", None))
    assert sorted((r.id, r.change, tuple(r.fields)) for r in changes(old, new, "id").collect()) == [(2, "changed", ("seq",)), (3, "deleted", ()), (4, "changed", ("name", "seq")), (5, "inserted", ())]
