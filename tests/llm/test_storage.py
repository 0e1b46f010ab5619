"""Tables in the shared folder and their end."""

import os

import pytest

from lamina.llm import simhash
from lamina.llm.storage import dropped, fresh_path, scratch, shared_dir, written


def files(folder: str) -> set[str]:
    return {os.path.join(d, f) for d, _, names in os.walk(folder.removeprefix("file:")) for f in names}


def test_scratch_tables_go(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, None)], "doc_id bigint, text string")
    before, out = files(shared_dir(spark)), str(tmp_path / "out")
    with scratch(spark):
        simhash.near_duplicates(rows).write.parquet(out)
        inside = files(shared_dir(spark)) - before
    assert inside and files(shared_dir(spark)) == before and spark.read.parquet(out).count() == 3


def test_scratch_is_nested_and_ends_with_an_error(spark):
    rows, before = spark.range(3), files(shared_dir(spark))
    with scratch(spark):
        kept = written(rows, "outer")
        with pytest.raises(ValueError), scratch(spark):
            written(rows, "inner")
            raise ValueError
        assert kept.count() == 3
        assert "scratch-" in fresh_path(spark, "x")
    assert files(shared_dir(spark)) == before and "scratch-" not in fresh_path(spark, "x")
    with scratch(spark):
        pass  # nothing was written


def test_dropped_table_is_gone(spark):
    before = files(shared_dir(spark))
    dropped(written(spark.range(3), "gone"))
    dropped(spark.range(3))  # no files
    assert files(shared_dir(spark)) == before
