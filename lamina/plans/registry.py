"""Queries by name, with SQL of the same columns and rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, paths: bool = False):
    """Registers a function of a table reader (name -> DataFrame), or with ``paths`` of the session and the tables' folder, under its own name."""

    def register(f):
        QUERIES[f.__name__] = f if paths else lambda spark, d: f(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register
