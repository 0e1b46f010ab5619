"""Counts of different values and quantiles that can be kept by day and put together later.

A day's state is one row for each group: a HyperLogLog of the values to be told apart and a KLL sketch of the numbers. States are stored as binary columns and merge
to any longer time without the events. With 2**LG_K registers a HyperLogLog has a standard error of 1.04 / 2**(LG_K / 2); a KLL sketch of size K gives a value whose rank is off by
RANK_ERROR at most with a confidence of 99 %.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, K = 14, 800
STANDARD_ERROR = 1.04 / 2 ** (LG_K / 2)
RANK_ERROR = 2.296 / K**0.9023


def daily(events: DataFrame, at: str, by: list[str], distinct: Column, value: Column) -> DataFrame:
    """day, ``by``, n, least, most, users and numbers (states). Events without a time are left out; nulls and NaN are in no sketch but count in n."""
    number = value.cast("double")
    rows = events.filter(F.col(at).isNotNull()).select(F.to_date(at).alias("day"), *by, distinct.alias("d"), F.when(~F.isnan(number), number).alias("v"))
    return rows.groupBy("day", *by).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.hll_sketch_agg("d", LG_K).alias("users"), F.kll_sketch_agg_double("v", K).alias("numbers"))


def merged(states: DataFrame, unit: str, by: list[str]) -> DataFrame:
    """States of days put together to a ``unit`` (month, year); of what comes out more can be put together."""
    rows = states.withColumn("day", F.trunc("day", unit))
    return rows.groupBy("day", *by).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("numbers", K).alias("numbers"))


def distinct_estimate() -> Column:
    return F.hll_sketch_estimate("users")


def quantile(rank: float) -> Column:
    """The number at a rank between 0 and 1; null where there was none."""
    n = F.kll_sketch_get_n_double("numbers")
    return F.when(n > 0, F.kll_sketch_get_quantile_double(F.when(n > 0, F.col("numbers")), F.lit(rank)))
