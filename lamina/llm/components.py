"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dropped, written_once


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links between long ids -> (node, root): the smallest id reachable. Nodes without a link aren't in it.

    Each round is written to the shared folder, and the round before it deleted. A node's neighbours are never gathered:
    minima are partial aggregates, and the joins that carry them back can be split by key at run time.
    """
    edges = written_once(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = fingerprint(edges)
    while True:
        before, last = state, edges
        stars = written_once(large_star(edges), "large-star")
        edges = written_once(small_star(stars), "small-star")
        state = fingerprint(edges)
        dropped(stars)
        dropped(last)
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest among itself and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))  # a > b in every edge
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m")).distinct()
