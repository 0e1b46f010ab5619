"""Which scenes a chain of scene links leads to.

Semi-naive rounds: each joins only the nodes that the last round was first to find, so a link is followed once whatever cycles there are. Rounds are written to the shared
folder, one below the other, and read as one table: the plan of a round doesn't grow with their number, and a lost executor costs no earlier round.
There are as many rounds as the farthest node has links before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import fresh_path
from .lookup import small


def reachable(links: DataFrame, starts: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """node, steps: each node of ``starts`` (its first column) and all that links lead to, with the fewest links that it takes.

    Nulls on either side are no nodes. Repeated links and starts count once; a link to oneself leads nowhere new.
    """
    spark = links.sparkSession
    path = fresh_path(spark, "reach")
    ways = links.select(F.col(source).alias("node"), F.col(target).alias("next")).filter("node IS NOT NULL AND next IS NOT NULL AND node <> next").distinct()
    kind = ways.schema["next"].dataType
    edges = f"{path}/links"
    ways.write.parquet(edges)
    ways = spark.read.schema(ways.schema).parquet(edges)
    found = starts.select(F.col(starts.columns[0]).cast(kind).alias("node")).filter("node IS NOT NULL").distinct()
    steps = 0
    while True:
        round_ = f"{path}/nodes/steps={steps}"
        found.write.parquet(round_)
        last = spark.read.schema(found.schema).parquet(round_)
        if last.isEmpty():
            break
        steps += 1
        seen = spark.read.schema(found.schema).parquet(f"{path}/nodes").select("node")
        # The frontier is broadcast only where the files that it was written to are small, so a node with very many links needs no shuffle then.
        found = ways.join(small(last), "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti")
    return spark.read.schema(f"node {kind.simpleString()}, steps int").option("basePath", f"{path}/nodes").parquet(f"{path}/nodes")
