"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import settle


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's greater neighbours are linked to the least node around it."""
    both = links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    least = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("least"))
    return both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("least").alias("y"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its lesser neighbours are linked to the least of them."""
    down = links.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    least = down.groupBy("x").agg(F.min("y").alias("least"))
    return down.join(least, "x").where("y <> least").select("y", "least").toDF("x", "y").unionByName(least.select("x", F.col("least").alias("y")))


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every node that has a link; the component is its least node.

    Stars are sums and joins by key: no node gathers its neighbours, and each round's links are
    written to the shared folder.
    """
    now = links.where("x <> y").select("x", "y")
    seen = None
    while True:
        now = settle(_small_star(_large_star(now)).where("x <> y").distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    nodes = now.select(F.col("x").alias("id"), F.col("y").alias("component"))
    return nodes.unionByName(now.select(F.col("y").alias("id"), F.col("y").alias("component")).distinct())
