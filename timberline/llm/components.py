"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round is one groupBy a star over the links that are left; nothing but a change
counter reaches the driver, and rounds are written to the shared folder. The hub of a
large component is no hot key: only its minimum is grouped, with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import discard, materialize


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (u, v) bigint to (node, component): the least node reachable, for nodes that have a link."""
    edges = materialize(links.select("u", "v").where("u <> v").distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for k in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_minimum(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        following = materialize(small.where("u <> v").distinct(), f"star{k}")
        # stable once every node points at one smaller node that itself points nowhere
        tops = following.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        stable = following.join(tops.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and tops.where("n > 1").isEmpty()
        discard(edges)
        edges = following
        if stable:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
