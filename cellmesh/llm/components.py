"""Connected components of a graph in tables, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of each node in ``edges`` (``a``, ``b``).

    Each round joins every node's larger neighbours to its smallest one, then its smaller neighbours and itself
    to the smallest.  Rounds follow the logarithm of the longest path.  Neighbour lists are never collected: a round is
    a grouped minimum joined back to the edges, whose hot nodes an adaptive join can split.
    """
    now = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    while True:
        # Large star: each node's larger neighbours go to the smallest of the node and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        after = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = stash(after, "cc")
        # It is done when every edge leads to a root, and each node has one edge.
        state = after.agg(F.count("*").alias("n"), F.countDistinct("u").alias("nodes")).first()
        roots = after.select(F.col("v").alias("r")).distinct().join(after.select("u").distinct(), F.col("r") == F.col("u"), "left_semi").limit(1).count()
        now = after
        if state["n"] == state["nodes"] and not roots:
            break
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
