"""Connected components of a link table, by contraction.

Union-find spread over the cluster: each round every node points to its smallest
neighbour (or itself), pointers are shortened once, links are re-written to the
nodes pointed to, and links inside a node vanish.  Every node that is not the
smallest of its neighbourhood merges, so the links left shrink geometrically.
Only row counts reach the driver; a hub's links are pre-aggregated before the
shuffle and joined, where Spark can split them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of links (a, b longs); root is the smallest node reachable."""
    edges = scratch.keep(links.filter(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    maps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        near = scratch.keep(near, "near")
        hop = near.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        jump = scratch.keep(near.join(hop, "p").select(F.col("a").alias("node"), F.col("pp").alias("to")), "to")
        maps.append(jump)
        left = jump.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = jump.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = scratch.keep(edges.join(left, "a").join(right, "b").filter(F.col("x") != F.col("y")).select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if not maps:
        return links.sparkSession.createDataFrame([], "node long, root long")
    out = maps[0].select("node", F.col("to").alias("root"))
    for m in maps[1:]:
        step = m.select(F.col("node").alias("root"), F.col("to").alias("next"))
        out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return scratch.keep(out, "components") if len(maps) > 1 else out
