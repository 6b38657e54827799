"""Connected components of links between 64-bit nodes, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm import common


def _least(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour or itself; a table of its own, so that a hub's edges can be split in the join with it."""
    return common.written(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "components-least")


def components(links: DataFrame) -> DataFrame:
    """
    (node, root) for every node of links (a, b); the root is the component's smallest node.

    Large star: every larger neighbour of a node moves to the smallest node in its neighbourhood. Small star: the smaller
    neighbours do. Links stay as many or fewer, and after a few steps (logarithmic in their number) each node hangs on its root.
    Every step is written to the shared folder. A link with a null end or from a node to itself says nothing.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, last = common.written(edges, "components"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        last = state
        both = edges.union(edges.select("v", "u"))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.written(large, "components-large")
        least = _least(large)
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = common.written(small.union(least).distinct(), "components")
