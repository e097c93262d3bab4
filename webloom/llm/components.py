"""Connected components of an edge table, by alternating large-star and small-star rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (columns a, b); component is the least node of it.

    Ends when a round changes nothing: every edge then leads from a node to its component. Nodes that only stand in
    edges to themselves do not come out; an empty table gives none.
    """
    now = checkpointed(edges.select("a", "b").where("a <> b").distinct())
    state = None
    for _ in range(most_rounds):
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if after == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = after
        now = checkpointed(_small_star(_large_star(now)))
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
