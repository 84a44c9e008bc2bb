"""Connected components by alternating star contractions, for edges between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> (node long, component long): the smallest id that each node reaches.

    Large-star and small-star steps in turn: each replaces a node's links by links to the smallest id it sees, until every link
    goes straight to its component's smallest id. Rounds grow with the logarithm of the longest path. Every step takes a minimum
    (pre-aggregated before the shuffle) and joins it back to the links, so a hub's links stay spread when Spark splits skewed partitions.
    Nodes without links have no row. Self links and null ends are ignored.
    """
    links = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    links = materialize(links.distinct(), "links")
    before = None
    for _ in range(max_rounds):
        # Large star: each larger neighbour of x goes to the smallest of x and its neighbours.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        least = materialize(least, "least")
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where(F.col("u") != F.col("v")).distinct(), "links")
        # Small star: x and its smaller neighbours go to the smallest of them.
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links = materialize(small.where(F.col("u") != F.col("v")).distinct(), "links")
        now = links.agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.sum(F.col("u").cast("decimal(38,0)")).alias("t")).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
