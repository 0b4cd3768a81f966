"""Connected components by alternating large-star and small-star steps; no link or label passes the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("__a"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("__a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, is linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("__a"), "m")
    linked = down.join(least, F.col("a") == F.col("__a"))
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("__a").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) for every node of the links (a, b) that isn't its own root."""
    edges = stored(edges.filter("a <> b").select("a", "b"), "links")
    seen = None
    while True:
        edges = stored(_small(_large(edges)), "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
