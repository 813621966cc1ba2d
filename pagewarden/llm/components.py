"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step sends every edge once, keyed by one end; the number of steps grows
with the logarithm of the number of nodes.  Tables between steps are written to
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import persist


def _large(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).where("a != b").distinct()


def components(spark: SparkSession, edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for the nodes of ``edges`` (columns a, b, long); root is the least node of the component."""
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = persist(spark, edges, name)
    mark = None
    while True:
        edges = persist(spark, _small(_large(edges)), name)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(state) == mark:
            break
        mark = tuple(state)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
