"""Connected components of a graph given by its edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect the larger neighbours of every node to its smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(
        F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(
        F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every node with an edge; root is the smallest id of its component.

    Every round contracts the graph by a large and a small star step and writes the edges that
    are left to the shared folder, which cuts the lineage. Minima are combined map-side and the
    joins are left to Spark's skew handling, so a hub with a third of all edges is no obstacle.
    The rounds needed grow with the logarithm of the longest path."""
    x, y = F.col(a), F.col(b)
    now = edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    now = materialize(now.distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        mark = seen
        now = materialize(_small_star(_large_star(now)).distinct(), "edges")
