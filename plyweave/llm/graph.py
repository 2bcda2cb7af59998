"""Connected components by rounds of contraction; every round is written, nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame | None:
    """v, root for every vertex of edges (a, b: longs); None without edges.

    Each vertex is contracted into its least neighbour if that is less; ids are hashes, so paths shorten by a constant
    share a round. Hubs cost partial minima and joins whose other side has unique keys.
    """
    spark, found, left = edges.sparkSession, None, written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while left.limit(1).count():
        both = left.union(left.select("b", "a"))
        step = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).withColumnRenamed("a", "v"), "step")
        up = step.select(F.col("v").alias("root"), "to")
        if found is None:
            after = step.select("v", F.col("to").alias("root"))
        else:
            after = found.join(up, "root", "left").select("v", F.coalesce("to", "root").alias("root"))
        # A root that was contracted into another root is followed in the next round, as its edge is kept.
        moved = left.join(step.select(F.col("v").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
        kept = written(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        after = written(after, "found")
        discard(spark, step, left, found)
        found, left = after, kept
    return found
