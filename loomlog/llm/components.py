"""Connected components of an edge table, by alternating large stars and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import stable


def _are_stars(edges: DataFrame) -> bool:
    """Every node above another has exactly one edge, and none leads on from where it ends."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    sides = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return sides.where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("n") > 1))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any comparable type -> (node, root): root is the least node of the component; nodes without edges have no row.

    Every round links each node to the least neighbour it knows (large star: those above it; small star: itself and
    those below it), until all edges are stars around roots. Minima are combined before each shuffle, so a hub of any
    degree is fine. Each round is written to the checkpoint folder; the driver learns one bit of it.
    """
    e = stable(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _are_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("w")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(least, F.col("u") == F.col("w")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stable(small.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct())
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
