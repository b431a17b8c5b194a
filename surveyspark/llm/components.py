"""Connected components of a graph given as an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.runtime import materialise


def _all_stars(edges: DataFrame) -> bool:
    """Whether every larger end is in one edge and is nobody's smaller end."""
    ends = (edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(False).alias("below"))
            .unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(True).alias("below"))))
    return (ends.groupBy("node").agg(F.sum("up").alias("up"), F.bool_or("below").alias("below"))
            .filter((F.col("up") > 1) | (F.col("up") > 0) & F.col("below")).isEmpty())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge with the smallest node it can reach.

    Rounds of two steps: each node's larger neighbours are linked to the smallest node around, then
    each node's smaller ones are.  Both steps keep connectivity, and rounds end when all edges are stars
    around smaller nodes.  Each round is written to the shared folder.
    Edges with a NULL end and loops are ignored.  An edgeless input gives no rows.
    """
    current = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    while not _all_stars(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Larger neighbours go to the smallest of the neighbourhood.
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = (both.filter(F.col("v") > F.col("u")).join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Smaller neighbours, and the node itself, go to the smallest of them.
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        small = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(joined.select("u", F.col("m").alias("v")))
                 .filter(F.col("u") != F.col("v")).distinct())
        current = materialise(small)
    return (current.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
