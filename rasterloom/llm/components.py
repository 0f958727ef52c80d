"""Connected components of a graph given by its edges, by alternating large-star and small-star steps
(Kiveris et al., Connected Components in MapReduce and Beyond, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import forget, written


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u of edges (u, v) has one edge and is no other edge's v."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").limit(1).count()


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of edges (u, v: long) but the roots themselves; a component's root is its smallest node.

    Every step groups edges by a node with partial aggregates and joins on it; no node's neighbours are collected. Each
    step's edges are written for the next, which removes those before; the last table stays. As edges lead to smaller
    nodes, they are done when they are stars.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        before, edges = edges, written(small.distinct())
        forget(before)
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out.written_at = edges.written_at
    return out
