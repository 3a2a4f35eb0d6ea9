"""Connected components as DataFrames, by alternating star contractions.

Each round joins every node with the smallest id beside it, first for larger
neighbours, then for smaller ones, until all components are stars around their
smallest node: O(log n) rounds for usual graphs. Minima are aggregated with
map-side combine and joined back to the edges; the edges of a node with very
many neighbours meet in one partition of that join, which adaptive planning
splits. Rounds are cut with checkpoint(), which survives lost executors.

Defined cases: edges from a node to itself and nulls are left out, repeated
edges count once; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import ensure_checkpoints, few

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger to the smaller node."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node. edges: u, v (long)."""
    ensure_checkpoints(edges.sparkSession)
    now = few(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()).checkpoint()
    for _ in range(MAX_ROUNDS):
        # done when every node has one edge and no centre is a member: then all are stars
        members = now.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        centre = now.select(F.col("v").alias("u")).distinct()
        if members.where("n > 1").isEmpty() and now.join(centre, "u", "left_semi").isEmpty():
            break
        now = few(_small_star(_large_star(now).distinct())).checkpoint()
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
