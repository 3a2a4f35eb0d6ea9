"""Connected components of pairs, by alternating star contractions in logarithmically many rounds for usual graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.plans.checkpoints import cut

MAX_ROUNDS = 60


def components(pairs: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes in pairs (a, b: long) of two different nodes."""
    now = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # larger neighbours to the smallest node around, then each node with its smaller neighbours to the smallest of these
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        same = after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty()
        now = after
        if same:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError("components did not settle")
