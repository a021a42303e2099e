"""Connected components of an edge table, as joins and groupings that shrink towards stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.staging import stage

MAX_ROUNDS = 60


def _are_stars(edges: DataFrame) -> bool:
    """Whether every edge (a, b) leads straight to a centre: no `a` has two edges, and none is a `b` too."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (a, b): the label is the smallest node that it is linked with.

    Alternates two steps until only stars are left: each node hands its smallest neighbour to its larger neighbours, then
    to its smaller ones. Only minima are grouped, so a node with very many neighbours costs no task more than others.
    """
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        if _are_stars(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct())
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # a node that is its own minimum has no larger neighbour to move: its edges stay
        large = stage(large.filter("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = stage(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
