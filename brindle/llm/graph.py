"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stash


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step. Edges are (a, b) with b < a."""
    out = _both_ways(edges)
    least = out.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = out.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    kept = large.join(least, "a")
    return kept.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()


def components(edges: DataFrame, stash: Stash, most: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: any order, repeats and loops allowed); root is the smallest node reachable.

    Each round is written to the shared folder. A fixed point comes after few rounds (at most of the order of the squared
    logarithm of the longest path). No group is gathered in one task: minima are pre-aggregated and joins are splittable.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stash.keep(now, "cc0")
    mark = None
    for i in range(1, most + 1):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        mark = seen
        later = stash.keep(_round(now), f"cc{i}")
        stash.drop(f"cc{i - 1}")
        now = later
    raise RuntimeError(f"components did not settle in {most} rounds")
