"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the smallest of these; edges run from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(u, v): every node of ``edges`` (u, v) with the smallest node that it reaches; the smallest nodes themselves are left out.

    Each round is written to the shared folder, so no lineage builds up. A
    node with very many neighbours is never gathered: minima combine before
    the shuffle, and the joins have one row for a node on one side. Rounds end
    when the edges no longer change (their number and hash sum agree).
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    larger, smaller = F.greatest("u", "v"), F.least("u", "v")
    now = work.put(edges.where(F.col("u") != F.col("v")).select(larger.alias("u"), smaller.alias("v")).distinct())
    was = state(now)
    while was[0]:
        after = work.put(_small_star(_large_star(now)))
        work.drop(now)
        now, (before, was) = after, (was, state(after))
        if before == was:
            break
    return now
