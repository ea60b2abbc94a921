"""Connected components of a graph given as an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import salted_join


def _stars(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """Large star: neighbours above a node move to the least of its neighbourhood; small star: those below it do."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = both if large else both.where("b < a")
    least = side.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    moved = salted_join(side.where("b > a") if large else side, least, ["a"], "n", 2 * total, F.col("b"))
    out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node with an edge: root is the least node of its component.

    ``edges`` has columns a and b, in any direction, repeats and loops allowed. Each round is written to the
    shared folder; the rounds grow with the logarithm of the components' diameter, and a node with very many
    neighbours is dealt to several tasks.
    """
    now = scratch.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    mark = None
    while True:
        total, check = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if (total, check) == mark or not total:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = (total, check)
        # a star's plan holds its edges several times, so each star is written
        half = scratch.table(_stars(now, total, True))
        scratch.drop(now)
        now = scratch.table(_stars(half, total, False))
        scratch.drop(half)
