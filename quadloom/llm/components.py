"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import compact


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # here a > b in every row
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, comp`` for every node that has an edge; ``comp`` is the least node of its component.

    Edges are two long columns; nulls, loops and repeated rows are ignored. Each round shuffles the shrinking edge
    table by node and is cut into the checkpoint folder; hub nodes are combined before the shuffle.
    """
    e = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
    e = compact(e.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("a") != F.col("b"))).distinct())
    seen = None
    while True:
        sums = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == seen or not sums[0]:
            break
        seen = tuple(sums)
        e = compact(_small_star(_large_star(e)))
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
