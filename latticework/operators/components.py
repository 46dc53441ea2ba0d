"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.session import counted


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written, with their number and a sum that changes when they do."""
    cut, seen = counted(edges, n=F.count(F.lit(1)), mark=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    return cut, (seen["n"], seen["mark"])


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the least node reachable, for each node of an edge.

    `edges` has columns a, b of one type. Repeats, loops and either direction
    are allowed; a null end is dropped. Rows a round are at most twice the
    edges. Raises RuntimeError when `rounds` do not suffice.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = _counted(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        edges, now = _counted(small.where("a <> b").distinct())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(edges.select(F.col("b"), F.col("b")).distinct())
