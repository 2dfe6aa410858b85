"""Connected components of a graph of links, by alternating large and small stars.

A hub's links don't meet in one task: the least neighbour of each node is a sum that tasks combine first, and
hubs, of which there are few by their share of all links, are told it on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_join, saved


def _with_least(edges: DataFrame) -> DataFrame:
    """Links with m, the least b of their a."""
    least = saved(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
    return heavy_join(edges, least, ["a"], "n", edges.count())


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on the smallest node next to it."""
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    return _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them. Edges go from larger to smaller."""
    down = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    told = _with_least(down)
    moved = told.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(told.where("b = m").select("a", "b")).distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """The least node of its component for each node of `edges` (a, b; whole numbers) but the least: node, root.

    Every round is written, so that a lost executor costs one round at most. The number of
    rounds grows with the logarithm of the longest chain of links.
    """
    now = saved(edges.where("a <> b").select("a", "b").distinct())
    told = lambda e: tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.col("b") % 1000003)).first())
    before = told(now)
    for _ in range(rounds):
        if not before[0]:
            break
        now = saved(_small_star(_large_star(now)))
        after = told(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
