"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm.common import released, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(both: DataFrame) -> DataFrame:
    """(a, m, n): each node's least neighbour, itself included, and its number of neighbours."""
    return written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")))  # shuffles that adaptive joins may split


def _large_star(both: DataFrame, least: DataFrame) -> DataFrame:
    """Neighbours above a node move to its least neighbour; there are no more edges than before, some may repeat."""
    out = both.join(least.select("a", "m"), "a").where("b > a")
    return written(out.select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below move to the least of them."""
    both = _both(edges)
    out = both.where("b < a").join(_least(both).select("a", "m"), "a")
    moved = out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(out.select("a", F.col("m").alias("b")))
    return written(_distinct(moved))


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node of the component; nodes without edges don't appear.

    Each step is written to the shared folder, so a lost executor repeats one step at most and the plan
    never grows. Stars settle in a number of rounds that grows with the logarithm of the longest path: they have when
    each node but the least of a component has one neighbour.
    """
    edges = written(_distinct(edges))
    for _ in range(most_rounds):
        both = _both(edges)
        least = _least(both)
        if least.where("m < a and n > 1").isEmpty():
            break
        edges = _small_star(_large_star(both, least))
        released(edges.sparkSession)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
