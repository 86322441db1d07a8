"""Connected components of a graph of long ids, by alternating large-star and small-star."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelspark.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node of its neighbourhood."""
    both = edges.union(edges.select("v", "u").toDF("u", "v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(id, component) of every node with an edge to another node; component is the smallest id reachable.

    A node's neighbours are never listed in one row: minima are aggregates, and hubs meet their edges
    in plain joins that adaptive execution splits. Edges with a null end or equal ends say nothing.
    The rounds end when the stars no longer change; every round is written to the shared folder.
    """
    stars = cut_lineage(edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(stars)
    while True:
        stars = cut_lineage(_small_star(_large_star(stars).distinct()).distinct())
        before, state = state, _state(stars)
        if state == before:
            break
    nodes = stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.union(stars.select("v", "v").distinct())
