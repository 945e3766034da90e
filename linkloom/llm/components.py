"""Connected components by alternating large and small stars, each round cut by a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import forget, keep


def _least(edges: DataFrame) -> DataFrame:
    """u, m: the least neighbour of u, itself included. Grouped wider than joined, so that AQE can split a hub."""
    return edges.groupBy("u", F.shiftright("u", 62).alias("deal")).agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.col("u"), "m")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _least(down)
    linked = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node reachable) of every node of the undirected edges (u, v longs).

    Edges with a null end and loops are ignored; a node without another edge has no row; an empty
    table of edges has an empty result. Rounds grow with the logarithm of the longest path.
    """
    edges = keep(edges.select("u", "v").where("u <> v").distinct())
    seen = _digest(edges)
    while True:
        edges, old = keep(_small(_large(edges))), edges
        forget(old)
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    nodes = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
