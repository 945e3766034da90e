"""Trees of categories: who lies under whom, at any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.sources.scratch import keep


def closure(parents: DataFrame) -> DataFrame:
    """ancestor, descendant, depth (the least, from 1) of every pair, from rows child, parent.

    By doubling: paths of exactly 2^k steps meet all of up to 2^k, so that rounds grow with the logarithm of the depth, and
    only pairs that weren't known are written in each. Null parents, rows that repeat and nodes that are their own parent say nothing.
    Cycles end: a node is never its own ancestor here (see `cyclic`), and a round without new pairs is the last.
    """
    known = keep(parents.where("parent IS NOT NULL AND child <> parent").select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("depth")).distinct())
    reach = 1
    while True:
        ends = known.where(F.col("depth") == reach).select("ancestor", F.col("descendant").alias("at"), F.col("depth").alias("first"))
        met = ends.join(known.select(F.col("ancestor").alias("at"), "descendant", F.col("depth").alias("rest")), "at").where("ancestor <> descendant")
        new = met.groupBy("ancestor", "descendant").agg(F.min(F.col("first") + F.col("rest")).alias("depth")).join(known.select("ancestor", "descendant"), ["ancestor", "descendant"], "left_anti")
        new = keep(new)
        if new.isEmpty():
            return known
        known, reach = known.unionByName(new), 2 * reach


def cyclic(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """node: the nodes of cycles, those whose parent lies under them. pairs: their closure."""
    under = pairs.select(F.col("ancestor").alias("child"), F.col("descendant").alias("parent"))
    return parents.select("child", "parent").join(under, ["child", "parent"], "left_semi").select(F.col("child").alias("node")).distinct()


def with_descendants(chosen: DataFrame, pairs: DataFrame) -> DataFrame:
    """id: the chosen categories (id) and all that lie under one."""
    under = pairs.join(chosen.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select(F.col("descendant").alias("id"))
    return chosen.select("id").unionByName(under).distinct()
