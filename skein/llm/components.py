"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node that is reachable.

    Each round writes its edges, which also cuts the lineage.  A large star
    links larger neighbours to the smallest; a small star links a node and its
    smaller neighbours to their smallest.  Rounds end when every node has one
    edge to a root and no root has an edge of its own.
    """
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        new = scratch.save(small, "edges")
        scratch.drop(now)
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or a smaller and a larger one."""
    up = edges.select(F.col("a").alias("node"), F.lit(1).alias("lower"), F.lit(0).alias("upper"))
    down = edges.select(F.col("b").alias("node"), F.lit(0).alias("lower"), F.lit(1).alias("upper"))
    nodes = up.unionByName(down).groupBy("node").agg(F.sum("lower").alias("lower"), F.max("upper").alias("upper"))
    return nodes.where("lower > 1 OR lower = 1 AND upper = 1").isEmpty()
