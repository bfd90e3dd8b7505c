"""Fusion of recall channels, rerank merge, per-file cap and top k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K = 60


def ranked(channel: DataFrame, name: str) -> DataFrame:
    """(chunk_id, channel, rank, score): places of one channel's rows, which its recall limit bounds."""
    by = Window.partitionBy("channel").orderBy("score", "chunk_id")
    return channel.select("chunk_id", "score", F.lit(name).alias("channel")).withColumn("rank", F.row_number().over(by))


def rrf(channels: list[DataFrame]) -> DataFrame:
    """(chunk_id, rrf_score, channels, distance, rrf_rank) of ranked channels: the sum of 1 / (60 + rank)."""
    rows = reduce(DataFrame.unionByName, channels)
    out = rows.groupBy("chunk_id").agg(
        F.sum(1.0 / (RRF_K + F.col("rank"))).alias("rrf_score"),
        F.array_sort(F.collect_set("channel")).alias("channels"),
        F.max(F.when(F.col("channel") == "vector", F.col("score"))).alias("distance"),
    )
    by = Window.partitionBy(F.lit(0)).orderBy(F.desc("rrf_score"), "chunk_id")
    return out.withColumn("rrf_rank", F.row_number().over(by))


def merge_rerank(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates with final_rank and final_score: reranked ones in the reranker's order, then the others in fusion order.

    ``scores`` is (chunk_id, rerank_score, rerank_pos); ids that are no candidates
    are ignored, and of repeated ones the first position counts.
    """
    first = Window.partitionBy("chunk_id").orderBy("rerank_pos")
    told = scores.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    by = Window.partitionBy(F.lit(0)).orderBy(F.col("rerank_pos").isNull(), "rerank_pos", "rrf_rank")
    both = candidates.join(told, "chunk_id", "left")
    return both.withColumn("final_rank", F.row_number().over(by)).withColumn("final_score", F.coalesce("rerank_score", "rrf_score"))


def cap_per_file(rows: DataFrame, cap: int, order: str = "final_rank") -> DataFrame:
    """At most ``cap`` rows of each (source_id, relative_path), in the final order."""
    by = Window.partitionBy("source_id", "relative_path").orderBy(order)
    return rows.withColumn("in_file", F.row_number().over(by)).where(F.col("in_file") <= cap).drop("in_file")
