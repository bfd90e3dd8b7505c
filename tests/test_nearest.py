"""Batch recall by matrix products: the same rows and the same doubles as one distance for each pair."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators import vectors


def plain(rows, asked, k, metric):
    both = rows.crossJoin(asked).select("query_id", "chunk_id", vectors.distance(F.col("vector"), F.col("query"), metric).alias("score")).where("score IS NOT NULL")
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "chunk_id"))).where(F.col("rank") <= k)


def told(rows):
    return sorted((r.query_id, r.rank, r.chunk_id, str(r.score)) for r in rows.collect())


@pytest.fixture(scope="module")
def rows(spark):
    """Vectors of which many are equal or parallel, and zero, short, null and infinite ones."""
    x = lambda i, j: F.expr(f"(({i}) * 7919 + {j} * 104729) % 1009 / 1009.0 - 0.5").cast("float")
    some = spark.range(900).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.array(*[x("id % 300", j) for j in range(16)]).alias("vector"))
    twice = some.where("hash(chunk_id) % 5 = 0").select(F.concat("chunk_id", F.lit("x")).alias("chunk_id"), F.transform("vector", lambda v: (v * 3).cast("float")).alias("vector"))
    odd = [("zero", [0.0] * 16), ("short", [1.0]), ("hole", [None, *[1.0] * 15]), ("none", None), ("empty", []), ("nan", [float("nan"), *[1.0] * 15]), ("inf", [float("inf"), *[1.0] * 15]), ("tiny", [1e-30] * 16)]
    return some.unionByName(twice).unionByName(spark.createDataFrame(odd, "chunk_id string, vector array<float>")).repartition(3).localCheckpoint()


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_as_every_pair(spark, rows, metric, monkeypatch):
    asked = rows.where("chunk_id IN ('c3', 'c7', 'c150', 'zero', 'short', 'hole', 'none', 'tiny')").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query"))
    for at_once, held in ((1000, 1_000_000), (3, 40)):
        monkeypatch.setattr(vectors, "AT_ONCE", at_once)
        monkeypatch.setattr(vectors, "DISTANCES", held)
        for k in (1, 7):
            assert told(vectors.nearest_batch(rows, asked, k, metric)) == told(plain(rows, asked, k, metric))
    # fewer rows than asked for: those that are no number come last
    few = rows.where("chunk_id IN ('nan', 'inf', 'c1', 'c2', 'zero')")
    assert told(vectors.nearest_batch(few, asked, 10, metric)) == told(plain(few, asked, 10, metric))
    assert vectors.nearest_batch(rows, asked.limit(0), 3, metric).count() == 0


def test_no_row_for_each_pair(spark, rows):
    asked = rows.where("chunk_id < 'c2'").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query"))
    plan = vectors.nearest_batch(rows, asked, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
