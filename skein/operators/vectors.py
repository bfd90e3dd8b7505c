"""Exact vector recall and vector tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.matching import Best
from ..session import Batches, sparing

METRICS = ("cosine", "l2", "dot")
#: Queries of a block of a batch search and distances that a task holds at once.
AT_ONCE, DISTANCES = 1000, 1_000_000
#: What a distance from a matrix product may be off, in relation to the vectors' lengths.
OFF = 1e-11


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Cosine distance (null where a vector is zero), squared l2, or 1 - dot product, in double precision."""
    if metric == "cosine":
        return 1 - F.try_divide(_dot(a, b), F.sqrt(_dot(a, a) * _dot(b, b)))
    if metric == "l2":
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    if metric == "dot":
        return 1 - _dot(a, b)
    raise ValueError(f"metric must be one of {METRICS}")


def normalize(v: Column) -> Column:
    """Unit length; vectors that are zero or not finite are an error."""
    norm = F.sqrt(_dot(v, v))
    bad = F.isnan(norm) | (norm == 0) | (norm == float("inf"))
    return F.when(bad, F.raise_error(F.lit("vector is zero or not finite"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def nearest(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", space: str | None = None, source_ids: list[str] | None = None) -> DataFrame:
    """(chunk_id, score) of the k nearest vectors; filters apply before the top k, and vectors without a distance are not ranked."""
    if space is not None:
        vectors = vectors.where(F.col("embedding_space_id") == space)
    if source_ids:
        vectors = vectors.where(F.col("source_id").isin(source_ids))
    at = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("chunk_id", distance(F.col("vector"), at, metric).alias("score")).where("score IS NOT NULL").orderBy("score", "chunk_id").limit(k)


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, chunk_id, score, rank) for a stated set of queries (query_id, query), against all vectors.

    The queries are counted and go to the tasks in blocks of about ``AT_ONCE``, a
    scan of the vectors for each, so what the driver and a task hold of them is
    bounded.  A task multiplies vectors and queries as matrices, which tells the few
    rows that can be among the k best, and computes their distances as
    :func:`distance` does, in the order of the dimensions.  About k rows of each task
    are shuffled.  Vectors without a distance are not ranked.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    blocks, scored = max(1, -(-queries.count() // AT_ONCE)), None
    rows = T.StructType([queries.schema["query_id"], T.StructField("chunk_id", T.StringType()), T.StructField("score", T.DoubleType())])
    for i in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else queries
        asked = some.select("query_id", F.col("query").cast("array<double>")).toArrow().combine_chunks()  # about AT_ONCE queries
        run = _nearest(asked.column("query_id").combine_chunks(), asked.column("query").to_pylist(), k, metric)
        part = vectors.select("chunk_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(sparing(run), rows)
        scored = part if scored is None else scored.unionByName(part)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "chunk_id"))).where(F.col("rank") <= k)


def _sum(a: np.ndarray, b: np.ndarray, metric: str = "dot") -> np.ndarray:
    """Dot products, or squared distances, of pairs of rows, summed in the order of the dimensions as SQL does."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        out += (x - y) * (x - y) if metric == "l2" else x * y
    return out


def _nearest(ids: pa.Array, queries: list, k: int, metric: str) -> Callable[[Batches], Batches]:
    """A task that finds the ``k`` nearest of its vectors for each query; vectors and queries of different length have no distance."""
    by: dict[int, list[int]] = {}
    for i, q in enumerate(queries):
        if q is not None and None not in q:
            by.setdefault(len(q), []).append(i)
    sets = {d: (np.array(some), np.array([queries[i] for i in some], float).reshape(len(some), d)) for d, some in by.items()}

    def run(batches: Batches) -> Batches:
        best = Best(k, len(queries))
        for b in batches:
            column = b.column("vector")
            size = pc.fill_null(column.value_lengths(), -1).to_numpy(zero_copy_only=False)
            for d, (own, q) in sets.items():
                rows = np.flatnonzero(size == d)
                step = max(1, DISTANCES // len(own))
                for a in range(0, len(rows), step):
                    at = rows[a : a + step]
                    values = column.take(pa.array(at)).flatten()
                    v = values.to_numpy(zero_copy_only=False).reshape(len(at), d)
                    if values.null_count:
                        whole = values.is_valid().to_numpy(zero_copy_only=False).reshape(len(at), d).all(1)
                        at, v = at[whole], v[whole]
                    _rank(best, own, q, v, at, b.column("chunk_id"), metric)
        yield best.rows(ids, ("query_id", "chunk_id", "score"))

    return run


def _rank(best: Best, own: np.ndarray, q: np.ndarray, v: np.ndarray, at: np.ndarray, names: pa.Array, metric: str) -> None:
    """Give ``best`` the distances of those vectors ``v`` (rows ``at``) that can be among the nearest of the queries ``q`` (numbers ``own``)."""
    with np.errstate(all="ignore"):
        vv, qq, dot = _sum(v, v), _sum(q, q), v @ q.T
        both = vv[:, None] * qq[None, :]
        if metric == "cosine":
            about, off = 1 - dot / np.sqrt(both), OFF
            about[both == 0] = np.nan  # no distance
        else:
            about, off = (vv[:, None] + qq[None, :] - 2 * dot, OFF * (vv[:, None] + qq[None, :])) if metric == "l2" else (1 - dot, OFF * (1 + np.sqrt(both)))
        # a bound from distances that are surely reached; what is no number is looked at
        near = ~((about - off) > best.bounds(about + off, own))
        if metric == "cosine":
            near &= both != 0
        i, j = np.nonzero(near)
        exact = _sum(v[i], q[j], metric)
        if metric == "cosine":
            exact = 1 - exact / np.sqrt(vv[i] * qq[j])
        elif metric == "dot":
            exact = 1 - exact
    best.add(own[j], exact, names, at[i])


def fetch(vectors: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """Chosen columns of the vectors with given ids; columns not chosen are not read."""
    return vectors.select("chunk_id", *[c for c in columns if c != "chunk_id"]).join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def upsert(vectors: DataFrame, rows: DataFrame) -> DataFrame:
    """New rows take the place of those with their chunk_id."""
    return delete(vectors, rows).unionByName(rows)


def delete(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("chunk_id"), "chunk_id", "left_anti")


def reuse(chunks: DataFrame, vectors: DataFrame, space: str) -> DataFrame:
    """Chunks with the vector that some chunk of the same input has in the space (of several, the smallest chunk_id's), or null."""
    one = Window.partitionBy("embedding_input_hash").orderBy("chunk_id")
    known = vectors.where(F.col("embedding_space_id") == space).withColumn("n", F.row_number().over(one)).where("n = 1")
    known = known.select("embedding_input_hash", F.col("chunk_id").alias("reused_from"), F.col("vector").alias("reused_vector"))
    return chunks.join(known, "embedding_input_hash", "left")


def integrity(chunks: DataFrame, vectors: DataFrame, space: str) -> DataFrame:
    """Active chunks with state found, missing or invalid (another input or space)."""
    meta = vectors.select("chunk_id", F.col("embedding_input_hash").alias("vector_hash"), F.col("embedding_space_id").alias("vector_space"))
    state = F.when(F.col("vector_hash").isNull(), "missing").when((F.col("vector_hash") != F.col("embedding_input_hash")) | (F.col("vector_space") != space), "invalid").otherwise("found")
    return chunks.join(meta, "chunk_id", "left").withColumn("state", state).drop("vector_hash", "vector_space")
