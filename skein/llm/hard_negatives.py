"""Hard negatives by a vertical scan with bounds, over all rows.

Rows are dealt into groups by a hash of their id.  A stated set of anchors goes to
every group; a task holds one group's rows as columns, a dimension each, and the
anchors stream by, so nothing but a group and a batch of anchors is in memory and
nothing is broadcast.  For each anchor the dimensions are read in the descending
order of the anchor's magnitudes.  After each few of them a row's score lies between
bounds: what is known, plus the least and the most that the rest can add, by the
smallest and largest component of each dimension.  A bitmap of candidates shrinks
by these bounds until exact scores of the few that are left decide.

1. Positives: the best rows of the anchor's label.  A row leaves when its upper
   bound is below the k-th largest lower bound.
2. Negatives: each positive's score gives a window of scores.  A row of another
   label leaves a window when its bounds lie outside, or below the lower bounds of k
   rows that are surely inside.

Both times the groups' best go through a window by anchor.  All scores are whole
numbers; bounds are sums of whole numbers too, so no row is lost to rounding.

Nulls, ties and edges: rows with a null id, label or vector, a null or non-finite
component, or one of more than 2^26 units take no part; of rows that share an id the one
with the smallest (label, vector) does; ties go to the smaller id; rows have scores only
with anchors of their own length; an anchor without positives, or a positive
with no row in its window, gives no row; a negative positive score has an empty window,
one of 0 the window 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import Scratch

#: Units of a component of 1.
UNITS = 256
#: Components beyond this are out of range: sums of 2,047 products of two of them fit 63 bits.
MOST = 1 << 26
POSITIVES, NEGATIVES = 5, 3
#: A negative's score, in hundredths of the positive's: the positive counts LOW to HIGH times.
LOW, HIGH = 50, 95
#: Rows of a group at most, about; there are as many groups as shuffle partitions at least.
GROUP_ROWS = 1 << 20
#: Dimensions that are read before the bounds are looked at again.
STEP = 8

_IN = "grp int, anchor boolean, id long, label int, vector array<int>, asked array<struct<id:long,score:long>>"
_HIT = "anchor_id long, positive_id long, positive_score long, id long, score long"


def quantised(vector: Column) -> Column:
    """Components as whole numbers: floor(256 * x)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * UNITS).cast("int"))


def usable(label: Column, vector: Column) -> Column:
    """The row takes part."""
    fine = lambda x: F.coalesce(F.abs(x.cast("double") * UNITS) <= MOST, F.lit(False)) & ~F.isnan(x)
    return label.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))


class Columns:
    """A group's rows of one length: vertical columns, and the range of each dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        # whole numbers are exact in doubles as long as all sums stay below 2^53
        self.most = int(np.abs(rows).max(initial=0))
        self.vertical = {np.float64: np.ascontiguousarray(self.rows.T, np.float64)}
        self.bounds: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def _kind(self, anchor: np.ndarray) -> type:
        return np.float64 if len(anchor) * self.most * int(np.abs(anchor).max(initial=0)) < 1 << 53 else np.int64

    def range(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest component of each dimension over a stretch of rows."""
        if (a, b) not in self.bounds:
            self.bounds[a, b] = self.rows[a:b].min(axis=0), self.rows[a:b].max(axis=0)
        return self.bounds[a, b]

    def of(self, label: int) -> tuple[int, int]:
        """The stretch of a label's rows."""
        a, b = np.searchsorted(self.labels, [label, label + 1])
        return int(a), int(b)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, limits: tuple[np.ndarray, np.ndarray], shrink: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of those that ``shrink``, a bitmap by (lower, upper) bounds, has left."""
        kind = self._kind(anchor)
        if kind not in self.vertical:
            self.vertical[kind] = np.ascontiguousarray(self.rows.T, kind)
        vertical, a = self.vertical[kind], anchor.astype(kind)
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([a * limits[0].astype(kind), a * limits[1].astype(kind)])[:, order]
        # what the dimensions from a place on can add at least and at most
        rest = np.concatenate([np.cumsum(np.sort(ends, axis=0)[:, ::-1], axis=1)[:, ::-1], np.zeros((2, 1), kind)], axis=1)
        score = np.zeros(len(alive), kind)
        for at in range(0, len(order), STEP):
            if not len(alive):
                break
            dims = order[at : at + STEP]
            # while nearly all rows are left, whole columns are read
            part = vertical[dims] if len(alive) == vertical.shape[1] else vertical[np.ix_(dims, alive)]
            score += a[dims] @ part
            now = min(at + STEP, len(order))
            keep = shrink(score + rest[0, now], score + rest[1, now])
            if not keep.all():
                alive, score = alive[keep], score[keep]
        return alive, score.astype(np.int64)

    def best(self, anchor_id: int, label: int, anchor: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best other rows of a label."""
        a, b = self.of(label)
        alive = np.arange(a, b)
        alive = alive[self.ids[alive] != anchor_id]
        if not len(alive):
            return []

        def shrink(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
            return upper >= np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) > k else np.ones(len(lower), bool)

        rows, score = self.scan(anchor, alive, self.range(a, b), shrink)
        first = np.lexsort((self.ids[rows], -score))[:k]
        return list(zip(self.ids[rows[first]].tolist(), score[first].tolist(), strict=True))

    def within(self, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each window [low, high] of scores the k best (id, score) of other labels."""
        a, b = self.of(label)
        alive = np.concatenate([np.arange(a), np.arange(b, len(self.ids))])
        if not len(alive):
            return [[] for _ in windows]

        def shrink(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
            keep = np.zeros(len(lower), bool)
            for low, high in windows:
                inside = lower[(lower >= low) & (upper <= high)]
                if len(inside) >= k:  # that many are surely in the window
                    low = max(low, np.partition(inside, len(inside) - k)[len(inside) - k])
                keep |= (upper >= low) & (lower <= high)
            return keep

        rows, score = self.scan(anchor, alive, self.range(0, len(self.ids)), shrink)
        out = []
        for low, high in windows:
            some = np.flatnonzero((score >= low) & (score <= high))
            first = some[np.lexsort((self.ids[rows[some]], -score[some]))[:k]]
            out.append(list(zip(self.ids[rows[first]].tolist(), score[first].tolist(), strict=True)))
        return out


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and offsets."""
    return column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _meet(answer: Callable[[Columns, int, int, np.ndarray, list], list[tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over rows sorted by group, rows before anchors: ``answer`` tells the hits of each anchor among its group's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, columns = None, [], {}
        for batch in batches:
            grp, is_anchor = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            ids, labels = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            values, offsets = _vectors(batch.column(4))
            hits: list[tuple] = []
            edges = [0, *(np.flatnonzero((grp[1:] != grp[:-1]) | (is_anchor[1:] != is_anchor[:-1])) + 1).tolist(), len(grp)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if grp[a] != group:
                    group, held, columns = grp[a], [], {}
                if not is_anchor[a]:
                    held.append((ids[a:b], labels[a:b], values[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1])))
                    continue
                if held:
                    columns, held = _by_length(held), []
                asked = batch.column(5).slice(a, b - a).to_pylist()
                for i in range(a, b):
                    own = columns.get(offsets[i + 1] - offsets[i])
                    if own is not None:
                        hits += answer(own, int(ids[i]), int(labels[i]), values[offsets[i] : offsets[i + 1]].astype(np.int64), asked[i - a])
            names = [c.split()[0] for c in _HIT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([h[j] for h in hits], pa.int64()) for j in range(len(names))], names=names)

    return run


def _by_length(held: list[tuple]) -> dict[int, Columns]:
    """A group's rows by the length of their vectors."""
    ids, labels, values, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
    ends = np.cumsum(sizes)
    out = {}
    for size in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == size)
        at = (ends[mine] - size)[:, None] + np.arange(size)[None, :]
        out[size] = Columns(ids[mine], labels[mine], values[at].astype(np.int64).reshape(len(mine), size))
    return out


def _positives(k: int) -> Callable:
    return lambda own, id_, label, vector, asked: [(id_, None, None, i, s) for i, s in own.best(id_, label, vector, k)]


def _negatives(k: int, low: int, high: int) -> Callable:
    def answer(own: Columns, id_: int, label: int, vector: np.ndarray, asked: list) -> list[tuple]:
        windows = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in asked]
        found = own.within(label, vector, windows, k)
        return [(id_, p["id"], p["score"], i, s) for p, some in zip(asked, found, strict=True) for i, s in some]

    return answer


def _dealt(rows: DataFrame, anchors: DataFrame, groups: int) -> DataFrame:
    """Rows, a group each, and anchors, in every group, in one partition for each group, rows before anchors."""
    mine = rows.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("grp"), F.lit(False).alias("anchor"), "id", "label", "vector", F.lit(None).cast("array<struct<id:long,score:long>>").alias("asked"))
    theirs = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(True).alias("anchor"), "id", "label", "vector", "asked")
    return mine.unionByName(theirs).repartitionById(groups, "grp").sortWithinPartitions("grp", "anchor")


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows (id, label, vector of doubles or floats) that ``is_anchor`` tells.

    A negative's score is from ``low`` to ``high`` hundredths of the positive's.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    fine = rows.where(F.col("id").isNotNull() & usable(F.col("label"), F.col("vector"))).select(F.col("id").cast("long"), F.col("label").cast("int"), quantised(F.col("vector")).alias("vector"))
    one = fine.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector")
    one = scratch.save(one, "rows")
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-one.count() // group_rows))
    anchors = one.where(is_anchor)
    found = _dealt(one, anchors.withColumn("asked", F.lit(None).cast("array<struct<id:long,score:long>>")), groups).mapInArrow(_meet(_positives(positives)), _HIT)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    found = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= positives)
    # a negative score has no window
    asked = found.where("score >= 0").groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "score"))).alias("asked"))
    asked = scratch.save(anchors.join(asked, "id"), "asked")
    hits = _dealt(one, asked, groups).mapInArrow(_meet(_negatives(negatives, low, high)), _HIT)
    rank = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of the five nearest rows of the label of every row whose id is divisible by 50; labels of ids divisible by 7 are moved on."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mine(rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")), F.col("id") % 50 == 0)


SQL = """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2]))::BIGINT AS score
  FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 50 = 0
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM s WHERE same) WHERE n <= 5
), q AS (
  SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM q WHERE rank <= 3
"""
