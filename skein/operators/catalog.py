"""The catalog: roots, trees, scopes, source lifecycle, registration, rebuilds."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .snapshots import merge_rows

#: The errors of jobs whose source may not run, by its state.
RECOVERY = {"disabled": "source is disabled during indexer recovery", "cleanup": "source scope cleanup is pending during indexer recovery"}
OPEN = ("queued", "running")
#: Seconds for which a health check holds while the revision stays.
HEALTH_SECONDS = 300
#: Failing ids that a report shows.
SAMPLE = 50


# -- paths ----------------------------------------------------------------


def within(path: Column, root: Column) -> Column:
    """The path is the root or stands under it."""
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def ancestors(path: Column) -> Column:
    """The path and every folder above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def overlapping_roots(roots: DataFrame) -> DataFrame:
    """(outer_id, inner_id) of rows (id, absolute_path) where one root holds another or equals it, by an equi-join on folders."""
    inner = roots.select(F.col("id").alias("inner_id"), F.explode(ancestors(F.col("absolute_path"))).alias("absolute_path"))
    return inner.join(roots.select(F.col("id").alias("outer_id"), "absolute_path"), "absolute_path").where("outer_id <> inner_id").select("outer_id", "inner_id")


def tree_page(nodes: DataFrame, size: int, after: tuple[str, str, str] | None = None) -> DataFrame:
    """The next ``size`` nodes (source_id, path, kind) in tree order: by segments, a directory before a file of its name."""
    order = F.struct("source_id", F.split("path", "/").alias("parts"), "kind")
    if after:
        source, path, kind = after
        nodes = nodes.where(order > F.struct(F.lit(source).alias("source_id"), F.split(F.lit(path), "/").alias("parts"), F.lit(kind).alias("kind")))
    return nodes.orderBy(order).limit(size)


def scope_patterns(cover: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """(source_id, pattern) of a minimal cover (source_id, path, kind): files as they are, directories with every pattern, also for their own files."""
    tails = list(dict.fromkeys(t for p in patterns for t in (p.lstrip("/"), p.lstrip("/").removeprefix("**/"))))
    made = F.when(F.col("kind") == "directory", F.transform(F.array(*map(F.lit, tails)), lambda t: F.concat_ws("/", "path", t))).otherwise(F.array("path"))
    return cover.select("source_id", F.explode(made).alias("pattern")).distinct()


# -- sources and jobs -----------------------------------------------------


def register(sources: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources with the accepted rows, rejected (id, why)): ids are new and stand once, and roots overlap no other root, old or new."""
    both = sources.select("id", "absolute_path").unionByName(new.select("id", "absolute_path"))
    pairs = overlapping_roots(both)
    overlaps = pairs.select(F.col("outer_id").alias("id")).unionByName(pairs.select(F.col("inner_id").alias("id"))).distinct()
    known = sources.select("id").distinct()
    once = new.withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy("id")))
    why = once.join(known.withColumn("_known", F.lit(True)), "id", "left").join(overlaps.withColumn("_over", F.lit(True)), "id", "left")
    why = why.withColumn("why", F.when(F.col("_known"), "id exists").when(F.col("_times") > 1, "id repeats").when(F.col("_over"), "root overlaps another"))
    taken = why.where("why IS NULL").select(*sources.columns)
    return sources.unionByName(taken), why.where("why IS NOT NULL").select("id", "why")


def change(sources: DataFrame, ids: Sequence[str], **values: object) -> DataFrame:
    """Flags, scope or consent of some sources set to given values."""
    hit = F.col("id").isin(list(ids))
    return sources.withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def renew_consent(sources: DataFrame, jobs: DataFrame, identity: str) -> tuple[DataFrame, DataFrame]:
    """(sources with the current consent, ids to enqueue): enabled sources that were stale and have no open job."""
    stale = sources.where("enabled").where(~F.col("consent_identity").eqNullSafe(F.lit(identity)))
    busy = jobs.where(F.col("status").isin(*OPEN)).select(F.col("source_id").alias("id")).distinct()
    renewed = merge_rows(sources, stale.withColumn("consent_identity", F.lit(identity)).select(*sources.columns), ["id"])
    return renewed, stale.join(busy, "id", "left_anti").select("id")


def removal_refusals(sources: DataFrame, jobs: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(id, why) of the sources that may not be removed now: unknown ones, those with an open job, and those with a pending clean-up."""
    asked = sources.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")
    busy = jobs.where(F.col("status").isin(*OPEN)).select(F.col("source_id").alias("id"), F.lit(True).alias("_busy")).distinct()
    held = asked.join(sources.select("id", F.coalesce("scope_cleanup_pending", F.lit(False)).alias("_pending")), "id", "left").join(busy, "id", "left")
    why = F.when(F.col("_pending").isNull(), "unknown").when(F.col("_busy"), "a job is open").when(F.col("_pending"), "a scope cleanup is pending")
    return held.select("id", why.alias("why")).where("why IS NOT NULL")


def rescope(sources: DataFrame, jobs: DataFrame, scopes: DataFrame, consent: str) -> tuple[DataFrame, DataFrame]:
    """(sources, refused (id, why)) after new scopes (id, include_patterns).

    A source takes its scope with the given consent and waits for the clean-up of
    what left it; refused are unknown sources, ids that stand twice, and those with
    an open job.
    """
    busy = jobs.where(F.col("status").isin(*OPEN)).select(F.col("source_id").alias("id")).distinct().withColumn("_busy", F.lit(True))
    asked = scopes.groupBy("id").agg(F.count(F.lit(1)).alias("_times"), F.first("include_patterns").alias("_scope"))
    asked = asked.join(sources.select("id", F.lit(True).alias("_known")), "id", "left").join(busy, "id", "left")
    asked = asked.withColumn("why", F.when(F.col("_known").isNull(), "unknown").when(F.col("_times") > 1, "id repeats").when(F.col("_busy"), "a job is open"))
    out = sources.join(asked.where("why IS NULL").select("id", "_scope", F.lit(True).alias("_new")), "id", "left")
    taken = {"include_patterns": F.col("_scope"), "consent_identity": F.lit(consent), "scope_cleanup_pending": F.lit(True)}
    return out.withColumns({k: F.when(F.col("_new"), v).otherwise(F.col(k)) for k, v in taken.items()}).select(*sources.columns), asked.where("why IS NOT NULL").select("id", "why")


def finish_cleanup(sources: DataFrame, queued: DataFrame) -> DataFrame:
    """Sources no longer pending once no tombstone of a scope clean-up is left of theirs; ``queued`` are the tombstones."""
    left = queued.where("scope_cleanup").select(F.col("source_id").alias("id")).distinct().withColumn("_left", F.lit(True))
    out = sources.join(left, "id", "left")
    return out.withColumn("scope_cleanup_pending", F.col("scope_cleanup_pending") & F.coalesce("_left", F.lit(False))).select(*sources.columns)


def tombstones(vectors: DataFrame, now: Column) -> DataFrame:
    """Tombstones of the vectors of sources that go."""
    return vectors.select("chunk_id", "source_id", F.lit(True).alias("scope_cleanup"), now.alias("queued_at"))


def recovered(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """``jobs`` with error: open jobs of disabled sources, or of those with a pending clean-up, have failed."""
    state = sources.select(F.col("id").alias("source_id"), F.when(~F.col("enabled"), RECOVERY["disabled"]).when(F.col("scope_cleanup_pending"), RECOVERY["cleanup"]).alias("_error"))
    out = jobs.drop("error").join(state, "source_id", "left")
    error = F.when(F.col("status").isin(*OPEN), F.col("_error"))
    return out.withColumns({"error": error, "status": F.when(error.isNotNull(), "failed").otherwise(F.col("status"))}).drop("_error")


# -- vectors --------------------------------------------------------------


def behind(active: DataFrame, after: tuple[str, int, int] | None) -> DataFrame:
    """The active chunks whose (source_id, source_file_id, ordinal) is larger than a key."""
    if not after:
        return active
    source, file, ordinal = after
    return active.where(F.struct("source_id", "source_file_id", "ordinal") > F.struct(F.lit(source).alias("source_id"), F.lit(file).cast("long").alias("source_file_id"), F.lit(ordinal).cast("int").alias("ordinal")))


def rebuild_page(active: DataFrame, after: tuple[str, int, int] | None, size: int = 256) -> DataFrame:
    """The next active chunks by (source_id, source_file_id, ordinal) behind a key."""
    return behind(active, after).orderBy(F.struct("source_id", "source_file_id", "ordinal")).limit(size)


def failing_sample(states: DataFrame, size: int = SAMPLE) -> DataFrame:
    """The first failing ids of an integrity check (chunk_id, state)."""
    return states.where("state <> 'found'").orderBy("chunk_id").limit(size)


class Health:
    """An integrity verdict that is computed again after ``HEALTH_SECONDS`` or when the revision changes."""

    def __init__(self, states: Callable[[], DataFrame], revision: Callable[[], object], clock: Callable[[], float] = time.monotonic):
        self.states, self.revision, self.clock = states, revision, clock
        self._held: tuple[object, float, dict] | None = None

    def check(self) -> dict:
        """Counts by state, and the failing sample."""
        now, revision = self.clock(), self.revision()
        if self._held is None or self._held[0] != revision or now - self._held[1] >= HEALTH_SECONDS:
            states = self.states()
            counts = {r["state"]: r["n"] for r in states.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
            sample = [r["chunk_id"] for r in failing_sample(states).collect()]
            self._held = revision, now, {"counts": counts, "failing": sample, "ok": not sample}
        return self._held[2]
