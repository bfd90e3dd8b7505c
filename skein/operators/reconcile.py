"""Incremental reconciliation: scans against the manifest, generations, clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunking import Limits

STABLE_SECONDS = 30
CONFIRMATIONS = 2


def scan_diff(scan: DataFrame, manifest: DataFrame, now_ns: int, stable_seconds: int = STABLE_SECONDS, confirmations: int = CONFIRMATIONS) -> DataFrame:
    """One row for each file of the scan or the manifest, with its action.

    ``scan``: source_id, relative_path, mtime_ns, size, sha256, in_scope.
    ``manifest``: source_files with ``complete``, whether all vectors are there.
    The first rule that holds decides: unchanged by stamp, waiting until the
    file is quiet, unchanged by digest, else index; of files that the scan lacks
    or that left the scope: delete, or one more missing count.
    """
    s, m = scan.alias("s"), manifest.alias("m")
    both = s.join(m, ["source_id", "relative_path"], "full_outer")
    there = F.coalesce(F.col("s.in_scope"), F.lit(False))
    known = F.col("m.id").isNotNull()
    kept = ~F.coalesce(F.col("m.rechunk_required"), F.lit(False)) & (F.coalesce(F.col("m.active_generation"), F.lit(0)) > 0)
    stamp = kept & (F.col("s.mtime_ns") == F.col("m.mtime_ns")) & (F.col("s.size") == F.col("m.size")) & F.col("m.status").isin("indexed", "missing_pending")
    complete = F.coalesce(F.col("m.complete"), F.lit(False))
    quiet = F.lit(now_ns) - F.col("s.mtime_ns") >= stable_seconds * 1_000_000_000
    missing = F.coalesce(F.col("m.missing_count"), F.lit(0)) + 1
    action = (
        F.when(there & F.coalesce(stamp & complete, F.lit(False)), "unchanged")
        .when(there & ~F.coalesce(stamp, F.lit(False)) & ~quiet, "waiting_stable")
        .when(there & F.coalesce(kept & (F.col("s.sha256") == F.col("m.sha256")) & complete, F.lit(False)), "unchanged")
        .when(there, "index")
        .when(~known, "ignored")
        .when(F.col("s.relative_path").isNotNull(), "delete")  # a file that the scope lost
        .when(missing >= confirmations, "delete")
        .otherwise("missing")
    )
    count = F.when(action.isin("missing", "delete") & F.col("s.relative_path").isNull(), missing).when(action == "waiting_stable", F.coalesce(F.col("m.missing_count"), F.lit(0))).otherwise(F.lit(0))
    return both.select("source_id", "relative_path", F.col("m.id").alias("id"), action.alias("action"), count.cast("int").alias("missing_count"), F.coalesce(F.col("m.active_generation"), F.lit(0)).alias("active_generation"))


def complete_files(chunks: DataFrame, files: DataFrame, vectors: DataFrame, space: str) -> DataFrame:
    """``files`` with complete: every active chunk has a vector of the space and its input; no chunk is complete too."""
    active = chunks.select("chunk_id", "source_file_id", "generation", "embedding_input_hash")
    good = vectors.where(F.col("embedding_space_id") == space).select("chunk_id", "embedding_input_hash", F.lit(True).alias("has"))
    per = active.join(good, ["chunk_id", "embedding_input_hash"], "left").groupBy(F.col("source_file_id").alias("id"), F.col("generation").alias("active_generation")).agg(F.count_if(F.col("has").isNull()).alias("lacking"))
    return files.join(per, ["id", "active_generation"], "left").withColumn("complete", F.coalesce(F.col("lacking"), F.lit(0)) == 0).drop("lacking")


def next_generation(diff: DataFrame) -> DataFrame:
    """Files to index with the generation that their new chunks get."""
    return diff.where("action = 'index'").withColumn("pending_generation", F.col("active_generation") + 1)


def activate(files: DataFrame, staged: DataFrame) -> DataFrame:
    """Files after staged generations (id, pending_generation) became active; one whose pending number has changed meanwhile keeps its own."""
    s = staged.select("id", F.col("pending_generation").alias("staged"))
    swap = F.col("staged").isNotNull() & (F.col("staged") == F.col("pending_generation"))
    out = files.join(s, "id", "left")
    return out.withColumns({
        "active_generation": F.when(swap, F.col("staged")).otherwise(F.col("active_generation")),
        "status": F.when(swap, "indexed").otherwise(F.col("status")),
        "pending_generation": F.when(swap, F.lit(None).cast("long")).otherwise(F.col("pending_generation")),
    }).drop("staged")


def inactive_chunks(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks that no active or pending generation holds: garbage and, with their ids, tombstones."""
    live = files.select(F.col("id").alias("source_file_id"), F.explode(F.array_compact(F.array("active_generation", "pending_generation"))).alias("generation"))
    return chunks.join(live, ["source_file_id", "generation"], "left_anti")


def merge_tombstones(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each chunk: the first time queued, and scope_cleanup once any row has it."""
    return old.unionByName(new).groupBy("chunk_id").agg(F.min("source_id").alias("source_id"), F.max("scope_cleanup").alias("scope_cleanup"), F.min("queued_at").alias("queued_at"))


def binding(tombstones: DataFrame, chunks: DataFrame) -> DataFrame:
    """Tombstones that count: those whose chunk is not indexed."""
    return tombstones.join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def rechunk_plan(reasons: DataFrame, files: DataFrame) -> DataFrame:
    """(outcome, n_sources, n_files) of a change of chunk settings: queued, or the reason that skips a source (see access.eligibility)."""
    marked = files.where("active_generation > 0").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    told = reasons.select(F.col("id").alias("source_id"), F.coalesce("why_not", F.lit("queued")).alias("outcome"))
    return told.join(marked, "source_id", "left").groupBy("outcome").agg(F.count(F.lit(1)).alias("n_sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"))


def rechunk(reasons: DataFrame, files: DataFrame, jobs: DataFrame, old: Limits | None, new: Limits, now: Column, why: str) -> tuple[DataFrame, DataFrame] | None:
    """(files, new jobs) of a change of chunk settings, None where nothing changes.

    Every file with an active generation is marked, also those of skipped
    sources, which come later; a source without a reason against it (see
    access.eligibility) gets a job unless one is open.
    """
    if old == new:
        return None
    marked = files.withColumn("rechunk_required", (F.col("active_generation") > 0) | F.coalesce("rechunk_required", F.lit(False)))
    busy = jobs.where("status IN ('queued', 'running')").select("source_id").distinct()
    queued = reasons.where("why_not IS NULL").select(F.col("id").alias("source_id")).join(busy, "source_id", "left_anti")
    return marked, queued.select("source_id", now.alias("requested_at"), F.lit("queued").alias("status"), F.lit(why).alias("reason"))


def due(last_scan: Column, last_error: Column, now: Column, interval: int) -> tuple[Column, Column]:
    """(next time, whether it is due): an hour at least after an error that needs the provider's account settled."""
    wait = F.greatest(F.lit(interval), retry_delay(last_error))
    at = F.timestamp_seconds(F.unix_seconds(last_scan) + wait)
    return at, F.coalesce(at <= now, F.lit(True))


def retry_delay(error: Column) -> Column:
    """Seconds: 3600 for errors 401, 402, 403 and those that name a provider action, else 0."""
    return F.when(F.coalesce(error, F.lit("")).rlike(r"provider action required|HTTP 40[123]\b"), 3600).otherwise(0)


def backoff(failures: Column) -> Column:
    """Seconds to wait after so many failures in a row: 5, 10, ... 160."""
    return F.least(F.lit(300.0), 5 * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(5)))).cast("int")
