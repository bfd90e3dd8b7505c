"""Operational aggregates: source statistics, queue, runs, doctor, scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .reconcile import retry_delay

OPEN = ("queued", "running")
#: Seconds from which on an open job counts as stuck.
STUCK_SECONDS = 900
#: Nodes of a source's minimal scope from which on it is shown as truncated.
MOST_NODES = 1000


def source_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per source: files, active chunks, and files by status.  Chunks are summed for each file first, so no count needs distinct values."""
    per_file = chunks.groupBy(F.col("source_file_id").alias("id"), F.col("generation").alias("active_generation")).agg(F.count(F.lit(1)).alias("n"))
    both = files.join(per_file, ["id", "active_generation"], "left")
    status = lambda s: F.count_if(F.col("status") == s)
    return both.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"),
        status("indexed").alias("n_indexed"),
        status("error").alias("n_error"),
        status("waiting_stable").alias("n_waiting"),
        status("missing_pending").alias("n_missing"),
    )


def job_counts(jobs: DataFrame) -> DataFrame:
    """Jobs by status; queued and running are there with zero too."""
    spark: SparkSession = jobs.sparkSession
    always = spark.range(len(OPEN)).select(F.element_at(F.array(*[F.lit(s) for s in OPEN]), (F.col("id") + 1).cast("int")).alias("status"), F.lit(0).cast("long").alias("n"))
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n")).unionByName(always).groupBy("status").agg(F.sum("n").alias("n"))


def queue_head(jobs: DataFrame, sources: DataFrame, k: int = 1) -> DataFrame:
    """The oldest queued jobs of enabled sources without pending clean-up."""
    open_to = sources.where("enabled AND NOT scope_cleanup_pending").select(F.col("id").alias("source_id"), "display_name")
    return jobs.where("status = 'queued'").join(open_to, "source_id").orderBy("requested_at", "id").limit(k)


def job_history(jobs: DataFrame, k: int) -> DataFrame:
    """Open jobs, oldest first, then closed ones, newest first, within one limit; ``place`` is the order."""
    bucket = F.when(F.col("status").isin(*OPEN), 0).otherwise(1)
    rows = jobs.withColumn("bucket", bucket).withColumn("sort_id", F.when(F.col("bucket") == 0, F.col("id")).otherwise(-F.col("id")))
    first = rows.orderBy("bucket", "sort_id").limit(k)
    return first.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("bucket", "sort_id"))).drop("bucket", "sort_id")


def recent_closed(jobs: DataFrame, k: int = 10) -> DataFrame:
    """Of the last closed jobs, how many succeeded and failed."""
    last = jobs.where(~F.col("status").isin(*OPEN)).orderBy(F.desc("id")).limit(k)
    return last.agg(F.count_if(F.col("status") == "succeeded").alias("n_succeeded"), F.count_if(F.col("status") == "failed").alias("n_failed"))


def _age(now: str) -> Column:
    """Seconds for which a job has run or waited."""
    since = F.when(F.col("status") == "running", F.coalesce("started_at", "requested_at")).otherwise(F.col("requested_at"))
    return F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(since)


def stuck(jobs: DataFrame, now: str, seconds: int = STUCK_SECONDS) -> DataFrame:
    """Open jobs that have waited or run too long, with their age."""
    return jobs.where(F.col("status").isin(*OPEN)).withColumn("age_seconds", _age(now)).where(F.col("age_seconds") > seconds)


def doctor(sources: DataFrame, files: DataFrame, active: DataFrame, consent: str) -> DataFrame:
    """One row of counts for the health report."""
    s = sources.agg(
        F.count(F.lit(1)).alias("n_sources"),
        F.count_if("enabled").alias("n_enabled"),
        F.count_if("auto_sync").alias("n_auto_sync"),
        F.count_if(F.col("consent_identity") == consent).alias("n_consent_current"),
    )
    f = files.agg(
        F.count_if(F.col("active_generation") > 0).alias("n_files"),
        F.count_if(F.col("status") == "error").alias("n_file_errors"),
        F.count_if(F.col("last_error").contains("provider action required")).alias("n_action_required"),
    )
    c = active.agg(F.count(F.lit(1)).alias("n_active_chunks"))
    rows = s.withColumn("k", F.lit(0)).join(f.withColumn("k", F.lit(0)), "k").join(c.withColumn("k", F.lit(0)), "k").drop("k")
    verdict = F.when(F.col("n_action_required") > 0, "error").when((F.col("n_file_errors") > 0) | (F.col("n_consent_current") < F.col("n_sources")), "warning").otherwise("ok")
    return rows.withColumn("verdict", verdict)


def health_report(sources: DataFrame, files: DataFrame, active: DataFrame, jobs: DataFrame, states: DataFrame, consent: str, now: str, running: bool | None, seconds: int = STUCK_SECONDS) -> DataFrame:
    """One row (status, message, counts) of the health of a catalog.

    Of the states that make a search empty or old only the first is told, in the
    order below; so are an account to settle before other file errors, and stuck
    jobs before open ones.  Any error outweighs any warning.  ``states`` are those of
    vectors.integrity; ``running`` tells whether jobs are being worked off, None if
    that is not known.
    """
    enabled = sources.where("enabled")
    count = lambda name: F.count(F.lit(1)).alias(name)
    broken = files.where("status = 'error'").join(enabled.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    parts = [
        enabled.agg(count("n_enabled"), F.count_if(F.col("consent_identity") == consent).alias("n_consent_current"), F.count_if("auto_sync").alias("n_auto_sync")),
        broken.agg(count("n_file_errors"), F.count_if(retry_delay(F.col("last_error")) > 0).alias("n_action_required")),
        active.agg(count("n_active_chunks")),
        jobs.where(F.col("status").isin(*OPEN)).agg(count("n_open"), F.count_if(_age(now) > seconds).alias("n_stuck")),
        states.agg(F.count_if(F.col("state") != "found").alias("n_failing")),
    ]
    # each part is one row
    row = reduce(lambda a, b: a.join(b, "_k"), [p.withColumn("_k", F.lit(0)) for p in parts]).drop("_k")
    n = F.col
    # fixed values: what the report says
    search = (
        F.when(n("n_enabled") == 0, "no enabled knowledge source")
        .when(n("n_active_chunks") == 0, "no active knowledge chunks")
        .when(n("n_consent_current") != n("n_enabled"), "one or more source consents are stale")
        .when(n("n_auto_sync") != n("n_enabled"), "one or more enabled sources are not set to auto-sync")
    )
    account = "provider credentials, account balance, quota, or model access requires attention before failed files can be retried"
    failed = F.when(n("n_action_required") > 0, account).when(n("n_file_errors") > 0, "one or more source files failed to index")
    worker = {True: None, False: "knowledge coordinator is not running", None: "coordinator status could not be determined"}[running]
    waiting = F.when((n("n_stuck") == 0) & (n("n_open") > 0), "knowledge tasks are still open" if running else "knowledge tasks remain open while the coordinator is not running")
    stopped = F.when(n("n_stuck") > 0, "one or more knowledge tasks appear stuck")
    vectors = F.when(n("n_failing") > 0, "one or more active vectors are missing or invalid")
    none = F.lit(None).cast("string")
    errors = F.array_compact(F.array(stopped, none if running else waiting, vectors))
    warnings = F.array_compact(F.array(search, failed, F.lit(worker).cast("string"), waiting if running else none))
    told = F.array_join(F.concat(errors, warnings), "; ")
    return row.withColumns({
        "status": F.when(F.size(errors) > 0, "error").when(F.size(warnings) > 0, "warning").otherwise("ok"),
        "message": F.when(told == "", "knowledge backend is ready").otherwise(F.concat(F.lit("knowledge backend has errors: "), told)),
    })


def preview(files: DataFrame, target: int, price_per_million: float) -> DataFrame:
    """Per source: bytes, estimated chunks and tokens, and the cost with four decimals."""
    return files.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("size").alias("n_bytes"),
        F.sum(F.greatest(F.lit(1), F.ceil(F.col("size") / target))).cast("long").alias("n_chunks"),
        F.sum(F.floor(F.col("size") / 2)).cast("long").alias("n_tokens"),
    ).withColumn("cost", F.round(F.col("n_tokens") / 1e6 * price_per_million, 4))


def directory_rollup(files: DataFrame) -> DataFrame:
    """Per source and directory: all and selected files below it, and whether it is full, partial or off.

    Rows (source_id, relative_path, selected).  Counts are taken for each parent
    directory first; only those are exploded to their ancestors.
    """
    parts = F.split("relative_path", "/")
    direct = files.groupBy("source_id", F.slice(parts, F.lit(1), F.size(parts) - 1).alias("dir")).agg(F.count(F.lit(1)).alias("n"), F.count_if("selected").alias("n_selected"))
    ups = F.transform(F.sequence(F.lit(1), F.size("dir")), lambda i: F.array_join(F.slice("dir", F.lit(1), i), "/"))
    above = direct.where(F.size("dir") > 0).select("source_id", F.explode(ups).alias("dir"), "n", "n_selected")
    out = above.groupBy("source_id", "dir").agg(F.sum("n").alias("n_files"), F.sum("n_selected").alias("n_selected"))
    return out.withColumn("state", F.when(F.col("n_selected") == 0, "off").when(F.col("n_selected") == F.col("n_files"), "full").otherwise("partial"))


def minimal_cover(files: DataFrame) -> DataFrame:
    """(source_id, path, kind): the shallowest full directories and the selected files that none of them holds."""
    rolled = directory_rollup(files)
    full = rolled.where("state = 'full'").select("source_id", "dir")
    parts = F.split("path", "/")
    ups = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))
    nodes = full.select("source_id", F.col("dir").alias("path"), F.lit("directory").alias("kind")).unionByName(files.where("selected").select("source_id", F.col("relative_path").alias("path"), F.lit("file").alias("kind")))
    covered = nodes.select("source_id", "path", "kind", F.explode(ups).alias("dir")).join(full, ["source_id", "dir"], "left_semi").select("source_id", "path", "kind").distinct()
    return nodes.join(covered, ["source_id", "path", "kind"], "left_anti")


def capped_cover(cover: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """(source_id, path, kind, truncated): a source's cover, or, where it has more than ``most`` nodes, one row that says so and selects nothing."""
    sizes = cover.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n"))
    kept = cover.join(sizes.where(F.col("_n") <= most), "source_id", "left_semi").select("source_id", "path", "kind", F.lit(False).alias("truncated"))
    none = F.lit(None).cast("string")
    return kept.unionByName(sizes.where(F.col("_n") > most).select("source_id", none.alias("path"), none.alias("kind"), F.lit(True).alias("truncated")))


def run_counters(outcomes: DataFrame) -> DataFrame:
    """Per source: files scanned, indexed and missing of one run, from rows (source_id, action)."""
    n = lambda a: F.count_if(F.col("action") == a)
    return outcomes.groupBy("source_id").agg(F.count_if(~F.col("action").isin("missing", "delete")).alias("scanned_files"), n("index").alias("indexed_files"), n("missing").alias("missing_files"), n("delete").alias("deleted_files"))


def first_errors(files: DataFrame, k: int = 5) -> DataFrame:
    """Per source the first ``k`` errors by path; one that needs a provider action comes first."""
    by = Window.partitionBy("source_id").orderBy(~F.col("last_error").contains("provider action required"), "relative_path")
    return files.where("status = 'error'").withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)
