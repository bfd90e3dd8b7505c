"""Polling as a stream: new files under a folder, reconciled in micro-batches.

The file source reports new paths only; edits and deletions need the batch
reconciliation over a whole scan: :func:`poll_source` calls it for each batch of
arrivals, and a timer for edits and deletions is the caller's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

INTERVALS = (300, 600, 1800)


def poll_text(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], seconds: int | None = None) -> StreamingQuery:
    """Call ``handle`` with (relative_path, content) of files that arrived, every ``seconds`` or, without, once for what is there."""
    if seconds is not None and seconds not in INTERVALS:
        raise ValueError(f"seconds must be one of {INTERVALS}")
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/") + "/"
    # file_path is a URI: what stands behind the root, with its escapes resolved
    full = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    relative = F.expr("substring(_full, instr(_full, _root) + length(_root))")
    rows = files.select(full.alias("_full"), F.lit(root).alias("_root"), F.col("value").alias("content")).select(relative.alias("relative_path"), "content")
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def poll_source(spark: SparkSession, folder: str, checkpoint: str, sync: Callable[[], object], seconds: int | None = None) -> StreamingQuery:
    """Synchronise a source (plans.ingest.sync) whenever files arrive under its folder."""
    return poll_text(spark, folder, checkpoint, lambda rows, n: sync(), seconds)
