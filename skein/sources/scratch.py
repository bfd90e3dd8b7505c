"""Written intermediate tables in the folder that a cluster shares.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset
and Spark runs on one machine, as in tests, a temporary folder is made and set; a
cluster without the setting is an error.  What a run has not dropped itself is
deleted when the driver's interpreter ends.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; its setting is read from the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        with contextlib.suppress(Exception):
            found = context.getCheckpointDir()
        if not found:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="spark-")
            context.setCheckpointDir(found)
    return found.rstrip("/")


def _delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder, if it is there and the JVM still is."""
    with contextlib.suppress(Exception):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of one run of an operator, under a folder name of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(_delete, spark, self.root)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
        """Write a table (partitioned by a column) and read it again: the plan so far is cut, and a lost executor costs no more than the readers' own work."""
        path = self.path(name)
        with self._freeing():
            writer = df.write.option("compression", codec)
            (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_all(self, parts: list[DataFrame], name: str, codec: str = "zstd") -> DataFrame:
        """Write parts of one schema into one table, one after the other: the shuffle files of each are gone before the next one's are made."""
        path = self.path(name)
        for df in parts:
            with self._freeing():
                df.write.mode("append").option("compression", codec).parquet(path)
            self.tidy()
        return self.spark.read.schema(parts[0].schema).parquet(path)

    @contextlib.contextmanager
    def _freeing(self) -> Iterator[None]:
        """Spark deletes the shuffle files of what runs inside as soon as it has ended; a written table has no use for them."""
        was = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            yield
        finally:
            if was is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, was)

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table of this run that nothing reads any more."""
        top = self.root.rsplit("/", 1)[1]
        for folder in {f[: f.index(top) + len(top)] + "/" + f[f.index(top) + len(top) + 1 :].split("/", 1)[0] for f in df.inputFiles() if f"/{top}/" in f}:
            _delete(self.spark, folder)

    def clear(self) -> None:
        """Delete all tables of this run."""
        _delete(self.spark, self.root)

    def tidy(self) -> None:
        """Let Spark's cleaner drop the shuffle files of plans that are out of use, which it does when the driver's JVM collects garbage."""
        gc.collect()
        self.spark._jvm.System.gc()
