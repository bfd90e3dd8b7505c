"""Scans as a stream, and what becomes of each file as keyed state with timers.

:class:`FolderScan` is a streaming source: each micro-batch is one scan of a
root, walked by tasks that share its folders out by a hash, with a beat row for
each task so that time goes on in an empty folder.  :func:`file_events` keeps a row of
state for each (source, path) and tells what a scan's comparison with the manifest
tells (see operators.reconcile.scan_diff): index, waiting_stable, missing and
delete.  Time is the scans' own: a file that is still being written is indexed
when its quiet time has passed, and one that later scans lack is missing, then
deleted, by timers; nobody has to ask.  A timer fires once a later scan has moved
the watermark, so an event about an absent file comes with the batch after the scan
that lacked it.
"""

from __future__ import annotations

import os
import re
import stat
import time
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.globs import EXCLUDE, HARD_EXCLUDED
from ..operators.reconcile import CONFIRMATIONS, STABLE_SECONDS
from ..sources.files import pruned

#: The state store that keyed state with timers needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCAN = "source_id string, relative_path string, mtime_ns long, size long, seen_at timestamp"
EVENTS = "source_id string, relative_path string, action string, mtime_ns long, size long, missing_count int"


class Share(InputPartition):
    """One task's share of a scan."""

    def __init__(self, number: int, of: int, at_ms: int):
        self.number, self.of, self.at_ms = number, of, at_ms


class FolderScan(DataSource):
    """Format ``skein_scan``; options: source_id, root, tasks, exclude (patterns, a line each)."""

    @classmethod
    def name(cls) -> str:
        return "skein_scan"

    def schema(self) -> str:
        return SCAN

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _ScanReader(self.options)


class _ScanReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.source, self.root, self.tasks = options["source_id"], options["root"], int(options.get("tasks", "8"))
        lines = options.get("exclude")
        self.prune = pruned(EXCLUDE if lines is None else lines.splitlines())

    def initialOffset(self) -> dict:
        return {"ms": 0}

    def latestOffset(self) -> dict:
        return {"ms": int(time.time() * 1000)}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return [Share(i, self.tasks, end["ms"]) for i in range(self.tasks)]

    def commit(self, end: dict) -> None:
        pass

    def read(self, share: Share) -> Iterator[tuple]:
        """The files of the folders that fall to this share; every task sees the top two levels' names, none all files."""
        seen_at, skip = pd.Timestamp(share.at_ms, unit="ms").to_pydatetime(), re.compile(self.prune)
        yield self.source, "", None, None, seen_at
        open_ = [("", 0)]
        while open_:
            folder, depth = open_.pop()
            own = depth > 2 or zlib.crc32(folder.encode()) % share.of == share.number
            with os.scandir(os.path.join(self.root, folder)) as found:
                for e in found:
                    path = f"{folder}/{e.name}".lstrip("/")
                    if e.name.startswith(".") or e.name.lower() in HARD_EXCLUDED or not own and not e.is_dir(follow_symlinks=False):
                        continue
                    info = e.stat(follow_symlinks=False)
                    if stat.S_ISDIR(info.st_mode):
                        # below the second level a folder belongs to the share of its ancestor there
                        if not skip.search(path + "/") and (depth < 2 or own):
                            open_.append((path, depth + 1))
                    elif stat.S_ISREG(info.st_mode):
                        yield self.source, path, info.st_mtime_ns, info.st_size, seen_at


class _Files(StatefulProcessor):
    """One file's state: the stamp that was reported, the stamp seen last, and how many scans have lacked it."""

    def __init__(self, stable_ms: int, confirmations: int):
        self.stable_ms, self.confirmations = stable_ms, confirmations

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", "known_mtime long, known_size long, mtime long, size long, missing int")

    def _timer(self, at_ms: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at_ms)

    def _event(self, key, action: str, mtime, size, missing: int) -> pd.DataFrame:
        return pd.DataFrame({"source_id": [key[0]], "relative_path": [key[1]], "action": [action], "mtime_ns": [mtime], "size": [size], "missing_count": [missing]}).astype({"mtime_ns": "Int64", "size": "Int64", "missing_count": "Int32"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not key[1]:  # a beat
            return
        last = max((r for frame in rows for r in frame.itertuples(index=False)), key=lambda r: r.seen_at)
        stamp, now = (int(last.mtime_ns), int(last.size)), int(pd.Timestamp(last.seen_at).value // 1_000_000)
        known = (None, None)
        if self.file.exists():
            known = tuple(self.file.get()[:2])
        if known != stamp:
            if now - stamp[0] // 1_000_000 >= self.stable_ms:
                known = stamp
                yield self._event(key, "index", *stamp, 0)
            else:
                yield self._event(key, "waiting_stable", *stamp, 0)
        self.file.update((*known, *stamp, 0))
        # the next scan: by then it is seen again, or it is missing
        self._timer(now + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known_mtime, known_size, mtime, size, missing = self.file.get()
        missing += 1
        if missing >= self.confirmations:
            self.file.clear()
            yield self._event(key, "delete", known_mtime, known_size, missing)
            return
        self.file.update((known_mtime, known_size, mtime, size, missing))
        self._timer(timerValues.getCurrentWatermarkInMs() + 1)
        yield self._event(key, "missing", known_mtime, known_size, missing)

    def close(self) -> None:
        pass


def scans(spark: SparkSession, source_id: str, root: str, tasks: int = 8, exclude: tuple[str, ...] = EXCLUDE) -> DataFrame:
    """A stream of a root's scans, one for each trigger."""
    spark.dataSource.register(FolderScan)
    return spark.readStream.format("skein_scan").options(source_id=source_id, root=root, tasks=tasks, exclude="\n".join(exclude)).load()


def file_events(seen: DataFrame, stable_seconds: int = STABLE_SECONDS, confirmations: int = CONFIRMATIONS) -> DataFrame:
    """Events (source_id, relative_path, action, mtime_ns, size, missing_count) of a stream of scans (see ``SCAN``)."""
    seen.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    keyed = seen.withWatermark("seen_at", "0 seconds").groupBy("source_id", "relative_path")
    return keyed.transformWithStateInPandas(_Files(stable_seconds * 1000, confirmations), EVENTS, "Append", "EventTime")
