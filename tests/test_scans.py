"""A stream of scans against the comparison of each scan with the manifest."""

import os
import time
from collections import defaultdict
from datetime import datetime, timedelta, timezone
from random import Random

import pytest

from skein.session import ship
from skein.streaming import scans

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
NS = 10**9


def plain(history, stable=30, confirmations=2):
    """Events of a history of scans {path: (mtime_ns, size)}, after the rules for one scan and a manifest."""
    manifest, out = {}, []
    for at, scan in history:
        now = int(at.timestamp()) * NS
        for path in sorted(set(scan) | set(manifest)):
            known, missing = manifest.get(path, (None, 0))
            if path in scan:
                if scan[path] != known:
                    quiet = now - scan[path][0] >= stable * NS
                    out.append((path, "index" if quiet else "waiting_stable", *scan[path]))
                    known = scan[path] if quiet else known
                manifest[path] = known, 0
            elif missing + 1 >= confirmations:
                out.append((path, "delete", *(known or (None, None))))
                del manifest[path]
            else:
                out.append((path, "missing", *(known or (None, None))))
                manifest[path] = known, missing + 1
    return out


def by_path(events):
    """Each path's events in order; a missing one that is seen again right away may go untold."""
    out = defaultdict(list)
    for path, *rest in events:
        out[path].append(tuple(rest))
    return {p: [e for i, e in enumerate(es) if e[0] != "missing" or (i + 1 < len(es) and es[i + 1][0] == "delete")] for p, es in out.items()}


def test_replayed_history(spark, tmp_path):
    ship(spark)
    rng, history, files = Random(2), [], {}
    for i in range(9):
        at = START + timedelta(seconds=100 * i)
        now = int(at.timestamp()) * NS
        for path in [f"d/{k}.md" for k in range(8)]:
            dice = rng.random()
            if dice < 0.25:
                files.pop(path, None)
            elif dice < 0.6 or path not in files:
                files[path] = now - rng.choice([5, 60, 90]) * NS, rng.randint(1, 99)
        history.append((at, dict(files)))
    history += [(START + timedelta(seconds=100 * i), dict(files)) for i in (9, 10, 11)]  # what is still open settles
    folder = tmp_path / "history"
    for i, (at, scan) in enumerate(history):
        rows = [("s", p, m, n, at) for p, (m, n) in scan.items()] + [("s", "", None, None, at)]
        spark.createDataFrame(rows, scans.SCAN).coalesce(1).write.parquet(str(folder / f"scan={i:02}"))
        time.sleep(0.01)
    seen = spark.readStream.schema(scans.SCAN).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
    out = []
    query = scans.file_events(seen).writeStream.foreachBatch(lambda df, n: out.extend((n, *r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    got = by_path((path, action, mtime, size) for _, _, path, action, mtime, size, _ in out)
    assert got == by_path(plain(history))
    assert {e[0] for es in got.values() for e in es} == {"index", "waiting_stable", "missing", "delete"}


def test_folder_as_a_stream(spark, tmp_path):
    ship(spark)
    root = tmp_path / "root"
    (root / "a" / "b" / "c" / "d").mkdir(parents=True)
    (root / "skip").mkdir()
    names = ["x.md", "a/y.md", "a/b/z.md", "a/b/c/u.md", "a/b/c/d/v.md"]
    for name in [*names, "skip/no.md", ".hidden.md"]:
        (root / name).write_text(name)
        os.utime(root / name, ns=(10**18, 10**18))
    out = []
    events = scans.file_events(scans.scans(spark, "s", str(root), tasks=3, exclude=("skip/**",)))
    query = events.writeStream.foreachBatch(lambda df, n: out.extend(tuple(r)[1:3] for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 120
        while len(out) < len(names) and time.time() < until and query.isActive:
            time.sleep(0.5)
        assert sorted(out) == sorted((n, "index") for n in names)
        os.remove(root / "a/y.md")
        while ("a/y.md", "delete") not in out and time.time() < until and query.isActive:
            time.sleep(0.5)
        assert out[-2:] == [("a/y.md", "missing"), ("a/y.md", "delete")]
    finally:
        query.stop()
    if query.exception():
        pytest.fail(str(query.exception()))
