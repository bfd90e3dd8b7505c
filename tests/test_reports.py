"""The health report's precedence and what a change of chunk settings marks."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skein.functions.chunking import Limits
from skein.operators import reconcile, reports

NOW = "2024-02-01 00:00:00"


def report(spark, sources=((True, "c", True),), errors=(), chunks=1, jobs=(), failing=0, running=True):
    s = spark.createDataFrame([(f"s{i}", *x) for i, x in enumerate(sources)], "id string, enabled boolean, consent_identity string, auto_sync boolean")
    f = spark.createDataFrame([("s0", "error", e) for e in errors], "source_id string, status string, last_error string")
    j = spark.createDataFrame([(x, datetime(2024, 1, 31, 23, m), None) for x, m in jobs], "status string, requested_at timestamp, started_at timestamp")
    states = spark.range(failing + 1).select(F.when(F.col("id") < failing, "missing").otherwise("found").alias("state"))
    row = reports.health_report(s, f, spark.range(chunks), j, states, "c", NOW, running).first()
    return row["status"], row["message"].removeprefix("knowledge backend has errors: ")


@pytest.mark.parametrize(
    ("given", "status", "told"),
    [
        ({}, "ok", "knowledge backend is ready"),
        ({"sources": (), "chunks": 0}, "warning", "no enabled knowledge source"),
        ({"sources": ((False, "old", False),)}, "warning", "no enabled knowledge source"),
        ({"sources": ((True, "old", False),), "chunks": 0}, "warning", "no active knowledge chunks"),
        ({"sources": ((True, "old", False),)}, "warning", "one or more source consents are stale"),
        ({"sources": ((True, "c", True), (True, "c", False), (False, None, None))}, "warning", "one or more enabled sources are not set to auto-sync"),
        ({"errors": ("not UTF-8", None)}, "warning", "one or more source files failed to index"),
        ({"errors": ("HTTP 402",)}, "warning", "provider credentials, account balance, quota, or model access requires attention before failed files can be retried"),
        ({"jobs": (("queued", 50),)}, "warning", "knowledge tasks are still open"),
        ({"jobs": (("queued", 50),), "running": False}, "error", "knowledge tasks remain open while the coordinator is not running; knowledge coordinator is not running"),
        ({"jobs": (("running", 1), ("queued", 50))}, "error", "one or more knowledge tasks appear stuck"),
        ({"jobs": (("failed", 1),), "running": None}, "warning", "coordinator status could not be determined"),
        ({"failing": 2, "errors": ("x",)}, "error", "one or more active vectors are missing or invalid; one or more source files failed to index"),
    ],
)
def test_report(spark, given, status, told):
    assert report(spark, **given) == (status, told)


def test_rechunk(spark):
    reasons = spark.createDataFrame([("a", None), ("b", "disabled"), ("c", None)], "id string, why_not string")
    files = spark.createDataFrame([(1, "a", 0, False), (2, "b", 3, None), (3, "c", 0, True)], "id long, source_id string, active_generation long, rechunk_required boolean")
    jobs = spark.createDataFrame([("c", "running"), ("a", "failed")], "source_id string, status string")
    now = F.lit(NOW).cast("timestamp")
    assert reconcile.rechunk(reasons, files, jobs, Limits(), Limits(), now, "why") is None
    marked, new = reconcile.rechunk(reasons, files, jobs, Limits(), Limits(1200), now, "why")
    assert {r["id"]: r["rechunk_required"] for r in marked.collect()} == {1: False, 2: True, 3: True}
    assert [(r["source_id"], r["status"], r["reason"]) for r in new.collect()] == [("a", "queued", "why")]
