"""Catalog operators on small tables."""

from pyspark.sql import functions as F

from skein.operators import catalog


def sources(spark, rows):
    return spark.createDataFrame(rows, "id string, absolute_path string, enabled boolean")


def test_registration_refuses_overlaps_and_known_ids(spark):
    old = sources(spark, [("a", "/x/a", True), ("b", "/x/b", True)])
    new = sources(spark, [("c", "/x/a/sub", True), ("d", "/x/ab", True), ("b", "/y", True), ("e", "/x/d", True), ("f", "/x/d", True), ("g", "/g1", True), ("g", "/g2", True), ("h", "/h", True), ("h", "/h", True)])
    taken, why = catalog.register(old, new)
    assert {r.id for r in taken.collect()} == {"a", "b", "d"}
    assert {r.id: r.why for r in why.collect()} == {"c": "root overlaps another", "b": "id exists", "e": "root overlaps another", "f": "root overlaps another", "g": "id repeats", "h": "id repeats"} and why.count() == 8


def test_lifecycle(spark):
    s = spark.createDataFrame([("a", True, "old"), ("b", False, "old"), ("c", True, "new"), ("d", True, None)], "id string, enabled boolean, consent_identity string")
    jobs = spark.createDataFrame([("d", "queued"), ("a", "failed")], "source_id string, status string")
    renewed, due = catalog.renew_consent(s, jobs, "new")
    assert {r.id: r.consent_identity for r in renewed.collect()} == {"a": "new", "b": "old", "c": "new", "d": "new"} and [r.id for r in due.collect()] == ["a"]
    assert {r.id for r in catalog.change(s, ["b"], enabled=True).where("enabled").collect()} == {"a", "b", "c", "d"}
    held = s.withColumn("scope_cleanup_pending", F.col("id") == "b")
    why = catalog.removal_refusals(held, jobs, ["a", "b", "d", "x", "a"])
    assert {r.id: r.why for r in why.collect()} == {"b": "a scope cleanup is pending", "d": "a job is open", "x": "unknown"}


def test_health_is_held(spark):
    calls, now, revision = [], [0.0], [1]

    def states():
        calls.append(1)
        return spark.createDataFrame([(f"c{i:03}", "missing" if i < 60 else "found") for i in range(100)], "chunk_id string, state string")

    h = catalog.Health(states, lambda: revision[0], lambda: now[0])
    r = h.check()
    assert r["counts"] == {"missing": 60, "found": 40} and len(r["failing"]) == 50 and not r["ok"]
    now[0] = 299.0
    h.check()
    assert len(calls) == 1
    revision[0] = 2
    h.check()
    now[0] = 600.0
    h.check()
    assert len(calls) == 3


def test_scope_waits_for_its_cleanup(spark):
    sources = spark.createDataFrame([("a", ["**/*.md"], "c", False), ("b", ["**/*.md"], "c", False), ("d", None, None, True), ("e", None, "c", False)], "id string, include_patterns array<string>, consent_identity string, scope_cleanup_pending boolean")
    jobs = spark.createDataFrame([("b", "running"), ("a", "failed")], "source_id string, status string")
    scopes = spark.createDataFrame([("a", ["x/**"]), ("b", ["x/**"]), ("d", ["y/**"]), ("e", ["1"]), ("e", ["2"]), ("f", ["z"])], "id string, include_patterns array<string>")
    after, refused = catalog.rescope(sources, jobs, scopes, "new")
    assert {r["id"]: r["why"] for r in refused.collect()} == {"b": "a job is open", "e": "id repeats", "f": "unknown"}
    assert {r["id"]: tuple(r)[1:] for r in after.collect()} == {"a": (["x/**"], "new", True), "b": (["**/*.md"], "c", False), "d": (["y/**"], "new", True), "e": (None, "c", False)}
    queued = spark.createDataFrame([("1", "a", False), ("2", "d", True), ("3", "d", True), ("4", "b", True)], "chunk_id string, source_id string, scope_cleanup boolean")
    assert {r["id"]: r["scope_cleanup_pending"] for r in catalog.finish_cleanup(after, queued).collect()} == {"a": False, "b": False, "d": True, "e": False}
