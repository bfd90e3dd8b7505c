import hashlib
import os

import pytest
from pyspark.sql import functions as F

from skein.operators import fusion, reconcile, vectors
from skein.operators.snapshots import Change, Conflict, Store
from skein.plans.search import Searcher, as_groups
from skein.schema import assert_schema, conform, schema
from skein.sources import files as fs
from skein.sources import providers


def test_rrf_adds_channels_and_breaks_ties_by_id(spark):
    a = spark.createDataFrame([("x", -2.0), ("y", -1.0)], "chunk_id string, score double")
    b = spark.createDataFrame([("x", 0.1), ("z", 0.2)], "chunk_id string, score double")
    rows = fusion.rrf([fusion.ranked(a, "fts"), fusion.ranked(b, "vector")]).orderBy("rrf_rank").collect()
    assert [(r.chunk_id, r.channels) for r in rows] == [("x", ["fts", "vector"]), ("y", ["fts"]), ("z", ["vector"])]
    assert rows[0].rrf_score == pytest.approx(2 / 61) and rows[0].distance == 0.1 and rows[1].distance is None


def test_rerank_merge_and_cap(spark):
    c = spark.createDataFrame([("a", 1, 0.3, "s", "f"), ("b", 2, 0.2, "s", "f"), ("c", 3, 0.1, "s", "g")], "chunk_id string, rrf_rank int, rrf_score double, source_id string, relative_path string")
    told = spark.createDataFrame([("c", 0.9, 0), ("c", 0.1, 5), ("q", 1.0, 1), ("b", 0.5, 2)], "chunk_id string, rerank_score double, rerank_pos int")
    merged = fusion.merge_rerank(c, told)
    assert [(r.chunk_id, r.final_score) for r in merged.orderBy("final_rank").collect()] == [("c", 0.9), ("b", 0.5), ("a", 0.3)]
    assert [r.chunk_id for r in fusion.cap_per_file(merged, 1).orderBy("final_rank").collect()] == ["c", "b"]


def test_vectors(spark):
    v = spark.createDataFrame([("a", "s", "x", [1.0, 0.0]), ("b", "s", "x", [0.0, 1.0]), ("c", "t", "y", [1.0, 0.0])], "chunk_id string, source_id string, embedding_space_id string, vector array<float>")
    assert [(r.chunk_id, r.score) for r in vectors.nearest(v, [1.0, 0.0], 2).collect()] == [("a", 0.0), ("c", 0.0)]
    assert [r.chunk_id for r in vectors.nearest(v, [1.0, 0.0], 5, "l2", space="x", source_ids=["s"]).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        vectors.distance(F.col("vector"), F.col("vector"), "other")
    with pytest.raises(Exception, match="zero or not finite"):
        spark.range(1).select(vectors.normalize(F.array(F.lit(0.0), F.lit(0.0)))).collect()


def test_backoff_and_retry(spark):
    rows = spark.createDataFrame([(1, "HTTP 402"), (3, "HTTP 4020"), (9, None)], "n int, e string").select(reconcile.backoff(F.col("n")).alias("b"), reconcile.retry_delay(F.col("e")).alias("d")).collect()
    assert [(r.b, r.d) for r in rows] == [(5, 3600), (20, 0), (160, 0)]


def tombstones(spark, ids, source="s"):
    return conform(spark.createDataFrame([(i, source) for i in ids], "chunk_id string, source_id string"), "vector_deletions")


def held(store, name="vector_deletions", part=None):
    return sorted(r["chunk_id"] for r in store.read(name, part).collect())


def test_store_swaps_a_pointer_and_refuses_a_stale_base(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.version() == 0 and store.read("chunks").count() == 0
    rows = tombstones(spark, ["a"])
    assert store.commit({"vector_deletions": rows}, 0) == 1
    with pytest.raises(Conflict):
        store.commit({"vector_deletions": rows}, 0)
    assert store.commit({"vector_deletions": rows.limit(0)}, 1) == 2
    assert store.read("vector_deletions").count() == 0
    assert_schema(store.read("vector_deletions"), "vector_deletions")
    with pytest.raises(ValueError):
        assert_schema(rows.select("chunk_id"), "vector_deletions")


def test_store_merges_on_read(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    key = lambda *ids: tombstones(spark, ids).select("chunk_id")
    store.commit({"vector_deletions": tombstones(spark, ["a", "b", "old"])}, 0)
    store.commit({"vector_deletions": Change("s", tombstones(spark, ["c", "d"]), key("a"))}, 1)
    # an upsert: the new row stands though its key is deleted in the same commit; a key that comes back later lives
    store.commit({"vector_deletions": [Change("s", tombstones(spark, ["b", "a"]), key("b")), Change("t", tombstones(spark, ["e"], "t"))]}, 2)
    assert held(store) == ["a", "b", "c", "d", "e", "old"]
    assert held(store.__class__(spark, store.root), part="s") == ["a", "b", "c", "d", "old"]
    # what a commit writes is what changed
    sizes = [r[1] for p in store.state()["tables"]["vector_deletions"].values() for r in p["rows"]]
    assert sorted(sizes) == [1, 2, 2, 3]
    store.commit({"vector_deletions": Change("s", delete=key("c", "zz"))}, 3)
    assert held(store) == ["a", "b", "d", "e", "old"] and len(held(store)) == 5
    assert store.read("vector_deletions", version=2).count() == 4


def test_commits_that_do_not_meet_both_stand(spark, tmp_path):
    store, other = (Store(spark, f"file://{tmp_path}/store") for _ in range(2))
    store.commit({"vector_deletions": Change("s", tombstones(spark, ["a"]))}, 0)
    base = store.version()
    store.commit({"vector_deletions": Change("s", tombstones(spark, ["b"]))}, base, {"s": {"n": 1}})
    assert other.commit({"vector_deletions": Change("t", tombstones(spark, ["c"], "t"))}, base, {"t": {"n": 2}}) == base + 2
    with pytest.raises(Conflict, match="vector_deletions, s"):
        other.commit({"vector_deletions": Change("s", tombstones(spark, ["d"]))}, base)
    with pytest.raises(Conflict):
        other.commit({"vector_deletions": tombstones(spark, ["d"])}, base)  # a whole table meets every part
    assert held(store) == ["a", "b", "c"] and store.revision("vector_deletions", "s") == base + 1
    assert store.state()["sums"] == {"s": {"n": 1}, "t": {"n": 2}}
    assert [store.reserve("sync_runs", n) for n in (1, 3, 1)] == [1, 2, 5] and other.reserve("sync_runs", 1) == 6


def test_segments_are_compacted_and_old_files_go(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    for i in range(8):
        gone = tombstones(spark, [f"k{i - 1}"]).select("chunk_id") if i % 2 else None
        store.commit({"vector_deletions": Change("s", tombstones(spark, [f"k{i}", f"m{i}"]), gone)}, i)
    before = held(store)
    assert store.compact("vector_deletions", "s") and held(store) == before == sorted([f"m{i}" for i in range(8)] + ["k1", "k3", "k5", "k7"])
    part = store.state()["tables"]["vector_deletions"]["s"]
    assert len(part["rows"]) == 1 and not part["deletes"] and not store.compact("vector_deletions", "s")
    assert store.expire(1) == 12 and held(store) == before and store._pointers() == [9]


def test_files(spark, tmp_path):
    root = tmp_path / "root"
    (root / "sub").mkdir(parents=True)
    (root / ".hidden").mkdir()
    (root / "_x.md").write_text("é")
    (root / "sub/bad.txt").write_bytes(b"\xff\xfe")
    (root / "sub/gone.txt").write_text("x")
    (root / ".hidden/a.md").write_text("no")
    os.symlink(root / "_x.md", root / "link.md")
    listed = fs.scan(spark, "s", str(root))
    assert [r.relative_path for r in listed.collect()] == ["_x.md", "sub/bad.txt", "sub/gone.txt"]
    (root / "sub/gone.txt").write_text("changed")
    rows = {r.relative_path: (r.content, r.error) for r in fs.read(listed).collect()}
    assert rows == {"_x.md": ("é", ""), "sub/bad.txt": (None, "not UTF-8"), "sub/gone.txt": (None, "changed since the scan")}
    assert fs.safe_root(str(root)) and not fs.safe_root(str(root / "link.md")) and not fs.safe_root(str(root / "none"))
    with pytest.raises(Exception, match="No such file"):
        fs.scan(spark, "s", str(root / "none"))


def test_walk_in_rounds_prunes_and_hashes_in_blocks(spark, tmp_path, monkeypatch):
    root = tmp_path / "root"
    for i in range(12):
        (root / f"d{i}" / "sub" / "skip").mkdir(parents=True)
        for name in ("a.md", "sub/b.txt", "sub/skip/c.md"):
            (root / f"d{i}" / name).write_text(f"{i} {name}")
    (root / "d3/locked").mkdir(mode=0o000)  # would end a walk that entered it
    got = fs.scan(spark, "s", str(root), ["**/skip/**", "d3/locked/**"], entries=3)
    assert sorted(r.relative_path for r in got.collect()) == sorted(f"d{i}/{n}" for i in range(12) for n in ("a.md", "sub/b.txt"))
    os.chmod(root / "d3/locked", 0o700)
    (root / "big.txt").write_bytes("é".encode() * (fs.BLOCK + 7))  # letters across the blocks' edges
    (root / "bad.txt").write_bytes(b"x" * (2 * fs.BLOCK) + b"\xff" + b"y" * fs.BLOCK)
    (root / "cut.txt").write_bytes(b"x" * 10 + "é".encode()[:1])
    listed = fs.scan(spark, "s", str(root)).where("relative_path NOT LIKE 'd%'")
    told = {r.relative_path: (r.sha256, r.error) for r in fs.digests(listed).collect()}
    sha = {n: hashlib.sha256((root / n).read_bytes()).hexdigest() for n in ("big.txt", "bad.txt", "cut.txt")}
    assert told == {"big.txt": (sha["big.txt"], ""), "bad.txt": (sha["bad.txt"], "not UTF-8"), "cut.txt": (sha["cut.txt"], "not UTF-8")}
    assert {r.relative_path: r.sha256 for r in fs.read(listed).collect()} == sha
    assert fs.why_unsafe(str(root / "none")) == "root does not exist or can't be read" and fs.root_identity(str(root / "none")) is None
    assert fs.why_unsafe(str(root / "big.txt")) == "root is not a directory" and fs.why_unsafe(str(root)) is None


def test_scope_is_the_sources_own(spark):
    from skein.operators.access import in_scope

    sources = spark.createDataFrame([("a", ["**/*.rst"], []), ("b", None, None), ("c", ["**/*.md"], ["old/**"])], "id string, include_patterns array<string>, exclude_patterns array<string>")
    rows = spark.createDataFrame([(s, p) for s in "abcd" for p in ("x.rst", "x.md", "old/x.md", "old/x.rst")], "source_id string, relative_path string")
    got = {(r.source_id, r.relative_path) for r in rows.where(in_scope(sources, F.col("source_id"), F.col("relative_path"))).collect()}
    assert got == {("a", "x.rst"), ("a", "old/x.rst"), ("b", "x.md"), ("b", "old/x.md"), ("c", "x.md")}


def test_providers():
    assert providers.realign([{"index": 1, "v": "b"}, {"index": 0, "v": "a"}], 2, "v") == ["a", "b"]
    for bad in ([{"index": 0, "v": 1}], [{"index": 0, "v": 1}, {"index": 0, "v": 1}], [{"index": True, "v": 1}, {"index": 0, "v": 1}]):
        with pytest.raises(ValueError):
            providers.realign(bad, 2, "v")
    with pytest.raises(ValueError):
        providers.checked([[0.0, 0.0]], 2)
    assert providers.with_instruction(["t"], "do") == ["do\nt"]
    assert providers.overlap_reranker("a b", ["c", "a b", "a"]) == [(1, 1.0), (2, 0.5), (0, 0.0)]


@pytest.fixture
def searcher(spark):
    embed = providers.hashing_embedder(8)
    docs = [("1:1:0", 1, "alpha alpha one"), ("2:1:0", 2, "alpha beta"), ("3:1:0", 3, "gamma"), ("4:1:0", 4, "alpha hidden")]
    tables = {
        "sources": spark.createDataFrame([("a", True, "ok", False, True), ("b", False, "ok", False, True), ("c", True, "old", False, True)], "id string, enabled boolean, consent_identity string, scope_cleanup_pending boolean, root_safe boolean").withColumns({c: F.lit(None).cast("array<string>") for c in ("include_patterns", "exclude_patterns")}),
        "source_files": spark.createDataFrame([(1, "a", "x/1.md", 1), (2, "a", "x/2.md", 1), (3, "a", "x/3.md", 1), (4, "a", "x/.d/4.md", 1)], "id long, source_id string, relative_path string, active_generation long"),
        "chunks": spark.createDataFrame([(c, f, 1, t, "", "T", "f.md") for c, f, t in docs], "chunk_id string, source_file_id long, generation long, text string, heading_path string, title string, filename string"),
        "vectors": spark.createDataFrame([(c, "a", "sp", embed([t])[0]) for c, _, t in docs], "chunk_id string, source_id string, embedding_space_id string, vector array<double>"),
    }
    return Searcher(tables.__getitem__, "ok", "sp", embed, providers.overlap_reranker)


def test_search_finds_authorized_chunks(searcher):
    out = searcher.search("alpha", top_k=2)
    assert out.status == "ok" and {r["chunk_id"] for r in out.rows} == {"1:1:0", "2:1:0"}
    assert out.warnings == ["some enabled sources were skipped because provider consent is stale or scope cleanup is pending: c"]
    seen = out.diagnostics
    assert list(seen["stages"]) == ["fts", "vector", "fusion", "rerank", "final"] and [r["chunk_id"] for r in seen["stages"]["final"]] == [r["chunk_id"] for r in out.rows]
    assert set(seen["milliseconds"]) == {"keyword", "embedding", "vector", "recall and fusion", "policy", "rerank"} and seen["settings"]["top_k"] == 2 and seen["settings"]["sources"] == ["a"]
    shape = as_groups(out)
    assert shape["groups"][0]["table"] == "text" and "chunk_id" not in shape["groups"][0]["results"][0]


@pytest.mark.parametrize(
    ("args", "status", "said"),
    [
        ({"query": " "}, "invalid_request", "query must not be empty"),
        ({"query": "a", "top_k": 21}, "invalid_request", "top_k must be between 1 and 20"),
        ({"query": "a", "table_ids": ["x"]}, "invalid_request", "unknown table_ids: x"),
        ({"query": "a", "source_ids": ["z"]}, "invalid_request", "unknown source_ids: z"),
        ({"query": "a", "source_ids": ["b"]}, "invalid_request", "requested source_ids are disabled: b"),
        ({"query": "a", "source_ids": ["c"]}, "consent_required", "one or more requested sources require renewed provider consent or scope cleanup"),
    ],
)
def test_search_refuses(searcher, args, status, said):
    out = searcher.search(**args)
    assert (out.status, out.warnings) == (status, [said])


def test_search_degrades(searcher):
    def broken(*_):
        raise TimeoutError

    searcher.embed = searcher.rerank = broken
    out = searcher.search("alpha")
    assert out.status == "ok" and {"vector recall unavailable: TimeoutError", "rerank unavailable: TimeoutError"} <= set(out.warnings)
    searcher.embed, load = (lambda t: [[1.0] * 8]), searcher.load
    searcher.load = lambda name: broken() if name == "vectors" else load(name)
    assert "vector recall unavailable after one retry: TimeoutError" in searcher.search("alpha").warnings
    searcher.rerank, searcher.load = (lambda q, d: [(99, 1.0)]), load
    assert "reranker returned no valid result indexes; using RRF" in searcher.search("alpha").warnings
    searcher.load = lambda name: broken()
    assert searcher.search("alpha").status == "unavailable"


def test_every_schema_parses():
    assert all(schema(n).fields for n in ("sources", "source_files", "chunks", "vectors", "sync_jobs", "sync_runs"))


def test_scratch_writes_and_leaves_the_session_as_it_was(spark):
    from skein.sources.scratch import _CLEANUP, Scratch

    was = spark.conf.get(_CLEANUP, None)
    scratch = Scratch(spark, "test")
    plan = spark.range(100).repartition(4, "id").groupBy((F.col("id") % 3).alias("k")).count()
    saved = scratch.save(plan, "counts")
    # a plan whose shuffle files are gone can be run again
    assert {tuple(r) for r in plan.collect()} == {tuple(r) for r in saved.collect()} == {(0, 34), (1, 33), (2, 33)}
    assert {tuple(r) for r in scratch.save(plan, "again").collect()} == {(0, 34), (1, 33), (2, 33)}
    assert spark.conf.get(_CLEANUP, None) == was
