"""A folder from its first synchronisation to the deletion of a file."""

import os

import pytest
from pyspark.sql import functions as F

from skein.operators import catalog as catalog_ops
from skein.operators import lexical, snapshots
from skein.plans import ingest
from skein.plans.search import Searcher
from skein.schema import schema
from skein.sources.providers import ProviderActionRequired, hashing_embedder, overlap_reranker

DAY = 86_400 * 10**9


def put(root, name, text, at):
    path = root / name
    path.parent.mkdir(exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    os.utime(path, ns=(at, at))


def state(store):
    files = {r["relative_path"]: (r["status"], r["active_generation"], r["missing_count"]) for r in store.read("source_files").collect()}
    chunks, vectors = ({r["chunk_id"] for r in store.read(t).select("chunk_id").collect()} for t in ("chunks", "vectors"))
    return files, chunks, vectors


@pytest.fixture
def catalog(spark, tmp_path):
    root = tmp_path / "notes"
    root.mkdir()
    store = snapshots.Store(spark, f"file://{tmp_path}/store")
    row = spark.createDataFrame([("s", str(root))], "id string, absolute_path string")
    row = row.withColumns({"enabled": F.lit(True), "auto_sync": F.lit(True), "consent_identity": F.lit("c"), "scope_cleanup_pending": F.lit(False)})
    store.commit({"sources": row}, 0)
    return root, store


def test_sync(catalog):
    root, store = catalog

    def refuse(texts):
        raise ProviderActionRequired("provider action required: HTTP 402")

    good = ingest.Space(hashing_embedder(8), "hash|8", "a")
    bad = ingest.Space(refuse, "hash|8", "a")

    def sync(day, to=good):
        return ingest.sync(store, "s", "c", to, day * DAY)

    assert sync(2)["scanned_files"] == 0
    put(root, "a.md", "# One\n\nFirst text.", DAY)
    put(root, "deep/b.txt", "Second text.", DAY)
    put(root, "copy.txt", b"\xff\xfe", DAY)
    put(root, "young.md", "Still written.", 3 * DAY)
    put(root, ".hidden.md", "Never seen.", DAY)
    told = sync(3)
    assert (told["indexed_files"], told["embedded_vectors"], told["failed_files"], told["waiting_files"], told["status"]) == (2, 2, 1, 1, "partial")
    files, chunks, vectors = state(store)
    assert files == {"a.md": ("indexed", 1, 0), "deep/b.txt": ("indexed", 1, 0), "copy.txt": ("error", 0, 0), "young.md": ("waiting_stable", 0, 0)}
    assert len(chunks) == 2 and chunks == vectors and "not UTF-8" in told["error"]

    # nothing changed but the young file is quiet now; the file with bad bytes is mended
    put(root, "copy.txt", "Mended.", DAY)
    told = sync(4)
    assert (told["indexed_files"], told["unchanged_files"], told["status"]) == (2, 2, "succeeded")

    # the provider refuses: the last good generation stays, and so does what it was made from
    put(root, "a.md", "# One\n\nAnother text.", 4 * DAY)
    before = state(store)
    told = sync(6, bad)
    assert (told["failed_files"], told["indexed_files"], told["embedded_vectors"]) == (1, 0, 0) and "HTTP 402" in told["error"]
    files, chunks, vectors = state(store)
    assert files["a.md"] == ("error", 1, 0) and (chunks, vectors) == before[1:]

    # later it works; the old vector is queued, then drained
    assert sync(7)["indexed_files"] == 1
    files, chunks, vectors = state(store)
    assert files["a.md"] == ("indexed", 2, 0) and vectors - chunks == {c for c in before[1] if c not in chunks} and len(vectors - chunks) == 1
    assert ingest.drain(store, 10) == 1 and ingest.drain(store, 10) == 0
    files, chunks, vectors = state(store)
    assert chunks == vectors and len(chunks) == 4

    # a renamed file of the same name and text reuses its vector, even where the provider refuses; the old path goes when missing twice
    os.makedirs(root / "moved")
    os.rename(root / "deep/b.txt", root / "moved/b.txt")
    told = sync(8, bad)
    assert (told["indexed_files"], told["reused_vectors"], told["embedded_vectors"], told["missing_files"]) == (1, 1, 0, 1)
    assert state(store)[0]["deep/b.txt"] == ("missing_pending", 1, 1)
    assert sync(9)["deleted_files"] == 1
    files, chunks, vectors = state(store)
    assert "deep/b.txt" not in files and len(chunks) == 4 and len(vectors - chunks) == 1
    runs = store.read("sync_runs")
    assert runs.schema == schema("sync_runs") and runs.count() == 7


def test_ids_are_never_used_again(catalog):
    root, store = catalog
    to = ingest.Space(hashing_embedder(8), "hash|8", "a")
    put(root, "a.md", "First.", DAY)
    ingest.sync(store, "s", "c", to, 3 * DAY)
    os.remove(root / "a.md")
    ingest.sync(store, "s", "c", to, 4 * DAY)
    ingest.sync(store, "s", "c", to, 5 * DAY)
    put(root, "z.md", "Last.", DAY)
    ingest.sync(store, "s", "c", to, 6 * DAY)
    files, chunks, vectors = state(store)
    assert list(files) == ["z.md"] and len(chunks) == 1 and len(vectors) == 2
    assert ingest.drain(store, 10) == 1
    _, chunks, vectors = state(store)
    assert chunks == vectors and len(chunks) == 1
    # a tombstone whose chunk lives all the same is void
    live = store.read("chunks").select("chunk_id", F.lit("s").alias("source_id"), F.lit(False).alias("scope_cleanup"), F.current_timestamp().alias("queued_at"))
    store.commit({"vector_deletions": snapshots.Change("s", live)}, store.version())
    assert ingest.drain(store, 10) == 1 and state(store)[2] == chunks and store.read("vector_deletions").count() == 0


def test_from_folder_to_result(catalog, spark):
    root, store = catalog
    to = ingest.Space(hashing_embedder(8), "hash|8", "a")
    searcher = Searcher.over(store, "c", "a", to.embed, overlap_reranker)
    found = lambda text: [(r["source"], r["text"]) for r in searcher.search(text).rows]
    scoped = lambda **v: store.commit({"sources": catalog_ops.change(store.read("sources"), ["s"], **v)}, store.version())
    scoped(include_patterns=F.array(F.lit("**/*.rst")))
    put(root, "a.rst", "alpha beta", DAY)
    put(root, "deep/b.rst", "alpha gamma", DAY)
    put(root, "c.md", "alpha delta", DAY)
    assert ingest.sync(store, "s", "c", to, 3 * DAY)["indexed_files"] == 2
    assert sorted(found("alpha")) == [("s/a.rst", "alpha beta"), ("s/deep/b.rst", "alpha gamma")]

    # one file is edited: a search reads its new segment, nothing else was tokenised, and the old places are gone
    put(root, "a.rst", "epsilon beta", 2 * DAY)
    before = {r[0] for r in store.state()["tables"]["postings"]["s"]["rows"]}
    ingest.sync(store, "s", "c", to, 4 * DAY)
    part = store.state()["tables"]["postings"]["s"]
    new = [r for r in part["rows"] if r[0] not in before]
    assert before < {r[0] for r in part["rows"]} and len(new) == 1 and part["deletes"]
    added = spark.read.parquet(f"{store.root}/{new[0][0]}")
    assert {r.term for r in added.collect()} >= {"epsilon", "beta", "rst"} and added.select("chunk_id").distinct().count() == 1
    assert [s for s, _ in found("epsilon")][0] == "s/a.rst" and "s/a.rst" in [s for s, _ in found("beta")]
    terms = store.read("postings").groupBy("term").count()
    assert {r["term"]: r["count"] for r in terms.where("term IN ('alpha', 'epsilon', 'beta')").collect()} == {"alpha": 1, "epsilon": 1, "beta": 1}
    assert lexical.stored(store).stats() == lexical.layout(lexical.lexical_index(store.read("chunks"))).stats()

    # a narrower scope hides at once what is still indexed, and the next run removes it
    scoped(exclude_patterns=F.array(F.lit("deep/**")))
    assert [s for s, _ in found("alpha gamma")] == ["s/a.rst"]
    assert ingest.sync(store, "s", "c", to, 5 * DAY)["deleted_files"] == 1
    assert {r["relative_path"] for r in store.read("source_files").collect()} == {"a.rst"}
    assert searcher.search("alpha", source_ids=["s"]).status in ("ok", "no_results")
    os.rename(root, root.parent / "elsewhere")
    assert searcher.search("alpha").status == "consent_required"


def test_two_sources_do_not_disturb_each_other(catalog, spark, tmp_path):
    root, store = catalog
    second = tmp_path / "second"
    second.mkdir()
    row = store.read("sources").withColumns({"id": F.lit("t"), "absolute_path": F.lit(str(second))})
    store.commit({"sources": snapshots.Change("t", row)}, store.version())
    put(root, "a.md", "one", DAY)
    put(second, "b.md", "two", DAY)
    good = hashing_embedder(8)
    inner = []

    def meanwhile(texts):
        return good(texts)

    class Late(snapshots.Store):
        """Another source's run, and then this one's, commits before this one's own commit."""

        def commit(self, changed, base, sums=None):
            if not inner:
                inner.append(1)
                ingest.sync(snapshots.Store(spark, store.root), who, "c", ingest.Space(good, "hash|8", "a"), 3 * DAY)
            return super().commit(changed, base, sums)

    who = "t"
    assert ingest.sync(Late(spark, store.root), "s", "c", ingest.Space(meanwhile, "hash|8", "a"), 3 * DAY)["indexed_files"] == 1
    files, chunks, vectors = state(store)
    assert set(files) == {"a.md", "b.md"} and len(chunks) == 2 and chunks == vectors
    assert {r["id"]: r["source_id"] for r in store.read("sync_runs").collect()}.keys() == {1, 2}
    who = "s"
    inner.clear()
    put(root, "a.md", "three", 2 * DAY)
    with pytest.raises(snapshots.Conflict):
        ingest.sync(Late(spark, store.root), "s", "c", ingest.Space(good, "hash|8", "a"), 4 * DAY)
    assert len(state(store)[1]) == 2


def test_refusals(catalog, spark):
    root, store = catalog
    to = ingest.Space(hashing_embedder(8), "hash|8", "a")
    with pytest.raises(ValueError, match="unknown"):
        ingest.sync(store, "other", "c", to, DAY)
    with pytest.raises(ValueError, match="s:"):
        ingest.sync(store, "s", "another consent", to, DAY)
    assert store.version() == 1
