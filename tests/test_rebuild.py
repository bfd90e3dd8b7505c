"""A rebuild by pages: interrupted, resumed, refused."""

import pytest
from pyspark.sql import functions as F

from skein.operators import snapshots
from skein.plans.ingest import Space
from skein.plans.rebuild import rebuild
from skein.schema import conform


@pytest.fixture
def store(spark, tmp_path):
    store = snapshots.Store(spark, f"file://{tmp_path}/store")
    none = F.lit(None).cast("array<string>")
    sources = spark.createDataFrame([(i, str(tmp_path), i != "off", "c") for i in ("a", "b", "off")], "id string, absolute_path string, enabled boolean, consent_identity string")
    sources = sources.withColumns({"scope_cleanup_pending": F.lit(False), "include_patterns": none, "exclude_patterns": none})
    files = spark.createDataFrame([(i, "off" if i == 9 else "ab"[i % 2], f"{i}.md", 1) for i in range(10)], "id long, source_id string, relative_path string, active_generation long")
    chunks = spark.range(40).select(F.concat_ws(":", (F.col("id") % 10).cast("string"), F.lit("1"), F.floor(F.col("id") / 10).cast("string")).alias("chunk_id"), (F.col("id") % 10).alias("source_file_id"), F.lit(1).cast("long").alias("generation"), F.floor(F.col("id") / 10).cast("int").alias("ordinal"), F.concat(F.lit("text "), "id").alias("text"), F.lit("").alias("heading_path"), F.lit("t").alias("title"), F.lit("f.md").alias("filename"), F.concat(F.lit("h"), "id").alias("embedding_input_hash"))
    old = chunks.select("chunk_id", F.lit("old").alias("embedding_space_id"), F.array(F.lit(0.0)).alias("vector"))
    store.commit({n: conform(d, n) for n, d in {"sources": sources, "source_files": files, "chunks": chunks, "vectors": old}.items()}, 0)
    return store


def embedder():
    """A function that is sent by value: workers don't import this module."""
    return lambda texts: [[float(len(t))] for t in texts]


def held(store):
    return {r["chunk_id"]: (r["embedding_space_id"], r["vector"][0], r["embedding_input_hash"]) for r in store.read("vectors").collect()}


def test_goes_on_where_it_was_interrupted(store, tmp_path):
    counter, lengths = tmp_path / "pages", embedder()
    counter.mkdir()

    def dies(texts):  # every task's call after page 3's commit fails
        if (counter / "stop").exists():
            raise TimeoutError("gone")
        return lengths(texts)

    class Watched(snapshots.Store):
        def commit(self, changed, base, sums=None, notes=None):
            out = super().commit(changed, base, sums, notes)
            if notes and notes["rebuild"] and notes["rebuild"]["chunks"] >= 21:
                (counter / "stop").touch()
            return out

    before = held(store)
    with pytest.raises(ValueError, match="gone"):
        rebuild(Watched(store.spark, store.root), Space(dies, "i", "new"), "c", page=7)
    assert held(store) == before and store.state()["notes"]["rebuild"]["chunks"] == 21 and store.read("rebuilt_vectors").count() == 21
    assert rebuild(store, Space(lengths, "i", "new"), "c", page=7) == {"pages": 3, "chunks": 36}  # 36 of 40: the disabled source's are left out
    got = held(store)
    assert len(got) == 36 and {v[0] for v in got.values()} == {"new"} and not any(k.startswith("9:") for k in got)
    text = {r["chunk_id"]: (float(len(f"Title: t\nFilename: f.md\nText:\n{r['text']}")), r["embedding_input_hash"]) for r in store.read("chunks").collect()}
    assert all(v[1:] == text[k] for k, v in got.items())
    assert store.read("rebuilt_vectors").count() == 0 and store.state()["notes"]["rebuild"] is None
    # the new table takes upserts and deletes as any other
    store.commit({"vectors": snapshots.Change("a", delete=store.read("vectors").where("chunk_id = '0:1:0'").select("chunk_id"))}, store.version())
    assert len(held(store)) == 35


def test_is_refused_where_something_moved(store):
    lengths = embedder()

    def stops(texts):
        raise TimeoutError("gone")

    for what in ("catalog", "settings"):
        with pytest.raises(ValueError, match="gone"):
            rebuild(store, Space(stops, "i", "new"), "c", page=30)
        if what == "catalog":
            store.commit({"source_files": snapshots.Change("a", delete=store.read("source_files").where("id = 0").select("id"))}, store.version())
        before = held(store)
        with pytest.raises(snapshots.Conflict, match="given up"):
            rebuild(store, Space(lengths, "i", "new" if what == "catalog" else "newer"), "c", page=30)
        assert held(store) == before and store.state()["notes"]["rebuild"] is None

    class Moved(snapshots.Store):
        """A file goes while the last page is embedded."""

        def take_place(self, name, by, base, reads=(), notes=None):
            store.commit({"source_files": snapshots.Change("b", delete=store.read("source_files").where("id = 1").select("id"))}, store.version())
            return super().take_place(name, by, base, reads, notes)

    before = held(store)
    with pytest.raises(snapshots.Conflict):
        rebuild(Moved(store.spark, store.root), Space(lengths, "i", "new"), "c", page=100)
    assert held(store) == before


def test_a_page_reads_only_its_files(spark, store, monkeypatch):
    """All chunks are sorted once; each page is whole and in order, from the files that hold it."""
    from skein.plans import rebuild as r
    from skein.sources.scratch import Scratch

    chunks, calls = r.eligible_chunks(store, "c"), []
    want = [tuple(x) for x in chunks.select(*r._BY).orderBy(*r._BY).collect()]
    pages = list(r._pages(chunks.repartition(5), 7, Scratch(spark, "test")))
    assert [[tuple(x) for x in p.select(*r._BY).orderBy(*r._BY).collect()] for p in pages] == [want[a : a + 7] for a in range(0, len(want), 7)]
    read = [{x[0] for x in p.select("_metadata.file_name").collect()} for p in r._pages(chunks, 7, Scratch(spark, "test"))]
    assert all(len(x) <= 2 for x in read) and len(read) == 6
    monkeypatch.setattr(r, "eligible_chunks", lambda *a: calls.append(a) or chunks)
    monkeypatch.setattr(r.catalog, "rebuild_page", lambda *a: pytest.fail("a page was taken from all chunks"))
    assert rebuild(store, Space(embedder(), "i", "new"), "c", page=7) == {"pages": 6, "chunks": 36} and len(calls) == 1
