"""A full rebuild of the vectors, by pages, that goes on where it was interrupted.

The active chunks of eligible sources are embedded in the order of their keys.  They
are sorted once; a page reads the files that hold its places, not all chunks.  Each
page is a commit that holds its vectors and the key it reached, so a rebuild that
dies begins with the next page.  When all are there, the pointer alone puts the new
table in the old one's place.  If sources, files or chunks were written meanwhile, or
the settings are others, the rebuild is given up: nothing has changed but the
version's number.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexing import retrieval_text
from ..operators import access, catalog
from ..operators.snapshots import Change, Conflict, Store
from ..sources.scratch import Scratch
from .ingest import Space, embed_each, with_roots

#: Chunks of a page.
PAGE = 50_000
#: What a rebuild rests on.
RESTS_ON = ("sources", "source_files", "chunks")
_PART = "pages"
#: The key of a chunk.
_BY = ("source_id", "source_file_id", "ordinal")


def _now(store: Store, to: Space, consent: str, page: int) -> dict:
    """The state and settings that a rebuild holds for."""
    revisions = store.state()["revisions"]
    return {"space": to.space, "identity": to.identity, "consent": consent, "page": page, "revisions": {n: revisions.get(n, {}) for n in RESTS_ON}}


def eligible_chunks(store: Store, consent: str) -> DataFrame:
    """Active chunks of the sources that may be sent to the provider."""
    sources = access.eligible(with_roots(store.read("sources")), consent)
    return access.active_chunks(store.read("chunks"), store.read("source_files"), sources)


def _pages(chunks: DataFrame, page: int, scratch: Scratch) -> Iterator[DataFrame]:
    """Chunks in the order of their keys, ``page`` at a time; what a page reads are the files that hold some of it."""
    text = retrieval_text(F.col("text"), F.col("title"), F.col("heading_path"), F.col("filename"))
    rows = chunks.select("chunk_id", *_BY, "generation", "embedding_input_hash", text.alias("embedding_text"))
    # dealt by ranges: of two rows the one with the larger key has the larger place, though places have gaps
    placed = scratch.save(rows.repartitionByRange(*_BY).sortWithinPartitions(*_BY).withColumn("_place", F.monotonically_increasing_id()), "sorted")
    name = F.col("_metadata.file_name")
    # a row for each file; within one, places have no gaps
    held = placed.groupBy(name.alias("file")).agg(F.min("_place").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("first").collect()
    some: list[tuple[str, int, int]] = []
    left = page
    for r in held:
        at, end = r["first"], r["first"] + r["n"]
        while at < end:
            took = min(left, end - at)
            some.append((r["file"], at, at + took))
            at, left = at + took, left - took
            if not left:
                yield _those(placed, name, some)
                some, left = [], page
    if some:
        yield _those(placed, name, some)


def _those(placed: DataFrame, name: Column, some: list[tuple[str, int, int]]) -> DataFrame:
    """The rows of places between bounds in some files."""
    # a page is a run of places but for the gaps between files
    return placed.where(name.isin([f for f, _, _ in some]) & (F.col("_place") >= some[0][1]) & (F.col("_place") < some[-1][2])).drop("_place")


def rebuild(store: Store, to: Space, consent: str, page: int = PAGE) -> dict:
    """Embed all eligible chunks anew and put them in the old vectors' place; returns counts of pages (of this call) and chunks."""
    here = _now(store, to, consent, page)
    found = store.state()["notes"].get("rebuild")
    if found and {k: found[k] for k in here} != here:
        store.commit({"rebuilt_vectors": store.read("rebuilt_vectors").limit(0)}, store.version(), notes={"rebuild": None})
        raise Conflict("sources, files, chunks or settings have changed since the rebuild began; it is given up")
    if not found:
        found = here | {"cursor": None, "chunks": 0}
        store.commit({"rebuilt_vectors": store.read("rebuilt_vectors").limit(0)}, store.version(), notes={"rebuild": found})
    active, pages, sorted_ = eligible_chunks(store, consent), 0, Scratch(store.spark, "rebuild")
    behind = catalog.behind(active, tuple(found["cursor"]) if found["cursor"] else None)
    for some in _pages(behind, page, sorted_):
        base, scratch = store.version(), Scratch(store.spark, "page")
        if _now(store, to, consent, page) != here:
            raise Conflict("sources, files or chunks have changed during the rebuild")
        told = some.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*_BY)).alias("last")).first()
        made = scratch.save(embed_each(some.select("embedding_input_hash", "embedding_text"), to.embed), "made")
        failed = made.where("vector IS NULL").first()
        if failed:
            raise ValueError(f"page behind {found['cursor']}: {failed['error']}")
        rows = some.join(made.select("embedding_input_hash", "vector"), "embedding_input_hash").withColumn("embedding_space_id", F.lit(to.space))
        found = found | {"cursor": list(told["last"]), "chunks": found["chunks"] + told["n"]}
        store.commit({"rebuilt_vectors": Change(_PART, rows)}, base, notes={"rebuild": found})
        while store.compact("rebuilt_vectors", _PART):
            pass
        scratch.clear()
        pages += 1
    sorted_.clear()
    base = store.version()
    if _now(store, to, consent, page) != here:
        raise Conflict("sources, files or chunks have changed during the rebuild")
    if not active.join(store.read("rebuilt_vectors").select("chunk_id"), "chunk_id", "left_anti").isEmpty():
        raise ValueError("the rebuilt table lacks chunks")
    store.take_place("vectors", "rebuilt_vectors", base, RESTS_ON, {"rebuild": None})
    return {"pages": pages, "chunks": found["chunks"]}
