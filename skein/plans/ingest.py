"""One synchronisation of a source: from a folder to a committed state of the catalog.

Scan, compare with the manifest, read what changed, split it, reuse or make
vectors, and commit files, chunks, postings, vectors, tombstones and the run's
counters in one version of the store: rows that changed are written, and the keys
of those that went.  A file that can't be read, or one of whose chunks got
no vector, keeps its last good generation and its old stamp, so the next run tries
it again; the others go on.  Runs of different sources do not disturb each other; if
another commit wrote this source meanwhile, nothing is written.

File ids come from a counter that only goes up, so that the ids of chunks, which hold
them, are never used again and a late tombstone can't meet a younger vector.

An empty folder counts its files as missing; a scan that fails ends the run before
anything is written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunking import Limits, chunk_documents
from ..functions.lexing import chunk_id
from ..operators import access, catalog, lexical, reconcile, vectors
from ..operators.snapshots import Change, Store
from ..schema import schema
from ..sources import files
from ..sources.providers import BATCH
from ..sources.scratch import Scratch

Embed = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class Space:
    """Who embeds, and where the vectors belong."""

    embed: Embed
    identity: str
    space: str


def embed_each(inputs: DataFrame, embed: Embed) -> DataFrame:
    """(embedding_input_hash, vector, error) of rows (embedding_input_hash, embedding_text), each input once; a failing batch has errors instead of vectors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), BATCH):
                part = frame.iloc[a : a + BATCH]
                try:
                    made, error = embed(part["embedding_text"].tolist()), None
                except Exception as e:
                    made, error = [None] * len(part), str(e) or type(e).__name__
                yield pd.DataFrame({"embedding_input_hash": part["embedding_input_hash"], "vector": made, "error": error})

    once = inputs.select("embedding_input_hash", "embedding_text").dropDuplicates(["embedding_input_hash"])
    return once.mapInPandas(run, "embedding_input_hash string, vector array<float>, error string")


#: Tables of which a synchronisation writes its source's part.
PARTS = ("sources", "source_files", "chunks", "postings", "chunk_lengths", "vectors", "vector_deletions", "sync_runs")


def with_roots(sources: DataFrame) -> DataFrame:
    """Sources with root_safe and root_identity, the device and number of their root folder (null where it is none); sources are few."""
    found = [(r["id"], files.safe_root(r["absolute_path"]), files.root_identity(r["absolute_path"])) for r in sources.select("id", "absolute_path").collect()]
    told = sources.sparkSession.createDataFrame(found, "id string, root_safe boolean, root_identity string")
    return sources.drop("root_safe", "root_identity").join(told, "id", "left")


def sync(store: Store, source_id: str, consent: str, to: Space, now_ns: int, limits: Limits = Limits(), stable_seconds: int = reconcile.STABLE_SECONDS, confirmations: int = reconcile.CONFIRMATIONS) -> dict:
    """Bring one source up to date; returns the counters of the run, which is also a row of sync_runs."""
    base = store.version()
    found = store.read("sources").where(F.col("id") == source_id)
    row = found.first()
    if row is None:
        raise ValueError(f"source {source_id}: unknown")
    source = access.eligibility(with_roots(found), consent).first()
    if source["why_not"]:
        raise ValueError(f"source {source_id}: {source['why_not']}")
    scratch = Scratch(store.spark, "ingest")
    mine = store.read("source_files", source_id).where(F.col("source_id") == source_id)
    chunks, own_vectors = (store.read(t, source_id) for t in ("chunks", "vectors"))
    manifest = reconcile.complete_files(chunks, mine, own_vectors, to.space)

    # files are hashed only where their stamp doesn't settle it, and read only where they are to be indexed
    keys = ["source_id", "relative_path"]
    seen_ = scratch.save(files.scan(store.spark, source["id"], source["absolute_path"], source["exclude_patterns"]), "scan")
    # what the walk didn't enter may stand in the manifest: it has left the scope and is not missing
    left = mine.select(*keys).join(seen_, keys, "left_anti").withColumn("in_scope", access.in_scope(found, F.col("source_id"), F.col("relative_path"))).where("NOT in_scope")
    listed = seen_.withColumn("in_scope", access.in_scope(found, F.col("source_id"), F.col("relative_path")))
    listed = scratch.save(listed.unionByName(left, allowMissingColumns=True), "listed")
    first = reconcile.scan_diff(listed.withColumn("sha256", F.lit(None).cast("string")), manifest, now_ns, stable_seconds, confirmations)
    doubtful = listed.join(first.where("action = 'index'").select(*keys), keys, "left_semi")
    hashed = scratch.save(files.digests(doubtful), "digests")
    scan = listed.join(hashed.select(*keys, "sha256", F.nullif("error", F.lit("")).alias("hash_error")), keys, "left")
    diff = reconcile.scan_diff(scan, manifest, now_ns, stable_seconds, confirmations)
    told = scan.select(*keys, F.col("mtime_ns").alias("new_mtime"), F.col("size").alias("new_size"), F.col("sha256").alias("new_sha"), "hash_error")
    plan = scratch.save(diff.where("action <> 'ignored'").join(told, keys, "left"), "plan")
    wanted = plan.where("action = 'index' AND hash_error IS NULL").select(*keys, "new_sha")
    contents = files.read(listed.join(wanted, keys, "left_semi")).join(wanted, keys)
    changed_since = F.when(F.col("sha256") != F.col("new_sha"), "changed since it was hashed")
    contents = scratch.save(contents.select(*keys, "content", F.coalesce(F.nullif("error", F.lit("")), changed_since).alias("read_error")), "contents")
    plan = plan.join(contents.select(*keys, "read_error"), keys, "left").withColumn("read_error", F.coalesce("hash_error", "read_error")).drop("hash_error")
    # monotonic ids have gaps: what is reserved reaches up to the largest
    plan = scratch.save(plan.withColumn("_own", F.when(F.col("id").isNull(), F.monotonically_increasing_id())), "marked")
    span = plan.agg(F.max("_own")).first()[0]
    first_id = store.reserve("source_files", span + 1) if span is not None else 0
    plan = scratch.save(plan.withColumn("file_id", F.coalesce("id", F.lit(first_id) + F.col("_own"))).drop("_own"), "numbered")

    # chunks and vectors of the next generation
    to_index = reconcile.next_generation(plan).where("read_error IS NULL")
    texts = to_index.join(contents.select(*keys, "content"), keys).select(F.col("file_id").alias("source_file_id"), "relative_path", "content")
    cut = chunk_documents(texts, limits, to.identity).join(to_index.select(F.col("file_id").alias("source_file_id"), F.col("pending_generation").alias("generation")), "source_file_id")
    cut = scratch.save(cut.withColumn("chunk_id", chunk_id(F.col("source_file_id"), F.col("generation"), F.col("ordinal"))), "chunks")
    cut = scratch.save(vectors.reuse(cut, store.read("vectors"), to.space), "reused")
    made = scratch.save(embed_each(cut.where("reused_vector IS NULL"), to.embed), "embedded")
    filled = cut.join(made, "embedding_input_hash", "left").withColumn("vector", F.coalesce("reused_vector", "vector"))
    failed = filled.where("vector IS NULL").groupBy(F.col("source_file_id").alias("file_id")).agg(F.min(F.coalesce("error", F.lit("no vector"))).alias("embed_error"))
    plan = plan.join(failed, "file_id", "left").withColumn("why", F.coalesce("read_error", "embed_error"))
    plan = scratch.save(plan.withColumn("action", F.when((F.col("action") == "index") & F.col("why").isNotNull(), "failed").otherwise(F.col("action"))), "outcome")
    ready = plan.where("action = 'index'").select(F.col("file_id").alias("source_file_id"))
    fresh = scratch.save(filled.join(ready, "source_file_id", "left_semi"), "fresh")

    # the next state of the tables
    old = mine.select("id", *[F.col(c).alias("old_" + c) for c in ("mtime_ns", "size", "sha256", "rechunk_required", "pending_generation", "last_error")])
    action, seen = F.col("action"), F.col("action").isin("index", "unchanged")
    status = F.when(seen, "indexed").when(action == "failed", "error").when(action == "missing", "missing_pending").otherwise("waiting_stable")
    now_files = plan.where("action <> 'delete'").join(old, "id", "left").select(
        F.col("file_id").alias("id"), "source_id", "relative_path",
        F.when(seen, F.col("new_mtime")).otherwise(F.col("old_mtime_ns")).alias("mtime_ns"),
        F.when(seen, F.col("new_size")).otherwise(F.col("old_size")).alias("size"),
        F.when(seen, F.coalesce("new_sha", "old_sha256")).otherwise(F.col("old_sha256")).alias("sha256"),
        status.alias("status"), "missing_count",
        (F.col("active_generation") + (action == "index").cast("long")).alias("active_generation"),
        F.lit(None).cast("long").alias("pending_generation"),
        F.when(seen, "").when(action == "failed", F.col("why")).otherwise(F.col("old_last_error")).alias("last_error"),
        F.when(seen, False).otherwise(F.coalesce("old_rechunk_required", F.lit(False))).alias("rechunk_required"),
    )
    changed = scratch.save(_differing(mine, now_files), "files")
    dropped = plan.where("action = 'delete'").select("id")
    live = mine.join(changed, "id", "left_anti").join(dropped, "id", "left_anti").unionByName(changed)
    own_chunks = chunks.join(plan.select(F.col("id").alias("source_file_id")), "source_file_id", "left_semi")
    gone = scratch.save(reconcile.inactive_chunks(own_chunks, live).select("chunk_id"), "gone")
    stamp = F.timestamp_micros(F.lit(now_ns // 1000))
    queued = gone.select("chunk_id", F.lit(source_id).alias("source_id"), F.lit(False).alias("scope_cleanup"), stamp.alias("queued_at"))
    rows = fresh.select("chunk_id", F.lit(source_id).alias("source_id"), "source_file_id", "embedding_input_hash", F.lit(to.space).alias("embedding_space_id"), "generation", "vector")
    # only new chunks are tokenised
    made_terms = scratch.save(lexical.lexical_index(fresh), "terms")
    sums = lexical.sums(store, source_id, made_terms, gone)

    by = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = fresh.agg(F.count_if(F.col("reused_vector").isNotNull()).alias("reused"), F.count_if(F.col("reused_vector").isNull()).alias("embedded")).first()
    # five errors at most, by path
    errors = [f"{r['relative_path']}: {r['why']}" for r in plan.where("action = 'failed'").orderBy("relative_path").select("relative_path", "why").limit(5).collect()]
    moment = datetime.fromtimestamp(now_ns / 1e9, timezone.utc)
    run = {
        "id": store.reserve("sync_runs", 1), "source_id": source_id, "started_at": moment, "finished_at": moment,
        "status": "partial" if errors else "succeeded", "scanned_files": seen_.count(), "indexed_files": by.get("index", 0),
        "reused_vectors": parts["reused"], "embedded_vectors": parts["embedded"], "missing_files": by.get("missing", 0), "error": "; ".join(errors) or None,
    }
    runs = schema("sync_runs")
    row = store.spark.createDataFrame([tuple(run[f.name] for f in runs)], runs)
    told = found.withColumns({"last_scan_at": stamp, "last_error": F.lit(run["error"]).cast("string")} | ({} if errors else {"last_success_at": stamp}))
    store.commit({
        "sources": Change(source_id, told, told.select("id")),
        "source_files": Change(source_id, changed, changed.select("id").unionByName(dropped)),
        "chunks": Change(source_id, fresh, gone), **{name: Change(source_id, some, gone) for name, some in lexical.segment(made_terms).items()},
        "vectors": Change(source_id, rows, rows.select("chunk_id")),
        "vector_deletions": Change(source_id, reconcile.merge_tombstones(store.read("vector_deletions", source_id).join(gone, "chunk_id", "left_semi"), queued), queued.select("chunk_id")),
        "sync_runs": Change(source_id, row),
    }, base, {source_id: sums})
    for name in PARTS:
        while store.compact(name, source_id):
            pass
    return run | {"failed_files": by.get("failed", 0), "deleted_files": by.get("delete", 0), "waiting_files": by.get("waiting_stable", 0), "unchanged_files": by.get("unchanged", 0)}


def _differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` that ``old`` does not hold as they are."""
    same = F.lit(True)
    for c in new.columns:
        same = same & F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}"))
    return new.alias("_new").join(old.select(*new.columns).alias("_old"), same, "left_anti")


def remove(store: Store, source_id: str, now_ns: int) -> None:
    """Take a source out of the catalog with its files, chunks, postings and jobs, and queue its vectors for deletion; refused while a job is open or a clean-up is pending."""
    base = store.version()
    refused = catalog.removal_refusals(store.read("sources"), store.read("sync_jobs"), [source_id]).first()
    if refused:
        raise ValueError(f"source {source_id}: {refused['why']}")
    keys = lambda name: store.read(name, source_id).where(F.col("source_id") == source_id)
    chunks = store.read("chunks", source_id).join(keys("source_files").select(F.col("id").alias("source_file_id")), "source_file_id", "left_semi").select("chunk_id")
    queued = catalog.tombstones(keys("vectors"), F.timestamp_micros(F.lit(now_ns // 1000)))
    store.commit({
        "sources": Change(source_id, delete=store.spark.createDataFrame([(source_id,)], "id string")),
        "source_files": Change(source_id, delete=keys("source_files")), "sync_jobs": Change(source_id, delete=keys("sync_jobs")),
        **{name: Change(source_id, delete=chunks) for name in ("chunks", "postings", "chunk_lengths")},
        "vector_deletions": Change(source_id, queued, queued.select("chunk_id")),
    }, base, {source_id: lexical.sums(store, source_id, store.read("chunk_lengths", source_id).limit(0), chunks)})


def drain(store: Store, most: int) -> int:
    """Delete the vectors of the oldest ``most`` tombstones, and then these; returns how many.  A vector whose chunk is indexed stays: its tombstone is void."""
    base = store.version()
    queue = store.read("vector_deletions")
    now = Scratch(store.spark, "drain").save(queue.orderBy("queued_at", "chunk_id").limit(most).select("chunk_id", "source_id"), "ids")
    held = now.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).collect()  # ``most`` rows at most
    changes: dict[str, list[Change]] = {"vectors": [], "vector_deletions": []}
    for r in held:
        mine = now.where(F.col("source_id") == r["source_id"])
        dead = reconcile.binding(mine, store.read("chunks", r["source_id"]))
        changes["vectors"].append(Change(r["source_id"], delete=dead))
        changes["vector_deletions"].append(Change(r["source_id"], delete=mine))
    if held:
        store.commit(changes, base)
    return sum(r["n"] for r in held)
