"""Substring dedup with prefix-partitioned suffix trees over words.

Every place where a window of ``WINDOW`` words stands is a suffix.  Suffixes are
dealt into groups by prefixes of variable length: a cell of the trie of word
hashes (one, two or three words, and the whole window where three words still
hold too many) belongs to one group, and cells are packed so that a group fits
in a task's memory; tasks grow in number with the groups.  The plan comes from a
histogram of all suffixes over a fixed number of cells.  Within a group the
suffixes are sorted by their window: a run of suffixes that agree on it stands for
an internal node of depth ``WINDOW`` or more, that is, a repeat.  Of its suffixes
those whose document is not the smallest are marked, and words under a marked
window go.

Windows are compared by 80 bits within their group: a 64-bit hash and 16 bits of a
second, independent one, whose other bits deal out cells that are too large.  Of N
windows in groups of G, N * G / 2**81 pairs are expected to agree by chance.

A batch of documents settles its own repeats first and sends a repeat's smallest
document only, so a passage that a third of all documents share arrives in its
group once for each batch.

Nulls, ties and edges: a null text has no words; a text shorter than a window
loses nothing; rows that repeat a doc_id are one document (they do not mark each
other) but keep their own texts, told apart by 64 bits; a row with a null doc_id neither loses words
nor makes others lose any; an empty table gives an empty result; other columns
pass through :func:`drop_repeats` unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import Scratch
from .words import CHUNK_BYTES, chunks, hash_words, mix, rolling, utf8

WINDOW = 13
#: Suffixes of a group at most, where its prefix can be longer.
GROUP_SUFFIXES = 1_000_000
#: Bits of a word's hash in a prefix cell, and words of a prefix cell.
BITS, DEPTH = 5, 3
CELLS = 1 << (BITS * DEPTH)
#: Bytes of text whose repeats are settled before anything is sent.
BATCH_BYTES = 8 << 20


#: Turns word hashes into those of the second window hash.
_SECOND = np.uint64(0x8CB92BA72F3D8DD7)


def _suffixes(texts: list[bytes | None], window: int, second: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """For each chunk: (hash, text, place, prefix cell, second hash) of its suffixes."""
    for first, part in chunks(texts, CHUNK_BYTES):
        words, bounds = hash_words(part, lower=False)
        runs = rolling(words, window)
        doc = np.repeat(np.arange(len(part)), np.diff(bounds))[: len(runs)]
        inside = np.flatnonzero(bounds[doc + 1] - np.arange(len(runs)) >= window)
        cell = np.zeros(len(inside), np.int64)
        for j in range(DEPTH):
            cell = (cell << BITS) | (words[inside + j] >> np.uint64(64 - BITS)).astype(np.int64)
        doc = doc[inside]
        yield runs[inside], doc + first, inside - bounds[doc], cell, rolling(mix(words + _SECOND), window)[inside] if second else None


def _runs(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, head): an order in which equal windows are together, and where in it a window begins."""
    order = np.argsort(hashes)
    for _ in range(2):
        h, c = hashes[order], checks[order]
        same, differ = h[1:] == h[:-1], c[1:] != c[:-1]
        if not (same & differ).any():
            break
        order = np.lexsort((checks, hashes))
    return order, np.concatenate(([True], ~same | differ))


def histogram(docs: DataFrame, window: int = WINDOW) -> np.ndarray:
    """Suffixes in each prefix cell, over all documents; ``CELLS`` numbers whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for _, _, _, cell, _ in _suffixes(utf8(batch.column("text").slice(at, 500)), window, second=False):
                    total += np.bincount(cell, minlength=CELLS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["cell", "n"])

    out = np.zeros(CELLS, np.int64)
    for r in docs.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def deal(cells: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
    """(group, parts) of each cell: prefixes are lengthened until they hold ``target`` suffixes at most, then packed.

    A cell that is too large at full depth is dealt into ``parts`` groups by the windows' second hash.
    """
    group, parts = np.zeros(CELLS, np.int64), np.ones(CELLS, np.int64)
    step, now, held = 1 << BITS, 0, 0

    def place(a: int, b: int, n: int) -> None:
        nonlocal now, held
        if n > target and b - a > 1:
            for c in range(a, b, (b - a) // step):
                place(c, c + (b - a) // step, int(cells[c : c + (b - a) // step].sum()))
            return
        if held and held + n > target:
            now, held = now + 1, 0
        group[a:b] = now
        held += n
        if n > target:
            parts[a] = -(-n // target)
            now, held = now + int(parts[a]), 0

    for c in range(0, CELLS, CELLS // step):
        place(c, c + CELLS // step, int(cells[c : c + CELLS // step].sum()))
    return group, parts


#: Documents and, of each, places: ids and counts are packed by steps, which compress to about a byte.
_PACKED = ("doc_ids", "texts", "counts", "places")
_DEALT = "grp long, " + ", ".join(f"{k} binary" for k in _PACKED)


def _pack(doc_id: np.ndarray, text: np.ndarray, place: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Suffixes, those of a document together and in ascending places, as four binaries."""
    first = np.flatnonzero(np.concatenate(([True], (doc_id[1:] != doc_id[:-1]) | (text[1:] != text[:-1]))))
    steps = np.diff(place, prepend=place[:1])
    steps[first] = place[first]
    parts = np.diff(doc_id[first], prepend=0), text[first].astype("<i8"), np.diff(np.append(first, len(place))).astype("<u4"), steps.astype("<u4")
    return tuple(zstandard.compress(np.ascontiguousarray(x).tobytes(), 1) for x in parts)


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, text, place) of each suffix of a packed row."""
    doc_id, text, counts, steps = (np.frombuffer(zstandard.decompress(row[k]), kind).astype(np.int64) for k, kind in zip(_PACKED, ("<i8", "<i8", "<u4", "<u4"), strict=True))
    run, first = np.cumsum(steps), np.cumsum(counts) - counts
    return np.repeat(np.cumsum(doc_id), counts), np.repeat(text, counts), run - np.repeat(run[first] - steps[first], counts)


def _send(docs: DataFrame, group: np.ndarray, parts: np.ndarray, window: int) -> DataFrame:
    """Rows for the groups: suffixes that their batch could not settle, and marks that it could."""
    groups = int((group + parts).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = utf8(batch.column("text")), 0
            sizes = np.cumsum([len(t or b"") + 1 for t in texts])
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES, side="right")))
                yield from settle(texts[at:end], batch.slice(at, end - at))
                at = end

    def settle(texts: list[bytes | None], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc_id").to_pylist()
        known = np.array([i is not None for i in ids])
        doc_id = np.array([i or 0 for i in ids], dtype=np.int64)
        text = np.array(batch.column("text_hash").to_pylist(), dtype=np.int64)
        # a row without a doc_id has no suffixes
        found = []
        for h, d, p, c, s in _suffixes([t if k else None for t, k in zip(texts, known, strict=True)], window):
            part = ((s & np.uint64(0xFFFFFFFF)) % parts[c].astype(np.uint64)).astype(np.int32)
            found.append((h, d.astype(np.int32), p.astype(np.int32), group[c].astype(np.int32) + part, (s >> np.uint64(48)).astype("<u2")))
        if not found:
            return
        h, d, p, to, check = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        if not len(h):
            return
        order, head = _runs(h, check)
        least = np.minimum.reduceat(doc_id[d[order]], np.flatnonzero(head))
        mine = np.empty(len(h), bool)
        mine[order] = doc_id[d[order]] == least[np.cumsum(head, dtype=np.int32) - 1]
        # marks travel with the suffixes, dealt by document
        to[~mine] = text[d[~mine]] % groups
        order = np.lexsort((d, ~mine, to))  # places ascend within a document: chunks are in order and the sort is stable
        h, check, d, p, to, mine = h[order], check[order], d[order], p[order], to[order], mine[order]
        del order
        cut = np.flatnonzero(np.concatenate(([True], (to[1:] != to[:-1]) | (mine[1:] != mine[:-1]))))
        rows = []
        for a, b in zip(cut, [*cut[1:], len(to)], strict=True):
            rows.append((int(to[a]), *_pack(doc_id[d[a:b]], text[d[a:b]], p[a:b]), *((h[a:b].tobytes(), check[a:b].tobytes()) if mine[a] else (None, None))))
            if len(rows) == 256:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["grp", *_PACKED, "hashes", "checks"])

    return docs.select(F.col("doc_id").cast("long"), "text", text_hash(F.col("text")).alias("text_hash")).mapInArrow(run, _DEALT + ", hashes binary, checks binary")


def _repeats(buckets: int):
    """The work of a group: the suffixes of its repeats whose document is not the smallest, packed for buckets of documents."""

    def subtree(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [_unpack(r) for r in rows]
        ids, texts, places = (np.concatenate(x) for x in zip(*parts, strict=True))
        open_ = np.repeat([r["hashes"] is not None for r in rows], [len(x[0]) for x in parts])
        hashes, checks = (np.concatenate([np.frombuffer(r[k] or b"", kind) for r in rows]) for k, kind in (("hashes", "<u8"), ("checks", "<u2")))
        del rows, parts
        marked, at = ~open_, np.flatnonzero(open_)
        if len(at):
            order, head = _runs(hashes, checks)
            at = at[order]
            least = np.minimum.reduceat(ids[at], np.flatnonzero(head))
            marked[at] = ids[at] > least[np.cumsum(head) - 1]
        return _buckets(ids[marked], texts[marked], places[marked])

    def _buckets(ids: np.ndarray, texts: np.ndarray, places: np.ndarray) -> pa.Table:
        to = texts % buckets
        order = np.lexsort((places, texts, ids, to))
        ids, texts, places, to = ids[order], texts[order], places[order], to[order]
        cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else np.empty(0, np.int64)
        packed = [_pack(ids[a:b], texts[a:b], places[a:b]) for a, b in zip(cut, np.append(cut, len(to))[1:], strict=True)]
        return pa.table([pa.array(to[cut], pa.int64()), *[pa.array([x[k] for x in packed], pa.binary()) for k in range(len(_PACKED))]], names=["grp", *_PACKED])

    return subtree


def _gather(table: pa.Table) -> pa.Table:
    """Marks of a bucket's documents: (doc_id, text_hash, places), a row for each document."""
    ids, texts, places = (np.concatenate(x) for x in zip(*map(_unpack, table.to_pylist()), strict=True))
    order = np.lexsort((texts, ids))
    ids, texts, places = ids[order], texts[order], places[order].astype("<u4")
    cut = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1]))))
    return pa.table({"doc_id": pa.array(ids[cut]), "text_hash": pa.array(texts[cut]), "places": pa.array([places[a:b].tobytes() for a, b in zip(cut, np.append(cut, len(ids))[1:], strict=True)], pa.binary())})


def text_hash(text: Column) -> Column:
    """64 bits that tell the texts of rows with one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def marks(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, places): starts of the windows that a smaller document has too."""
    cells = histogram(docs, window)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    target = max(1, min(GROUP_SUFFIXES, -(-int(cells.sum()) // least)))
    group, parts = deal(cells, target)
    groups = int((group + parts).max())
    # as many tasks as groups: what a task reads does not grow with the documents
    tasks = max(least, groups)
    found = _send(docs, group, parts, window).repartition(tasks, "grp").groupBy("grp").applyInArrow(_repeats(groups), _DEALT)
    saved = scratch.save(found, "marks")
    del found
    scratch.tidy()
    return saved.repartition(tasks, "grp").groupBy("grp").applyInArrow(_gather, "doc_id long, text_hash long, places binary")


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with its text's words joined by one space less those under a marked window, and columns n_words and n_removed (such columns are replaced)."""
    docs = docs.drop("n_words", "n_removed", "_id", "_hash", "_places")
    scratch = Scratch(docs.sparkSession, "substrings")
    per_doc = marks(docs, scratch, window).toDF("_id", "_hash", "_places")
    both = docs.join(per_doc, (docs["doc_id"].cast("long") == per_doc["_id"]) & (text_hash(docs["text"]) == per_doc["_hash"]), "left").select(*docs.columns, "_places")
    out = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                texts, n, gone = [], [], []
                for text, places in zip(utf8(part.column(at)), part.column("_places"), strict=True):
                    words = (text or b"").split()
                    n.append(len(words))
                    blob = places.as_py()
                    if blob:
                        starts = np.frombuffer(blob, "<u4").astype(np.int64)
                        cover = np.zeros(len(words) + window + 1, np.int64)
                        np.add.at(cover, starts, 1)
                        np.add.at(cover, starts + window, -1)
                        keep = np.cumsum(cover)[: len(words)] == 0
                        words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                    gone.append(n[-1] - len(words))
                    texts.append(b" ".join(words).decode())
                cols = list(part.columns[:-1])
                cols[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=out.names)

    return both.mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: words, words removed, and the digest of what is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)
), least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY 1
), covered AS (
  SELECT DISTINCT doc_id, i + j AS pos
  FROM (SELECT doc_id, i FROM win JOIN least USING (k) WHERE m < doc_id), (SELECT unnest(range(0, 13)) AS j)
), word AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w
), kept AS (
  SELECT word.doc_id, word.pos, word.word, covered.pos IS NOT NULL AS gone
  FROM word LEFT JOIN covered ON word.doc_id = covered.doc_id AND word.pos = covered.pos
), per AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM kept GROUP BY 1
)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN per USING (doc_id)
"""
