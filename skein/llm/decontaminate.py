"""Benchmark decontamination: which documents contain a test item.

An item is found in a document when at least ``THRESHOLD`` of its distinct
five-word shingles are there (A-Z lower-cased).  Items are dealt into partitions
by their number of shingles; each partition has a MinHash sketch size of its
own: the ``k`` smallest shingle hashes of an item, where k is one more than the
shingles that a match may lack.  By the pigeonhole principle a document that
contains the item has at least one of those k, so the search loses nothing,
however short the item and however long the document.  (Banded MinHash over a
whole document's signature was the other choice; for a 40-word item in a
20,000-word document the Jaccard similarity is near 0.001 and it would miss.)
A document is searched against the partitions that it is large enough for, and
each candidate is verified on the words themselves.

Items are sent to the executors in blocks of ``BLOCK_BYTES`` bytes of text (an
item above that stands alone), and the documents are scanned once for each block:
what is broadcast, the items' texts and their sketches, is bounded whatever the
size of the benchmark and whatever its words are separated by.  Exact shingles are
made for candidates only, and a document is run through without keeping its own.
Nothing is shuffled.

Nulls, ties and edges: a null or empty text holds nothing; an item without words
matches nothing; items of 1 to 4 words are matched as one run of that many
words, against documents of at least that many; repeated items match
separately; rows with a null or repeated doc_id are reported like others; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import sparing
from .words import chunks, hash_words, rolling, utf8

SHINGLE = 5
THRESHOLD = 0.8
#: Bytes of items that are sent at once.
BLOCK_BYTES = 8 << 20


def word_list(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def shingles(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


@dataclass
class Block:
    """Items of one broadcast: their texts, and for each width and size partition the sketches."""

    ids: list[int | None]
    texts: list[bytes]
    width: list[int]
    #: (width, least shingles of a document, sorted hashes, item of each)
    sketches: list[tuple[int, int, np.ndarray, np.ndarray]]


def make_block(items: list[tuple[int | None, bytes]], threshold: float) -> Block:
    kept, width = [], []
    parts: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, t in items:
        hashes, _ = hash_words([t], lower=True)
        if not len(hashes):
            continue
        n, k = len(kept), min(SHINGLE, len(hashes))
        kept.append((i, t)), width.append(k)
        low = np.unique(rolling(hashes, k))
        size = len(low)
        sketch = size - math.ceil(threshold * size - 1e-9) + 1
        parts.setdefault((k, size.bit_length()), []).extend((int(h), n) for h in low[:sketch])
    sketches = []
    for (k, bits), pairs in sorted(parts.items()):
        pairs.sort()
        least = math.ceil(threshold * (1 << (bits - 1)) - 1e-9)
        sketches.append((k, least, np.array([h for h, _ in pairs], dtype=np.uint64), np.array([n for _, n in pairs])))
    return Block([i for i, _ in kept], [t for _, t in kept], width, sketches)


def search(texts: list[bytes | None], block: Block, threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """(index of the text, index of the item, shingles found, shingles of the item)."""
    for first, part in chunks(texts):
        words, bounds = hash_words(part, lower=True)
        found: set[tuple[int, int]] = set()
        runs = {k: rolling(words, k) for k in {s[0] for s in block.sketches}}
        for k, least, hashes, item in block.sketches:
            run = runs[k]
            if not len(run):
                continue
            at = np.searchsorted(hashes, run)
            at[at == len(hashes)] = 0
            for place in np.flatnonzero(hashes[at] == run):
                doc = int(np.searchsorted(bounds, place, side="right")) - 1
                room = bounds[doc + 1] - place
                if room < k or bounds[doc + 1] - bounds[doc] - k + 1 < least:
                    continue
                j = int(at[place])
                while j < len(hashes) and hashes[j] == run[place]:
                    found.add((doc, int(item[j])))
                    j += 1
        for doc, some in groupby(sorted(found), key=lambda x: x[0]):
            items = {n: shingles(word_list(block.texts[n]), block.width[n]) for _, n in some}
            words_, wanted, seen = word_list(part[doc]), set().union(*items.values()), set()
            for k in {block.width[n] for n in items}:
                seen.update(t for t in zip(*(words_[j:] for j in range(k)), strict=False) if t in wanted)
            for n, exact in items.items():
                both = len(exact & seen)
                if both >= threshold * len(exact) - 1e-9:
                    yield first + doc, n, both, len(exact)


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in bounded blocks, read one partition at a time."""
    held, n = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        text = (r["text"] or "").encode()
        if held and n + len(text) >= BLOCK_BYTES:
            yield held
            held, n = [], 0
        held.append((r["item_id"], text))
        n += len(text) + 1
    if held:
        yield held


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("n_common", T.LongType()), T.StructField("n_item", T.LongType()), T.StructField("containment", T.DoubleType())])


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_common, n_item, containment) of each item found in each document row."""
    spark, out = docs.sparkSession, None
    for items in blocks(benchmark):
        sent = spark.sparkContext.broadcast(make_block(items, threshold))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[d], block.ids[n], both, size, both / size) for d, n, both, size in search(utf8(batch.column("text")), block, threshold)]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in rows], schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_common", pa.int64()), ("n_item", pa.int64()), ("containment", pa.float64())]))

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sparing(run), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def count_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with n_items, the number of items found in each row; a column of that name is replaced."""
    spark, out = docs.sparkSession, docs.drop("n_items").withColumn("n_items", F.lit(0).cast("long"))
    for items in blocks(benchmark):
        sent = spark.sparkContext.broadcast(make_block(items, threshold))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in batches:
                n = np.array(batch.column("n_items").to_numpy())
                for d, *_ in search(utf8(batch.column(batch.schema.get_field_index("text"))), block, threshold):
                    n[d] += 1
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=batch.schema.names)

        out = out.mapInArrow(sparing(run), out.schema)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it contains."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM benchmark
), bs AS (
  SELECT DISTINCT item_id, least(5, len(words)) AS k, array_to_string(words[i:i + least(5, len(words)) - 1], ' ') AS s
  FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM b WHERE len(words) > 0)
), size AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY 1
), ds AS (
  SELECT DISTINCT doc_id, k, array_to_string(words[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM bs) WHERE len(words) >= k)
)
SELECT doc_id, item_id, count(*)::BIGINT AS n_common, any_value(n_item)::BIGINT AS n_item, count(*) / any_value(n_item)::DOUBLE AS containment
FROM ds JOIN bs USING (k, s) JOIN size USING (item_id)
GROUP BY 1, 2 HAVING count(*) >= 0.8 * any_value(n_item)
"""
