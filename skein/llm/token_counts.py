"""Token counts of documents in flat, unindexed token files.

:func:`write_files` makes token files: a stream of little-endian token ids with
an end-of-document id after every document, cut into blocks of ``BLOCK`` ids that
ignore where documents end.  :func:`count` knows only these blocks.  It searches
each block for the end-of-document id (one vectorised comparison) and reports
the pieces between; a prefix scan over the blocks of a file gives the number of
documents before each block and the tokens that a document carries over from
earlier blocks.  The scan has two levels, within groups of ``GROUP`` blocks and
over groups, so that one giant file is no single task.

Nulls, ties and edges: a null or empty text has no token, only its end; the
end-of-document string inside a text is ordinary text; long documents run over
any number of blocks; repeated rows and a null doc_id are counted each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import Scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The splitting pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The free id of the vocabulary.
END_OF_DOCUMENT = 50_256
BLOCK = 1 << 16
GROUP = 1 << 12
_loaded: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer, loaded once in each Python worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def tokens(text: str, path: str) -> list[int]:
    """Token ids of a whole text."""
    return encoding(path).encode_ordinary(text)


def write_files(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END_OF_DOCUMENT, block: int = BLOCK) -> DataFrame:
    """Rows of token files, one file for each partition: (file, block, ids) for the flat blocks, and (file, doc_ids) with a null block for the documents in their order."""
    kind = np.dtype("<u2") if end < 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, n, rest, seen = TaskContext.get().partitionId(), 0, np.empty(0, kind), 0

        def row(block: int | None, first: int | None, ids: bytes | None, doc_ids: list | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([first], pa.int64()), pa.array([ids], pa.binary()), pa.array([doc_ids], pa.list_(pa.int64()))], names=["file", "block", "first", "ids", "doc_ids"])

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                held = [rest]
                for t in part.column("text"):
                    ids = tokens(t.as_py() or "", vocabulary)
                    ids.append(end)
                    held.append(np.array(ids, dtype=kind))
                flat = np.concatenate(held)
                whole = len(flat) // block * block
                for a in range(0, whole, block):
                    yield row(n, None, flat[a : a + block].tobytes(), None)
                    n += 1
                rest = flat[whole:]
                yield row(None, seen, None, part.column("doc_id").to_pylist())
                seen += part.num_rows
        if len(rest):
            yield row(n, None, rest.tobytes(), None)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "file long, block long, first long, ids binary, doc_ids array<long>")


def scan(files: DataFrame, end: int = END_OF_DOCUMENT) -> DataFrame:
    """Per block: its ids, its separators, the ids after its last one, and the lengths of the pieces that its separators close."""
    kind = np.dtype("<u2") if end < 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends, tail, pieces = [], [], [], []
            for blob in batch.column("ids"):
                ids = np.frombuffer(blob.as_buffer(), dtype=kind)
                at = np.flatnonzero(ids == end)
                n.append(len(ids)), ends.append(len(at))
                tail.append(len(ids) - 1 - int(at[-1]) if len(at) else len(ids))
                pieces.append(np.diff(at, prepend=-1) - 1)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(ends))), pa.int32()), pa.array(np.concatenate(pieces) if pieces else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(n, pa.int64()), pa.array(ends, pa.int64()), pa.array(tail, pa.int64()), lists], names=["file", "block", "n_ids", "n_ends", "tail", "pieces"])

    return files.select("file", "block", "ids").where("block IS NOT NULL").mapInArrow(run, "file long, block long, n_ids long, n_ends long, tail long, pieces array<long>")


def count(files: DataFrame, end: int = END_OF_DOCUMENT) -> DataFrame:
    """(file, ordinal, n_tokens) of every document of the files."""
    blocks = scan(files, end).withColumn("grp", F.floor(F.col("block") / GROUP))
    inner = Window.partitionBy("file", "grp").orderBy("block")
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    # carried: ids since the last separator within the group; open: no separator came before in the group
    blocks = blocks.withColumns({
        "ends_before": F.coalesce(F.sum("n_ends").over(before), F.lit(0)),
        "ids_before": F.coalesce(F.sum("n_ids").over(before), F.lit(0)),
    })
    blocks = blocks.withColumn("mark", F.when(F.col("n_ends") > 0, F.struct((F.col("ids_before") + F.col("n_ids")).alias("ids_to"), F.col("tail").alias("tail"))))
    blocks = blocks.withColumn("last", F.last("mark", ignorenulls=True).over(before))
    blocks = blocks.withColumns({
        "open": F.col("last").isNull(),
        "carried": F.when(F.col("last").isNull(), F.col("ids_before")).otherwise(F.col("ids_before") - F.col("last.ids_to") + F.col("last.tail")),
    })
    groups = blocks.groupBy("file", "grp").agg(F.sum("n_ends").alias("g_ends"), F.sum("n_ids").alias("g_ids"), F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("block"))).alias("g_mark"))
    outer = Window.partitionBy("file").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumns({
        "g_ends_before": F.coalesce(F.sum("g_ends").over(outer), F.lit(0)),
        "g_ids_before": F.coalesce(F.sum("g_ids").over(outer), F.lit(0)),
    })
    groups = groups.withColumn("g_place", F.when(F.col("g_mark").isNotNull(), F.struct((F.col("g_ids_before") + F.col("g_mark.ids_to")).alias("ids_to"), F.col("g_mark.tail").alias("tail"))))
    groups = groups.withColumn("g_last", F.last("g_place", ignorenulls=True).over(outer))
    groups = groups.select("file", "grp", "g_ends_before", F.when(F.col("g_last").isNull(), F.col("g_ids_before")).otherwise(F.col("g_ids_before") - F.col("g_last.ids_to") + F.col("g_last.tail")).alias("g_carried"))
    stitched = blocks.join(groups, ["file", "grp"])
    carry = F.col("carried") + F.when(F.col("open"), F.col("g_carried")).otherwise(F.lit(0))
    return stitched.select("file", (F.col("g_ends_before") + F.col("ends_before")).alias("first"), carry.alias("carry"), F.posexplode("pieces").alias("pos", "piece")).select(
        "file", (F.col("first") + F.col("pos")).alias("ordinal"), (F.col("piece") + F.when(F.col("pos") == 0, F.col("carry")).otherwise(F.lit(0))).alias("n_tokens")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its number of tokens, found by scanning the token files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = Scratch(spark, "tokens").save(write_files(docs), "files")
    order = files.where("block IS NULL").select("file", "first", F.posexplode("doc_ids").alias("pos", "doc_id")).select("file", (F.col("first") + F.col("pos")).alias("ordinal"), "doc_id")
    return order.join(count(files), ["file", "ordinal"]).select("doc_id", "n_tokens")
