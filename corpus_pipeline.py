"""A corpus pipeline of five operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  :func:`run` writes each stage as Parquet and
reads it again as the next one's input.

Nulls, ties and edges are the operators'; here, near duplicates
are dropped by row: of each component one row stays, with the smallest doc_id
(nulls last), of several such rows one by a hash of the row; a doc_id that
different texts share, or a null one, is placed like any other; texts without
words are linked with nothing and stay; an empty table gives an empty result; columns beyond those of documents are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, jaccard_join, language_id, line_dedup, sentencepiece_codec
from skein.sources.scratch import Scratch
from skein.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; the others go."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    learned = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))).select("text", "lang", F.col("doc_id").alias("key")))
    return language_id.predict(docs, learned).where("accepted").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that many of them share."""
    out = line_dedup.drop_common_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: the smallest (doc_id, row), a null doc_id last."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # equal rows become one, so that the hash of a row is its id
    rows = Scratch(spark, "rows").save(docs.where(worded).distinct().withColumn("_row", F.xxhash64(*COLUMNS)), "rows")
    placed = jaccard_join.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    kept = placed.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(first.alias("f")).select("f._row")
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS).unionByName(docs.where(~worded))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    ship(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.count_leaks(docs.select(*COLUMNS), items).where("n_items = 0").select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and the digest of the text that they decode to."""
    ship(spark)
    return sentencepiece_codec.encode(docs.select(*COLUMNS)).drop("text")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontaminate", decontaminate_benchmark),
    ("sentencepiece", encode_pieces),
]

#: Compression sizes and suffix arrays have no SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.tidy()
    return STAGES[-1][1](spark, docs, sf_dir)
