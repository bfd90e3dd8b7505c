"""Explicit schemas of the model's tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 9

_DDL = {
    "knowledge_tables": "table_id string, content_type string, vector_table string, schema_version int, enabled boolean, created_at timestamp, updated_at timestamp",
    "retrieval_profiles": "profile_id string, table_id string, embedding_identity string, rerank_identity string, tokenizer_version string, chunker_version string, retrieval_limits map<string,int>, created_at timestamp, updated_at timestamp",
    "sources": "id string, display_name string, absolute_path string, enabled boolean, auto_sync boolean, include_patterns array<string>, exclude_patterns array<string>, consent_identity string, status string, scope_cleanup_pending boolean, last_scan_at timestamp, last_success_at timestamp, last_error string",
    "source_files": "id long, source_id string, relative_path string, mtime_ns long, size long, sha256 string, status string, missing_count int, active_generation long, pending_generation long, last_error string, rechunk_required boolean",
    "chunks": "chunk_id string, source_file_id long, generation long, ordinal int, text string, heading_path string, title string, filename string, content_hash string, embedding_input_hash string, start_line int, end_line int",
    "vectors": "chunk_id string, source_id string, source_file_id long, embedding_input_hash string, embedding_space_id string, generation long, vector array<float>",
    "sync_jobs": "id long, source_id string, requested_at timestamp, started_at timestamp, finished_at timestamp, status string, reason string, error string",
    "sync_runs": "id long, source_id string, started_at timestamp, finished_at timestamp, status string, scanned_files long, indexed_files long, reused_vectors long, embedded_vectors long, missing_files long, error string",
    "postings": "term string, chunk_id string, field string, pos int, n_terms long",
    "chunk_lengths": "chunk_id string, n_terms long",
    "vector_deletions": "chunk_id string, source_id string, scope_cleanup boolean, queued_at timestamp",
}
#: Vectors that a rebuild has made so far.
_DDL["rebuilt_vectors"] = _DDL["vectors"]


def schema(name: str) -> T.StructType:
    """The schema of a table of the model."""
    return T.StructType.fromDDL(_DDL[name])


def assert_schema(df: DataFrame, name: str) -> DataFrame:
    """``df``, if its columns have the names and types of a table."""
    want = [(f.name, f.dataType.simpleString()) for f in schema(name)]
    if df.dtypes != want:
        raise ValueError(f"{name}: expected {want}, found {df.dtypes}")
    return df


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` in a table's columns; those that an older layout lacks are null."""
    return df.select(*[(df[f.name] if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)])
