"""Authorization as relational operators: consent, active generations, path scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import EXCLUDE, INCLUDE, selected


def eligibility(sources: DataFrame, consent: str) -> DataFrame:
    """Sources with why_not: null where they may be searched, else the first of disabled, cleanup, consent, unsafe that holds."""
    why = (
        F.when(~F.col("enabled"), "disabled")
        .when(F.col("scope_cleanup_pending"), "cleanup")
        .when(F.col("consent_identity") != consent, "consent")
        .when(~F.col("root_safe"), "unsafe")
    )
    return sources.withColumn("why_not", why)


def eligible(sources: DataFrame, consent: str) -> DataFrame:
    return eligibility(sources, consent).where("why_not IS NULL").drop("why_not")


def active_chunks(chunks: DataFrame, files: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks of each file's active generation, of enabled sources, with source_id and relative_path."""
    live = files.select(F.col("id").alias("source_file_id"), F.col("active_generation").alias("generation"), "source_id", "relative_path")
    on = sources.where("enabled").select(F.col("id").alias("source_id"))
    return chunks.join(live, ["source_file_id", "generation"]).join(on, "source_id", "left_semi")


def in_scope(sources: DataFrame, source: Column, path: Column) -> Column:
    """The path is in the scope of its source: of the source's own patterns, or the default ones where it has none.

    Sources are few: their patterns come to the driver, and sources of equal patterns share an expression.
    """
    by: dict[tuple, list[str]] = {}
    for r in sources.select("id", "include_patterns", "exclude_patterns").collect():
        scope = INCLUDE if r["include_patterns"] is None else r["include_patterns"], EXCLUDE if r["exclude_patterns"] is None else r["exclude_patterns"]
        by.setdefault(tuple(map(tuple, scope)), []).append(r["id"])
    out = F.lit(False)
    for (include, exclude), ids in by.items():
        out = out | (source.isin(ids) & selected(path, include, exclude))
    return out


def authorized(chunks: DataFrame, eligible_sources: DataFrame) -> DataFrame:
    """Active chunks of eligible sources whose path is in their source's scope."""
    return chunks.where(in_scope(eligible_sources, F.col("source_id"), F.col("relative_path")))


def in_order(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks of (pos, chunk_id), first occurrences, in that order."""
    wanted = ids.groupBy("chunk_id").agg(F.min("pos").alias("pos"))
    return chunks.join(wanted, "chunk_id").orderBy("pos")


def unknown(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Ids asked for that are not known."""
    return asked.join(known, "id", "left_anti")
