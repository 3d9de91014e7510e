"""Summary statistics of a graph; single-row or single-level aggregates, combined before their shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, vocab


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    """{column}, n, ordered by n descending, ties by first appearance (ord)."""
    return rows.groupBy(column).agg(F.count("*").alias("n"), F.min("ord").alias("first")).orderBy(F.desc("n"), "first").drop("first")


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("total_relations"), F.count_if("negated").alias("negated_relations"), F.count_if(F.col("confidence") < vocab.LOW_CONFIDENCE).alias("low_confidence_relations"))


def malformed_rate(failed: int, total: int) -> str:
    """Half-even rounding of the exact binary value, as %.1f formats it."""
    return f"{failed}/{total} ({failed / max(total, 1) * 100:.1f}%)"


def summary(entities: DataFrame, edges: DataFrame, conflicts: DataFrame, contradictions: DataFrame, review: DataFrame, total: int, failed: int) -> DataFrame:
    """One row: all figures; counts by type as ordered arrays of structs."""
    spark = edges.sparkSession
    by = lambda rows, c: [tuple(r) for r in counts_by(rows, c).collect()]  # noqa: E731  as many rows as there are types
    e = edge_counts(edges).first()
    merges = [(r["entity_a"], r["entity_b"], round(r["similarity"], 3), r["type_a"], r["type_b"]) for r in review.orderBy("ord", "pos").collect()]
    row = (total, failed, malformed_rate(failed, total), entities.count(), by(entities, "entity_type"), e[0], by(edges, "relation_type"), e[1], e[2], conflicts.count() + contradictions.count(), len(merges), merges)
    pairs = "array<struct<type:string,n:bigint>>"
    return spark.createDataFrame([row], f"total_chunks_processed long, failed_chunks long, malformed_output_rate string, total_entities long, entity_counts_by_type {pairs}, total_relations long, relation_counts_by_type {pairs}, negated_relations long, low_confidence_relations long, total_contradictions long, ambiguous_merges_flagged long, ambiguous_merge_details array<struct<entity_a:string,entity_b:string,similarity:double,type_a:string,type_b:string>>")


def audit_names(notes: DataFrame) -> DataFrame:
    """notes: name, entity_type. Adds leak (pattern or null), descriptive and unknown."""
    return notes.withColumns({"leak": text.leak_pattern(F.col("name")), "descriptive": ~text.is_proper_name(F.col("name")), "unknown": F.col("entity_type") == vocab.UNKNOWN})


def audit_totals(notes: DataFrame) -> DataFrame:
    """One row. A leak is descriptive too and counts twice in total_problems; unknown types don't count."""
    a = audit_names(notes)
    leaks, phrases = F.count("leak"), F.count_if("descriptive")
    return a.agg(F.count("*").alias("notes"), leaks.alias("leaks"), phrases.alias("descriptive"), F.count_if("unknown").alias("unknown"), (leaks + phrases).alias("total_problems"))
