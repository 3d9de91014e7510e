"""From extractions to the graph's tables, notes and statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import export, notes, relations, resolve, stats
from ..sources.records import read_extractions
from ..storage import materialize


@dataclass
class Graph:
    entities: DataFrame  # canonical_name, entity_type, aliases, ord, pos; stubs included
    edges: DataFrame
    properties: DataFrame
    conflicts: DataFrame
    contradictions: DataFrame
    review: DataFrame
    mentions: DataFrame  # canonical_name, ord, pos, meta


def build(extractions: DataFrame) -> Graph:
    """extractions: ord, entities, relations, chunk_meta."""
    found = resolve.resolve(resolve.mentions_of(extractions))
    raw = relations.well_formed(relations.relations_of(extractions))
    resolved = materialize(relations.resolve_ends(raw, found.canonical), "resolved")
    stubs = relations.stub_entities(resolved, found.entities)
    # stubs come after all mentioned entities
    entities = found.entities.withColumn("late", F.lit(0)).unionByName(stubs.select("canonical_name", "entity_type", F.array().cast("array<string>").alias("aliases"), "ord", "pos", F.lit(1).alias("late")))
    edges = relations.edges(resolved)
    mentions = found.mentions.unionByName(stubs.select("canonical_name", "ord", "pos", "meta"))
    return Graph(materialize(entities, "entities"), edges, relations.properties(resolved), relations.negation_conflicts(edges), relations.contradictory_types(edges), found.review, mentions)


def note_rows(g: Graph) -> DataFrame:
    return notes.notes(g.entities.select("canonical_name", "entity_type", "aliases"), g.edges, g.properties, g.conflicts, g.contradictions, g.mentions)


def rebuild(spark: SparkSession, source: str, graph: str, vault: str | None = None, statistics: str | None = None) -> dict:
    """Offline rebuild from a file of extraction lines. Returns counts; raises as read_extractions does."""
    good, bad = read_extractions(spark, source)
    good = materialize(good, "extractions")
    valid, malformed = good.count(), bad.count()
    g = build(good)
    out = export.write_tables(g.entities, g.edges, graph) | {"valid_records": valid, "malformed_records": malformed}
    out["contradictions"] = g.conflicts.count() + g.contradictions.count()
    if vault:
        out["notes"] = notes.write_notes(note_rows(g), vault)
    if statistics:
        row = stats.summary(g.entities.withColumn("ord", F.col("late") * (1 << 60) + F.col("ord")), g.edges, g.conflicts, g.contradictions, g.review, valid + malformed, malformed)
        row.write.mode("overwrite").json(statistics)
    return out
