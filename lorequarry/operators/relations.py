"""Relations of the graph: flattening, defaults, end resolution, stubs, properties, de-duplication.

``relations`` frames have ord, pos and the ten fields of an extracted relation; ``meta`` (struct) is
the chunk's. Missing and null fields take the defaults. Ends are resolved by exact normalised
lookup only; an end that nothing defines becomes a stub entity of unknown type, spelt as first
seen (where both ends of one relation spell a new name differently, each keeps its spelling and
later relations take the target's).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vocab

EDGE = ["source_entity", "relation_type", "target_entity", "negated", "confidence", "justification", "source_chunk_id", "source_doc_id", "source_reliability"]
PROVENANCE = {"source_chunk_id": "chunk_id", "source_doc_id": "doc_id", "source_reliability": "source_reliability"}


def relations_of(extractions: DataFrame) -> DataFrame:
    """extractions: ord, relations, chunk_meta. Rows without a source, or without a target where one is due, are left out (see rejects)."""
    flat = extractions.select("ord", F.posexplode("relations").alias("pos", "r"), F.col("chunk_meta").alias("meta"))
    return with_defaults(flat.select("ord", "pos", "r.*", "meta"))


def with_defaults(rows: DataFrame) -> DataFrame:
    out = {"negated": F.coalesce("negated", F.lit(False)), "confidence": F.coalesce("confidence", F.lit(vocab.DEFAULT_CONFIDENCE)), "justification": F.coalesce("justification", F.lit(""))}
    for field, own in PROVENANCE.items():
        out[field] = F.coalesce(field, F.col(f"meta.{own}"), F.lit(""))
    return rows.withColumns(out)


def stamp(relations: DataFrame) -> DataFrame:
    """Provenance of the chunk, over whatever a model has written there."""
    return relations.withColumns({field: F.coalesce(F.col(f"meta.{own}"), F.lit("")) for field, own in PROVENANCE.items()})


def well_formed(relations: DataFrame) -> DataFrame:
    return relations.where((F.col("source_entity").isNotNull()) & F.col("relation_type").isNotNull() & ((F.col("relation_type") == vocab.PROPERTY) | F.col("target_entity").isNotNull()))


def stub_names(relations: DataFrame, canonical: DataFrame) -> DataFrame:
    """norm, spelling, ord, pos: ends that no entity or alias defines, as first seen."""
    source = relations.select(text.norm(F.col("source_entity")).alias("norm"), F.struct("ord", "pos", F.lit(1).alias("side"), F.col("source_entity").alias("name")).alias("seen"))
    target = relations.where(F.col("relation_type") != vocab.PROPERTY).select(text.norm(F.col("target_entity")).alias("norm"), F.struct("ord", "pos", F.lit(0).alias("side"), F.col("target_entity").alias("name")).alias("seen"))
    first = source.unionByName(target).groupBy("norm").agg(F.min("seen").alias("seen"))  # combined before the shuffle
    return first.join(canonical.select("norm"), "norm", "left_anti").select("norm", F.col("seen.name").alias("spelling"), F.col("seen.ord").alias("ord"), F.col("seen.pos").alias("pos"))


def resolve_ends(relations: DataFrame, canonical: DataFrame) -> DataFrame:
    """source_entity and target_entity by their canonical names."""
    stubs = stub_names(relations, canonical)
    ends = canonical.select("norm", F.col("canonical").alias("name"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("int").alias("at_pos"))
    ends = ends.unionByName(stubs.select("norm", F.col("spelling").alias("name"), F.col("ord").cast("long").alias("at"), F.col("pos").cast("int").alias("at_pos")))
    out = relations
    for side in ("source", "target"):
        own = ends.select(*[F.col(c).alias(f"_{side}_{c}") for c in ends.columns])
        out = out.join(own, text.norm(F.col(f"{side}_entity")) == F.col(f"_{side}_norm"), "left")
        here = F.col("ord").eqNullSafe(F.col(f"_{side}_at")) & F.col("pos").eqNullSafe(F.col(f"_{side}_at_pos"))
        keep = here | F.col(f"_{side}_norm").isNull()
        if side == "target":
            keep = keep | (F.col("relation_type") == vocab.PROPERTY)
        out = out.withColumn(f"{side}_entity", F.when(keep, F.col(f"{side}_entity")).otherwise(F.col(f"_{side}_name"))).drop(*own.columns)
    return out


def stub_entities(resolved: DataFrame, entities: DataFrame) -> DataFrame:
    """canonical_name, entity_type, ord, pos, meta: ends of resolved relations without an entity, with the chunk that first names them."""
    ends = resolved.select(F.col("source_entity").alias("canonical_name"), F.struct("ord", "pos", "meta").alias("seen"))
    ends = ends.unionByName(resolved.where(F.col("relation_type") != vocab.PROPERTY).select(F.col("target_entity").alias("canonical_name"), F.struct("ord", "pos", "meta").alias("seen")))
    first = ends.groupBy("canonical_name").agg(F.min_by("seen", F.struct("seen.ord", "seen.pos")).alias("seen"))
    return first.join(entities.select("canonical_name"), "canonical_name", "left_anti").select("canonical_name", F.lit(vocab.UNKNOWN).alias("entity_type"), "seen.ord", "seen.pos", "seen.meta")


def edges(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("relation_type") != vocab.PROPERTY).select("ord", "pos", *EDGE)


def properties(resolved: DataFrame) -> DataFrame:
    value = F.coalesce("property_value", "target_entity", F.lit(""))
    own = resolved.where(F.col("relation_type") == vocab.PROPERTY)
    return own.select("ord", "pos", F.col("source_entity").alias("owner"), value.alias("property_value"), *EDGE[3:])


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Edges that are equal in all nine fields, once, with the order of the first."""
    return edges.groupBy(*EDGE).agg(F.min("ord").alias("ord"))


def in_export_order(edges: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(c, F.lit(""))
    return edges.orderBy(*[empty(c) for c in ("source_entity", "relation_type", "target_entity", "source_doc_id", "source_chunk_id")], "ord")


def inverse_edges(edges: DataFrame) -> DataFrame:
    """The edges and, for relation types that have one, their inverses, marked derived."""
    table = F.create_map(*[F.lit(x) for p in vocab.INVERSES.items() for x in p])
    turned = edges.withColumn("_i", F.try_element_at(table, F.col("relation_type"))).where("_i is not null")
    turned = turned.withColumns({"source_entity": F.col("target_entity"), "target_entity": F.col("source_entity"), "relation_type": F.col("_i"), "derived": F.lit(True)}).drop("_i")
    return edges.withColumn("derived", F.lit(False)).unionByName(turned)


def pair_key() -> list:
    return [text.norm(F.col("source_entity")).alias("source"), text.norm(F.col("target_entity")).alias("target")]


def negation_conflicts(edges: DataFrame) -> DataFrame:
    """owner, source, target, relation_type, affirmed_by, negated_by (document ids in order, repeats kept), description."""
    groups = edges.select(F.col("source_entity").alias("owner"), *pair_key(), "relation_type", "negated", "source_doc_id", "ord", "pos")
    # only groups with both kinds are gathered; the first pass is combined before its shuffle
    key = ["owner", "source", "target", "relation_type"]
    both = groups.groupBy(*key).agg(F.bool_or("negated").alias("n"), F.bool_or(~F.col("negated")).alias("a")).where("n and a").select(*key)
    ids = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", "pos", "source_doc_id")))), lambda s: s["source_doc_id"])
    out = groups.join(both, key).groupBy(*key).agg(F.array_join(ids(~F.col("negated")), ", ").alias("affirmed_by"), F.array_join(ids(F.col("negated")), ", ").alias("negated_by"))
    said = F.concat(F.lit("NEGATION CONFLICT on '"), "relation_type", F.lit("' between "), "source", F.lit(" and "), "target", F.lit(": affirmed by ["), "affirmed_by", F.lit("] vs negated by ["), "negated_by", F.lit("]"))
    return out.withColumn("description", said)


def contradictory_types(edges: DataFrame) -> DataFrame:
    """owner, source, target, types, involved: affirmed types of a pair that exclude each other."""
    rows = edges.where(~F.col("negated")).select(F.col("source_entity").alias("owner"), *pair_key(), "relation_type", "source_doc_id", "source_reliability", "ord", "pos")
    sets = F.array(*[F.array(*map(F.lit, s)) for s in vocab.CONTRADICTORY])
    rows = rows.select("*", F.explode(F.filter(sets, lambda s: F.array_contains(s, F.col("relation_type")))).alias("types"))
    key = ["owner", "source", "target", "types"]
    both = rows.groupBy(*key).agg(F.size(F.collect_set("relation_type")).alias("k")).where("k >= 2").select(*key)
    said = F.concat(F.lit("'"), "relation_type", F.lit("' from "), "source_doc_id", F.lit(" (reliability: "), "source_reliability", F.lit(")"))
    out = rows.join(both, key).groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "pos", said.alias("said")))), lambda s: s["said"]), "; ").alias("involved"))
    types = F.array_join("types", ", ")
    description = F.concat(F.lit("CONTRADICTORY RELATIONS {"), types, F.lit("} between "), "source", F.lit(" and "), "target", F.lit(": "), "involved")
    return out.select("owner", "source", "target", types.alias("types"), "involved", description.alias("description"))


def note_lines(edges: DataFrame) -> DataFrame:
    """Relations as a note shows them: a line for each (source, target, type, negated), the first
    row's fields, the justifications of later rows appended."""
    key = ["source_entity", "target_entity", "relation_type", "negated"]
    rows = F.array_sort(F.collect_list(F.struct("ord", "pos", "justification", "source_doc_id", "confidence", "source_reliability")))
    out = edges.groupBy(*key).agg(rows.alias("rows"))
    first = F.get("rows", F.lit(0))
    more = F.transform(F.slice("rows", 2, F.size("rows")), lambda r: F.concat(F.lit('; also: "'), r["justification"], F.lit('" ['), r["source_doc_id"], F.lit("]")))
    out = out.select(*key, F.size("rows").alias("sources"), first["ord"].alias("ord"), first["confidence"].alias("confidence"), first["source_doc_id"].alias("doc"), first["source_reliability"].alias("reliability"),
                     F.concat(first["justification"], F.array_join(more, "")).alias("justification"))
    return out.withColumn("line", F.concat(F.lit("- [["), "target_entity", F.lit("]] (`"), "relation_type", F.lit("`)"), tags(), F.lit(' — "'), "justification", F.lit('" [source: '), "doc", F.lit(", reliability: "), "reliability", F.lit("]")))


def tags():
    return F.concat(F.when(F.col("negated"), " **[NEGATED]**").otherwise(""), F.when(F.col("confidence") < vocab.LOW_CONFIDENCE, " `[low confidence]`").otherwise(""))


def property_lines(properties: DataFrame) -> DataFrame:
    rows = properties.withColumn("_v", text.strip(F.col("property_value"))).where("_v <> ''")
    all_ = F.array_sort(F.collect_list(F.struct("ord", "pos", "justification", "source_doc_id", "confidence", "source_reliability", "property_value")))
    out = rows.groupBy("owner", "_v", "negated").agg(all_.alias("rows"))
    first = F.get("rows", F.lit(0))
    more = F.transform(F.slice("rows", 2, F.size("rows")), lambda r: F.concat(F.lit('; also: "'), r["justification"], F.lit('" ['), r["source_doc_id"], F.lit("]")))
    out = out.select("owner", first["property_value"].alias("property_value"), "negated", F.size("rows").alias("sources"), first["ord"].alias("ord"), first["confidence"].alias("confidence"), first["source_doc_id"].alias("doc"),
                     first["source_reliability"].alias("reliability"), F.concat(first["justification"], F.array_join(more, "")).alias("justification"))
    return out.withColumn("line", F.concat(F.lit("- "), "property_value", tags(), F.lit(' — "'), "justification", F.lit('" [source: '), "doc", F.lit(", reliability: "), "reliability", F.lit("]")))


def first_mentions(mentions: DataFrame) -> DataFrame:
    """A mention for each (entity, document, chunk), the first."""
    own = Window.partitionBy("canonical_name", "meta.doc_id", "meta.chunk_id").orderBy("ord", "pos")
    return mentions.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
