"""Named queries over the driver's tables, one or more for each operator family, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vocab
from ..operators import answer, relations, resolve, retrieve, sample, stats, validate
from ..operators import notes as notes_
from ..sources import files, records
from ..storage import materialize, table
from . import adapters as A


def q_doc_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pages(spark, sf_dir).select("doc_id", "doc_type", "source_reliability", text.extension(F.col("path")).alias("extension"))


def q_norm_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = A.event_relations(spark, sf_dir).select(text.norm(F.col("source_entity")).alias("norm"))
    return names.groupBy("norm").agg(F.count("*").alias("n"))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    forms = F.array("p_name", F.upper("p_name"), F.concat(F.upper(F.left("p_name", F.lit(1))), F.substr("p_name", F.lit(2))), F.concat(F.lit("One of the "), "p_name"), F.concat(F.lit("Part that is "), "p_name", F.lit(" of "), "p_brand"))
    return p.select(F.explode(forms).alias("name")).distinct()


def q_proper_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = part_names(spark, sf_dir)
    return n.select("name", text.is_proper_name(F.col("name")).alias("proper"), text.leak_pattern(F.col("name")).alias("leak"))


def q_chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.chunks(A.pages(spark, sf_dir)).select("chunk_id", "doc_id", "chunk_index", F.length("chunk_text").alias("n_chars"), F.md5(F.col("chunk_text").cast("binary")).alias("text_md5"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("""case event_id % 8
        when 0 then concat('{"entities": [{"name": "User ', user_id, '"}], "relations": [], "extra": 1}')
        when 1 then concat('{"entities": [{"name": "User ', user_id, '", "aliases": ["u"]}], "relations": [{"source_entity": "User ', user_id, '", "relation_type": "leads", "target_entity": "Group"}], "chunk_meta": {"chunk_id": "e', event_id, '", "page_number": ""}}')
        when 2 then concat('broken ', event_id) when 3 then '[1, 2]' when 4 then '{"entities": []}' when 5 then '{"entities": {}, "relations": []}'
        when 6 then '   ' else '{"entities": [{"aliases": []}], "relations": []}' end""")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), line.alias("line")).where(text.strip(F.col("line")) != "")


def q_valid_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = records.parse_extractions(event_lines(spark, sf_dir))
    good = good.select("ord", F.lit(True).alias("valid"), F.size("entities").alias("entities"), F.size("relations").alias("relations"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(bad.select("ord", F.lit(False).alias("valid"), F.lit(None).cast("int").alias("entities"), F.lit(None).cast("int").alias("relations"), "error"))


def event_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extraction per event: two entities and a relation, with one flaw in some of them."""
    user = "concat('User ', user_id)"
    kind = "case when event_id % 9 = 1 then 'Planet' else 'Character' end"
    target = "case when event_id % 9 = 2 then 'somewhere' when event_id % 9 = 3 then 'Elsewhere' when event_id % 9 = 8 then 'gv' else concat('Group ', event_type) end"
    rel = "case when event_id % 9 = 4 then 'likes' when event_id % 9 = 6 then 'has_property' else 'member_of' end"
    conf = "case when event_id % 9 = 5 then 1.5D when event_id % 9 = 7 then cast(null as double) else 0.5D end"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"),
        F.expr(f"array(named_struct('name', {user}, 'entity_type', {kind}, 'aliases', cast(array() as array<string>)), named_struct('name', concat('Group ', event_type), 'entity_type', 'Faction', 'aliases', array('gv')))").alias("entities"),
        F.expr(f"array(named_struct('source_entity', {user}, 'relation_type', {rel}, 'target_entity', {target}, 'property_value', cast(null as string), 'negated', false, 'confidence', {conf}, 'justification', 'x', 'source_chunk_id', '', 'source_doc_id', '', 'source_reliability', ''))").alias("relations"),
    )


def q_validate_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.with_error(event_extractions(spark, sf_dir)).select("ord", "error")


def q_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.pages(spark, sf_dir).select("doc_id", "doc_type")
    return sample.stratified(rows, per_type=3, least=15, id_col="doc_id")


def q_indel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar part names; the ratio by native folds, over the pairs that the bigram index gives."""
    names = table(spark, sf_dir, "part").select(text.norm(F.col("p_name")).alias("norm")).distinct()
    pairs = resolve.similar_names(names, 60)
    return pairs.select("a", "b", text.indel_ratio(F.col("a"), F.col("b")).alias("ratio"))


def resolved_parts(spark: SparkSession, sf_dir: str) -> resolve.Resolved:
    return resolve.resolve(A.part_mentions(spark, sf_dir))


def q_entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolved_parts(spark, sf_dir)
    n = r.mentions.groupBy("canonical_name").agg(F.count("*").alias("mentions"))
    return r.entities.join(n, "canonical_name").select("canonical_name", "entity_type", F.array_join(F.array_sort("aliases"), "|").alias("aliases"), "mentions")


def q_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved_parts(spark, sf_dir).review.select("entity_a", "entity_b", F.round("similarity", 3).alias("similarity"), "type_a", "type_b", "ord")


def resolved_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.resolve_ends(A.event_relations(spark, sf_dir), A.event_canonical(spark, sf_dir))


def q_resolve_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved_events(spark, sf_dir).select("ord", "source_entity", "relation_type", "target_entity", "negated", "confidence", "justification", "source_chunk_id", "source_doc_id", "source_reliability")


def q_stub_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = A.event_canonical(spark, sf_dir).select(F.col("canonical").alias("canonical_name"))
    return relations.stub_entities(resolved_events(spark, sf_dir), known).select("canonical_name", "entity_type", "ord", F.col("meta.chunk_id").alias("chunk_id"))


def q_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.properties(resolved_events(spark, sf_dir)).select("ord", "owner", "property_value", "negated", "confidence", "source_doc_id")


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.edges(resolved_events(spark, sf_dir))


def q_dedup_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges without their chunk, once each."""
    e = event_edges(spark, sf_dir).withColumn("source_chunk_id", F.lit("")).withColumn("confidence", F.lit(0.5))
    return relations.distinct_edges(e).drop("source_chunk_id", "confidence")


def q_negation_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.negation_conflicts(event_edges(spark, sf_dir))


def q_contradictory_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.contradictory_types(event_edges(spark, sf_dir))


def q_relation_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counts_by(event_edges(spark, sf_dir), "relation_type")


def q_entity_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = A.event_canonical(spark, sf_dir).select(F.col("canonical").alias("canonical_name"), F.when(F.startswith("canonical", F.lit("User")), "Character").otherwise("Faction").alias("entity_type"), F.lit(-1).cast("long").alias("ord"))
    stubs = relations.stub_entities(resolved_events(spark, sf_dir), known).select("canonical_name", "entity_type", "ord")
    return stats.counts_by(known.unionByName(stubs), "entity_type")


def q_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.edge_counts(event_edges(spark, sf_dir))


def q_note_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.note_lines(event_edges(spark, sf_dir)).select("source_entity", "target_entity", "relation_type", "negated", "sources", "line")


def q_property_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.property_lines(relations.properties(resolved_events(spark, sf_dir))).select("owner", "property_value", "negated", "sources", "line")


def q_first_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.event_relations(spark, sf_dir).select(text.norm(F.col("source_entity")).alias("canonical_name"), "ord", "pos", F.struct(F.lit("").alias("chunk_id"), F.col("target_entity").alias("doc_id")).alias("meta"))
    return relations.first_mentions(m).select("canonical_name", F.col("meta.doc_id").alias("doc_id"), "ord")


def q_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = materialize(resolved_events(spark, sf_dir), "resolved")
    edges, props = relations.edges(res), relations.properties(res)
    known = A.event_canonical(spark, sf_dir).select(F.col("canonical").alias("canonical_name"), F.lit("Character").alias("entity_type"))
    stubs = relations.stub_entities(res, known).select("canonical_name", "entity_type")
    entities = known.unionByName(stubs).withColumn("aliases", F.array(F.lower("canonical_name")))
    mentions = res.select(F.col("source_entity").alias("canonical_name"), "ord", "pos", "meta")
    out = notes_.notes(entities, edges, props, relations.negation_conflicts(edges), relations.contradictory_types(edges), mentions)
    return out.select("filename", F.md5(F.col("body").cast("binary")).alias("body_md5"), F.length("body").alias("n_chars"), "clash")


def q_name_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.audit_totals(part_names(spark, sf_dir).withColumn("entity_type", F.when(F.length("name") % 2 == 0, vocab.UNKNOWN).otherwise("Component")))


def q_pending_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = A.pages(spark, sf_dir).select("doc_id", "source_reliability")
    return sample.pending(ids, ids.where("source_reliability = 'low'").select("doc_id"), "doc_id")


def q_display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, citations, file names and excerpts."""
    r = A.event_relations(spark, sf_dir)
    page = F.when(F.col("ord") % 2 == 0, F.col("meta.page_number"))
    return r.select("ord", text.relation_label(F.col("relation_type")).alias("label"), text.citation(F.col("source_doc_id"), page, F.col("source_chunk_id")).alias("citation"), text.filename(F.concat("source_entity", F.lit("/"), "target_entity", F.lit("?. "))).alias("filename"), text.excerpt(F.col("target_entity"), 8).alias("excerpt"))


def q_seed_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.seeds(A.region_questions(spark, sf_dir), A.place_entities(spark, sf_dir), 100).select("qid", "canonical_name", "ratio")


def q_multi_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = A.region_questions(spark, sf_dir).join(table(spark, sf_dir, "region"), F.col("qid") == F.col("r_regionkey")).select("qid", F.col("r_name").alias("node"))
    visited, _ = retrieve.traverse(starts, A.place_edges(spark, sf_dir), 2)
    return visited.select("qid", "node", "hop", F.array_join("nodes", ">").alias("path"))


def q_evidence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = A.place_edges(spark, sf_dir)
    starts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("qid"), F.col("n_name").alias("node"))
    _, touched = retrieve.traverse(starts, edges, 1)
    kept = retrieve.top(touched, retrieve.edge_order(), 40)
    return retrieve.evidence_of(kept, A.place_chunks(edges), 10).select("qid", F.col("rank").cast("long").alias("rank"), "chunk_id", "doc_id", "chunk_text")


def q_fallback_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = materialize(A.place_edges(spark, sf_dir), "edges")
    out = answer.answer_questions(A.region_questions(spark, sf_dir), A.place_entities(spark, sf_dir), edges, A.place_chunks(edges), max_hops=1, fuzzy_threshold=100)
    return out.select("qid", "question", "answer", F.array_join("used_chunk_ids", ",").alias("used_chunk_ids"), "grounded", "fallback_used")


def q_inverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.inverse_edges(event_edges(spark, sf_dir)).select("ord", "source_entity", "relation_type", "target_entity", "negated", "derived")


def kept_events(edges: DataFrame) -> DataFrame:
    """A question for each source entity, which keeps its first edges."""
    return retrieve.top(edges.withColumn("qid", F.col("source_entity")), ["ord"], 40)


def q_kept_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = materialize(event_edges(spark, sf_dir), "edges")
    return retrieve.conflicts_of(kept_events(edges), edges).select("qid", "ord", "relation_type", "target_entity", "negated")


def q_disputed_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by rule with disputed findings, relations whose evidence is beyond the cap or lacks, and questions without any."""
    edges = materialize(event_edges(spark, sf_dir), "edges")
    kept = materialize(kept_events(edges).withColumn("hop", F.lit(1)), "kept")
    chunks = edges.where("ord % 3 <> 0 and source_entity not like '%7'").select(
        F.col("source_chunk_id").alias("chunk_id"), F.col("source_doc_id").alias("doc_id"), F.when(F.col("ord") % 2 == 0, F.col("ord") % 7).cast("int").alias("page_number"), "source_reliability", F.lit(None).cast("string").alias("source_path"), F.lit("").alias("chunk_text"))
    evidence = retrieve.evidence_of(kept, chunks, 10)
    fields = ["source_entity", "relation_type", "target_entity", "source_chunk_id"]
    cited = ["chunk_id", "doc_id", "page_number", "source_reliability", "source_path"]
    listed = lambda rows, fields, name: rows.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("row")))), lambda s: s["row"]).alias(name))
    found = listed(kept, fields, "relations")
    for rows, of, name in ((retrieve.conflicts_of(kept, edges), fields, "conflicts"), (evidence, cited, "evidence")):
        found = found.join(listed(rows, of, name), "qid", "left")
        found = found.withColumn(name, F.coalesce(name, F.array().cast(found.schema[name].dataType)))
    out = answer.by_rule(found.withColumn("warnings", F.array().cast("array<string>")))
    places = F.transform("citations", lambda c: F.concat_ws("/", c["chunk_id"], c["doc_id"], c["source_reliability"], c["page_number"].cast("string")))
    return out.select("qid", "answer", F.array_join("used_chunk_ids", ",").alias("used_chunk_ids"), F.array_join(places, ",").alias("citations"), "grounded")


QUERIES = (
    q_doc_metadata, q_norm_names, q_proper_name, q_chunk_windows, q_valid_extractions, q_validate_extractions, q_stratified_sample, q_indel_pairs,
    q_entity_resolution, q_review_queue, q_resolve_relations, q_stub_entities, q_properties, q_dedup_relations, q_negation_conflicts, q_contradictory_types,
    q_relation_type_counts, q_entity_type_counts, q_graph_stats, q_note_rollup, q_property_rollup, q_first_mentions, q_notes, q_name_audit, q_pending_chunks,
    q_display_text, q_seed_link, q_multi_hop, q_evidence_topk, q_fallback_answer,
    q_inverse_edges, q_kept_conflicts, q_disputed_answer,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
