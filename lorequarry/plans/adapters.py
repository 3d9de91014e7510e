"""The driver's tables as documents, chunks, mentions and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.relations import with_defaults
from ..storage import table

META = "named_struct('chunk_id', {chunk}, 'doc_id', {doc}, 'source_reliability', {level}, 'page_number', {page})"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text and the row's id: documents under folders that name their kind."""
    return table(spark, sf_dir, "documents").select("doc_id", F.expr("concat_ws('/', element_at(array('codex', 'wiki', 'novel', 'ephemera', 'misc'), cast(doc_id % 5 + 1 as int)), source, concat(doc_id, '.txt'))").alias("path"), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    kind = text.doc_type(F.col("path"))
    return d.select(text.doc_id(F.col("path")).alias("doc_id"), kind.alias("doc_type"), text.reliability_of(kind).alias("source_reliability"), F.lit(1).alias("page_number"), "text", "path", F.lit("native_text").alias("extraction_method"))


def event_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as extracted relations: users of three spellings, to groups and teams; one in ten has null fields."""
    e = table(spark, sf_dir, "events").where("event_id is not null")
    rows = e.select(
        F.col("event_id").alias("ord"), F.lit(0).alias("pos"),
        F.expr("case event_id % 3 when 0 then concat('User ', user_id) when 1 then concat(' user ', user_id, ' ') else concat('USER ', user_id) end").alias("source_entity"),
        F.expr("element_at(array('allied_with', 'enemy_of', 'reports_to', 'leads', 'member_of', 'has_property'), cast(event_id % 6 + 1 as int))").alias("relation_type"),
        F.expr("case when event_id % 5 <> 0 then concat('Group ', event_type) when event_id % 2 = 0 then concat('Team ', event_type) else concat('TEAM ', event_type) end").alias("target_entity"),
        F.expr("case when event_id % 6 = 5 and event_id % 4 <> 0 then concat(' level ', cast(floor(value / 25) as bigint), ' ') end").alias("property_value"),
        F.expr("case when event_id % 10 <> 9 then value < 20 end").alias("negated"),
        F.expr("case when event_id % 10 <> 9 then (event_id % 10) / 10D end").alias("confidence"),
        F.expr("case when event_id % 10 <> 9 then concat('j', event_id % 3) end").alias("justification"),
        F.lit(None).cast("string").alias("source_chunk_id"), F.lit(None).cast("string").alias("source_doc_id"), F.lit(None).cast("string").alias("source_reliability"),
        F.expr(META.format(chunk="concat('e', event_id)", doc="concat('d', user_id % 10)", level="element_at(array('high', 'medium', 'low'), cast(user_id % 3 + 1 as int))", page="cast(event_id % 7 as int)")).alias("meta"),
    )
    return with_defaults(rows)


def event_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """norm, canonical: three users in four and all groups are entities; teams and the rest become stubs."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type")
    users = e.where("user_id % 4 <> 0").select(F.concat(F.lit("User "), "user_id").alias("canonical"))
    names = users.unionByName(e.where("event_type is not null").select(F.concat(F.lit("Group "), "event_type").alias("canonical"))).distinct()
    return names.select(text.norm(F.col("canonical")).alias("norm"), "canonical")


def part_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as mentions: names in three spellings, types by the key, an alias here and there."""
    p = table(spark, sf_dir, "part").where("p_partkey is not null")
    return p.select(
        F.col("p_partkey").alias("ord"), F.lit(0).alias("pos"), F.expr("case p_partkey % 3 when 0 then initcap(p_name) when 1 then upper(p_name) else concat(p_name, case when p_partkey % 5 = 0 then 's' else '' end) end").alias("name"),
        F.expr("element_at(array('Component', 'Material', 'unknown', 'Component'), cast(p_partkey % 4 + 1 as int))").alias("entity_type"),
        F.expr("case when p_partkey % 50 = 0 then array(concat(p_name, ' mark ', p_partkey)) else cast(array() as array<string>) end").alias("aliases"),
        F.expr(META.format(chunk="concat('p', p_partkey)", doc="p_brand", level="'high'", page="cast(p_size as int)")).alias("meta"),
    )


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer and supplier located_in nation, nation part_of region."""
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation").select("n_nationkey", "n_name", "n_regionkey")

    def rows(source, kind, target, chunk, doc, level, confidence):
        return [source.alias("source_entity"), F.lit(kind).alias("relation_type"), target.alias("target_entity"), F.lit(False).alias("negated"), confidence.cast("double").alias("confidence"), F.lit("").alias("justification"),
                chunk.alias("source_chunk_id"), doc.alias("source_doc_id"), level.alias("source_reliability")]

    level = lambda k: F.expr(f"element_at(array('high', 'medium', 'low'), cast({k} % 3 + 1 as int))")
    c = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(*rows(F.col("c_name"), "located_in", F.col("n_name"), F.concat(F.lit("customer:"), "c_custkey"), F.lit("customers"), level("c_custkey"), F.expr("(c_custkey % 10) / 10D")))
    s = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(*rows(F.col("s_name"), "located_in", F.col("n_name"), F.concat(F.lit("supplier:"), "s_suppkey"), F.lit("suppliers"), level("s_suppkey"), F.expr("(s_suppkey % 10) / 10D")))
    n = nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(*rows(F.col("n_name"), "part_of", F.col("r_name"), F.concat(F.lit("nation:"), "n_nationkey"), F.lit("nations"), level("n_nationkey"), F.lit(0.9)))
    out = c.unionByName(s).unionByName(n)
    return out.withColumns({"ord": F.xxhash64("source_chunk_id"), "pos": F.lit(0)})


def place_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [table(spark, sf_dir, t).select(F.col(c).alias("canonical_name")) for t, c in (("region", "r_name"), ("nation", "n_name"), ("customer", "c_name"), ("supplier", "s_name"))]
    out = names[0]
    for n in names[1:]:
        out = out.unionByName(n)
    return out.distinct().withColumn("aliases", F.array().cast("array<string>"))


def place_chunks(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_chunk_id").alias("chunk_id"), F.col("source_doc_id").alias("doc_id"), F.lit(None).cast("int").alias("page_number"), F.concat_ws(" ", "source_entity", text.relation_label(F.col("relation_type")), "target_entity").alias("chunk_text"), "source_reliability", F.lit(None).cast("string").alias("source_path"))


def region_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("qid"), F.concat(F.lit("What belongs to "), "r_name", F.lit("?")).alias("question"))
