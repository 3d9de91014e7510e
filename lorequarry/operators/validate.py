"""Validation of extractions, graphs and model answers. The first error wins; a row is never dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vocab


def _at(i: Column, kind: str, rest) -> Column:
    return F.concat(F.lit(f"{kind} "), i.cast("string"), F.lit(" "), rest if isinstance(rest, Column) else F.lit(rest))


def _measured(elements: Column, name: str, fields: list[str], stripped: dict[str, str]) -> Column:
    """Elements with names stripped, and the one that must be proper lower-cased and its words counted, each once."""
    cut = F.transform(elements, lambda x: F.struct(*[x[f].alias(f) for f in fields], *[text.strip(F.coalesce(x[f], F.lit(""))).alias(to) for f, to in stripped.items()]))
    keep = [*fields, *stripped.values()]
    return F.transform(cut, lambda x: F.struct(*[x[f].alias(f) for f in keep], F.lower(x[name]).alias("low"), F.size(text.words(x[name])).alias("n")))


def entity_error(e: Column, i: Column) -> Column:
    return (
        F.when(e["name"].isNull(), _at(i, "Entity", "missing 'name'"))
        .when(e["entity_type"].isNull(), _at(i, "Entity", "missing 'entity_type'"))
        .when(~e["entity_type"].isin(*vocab.ENTITY_TYPES), _at(i, "Entity", F.concat(F.lit("has invalid entity_type: "), e["entity_type"])))
        .when(~text.is_proper(e["own"], e["low"], e["n"]), _at(i, "Entity", F.concat(F.lit("name '"), e["own"], F.lit("' is not a proper name"))))
    )


def relation_error(r: Column, i: Column, known: Column) -> Column:
    source, target, value = r["source"], r["target"], r["value"]
    out = F.when(F.lit(False), F.lit(""))
    for field in ("source_entity", "relation_type", "negated", "confidence", "justification"):
        out = out.when(r[field].isNull(), _at(i, "Relation", f"missing '{field}'"))
    prop = r["relation_type"] == vocab.PROPERTY
    return (
        out.when(~F.array_contains(known, F.lower(source)), _at(i, "Relation", F.concat(F.lit("source_entity '"), source, F.lit("' is not defined"))))
        .when(~r["relation_type"].isin(*vocab.RELATION_TYPES), _at(i, "Relation", F.concat(F.lit("has invalid relation_type: "), r["relation_type"])))
        .when(F.isnan(r["confidence"]) | (r["confidence"] < 0) | (r["confidence"] > 1), _at(i, "Relation", "'confidence' out of range [0, 1]"))
        .when(prop & (value == ""), _at(i, "Relation", "is has_property without 'property_value'"))
        .when(prop & (target != ""), _at(i, "Relation", F.concat(F.lit("is has_property but target_entity is '"), target, F.lit("'"))))
        .when(~prop & (target == ""), _at(i, "Relation", F.concat(F.lit("("), r["relation_type"], F.lit(") has empty 'target_entity'"))))
        .when(~prop & ~text.is_proper(target, r["low"], r["n"]), _at(i, "Relation", F.concat(F.lit("target_entity '"), target, F.lit("' is not a proper name"))))
        .when(~prop & ~F.array_contains(known, r["low"]), _at(i, "Relation", F.concat(F.lit("target_entity '"), target, F.lit("' is not defined"))))
    )


def with_error(extractions: DataFrame) -> DataFrame:
    """Adds ``error``, null for valid rows: entities first, then relations, in order. Names are
    compared lower-cased; a name is stripped, an alias is not."""
    e, r = F.col("entities"), F.col("relations")
    known = F.array_union(F.transform(e, lambda x: F.lower(text.strip(x["name"]))), F.flatten(F.transform(e, lambda x: F.transform(F.coalesce(x["aliases"], F.array().cast("array<string>")), F.lower))))
    entities = _measured(e, "own", ["name", "entity_type"], {"name": "own"})
    needed = ["source_entity", "relation_type", "negated", "confidence", "justification"]
    relations = _measured(r, "target", needed, {"source_entity": "source", "target_entity": "target", "property_value": "value"})
    out = extractions.withColumn("_known", known)
    first = lambda errors: F.get(F.filter(errors, lambda x: x.isNotNull()), F.lit(0))
    error = F.coalesce(
        F.when(e.isNull(), F.lit("Missing 'entities' key")),
        F.when(r.isNull(), F.lit("Missing 'relations' key")),
        first(F.transform(entities, entity_error)),
        first(F.transform(relations, lambda x, i: relation_error(x, i, F.col("_known")))),
    )
    return out.withColumn("error", error).drop("_known")


def check_graph(entities: DataFrame, relations: DataFrame, entity_count: int | None, relation_count: int | None) -> None:
    """Raises ValueError unless counts match and every relation has source, type and target."""
    for column in ("source_entity", "relation_type", "target_entity"):
        if column not in relations.columns:
            raise ValueError(f"Relation is missing '{column}'")
    counts = relations.agg(F.count("*"), F.count_if(F.col("source_entity").isNull() | F.col("relation_type").isNull() | F.col("target_entity").isNull())).first()
    if counts[1]:
        raise ValueError(f"{counts[1]} relations lack source_entity, relation_type or target_entity")
    if entities.count() != entity_count:
        raise ValueError("metadata entity_count does not match")
    if counts[0] != relation_count:
        raise ValueError("metadata relation_count does not match")


ANSWER = "struct<answer:string,used_chunk_ids:array<string>>"


def parsed_answer(raw: Column) -> Column:
    """The struct of a model's answer, null unless it is an object with a non-blank answer and a list of ids."""
    got = F.from_json(text.fenced(raw), ANSWER)
    return F.when((text.strip(got["answer"]) != "") & got["used_chunk_ids"].isNotNull(), got)
