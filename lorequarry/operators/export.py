"""Sinks of the graph: Parquet tables, the single JSON document, statistics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import relations as R
from .validate import check_graph

VERSION = "1.0"


def write_tables(entities: DataFrame, edges: DataFrame, folder: str) -> dict:
    """entities and relations as Parquet (each appears whole or not at all), and a metadata row."""
    spark = edges.sparkSession
    entities.write.mode("overwrite").parquet(f"{folder}/entities")
    R.distinct_edges(edges).write.mode("overwrite").parquet(f"{folder}/relations")
    n, m = spark.read.parquet(f"{folder}/entities").count(), spark.read.parquet(f"{folder}/relations").count()
    spark.createDataFrame([(VERSION, n, m)], "schema_version string, entity_count long, relation_count long").write.mode("overwrite").json(f"{folder}/metadata")
    return {"output_path": folder, "entity_count": n, "relation_count": m}


def read_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    meta = spark.read.schema("schema_version string, entity_count long, relation_count long").json(f"{folder}/metadata").first()
    if meta is None:
        raise ValueError("graph has no metadata")
    entities, relations = spark.read.parquet(f"{folder}/entities"), spark.read.parquet(f"{folder}/relations")
    check_graph(entities, relations, meta["entity_count"], meta["relation_count"])
    return entities, relations


def document(entities: DataFrame, edges: DataFrame) -> str:
    """The whole graph as one JSON document, for graphs that one reader can hold."""
    own = entities.orderBy(F.lower(F.btrim("canonical_name")), "canonical_name").toLocalIterator()
    nodes = {r["canonical_name"]: {k: v for k, v in r.asDict(recursive=True).items() if k not in ("canonical_name", "ord", "pos")} for r in own}
    rows = [r.asDict() for r in R.in_export_order(R.distinct_edges(edges)).select(*R.EDGE).toLocalIterator()]
    return json.dumps({"metadata": {"schema_version": VERSION, "entity_count": len(nodes), "relation_count": len(rows)}, "entities": nodes, "relations": rows}, ensure_ascii=False, indent=2)


def load_document(spark: SparkSession, path: str) -> dict:
    """Reads and validates such a document. Missing file: FileNotFoundError; bad shape: ValueError."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        raise FileNotFoundError(path)
    data = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(data, dict):
        raise ValueError("graph is not an object")
    kinds = {"metadata": dict, "entities": dict, "relations": list}
    for key, kind in kinds.items():
        if not isinstance(data.get(key), kind):
            raise ValueError(f"graph lacks a valid '{key}'")
    for r in data["relations"]:
        if not isinstance(r, dict) or not {"source_entity", "relation_type", "target_entity"} <= r.keys():
            raise ValueError("a relation lacks source_entity, relation_type or target_entity")
    if data["metadata"].get("entity_count") != len(data["entities"]) or data["metadata"].get("relation_count") != len(data["relations"]):
        raise ValueError("metadata counts do not match")
    return data
