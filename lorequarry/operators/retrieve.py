"""Retrieval from the graph: seeds, bounded traversal, edges, evidence, conflicts, warnings.

The reference result has no retriever to match, so these rules are this engine's: seeds are names or
aliases that occur in the question as word runs, or nearly so; traversal ignores directions and
visits each entity once, at its least number of hops; edges are ranked by hop, reliability,
confidence and name. Frontiers are DataFrames, joined once a hop, so a hub costs its degree.

questions: qid, question. entities: canonical_name, aliases. edges: the nine fields, ord, pos.
chunks: chunk_id, doc_id, page_number, chunk_text, source_reliability, source_path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vocab
from ..storage import materialize
from . import relations as R
from .resolve import similar_names

RUNS = 5  # words of the runs of a question that are looked up at least; more if a name has more
TOKEN = r"[^\p{L}\p{N}_#\-]+"


def seeds(questions: DataFrame, entities: DataFrame, fuzzy_threshold: int = 85) -> DataFrame:
    """qid, canonical_name, ratio."""
    names = entities.select("canonical_name", F.explode(F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    names = names.select("canonical_name", text.norm(F.col("name")).alias("norm")).where("norm <> ''").distinct()
    longest = names.agg(F.greatest(F.max(F.size(F.split("norm", " "))), F.lit(RUNS)).alias("_longest"))
    w = F.filter(F.split(F.lower("question"), TOKEN), lambda x: x != "")

    def run(k):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice("_w", i, k), " "))

    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.least("_longest", F.size("_w")), F.lit(1))), run))
    asked = questions.select("qid", w.alias("_w")).crossJoin(F.broadcast(longest))
    grams = asked.select("qid", F.explode(F.array_distinct(runs)).alias("norm")).where("norm <> ''")
    exact = grams.join(names, "norm").select("qid", "canonical_name", F.lit(100).alias("ratio"))
    if fuzzy_threshold >= 100:
        return exact.distinct()
    near = similar_names(grams.select("norm").unionByName(names.select("norm")).distinct(), fuzzy_threshold)
    near = near.select(F.col("a").alias("norm"), F.col("b").alias("other"), "ratio").unionByName(near.select(F.col("b").alias("norm"), F.col("a").alias("other"), "ratio"))
    fuzzy = grams.join(near, "norm").join(names.withColumnRenamed("norm", "other"), "other").select("qid", "canonical_name", "ratio")
    return exact.unionByName(fuzzy).groupBy("qid", "canonical_name").agg(F.max("ratio").alias("ratio"))


def both_ways(edges: DataFrame) -> DataFrame:
    one = edges.withColumns({"here": F.col("source_entity"), "there": F.col("target_entity")})
    return one.unionByName(edges.withColumns({"here": F.col("target_entity"), "there": F.col("source_entity")}))


def traverse(starts: DataFrame, edges: DataFrame, max_hops: int = 3) -> tuple[DataFrame, DataFrame]:
    """starts: qid, node. (visited, touched): visited has qid, node, hop, nodes (a shortest path,
    the least by name); touched has the edges that a hop passed, with qid and hop."""
    ways = both_ways(edges)
    steps = ways.select("here", "there").distinct()
    visited = starts.select("qid", "node", F.lit(0).alias("hop"), F.array("node").alias("nodes")).distinct()
    frontier, touched = visited, None
    for hop in range(1, max_hops + 1):
        passed = frontier.select("qid", F.col("node").alias("here")).join(ways, "here").drop("here", "there").withColumn("hop", F.lit(hop))
        touched = passed if touched is None else touched.unionByName(passed)
        ahead = frontier.join(steps, frontier["node"] == steps["here"]).select("qid", F.col("there").alias("node"), "nodes")
        ahead = ahead.groupBy("qid", "node").agg(F.min("nodes").alias("nodes")).join(visited.select("qid", "node"), ["qid", "node"], "left_anti")
        frontier = materialize(ahead.select("qid", "node", F.lit(hop).alias("hop"), F.concat("nodes", F.array("node")).alias("nodes")), "frontier")
        visited = visited.unionByName(frontier)
    touched = touched.groupBy("qid", *R.EDGE).agg(F.min("hop").alias("hop"), F.min("ord").alias("ord"))
    return visited, touched


def edge_order() -> list:
    return ["hop", text.reliability_rank(F.col("source_reliability")), F.desc("confidence"), "source_entity", "relation_type", "target_entity", "source_doc_id", "source_chunk_id", "ord"]


def top(rows: DataFrame, order: list, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= k)


def evidence_of(edges: DataFrame, chunks: DataFrame, max_evidence: int = 10) -> DataFrame:
    """qid, rank and the chunk's fields of the chunks behind kept edges: by least hop, reliability, id."""
    ids = edges.groupBy("qid", F.col("source_chunk_id").alias("chunk_id")).agg(F.min("hop").alias("hop"))
    return top(ids.join(chunks, "chunk_id"), ["hop", text.reliability_rank(F.col("source_reliability")), "chunk_id"], max_evidence)


def conflicts_of(kept: DataFrame, edges: DataFrame) -> DataFrame:
    """Kept edges that belong to a negation conflict or to contradictory types."""
    pair = ["owner", "source", "target"]
    # only edges between the pairs of kept ones can clash with them
    asked = kept.select("source_entity", text.norm(F.col("target_entity")).alias("_t")).distinct()
    edges = edges.withColumn("_t", text.norm(F.col("target_entity"))).join(asked, ["source_entity", "_t"], "left_semi").drop("_t")
    own = kept.withColumn("owner", F.col("source_entity")).withColumns({"source": text.norm(F.col("source_entity")), "target": text.norm(F.col("target_entity"))})
    negation = R.negation_conflicts(edges).select(*pair, "relation_type")
    types = R.contradictory_types(edges).select(*pair, F.explode(F.split("types", ", ")).alias("relation_type"))
    return own.join(negation.unionByName(types).distinct(), [*pair, "relation_type"], "left_semi").select(kept.columns)


def retrieve(questions: DataFrame, entities: DataFrame, edges: DataFrame, chunks: DataFrame, max_hops: int = 3, max_edges: int = 40, max_evidence: int = 10, fuzzy_threshold: int = 85, inverses: bool = False) -> DataFrame:
    """A row per question: qid, question, seed_entities, paths, relations, conflicts, evidence, warnings."""
    if inverses:
        edges = R.inverse_edges(edges).drop("derived")
    found = materialize(seeds(questions, entities, fuzzy_threshold), "seeds")
    visited, touched = traverse(found.select("qid", F.col("canonical_name").alias("node")), edges, max_hops)
    touched = materialize(touched, "touched")
    kept = top(touched, edge_order(), max_edges)
    evidence = evidence_of(kept, chunks, max_evidence)
    listed = lambda rows, order, fields, name: rows.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("row")))), lambda s: s["row"]).alias(name))
    relation = [*R.EDGE, "hop"]
    # lists hold at most the caps; seeds and paths at most what a question names and the kept edges' ends
    ends = kept.select("qid", F.explode(F.array("source_entity", "target_entity")).alias("node")).distinct()
    parts = [
        found.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("ratio")).alias("r"), "canonical_name"))), lambda s: s["canonical_name"]).alias("seed_entities")),
        listed(visited.where("hop > 0").join(ends, ["qid", "node"], "left_semi"), ["hop", "nodes"], ["nodes", F.col("hop").alias("hop_count")], "paths"),
        listed(kept, ["rank"], relation, "relations"),
        listed(conflicts_of(kept, edges), ["rank"], relation, "conflicts"),
        listed(evidence, ["rank"], ["chunk_id", "doc_id", "page_number", "chunk_text", "source_reliability", "source_path"], "evidence"),
        touched.groupBy("qid").agg(F.count("*").alias("_touched")),
        kept.join(chunks.select(F.col("chunk_id").alias("source_chunk_id")), "source_chunk_id", "left_anti").groupBy("qid").agg(F.count("*").alias("_lost")),
    ]
    out = questions
    for p in parts:
        out = out.join(p, "qid", "left")
    for p in parts[:5]:
        c = p.columns[-1]
        out = out.withColumn(c, F.coalesce(c, F.array().cast(p.schema[c].dataType)))
    said = F.array_compact(F.array(
        F.when(F.size("seed_entities") == 0, "no entity of the question is known"),
        F.when(F.col("_touched") > max_edges, F.concat(F.lit(f"edges capped at {max_edges} of "), F.col("_touched").cast("string"))),
        F.when(F.col("_lost") > 0, F.concat(F.col("_lost").cast("string"), F.lit(" edges have no chunk"))),
    ))
    return out.withColumn("warnings", said).drop("_touched", "_lost")
