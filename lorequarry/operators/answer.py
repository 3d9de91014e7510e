"""Cited answers from retrieval results, with or without a model.

``retrieved``: qid, question, relations, conflicts, evidence, warnings (arrays as in retrieve).
The answer by rule is native; a model is an injected client.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..storage import materialize
from .validate import parsed_answer

NO_EVIDENCE = "I cannot answer this question because the available evidence does not contain relevant information."
HEADER = "The available document evidence shows the following connections:"
DISPUTED = "\nDisputed Findings:"
MOST = 5
CONTEXT = 24_000
CITATION = "array<struct<doc_id:string,page_number:int,chunk_id:string,source_reliability:string,source_path:string>>"


def evidence_by_id(evidence: Column, chunk: Column) -> Column:
    return F.get(F.filter(evidence, lambda e: e["chunk_id"] == chunk), F.lit(0))


def _cite(evidence: Column, r: Column) -> Column:
    e = evidence_by_id(evidence, r["source_chunk_id"])
    return F.when(e.isNull(), F.concat(F.lit("["), F.lit("?, "), F.coalesce(r["source_chunk_id"], F.lit("?")), F.lit("]"))).otherwise(text.citation(e["doc_id"], e["page_number"], e["chunk_id"]))


def rule_lines(relations: Column, evidence: Column) -> Column:
    def line(r: Column) -> Column:
        return F.concat(F.lit("- "), r["source_entity"], F.lit(" --"), text.relation_label(r["relation_type"]), F.lit("--> "), r["target_entity"], F.lit(" "), _cite(evidence, r), F.when(evidence_by_id(evidence, r["source_chunk_id"])["source_reliability"] == "low", " (low reliability)").otherwise(""))

    return F.transform(F.slice(relations, 1, MOST), line)


def disputed_lines(conflicts: Column, evidence: Column) -> Column:
    def line(r: Column) -> Column:
        return F.concat(F.lit("- (Disputed) "), r["source_entity"], F.lit(" --"), text.relation_label(r["relation_type"]), F.lit("--> "), r["target_entity"], F.lit(" "), _cite(evidence, r))

    return F.transform(F.slice(conflicts, 1, MOST), line)


def citations(evidence: Column, ids: Column) -> Column:
    found = F.filter(F.transform(ids, lambda i: evidence_by_id(evidence, i)), lambda e: e.isNotNull())
    return F.transform(found, lambda e: F.struct(e["doc_id"].alias("doc_id"), e["page_number"].alias("page_number"), e["chunk_id"].alias("chunk_id"), e["source_reliability"].alias("source_reliability"), e["source_path"].alias("source_path"))).cast(CITATION)


def by_rule(retrieved: DataFrame, reason: Column | None = None) -> DataFrame:
    """Adds answer, citations, used_chunk_ids, grounded, fallback_used, and extends warnings."""
    rel, con, ev = F.col("relations"), F.col("conflicts"), F.col("evidence")
    lines = F.concat(F.array(F.lit(HEADER)), rule_lines(rel, ev), F.when(F.size(con) > 0, F.concat(F.array(F.lit(DISPUTED)), disputed_lines(con, ev))).otherwise(F.array().cast("array<string>")))
    shown = F.concat(F.transform(F.slice(rel, 1, MOST), lambda r: r["source_chunk_id"]), F.transform(F.slice(con, 1, MOST), lambda r: r["source_chunk_id"]))
    known = F.array_distinct(F.filter(shown, lambda i: F.exists(ev, lambda e: e["chunk_id"] == i)))
    none = F.size(ev) == 0
    used = F.when(none, F.array().cast("array<string>")).otherwise(known)
    more = F.array_compact(F.array(reason)) if reason is not None else F.array().cast("array<string>")
    out = retrieved.withColumn("used_chunk_ids", used).withColumn("answer", F.when(none, NO_EVIDENCE).otherwise(F.array_join(lines, "\n")))
    return out.withColumns({"citations": citations(F.col("evidence"), F.col("used_chunk_ids")), "grounded": F.size("used_chunk_ids") > 0, "fallback_used": F.lit(True), "warnings": F.concat("warnings", more)})


def fit_context(payload: dict, cap: int = CONTEXT) -> tuple[str, bool]:
    """The JSON that is sent, its evidence cut until it fits: the longest text to a hundred
    characters, then dropped; the last one to fifty. (text, whether anything was cut)."""
    evidence = [dict(e) for e in payload.get("evidence") or []]
    render = lambda: json.dumps(payload | {"evidence": evidence}, ensure_ascii=False)
    out, cut = render(), False
    while len(out) > cap and evidence:
        cut = True
        i = max(range(len(evidence)), key=lambda j: (len(evidence[j]["chunk_text"] or ""), -j))
        body = evidence[i]["chunk_text"] or ""
        if len(evidence) > 1:
            if len(body) > 200:
                evidence[i]["chunk_text"] = body[:100] + "... [truncated]"
            else:
                del evidence[i]
            out = render()
            continue
        evidence[i]["chunk_text"] = body[:50] + "... [truncated]"
        return render(), True
    return out, cut


def system_prompt() -> str:
    return (
        "Answer the question from the given relations and evidence only. Answer with one JSON object with the keys answer (text) and used_chunk_ids (the ids of the evidence chunks that support it). "
        "Where sources disagree prefer the more reliable one, but say that the other exists. If the evidence does not suffice, say so."
    )


def by_model(retrieved: DataFrame, client: Callable[[list[dict]], str], cap: int = CONTEXT) -> DataFrame:
    """As by_rule, from a model's answer where it is valid and cites known chunks; by rule elsewhere. No call without evidence."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, cut, error = [], [], []
            for row in batch.to_pylist():
                if not row["evidence"]:
                    raw.append(None), cut.append(False), error.append(None)
                    continue
                body, was = fit_context({k: row[k] for k in ("question", "relations", "conflicts", "paths", "evidence", "warnings") if k in row}, cap)
                try:
                    raw.append(client([{"role": "system", "content": system_prompt()}, {"role": "user", "content": body}]))
                    error.append(None)
                except Exception as e:  # any failure of the model leads to the answer by rule
                    raw.append(None)
                    error.append(str(e)[:100])
                cut.append(was)
            yield pa.RecordBatch.from_arrays([batch["qid"], pa.array(raw, pa.string()), pa.array(cut, pa.bool_()), pa.array(error, pa.string())], ["qid", "_raw", "_cut", "_error"])

    kind = retrieved.schema["qid"].dataType.simpleString()
    asked = materialize(retrieved.mapInArrow(ask, f"qid {kind}, _raw string, _cut boolean, _error string"), "model-answers")
    rows = retrieved.join(asked, "qid").withColumn("_a", parsed_answer(F.col("_raw")))
    known = lambda i: F.exists(F.col("evidence"), lambda e: e["chunk_id"] == i)
    ids = F.array_distinct(F.coalesce(F.col("_a")["used_chunk_ids"], F.array().cast("array<string>")))
    strange = F.transform(F.filter(ids, lambda i: ~known(i)), lambda i: F.concat(F.lit("unknown chunk ID: "), i))
    cut = F.when(F.col("_cut"), F.array(F.lit("evidence was truncated to fit the context"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("_ids", F.filter(ids, known)).withColumn("warnings", F.concat("warnings", cut, strange))
    good = rows.where("_a is not null and size(_ids) > 0")
    good = good.withColumns({"answer": F.col("_a")["answer"], "used_chunk_ids": F.col("_ids"), "citations": citations(F.col("evidence"), F.col("_ids")), "grounded": F.lit(True), "fallback_used": F.lit(False)})
    rest = rows.where("_a is null or size(_ids) = 0")
    why = F.when(F.size("evidence") == 0, F.lit(None)).when(F.col("_error").isNotNull(), F.concat(F.lit("model failed: "), "_error")).when(F.col("_a").isNull(), "model answer was not valid").otherwise("model cited no known chunk")
    mine = ["_raw", "_cut", "_error", "_a", "_ids"]
    return good.drop(*mine).unionByName(by_rule(rest, why).drop(*mine))


def answer_questions(questions: DataFrame, entities: DataFrame, edges: DataFrame, chunks: DataFrame, client=None, cap: int = CONTEXT, **limits) -> DataFrame:
    """Retrieve and answer; without a client by rule alone."""
    from .retrieve import retrieve

    found = materialize(retrieve(questions, entities, edges, chunks, **limits), "retrieved")
    return by_rule(found, F.lit("answered offline by rule")) if client is None else by_model(found, client, cap)
