"""Extraction of entities and relations from chunks by an injected model client."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.names import BLANKS
from ..sources.records import parse_extractions
from .validate import with_error

ATTEMPTS = 3
OUT = "chunk_id string, line string, error string"


def system_prompt() -> str:
    return (
        "Read the passage and answer with one JSON object with the keys entities and relations. "
        "An entity has name, entity_type and aliases; a relation has source_entity, relation_type, target_entity, property_value, negated, confidence (0 to 1) and justification. "
        f"Entity types: {', '.join(vocab.ENTITY_TYPES)}. Relation types: {', '.join(vocab.RELATION_TYPES)}. "
        "Entities are named things with proper names. Qualities are has_property relations with the quality in property_value and an empty target_entity; "
        "all other relations join two entities of the list. Report what is denied with negated true. Answer with JSON only."
    )


def messages_for(chunk: dict) -> list[dict]:
    head = f"Document type: {chunk['doc_type']}\nReliability: {chunk['source_reliability']}\n\n{chunk['chunk_text']}"
    return [{"role": "system", "content": system_prompt()}, {"role": "user", "content": head}]


def bare(answer: str) -> str:
    """Without a Markdown fence at its ends."""
    return re.sub(r"\A```[a-zA-Z]*\s*|\s*```\Z", "", answer.strip(BLANKS))


def loose_error(data) -> str:
    """What a retry is asked to mend; the full rules are applied to the result natively."""
    if not isinstance(data, dict):
        return "the answer is not a JSON object"
    for key in ("entities", "relations"):
        if not isinstance(data.get(key), list):
            return f"'{key}' is missing or not an array"
    return ""


def extract(chunks: DataFrame, client: Callable[[list[dict]], str], validate: Callable[[object], str] = loose_error, attempts: int = ATTEMPTS, per_minute: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(extractions, failures). Blank chunks cost no call; a malformed answer is sent back with what
    is wrong, up to ``attempts``; another error ends the chunk. ``per_minute`` spaces the chunks of
    each task (bound the tasks by repartitioning). The result should be written before it is used
    twice: a repeated task repeats its calls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, errors = [], [], []
            for chunk in batch.to_pylist():
                meta = {k: chunk[k] for k in ("chunk_id", "doc_id", "source_reliability", "page_number")}
                ids.append(chunk["chunk_id"])
                if not (chunk["chunk_text"] or "").strip(BLANKS):
                    out.append(json.dumps({"entities": [], "relations": [], "chunk_meta": meta}))
                    errors.append(None)
                    continue
                if per_minute:
                    time.sleep(60 / per_minute)
                talk, line, error = messages_for(chunk), None, None
                for _ in range(attempts):
                    try:
                        answer = client(talk)
                    except Exception as e:  # a failed chunk is reported, the rest goes on
                        error = f"{type(e).__name__}: {e}"
                        break
                    try:
                        data = json.loads(bare(answer))
                        error = validate(data) or None
                    except ValueError as e:
                        data, error = None, f"not JSON: {e}"
                    if error is None:
                        for r in data["relations"]:
                            if isinstance(r, dict):
                                r |= {"source_chunk_id": meta["chunk_id"], "source_doc_id": meta["doc_id"], "source_reliability": meta["source_reliability"]}
                        line = json.dumps(data | {"chunk_meta": meta})
                        break
                    talk = [*talk, {"role": "assistant", "content": answer}, {"role": "user", "content": f"That was not valid: {error}. Answer again with corrected JSON only."}]
                out.append(line)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.string()), pa.array(errors, pa.string())], ["chunk_id", "line", "error"])

    fields = ["chunk_id", "doc_id", "doc_type", "source_reliability", "page_number", "chunk_text"]
    from ..storage import materialize

    done = materialize(chunks.select(*fields).mapInArrow(run, OUT), "answers")
    rows = done.where("line is not null").select(F.xxhash64("chunk_id").alias("ord"), "line")
    good, bad = parse_extractions(rows)
    good = with_error(good)
    failures = done.where("error is not null").select("chunk_id", "error").unionByName(good.where("error is not null").select("chunk_meta.chunk_id", "error")).unionByName(bad.select(F.get_json_object("line", "$.chunk_meta.chunk_id").alias("chunk_id"), "error"))
    return good.where("error is null").drop("error"), failures
