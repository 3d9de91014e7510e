"""Scalar functions, splitting, ingestion, extraction, streaming, retrieval and answers."""

import json

import pytest
from pyspark.sql import functions as F

from lorequarry.functions import text
from lorequarry.functions.splitter import split_text
from lorequarry.operators import answer, extract, retrieve
from lorequarry.sources import clients, files
from lorequarry.streaming import resume


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(("name", "proper"), [
    ("", False), (None, False), ("endurance", False), ("Vault 7", True), ("1204", False), ("severe terrain", False), ("any faction, house, or Other", False), ("A b c d e f g h i", False),
    ("Lord of the Rings", False), ("Lord of the", True), ("Iron Covenant", True), (" Kael Ashborn ", True), ("éa", False), ("Éa", True),
])
def test_proper_name(spark, name, proper):
    assert one(spark, name, text.is_proper_name) is proper


def test_paths_and_labels(spark):
    kind = lambda p: one(spark, p, text.doc_type)
    assert [kind(p) for p in ("/x/Wiki/codex.md", "/WIKI/a", "/plain/a")] == ["codex", "wiki", "unknown"]
    assert one(spark, "/root/a/b c.tar.gz", lambda c: text.doc_id(c, "/root")) == "a__b c.tar"
    assert one(spark, "a\\b.pdf", text.doc_id) == "a__b"
    assert one(spark, "located_in", text.relation_label) == "located in" and one(spark, "", text.relation_label) == ""
    assert one(spark, "\t  Ab\x1c\n", text.norm) == "ab"
    assert one(spark, 'a<b>:"/\\|?* . ', text.filename) == "a_b________"
    assert one(spark, "x" * 11, lambda c: text.excerpt(c, 50)) == "x" * 11 and one(spark, "x" * 2000, lambda c: text.excerpt(c, 1500)) == "x" * 1500 + "... [excerpt truncated]"
    cite = lambda page: spark.range(1).select(text.citation(F.lit("doc1"), F.lit(page).cast("int"), F.lit("c1"))).first()[0]
    assert cite(42) == "[doc1, p. 42]" and cite(None) == "[doc1, c1]"


def test_path_text(spark):
    def draw(nodes, hops):
        df = spark.createDataFrame([(nodes, hops)], "n array<string>, h array<struct<source:string,target:string,kind:string>>")
        return df.select(text.path_text(F.col("n"), F.col("h"))).first()[0]

    assert draw(["A", "B"], [("A", "B", "located_in")]) == "A\n-> located in\nB"
    assert draw(["A", "B", "C"], [("A", "B", "located_in"), ("B", "C", "is_member")]) == "A\n-> located in\nB\n-> is member\nC"
    assert draw(["A", "B"], [("B", "A", "caused_by")]) == "A\n<- caused by\nB"
    assert draw([], []) == "" and draw(None, None) == ""


def test_splitter():
    body = "\n\n".join(" ".join(f"word{i}x{j}" for j in range(60)) + "." for i in range(12))
    out = split_text(body)
    assert all(0 < len(c) <= 1000 for c in out) and len(out) > 5
    assert all(w in " ".join(out) for w in body.split())
    assert split_text("") == [] and split_text(" \n ") == [] and split_text("short") == ["short"]
    assert max(map(len, split_text("x" * 5000))) <= 1000
    two = split_text("a" * 990 + " " + "b" * 100 + " " + "c" * 800)
    assert two[0].startswith("a") and all(len(c) <= 1000 for c in two)


def test_ingestion(spark, tmp_path):
    root = tmp_path / "corpus"
    (root / "codex" / "deep").mkdir(parents=True)
    (root / "codex" / "deep" / "One.MD").write_bytes(b"Good text \xff here")
    (root / "wiki.txt").write_text("  \n ")
    (root / "b.pdf").write_bytes(b"broken")
    (root / "c.xyz").write_bytes(b"ignored")
    (root / "d.png").write_bytes(b"picture")
    (root / "e.docx").write_bytes(b"doc")
    parsers = {"docx": lambda content, ocr: [(1, files.docx_text(["a", " "], [[["x", ""], ["", ""]]]), "native_text")], "pdf": lambda c, ocr: 1 / 0}
    bad = files.ingest(spark, str(root), str(tmp_path / "chunks"), parsers, ocr=lambda content: "seen " + content.decode())
    assert [r["error"].split(":")[0] for r in bad.collect()] == ["ZeroDivisionError"]
    got = {r["doc_id"]: r for r in spark.read.parquet(str(tmp_path / "chunks")).collect()}
    assert set(got) == {"codex__deep__One", "d", "e"}
    assert got["codex__deep__One"]["chunk_text"] == "Good text  here" and got["codex__deep__One"]["chunk_id"] == "codex__deep__One__p1__c0" and got["codex__deep__One"]["source_reliability"] == "high"
    assert got["d"]["extraction_method"] == "ocr" and got["e"]["chunk_text"] == "a\nx |"
    assert files.paged([(1, "few", b"p"), (2, "y" * 60, b"p")], lambda p: "from picture") == [(1, "from picture", "ocr"), (2, "y" * 60, "native_text")]


CHUNK = "doc_id string, doc_type string, source_reliability string, page_number int, chunk_text string, chunk_id string, source_path string, extraction_method string, chunk_index int"


def chunk_rows(spark, texts):
    return spark.createDataFrame([(f"d{i}", "wiki", "medium", 1, t, f"c{i}", "p", "native_text", 0) for i, t in enumerate(texts)], CHUNK)


def fake_model(messages):
    body = messages[-1]["content"] if len(messages) == 2 else "again"
    if "fail" in body:
        raise RuntimeError("no answer")
    if "never" in messages[1]["content"] or ("later" in body):
        return "not json"
    return '```json\n{"entities": [{"name": "Alpha", "entity_type": "Faction"}], "relations": []}\n```'


def test_extraction(spark):
    good, bad = extract.extract(chunk_rows(spark, ["fine", "later", "never", "fail", "  ", None]), fake_model)
    assert {r["chunk_meta"]["chunk_id"]: len(r["entities"]) for r in good.collect()} == {"c0": 1, "c1": 1, "c4": 0, "c5": 0}
    assert {r["chunk_id"] for r in bad.collect()} == {"c2", "c3"}


def test_stream_resumes(spark, tmp_path):
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    chunk_rows(spark, ["a", "b"]).write.parquet(source)
    work = lambda df: df.select("chunk_id", F.length("chunk_text").alias("n"))
    run = lambda: resume.extract_stream(resume.chunk_stream(spark, source), work, out, cp).awaitTermination()
    run()
    chunk_rows(spark, ["a", "b", "c"]).write.mode("append").parquet(source)
    run()
    assert sorted(r["chunk_id"] for r in spark.read.parquet(out).collect()) == ["c0", "c1", "c2"]


def test_client_retries():
    calls = []

    class Answer:
        def __init__(self, body):
            self.body = body

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

        def read(self):
            return self.body

    def opener(request, timeout):
        calls.append(timeout)
        if len(calls) < 3:
            raise ConnectionError("down")
        return Answer(json.dumps({"choices": [{"message": {"content": "hi"}}]}).encode())

    assert clients.chat("http://example.invalid", "m", "key", opener=opener, sleep=lambda s: None)([]) == "hi" and len(calls) == 3
    with pytest.raises(ValueError):
        clients.post("http://example.invalid", {}, "")


REL = "source_entity:string,relation_type:string,target_entity:string,source_chunk_id:string,source_reliability:string"
RETRIEVED = f"qid long, question string, relations array<struct<{REL}>>, conflicts array<struct<{REL}>>, evidence array<struct<chunk_id:string,doc_id:string,page_number:int,chunk_text:string,source_reliability:string,source_path:string>>, warnings array<string>"


def retrieved(spark, n=2, evidence=True, size=5):
    rel = [("A", "is_a", "B", "c1", "high"), ("B", "has_a", "C", "c2", "low")] if n == 2 else [(f"S{i}", "is", "T", "c1", "high") for i in range(n)]
    ev = [("c1", "d1", 10, "x" * size, "high", None), ("c2", "d2", None, "y" * size, "low", None)] if evidence else []
    return spark.createDataFrame([(1, "q", rel, [("X", "dislikes", "Y", "c1", "high")], ev, ["retriever warning"])], RETRIEVED)


def test_answer_by_rule(spark):
    r = answer.by_rule(retrieved(spark)).first()
    assert r["answer"] == (
        "The available document evidence shows the following connections:\n- A --is a--> B [d1, p. 10]\n- B --has a--> C [d2, c2] (low reliability)\n\nDisputed Findings:\n- (Disputed) X --dislikes--> Y [d1, p. 10]"
    )
    assert r["grounded"] and r["fallback_used"] and r["used_chunk_ids"] == ["c1", "c2"] and r["warnings"] == ["retriever warning"]
    assert answer.by_rule(retrieved(spark, 10)).first()["answer"].count("--is-->") == 5
    none = answer.by_rule(retrieved(spark, evidence=False)).first()
    assert none["answer"] == answer.NO_EVIDENCE and not none["grounded"] and none["fallback_used"]


@pytest.mark.parametrize(("said", "ids", "fallback", "warning"), [
    ('{"answer":"A is B.","used_chunk_ids":["c1"]}', ["c1"], False, None), ('{"answer":"A","used_chunk_ids":["c2","c1","c2"]}', ["c2", "c1"], False, None), ('```json\n{"answer":"A","used_chunk_ids":["c1"]}\n```', ["c1"], False, None),
    ('{"answer":"A","used_chunk_ids":["c1","c_fake"]}', ["c1"], False, "unknown chunk ID"), ('{"answer":"A","used_chunk_ids":["c_fake"]}', ["c1", "c2"], True, "no known chunk"), ("not json", ["c1", "c2"], True, "not valid"), ('{"answer":"","used_chunk_ids":["c1"]}', ["c1", "c2"], True, "not valid"),
])
def test_answer_by_model(spark, said, ids, fallback, warning):
    r = answer.by_model(retrieved(spark), lambda messages: said).first()
    assert r["used_chunk_ids"] == ids and r["fallback_used"] is fallback and r["grounded"]
    assert [c["chunk_id"] for c in r["citations"]] == ids
    assert warning is None or any(warning in w for w in r["warnings"])


def test_model_failure_and_context(spark):
    def fails(messages):
        raise RuntimeError("x" * 500)

    r = answer.by_model(retrieved(spark), fails).first()
    assert r["fallback_used"] and all(len(w) < 140 for w in r["warnings"])
    r = answer.by_model(retrieved(spark, size=500), lambda m: '{"answer":"A","used_chunk_ids":["c1"]}', cap=100).first()
    assert any("truncated" in w for w in r["warnings"]) and len(r["evidence"][0]["chunk_text"]) == 500
    assert answer.by_model(retrieved(spark, evidence=False), fails).first()["answer"] == answer.NO_EVIDENCE
    payload = {"evidence": [{"chunk_id": "a", "chunk_text": "x" * 300}, {"chunk_id": "b", "chunk_text": "y" * 150}]}
    sent, cut = answer.fit_context(payload, 260)
    assert cut and len(sent) <= 260 and payload["evidence"][0]["chunk_text"] == "x" * 300


def test_retrieval(spark):
    edge = "source_entity string, relation_type string, target_entity string, negated boolean, confidence double, justification string, source_chunk_id string, source_doc_id string, source_reliability string, ord long, pos int"
    rows = [("Alpha", "leads", "Beta", False, 0.9, "", "c1", "d", "high", 0, 0), ("Gamma Ray", "part_of", "Beta", False, 0.5, "", "c2", "d", "low", 1, 0), ("Beta", "leads", "Delta", False, 0.5, "", "c9", "d", "low", 2, 0), ("Alpha", "leads", "Beta", True, 0.2, "", "c3", "d", "low", 3, 0), ("Far", "leads", "Farther", False, 0.2, "", "c1", "d", "low", 4, 0)]
    edges = spark.createDataFrame(rows, edge)
    ents = spark.createDataFrame([(n, [a] if a else []) for n, a in (("Alpha", "First One"), ("Beta", None), ("Gamma Ray", None), ("Delta", None), ("Far", None), ("Farther", None))], "canonical_name string, aliases array<string>")
    chunks = spark.createDataFrame([(f"c{i}", "d", i, f"text {i}", "high", None) for i in (1, 2, 3)], "chunk_id string, doc_id string, page_number int, chunk_text string, source_reliability string, source_path string")
    qs = spark.createDataFrame([(1, "Who follows the first one?"), (2, "gamma rays and more"), (3, "nothing known here")], "qid long, question string")
    got = {r["qid"]: r for r in retrieve.retrieve(qs, ents, edges, chunks, max_hops=2, max_edges=3, max_evidence=2).collect()}
    assert got[1]["seed_entities"] == ["Alpha"] and got[2]["seed_entities"] == ["Gamma Ray"] and got[3]["seed_entities"] == []
    assert [r["target_entity"] for r in got[1]["relations"]][:2] == ["Beta", "Beta"] and len(got[1]["relations"]) == 3
    assert {p["hop_count"] for p in got[1]["paths"]} == {1, 2} and got[1]["paths"][0]["nodes"] == ["Alpha", "Beta"]
    assert len(got[1]["conflicts"]) == 2 and [e["chunk_id"] for e in got[1]["evidence"]] == ["c1", "c3"]
    assert any("capped" in w for w in got[1]["warnings"]) and got[3]["warnings"] == ["no entity of the question is known"]
    out = {r["qid"]: r["answer"] for r in answer.answer_questions(qs, ents, edges, chunks).collect()}
    assert out[3] == answer.NO_EVIDENCE and "Alpha --leads--> Beta [d, p. 1]" in out[1]


def test_seeds_of_many_words(spark):
    long = "The Society for the Prevention of Cruelty to Animals of Upper Norwood"
    ents = spark.createDataFrame([("Alpha", ["alias of no less than six words"]), (long, None), ("Beta", [])], "canonical_name string, aliases array<string>")
    qs = spark.createDataFrame([(1, f"Who leads {long}?"), (2, "Is it the alias of no less than six words, or beta?"), (3, long), (4, ""), (5, None), (6, "beta")], "qid long, question string")
    want = {(1, long), (2, "Alpha"), (2, "Beta"), (3, long), (6, "Beta")}
    for threshold in (100, 90):
        assert {(r["qid"], r["canonical_name"]) for r in retrieve.seeds(qs, ents, threshold).collect()} == want
    assert retrieve.seeds(qs, ents.limit(0), 100).count() == 0
