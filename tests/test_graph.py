"""Resolution, relations, contradictions, export, notes and statistics."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lorequarry.functions import names, text
from lorequarry.operators import export, notes, relations, resolve, sample, stats, validate
from lorequarry.plans import build
from lorequarry.sources import records

META = "struct<chunk_id:string,doc_id:string,source_reliability:string,page_number:int>"
MENTION = f"ord long, pos int, name string, entity_type string, aliases array<string>, meta {META}"


def mentions(spark, rows):
    return spark.createDataFrame([(i, 0, *r[:2], list(r[2]) if len(r) > 2 else [], (f"c{i}", "d", "high", 1)) for i, r in enumerate(rows)], MENTION)


def resolved(spark, rows):
    r = resolve.resolve(mentions(spark, rows))
    ent = {x["canonical_name"]: (x["entity_type"], sorted(x["aliases"])) for x in r.entities.collect()}
    return ent, {x["norm"]: x["canonical"] for x in r.canonical.collect()}, sorted((x["ord"], x["entity_a"], x["entity_b"], x["similarity"], x["type_a"], x["type_b"]) for x in r.review.collect())


def test_each_row_of_the_decision_table(spark):
    ent, canon, review = resolved(spark, [
        ("Iron Covenant", "Faction", ["The Covenant"]), ("iron covenant ", "Location"), ("IRON COVENANT", "Faction", ["Late Alias"]), ("the covenant", "unknown"),
        ("Stub Thing", "unknown"), ("stub thing", "Artifact"), ("Long Enough Name One", "Character"), ("Long Enough Name Ones", "Character"), ("Long Enough Name Onez", "Location"),
        ("Entity A", "unknown"), ("Entity B", "unknown"), ("Entity C", "unknown"), ("Late Alias", "Concept"),
    ])
    assert ent["Iron Covenant"] == ("Faction", ["IRON COVENANT", "Late Alias", "The Covenant", "iron covenant ", "the covenant"])
    assert canon["the covenant"] == "Iron Covenant" and canon["late alias"] == "Late Alias"
    assert ent["Stub Thing"][0] == "Artifact" and canon["long enough name ones"] == "Long Enough Name One"
    assert (1, "Iron Covenant", "iron covenant ", 1.0, "Faction", "Location") in review
    assert any(r[0] == 8 and r[2] == "Long Enough Name Onez" and r[3] >= 0.92 for r in review) and "Long Enough Name Onez" in ent
    assert (10, "Entity A", "Entity B", 0.88, "unknown", "unknown") in review and (11, "Entity A", "Entity C", 0.88, "unknown", "unknown") in review


def test_components_fold_like_the_whole(spark):
    r = random.Random(8)
    bases = ["Vault Seven", "Vault Eleven", "Kael Ashborn", "Kaela Ashborn", "Northern Gate", "Northern Gates", "Nothern Gate", "Iron", "Irons", "Ön"]
    rows = []
    for _ in range(160):
        n = r.choice(bases)
        n = r.choice([n, n.upper(), n.lower(), n + r.choice("abcs"), n[:-1]])
        rows.append((n, r.choice(["Location", "Character", "unknown"]), [r.choice(bases)] if r.random() < 0.15 else []))
    ent, canon, review = resolved(spark, rows)
    e, k, q = resolve.fold((i, 0, n, t, a) for i, (n, t, a) in enumerate(rows))
    assert ent == {n: (v[0], sorted(v[1])) for n, v in e.items()}
    assert canon == k
    assert review == sorted((o, a, b, s, ta, tb) for a, b, s, ta, tb, o, _ in q)


def test_indel_ratio_in_both_forms(spark):
    r = random.Random(1)
    pairs = [("", ""), ("", "a"), ("entity a", "entity b"), ("abc", "abc")] + [("".join(r.choice("abcé ") for _ in range(r.randrange(12))), "".join(r.choice("abcé ") for _ in range(r.randrange(12)))) for _ in range(150)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.indel_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for x in got:
        a, b = x["a"], x["b"]
        row = [0] * (len(a) + 1)
        for c in b:
            diag, new = 0, [0]
            for i, d in enumerate(a, 1):
                new.append(row[i - 1] + 1 if c == d else max(new[-1], row[i]))
            row = new
        want = 100 if not a and not b else 0 if not a or not b else round(200 * row[-1] / (len(a) + len(b)))
        assert names.indel_ratio(a, b) == want == x["r"], (a, b)


RAW = f"ord long, pos int, source_entity string, relation_type string, target_entity string, property_value string, negated boolean, confidence double, justification string, source_chunk_id string, source_doc_id string, source_reliability string, meta {META}"


def raw(spark, rows):
    return relations.with_defaults(spark.createDataFrame([(i, 0, s, t, o, v, n, c, j, None, None, None, (f"c{i}", f"d{i}", "low", None)) for i, (s, t, o, v, n, c, j) in enumerate(rows)], RAW))


@pytest.mark.parametrize("least", [60, 67, 68, 72, 85])
def test_similar_names_without_a_common_bigram(spark, least):
    r = random.Random(9)
    given = {"abc", "axbxc", "a", "ab", "xa", "abcdef", "axbxcxdxexf"} | {"".join(r.choice("abcxyz") for _ in range(r.randrange(1, 9))) for _ in range(150)}
    got = {(x["a"], x["b"], x["ratio"]) for x in resolve.similar_names(spark.createDataFrame([(x,) for x in sorted(given)], "norm string"), least).collect()}
    assert got == {(a, b, names.indel_ratio(a, b)) for a in given for b in given if a < b and names.indel_ratio(a, b) >= least}


def test_stubs_properties_and_defaults(spark):
    canon = spark.createDataFrame([("known", "Known"), ("alias", "Known")], "norm string, canonical string")
    df = raw(spark, [
        (" KNOWN ", "leads", "New Thing", None, None, None, None), ("NEW THING", "leads", "alias", None, True, 0.2, "x"), ("new thing", "has_property", "", "shiny", None, None, None),
        ("Ghost", "has_property", "fallback", None, None, 0.9, None), ("Echo", "related_to", "ECHO", None, None, None, None), ("echo", "related_to", "Known", None, None, None, None),
    ])
    res = relations.resolve_ends(df, canon).orderBy("ord").collect()
    assert [(r["source_entity"], r["target_entity"]) for r in res] == [("Known", "New Thing"), ("New Thing", "Known"), ("New Thing", ""), ("Ghost", "fallback"), ("Echo", "ECHO"), ("ECHO", "Known")]
    assert (res[0]["negated"], res[0]["confidence"], res[0]["justification"], res[0]["source_chunk_id"], res[0]["source_reliability"]) == (False, 0.5, "", "c0", "low")
    again = relations.resolve_ends(df, canon)
    stubs = {r["canonical_name"]: r["meta"]["chunk_id"] for r in relations.stub_entities(again, spark.createDataFrame([("Known",)], "canonical_name string")).collect()}
    assert stubs == {"New Thing": "c0", "Ghost": "c3", "Echo": "c4", "ECHO": "c4"}
    props = {r["owner"]: r["property_value"] for r in relations.properties(again).collect()}
    assert props == {"New Thing": "shiny", "Ghost": "fallback"}
    assert relations.edges(again).count() == 4


def test_contradictions(spark):
    canon = spark.createDataFrame([(x.lower(), x) for x in "ABCD"], "norm string, canonical string")
    df = raw(spark, [("A", "leads", "B", None, False, 0.5, ""), ("A", "leads", "B", None, True, 0.5, ""), ("A", "reports_to", "B", None, False, 0.5, ""), ("C", "allied_with", "D", None, False, 0.5, ""),
                     ("D", "enemy_of", "C", None, False, 0.5, ""), ("C", "enemy_of", "D", None, True, 0.5, ""), ("C", "member_of", "D", None, False, 0.5, "")])
    e = relations.edges(relations.resolve_ends(df, canon))
    n = {r["description"] for r in relations.negation_conflicts(e).collect()}
    assert n == {"NEGATION CONFLICT on 'leads' between a and b: affirmed by [d0] vs negated by [d1]"}
    c = {r["description"] for r in relations.contradictory_types(e).collect()}
    assert c == {"CONTRADICTORY RELATIONS {leads, reports_to} between a and b: 'leads' from d0 (reliability: low); 'reports_to' from d2 (reliability: low)"}
    assert relations.inverse_edges(e).where("derived").count() == 2


LINES = [
    {"entities": [{"name": "Entity A", "type": "X"}, {"name": "Entity B", "type": "X"}], "relations": [{"source_entity": "Entity A", "relation_type": "depends_on", "target_entity": "Entity B", "source_chunk_id": "c1", "source_doc_id": "d1", "source_reliability": "high"}], "chunk_meta": {"chunk_id": "c1", "doc_id": "d1", "source_reliability": "high", "page_number": 1}},
    {"entities": [{"name": "Entity C", "type": "X"}], "relations": [], "chunk_meta": {"chunk_id": "c2", "doc_id": "d1", "source_reliability": "high", "page_number": ""}},
]


def test_rebuild(spark, tmp_path):
    source = tmp_path / "in.jsonl"
    source.write_text("\n".join([json.dumps(LINES[0]), json.dumps(LINES[1]), "this is a malformed line", " "]))
    before = source.read_bytes()
    out = build.rebuild(spark, str(source), str(tmp_path / "graph"), str(tmp_path / "vault"), str(tmp_path / "stats"))
    assert (out["valid_records"], out["malformed_records"], out["entity_count"], out["relation_count"], out["notes"]) == (2, 1, 3, 1, 3)
    assert source.read_bytes() == before
    entities, edges = export.read_tables(spark, str(tmp_path / "graph"))
    r = edges.first()
    assert (r["source_chunk_id"], r["source_doc_id"], r["source_reliability"], r["negated"], r["confidence"]) == ("c1", "d1", "high", False, 0.5)
    note = (tmp_path / "vault" / "Entity A.md").read_text()
    assert note == '---\nentity_type: unknown\n---\n\n# Entity A\n\n## Relations\n\n- [[Entity B]] (`depends_on`) — "" [source: d1, reliability: high]\n\n## Mentions\n\n- d1 (c1) [reliability: high]\n'
    s = spark.read.json(str(tmp_path / "stats")).first()
    assert s["malformed_output_rate"] == "1/3 (33.3%)" and s["ambiguous_merges_flagged"] == 2
    assert {r["name"]: r["entity_type"] for r in records.read_notes(spark, str(tmp_path / "vault")).collect()} == {"Entity A": "unknown", "Entity B": "unknown", "Entity C": "unknown"}
    with pytest.raises(FileNotFoundError):
        build.rebuild(spark, str(tmp_path / "none.jsonl"), str(tmp_path / "g"))
    (tmp_path / "bad.jsonl").write_text("nothing\n")
    with pytest.raises(ValueError):
        build.rebuild(spark, str(tmp_path / "bad.jsonl"), str(tmp_path / "g"))


def test_document_export_and_bad_graphs(spark, tmp_path):
    good, _ = records.parse_extractions(spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(LINES)], "ord long, line string"))
    g = build.build(good)
    doc = export.document(g.entities.drop("late"), g.edges)
    assert doc == export.document(g.entities.drop("late"), g.edges)
    path = tmp_path / "graph.json"
    path.write_text(doc)
    assert export.load_document(spark, str(path))["metadata"] == {"schema_version": "1.0", "entity_count": 3, "relation_count": 1}
    for i, bad in enumerate(["[]", doc.replace('"entity_count": 3', '"entity_count": 99'), '{"metadata": {}, "entities": {}}']):
        (tmp_path / f"bad{i}.json").write_text(bad)
        with pytest.raises(ValueError):
            export.load_document(spark, str(tmp_path / f"bad{i}.json"))
    with pytest.raises(FileNotFoundError):
        export.load_document(spark, str(tmp_path / "none.json"))


def test_note_sections(spark):
    canon = spark.createDataFrame([("a", "A")], "norm string, canonical string")
    df = raw(spark, [("A", "leads", "B", None, False, 0.39, "one"), ("A", "leads", "B", None, False, 0.9, "two"), ("A", "has_property", "", " red ", True, 0.4, "p"), ("A", "has_property", "", "red", True, 0.4, "q"), ("A", "has_property", "", "  ", False, 0.4, "r")])
    res = relations.resolve_ends(df, canon)
    e = relations.edges(res)
    ent = spark.createDataFrame([("A", "Faction", ["Zé", "A", "Ab"]), ("B/C", "unknown", []), ("B:C", "unknown", [])], "canonical_name string, entity_type string, aliases array<string>")
    seen = spark.createDataFrame([("A", 1, 0, ("c1", "d1", "high", 1)), ("A", 0, 0, ("c1", "d1", "high", 1))], f"canonical_name string, ord long, pos int, meta {META}")
    rows = notes.notes(ent, e, relations.properties(res), relations.negation_conflicts(e), relations.contradictory_types(e), seen).collect()
    body = next(r["body"] for r in rows if r["filename"] == "A.md")
    assert body == (
        '---\nentity_type: Faction\naliases: ["Ab", "Z\\u00e9"]\n---\n\n# A\n\n## Relations\n\n- [[B]] (`leads`) `[low confidence]` — "one; also: "two" [d1]" [source: d0, reliability: low]\n\n'
        '## Properties\n\n-  red  **[NEGATED]** — "p; also: "q" [d3]" [source: d2, reliability: low]\n\n## Mentions\n\n- d1 (c1) [reliability: high]\n'
    )
    assert [r["clash"] for r in rows if r["filename"] == "B_C.md"] == [2, 2]


def test_validator_first_error_wins(spark):
    def ext(ents, rels):
        full = lambda r: {"source_entity": "Alpha", "relation_type": "leads", "target_entity": "Beta", "negated": False, "confidence": 0.5, "justification": "j"} | r
        return json.dumps({"entities": ents, "relations": [full(r) for r in rels]})

    ok = [{"name": "Alpha", "entity_type": "Faction"}, {"name": "Beta", "entity_type": "Faction", "aliases": ["Gamma "]}]
    cases = [
        (ok, [{}], None), (ok, [{"target_entity": "Gamma "}], "is not defined"), (ok, [{"source_entity": "Zeta"}], "source_entity 'Zeta'"), (ok, [{"relation_type": "likes"}], "invalid relation_type"), (ok, [{"confidence": 1.1}], "out of range"),
        (ok, [{"negated": None}], "missing 'negated'"), (ok, [{"relation_type": "has_property", "target_entity": ""}], "without 'property_value'"), (ok, [{"relation_type": "has_property", "property_value": "x"}], "but target_entity"),
        (ok, [{"target_entity": ""}], "empty 'target_entity'"), (ok, [{"target_entity": "severe terrain"}], "not a proper name"), ([{"name": "alpha", "entity_type": "Faction"}], [{"confidence": 9}], "Entity 0 name"), ([{"name": "Alpha", "entity_type": "Planet"}], [], "invalid entity_type"),
    ]
    df = spark.createDataFrame([(i, ext(e, r)) for i, (e, r, _) in enumerate(cases)], "ord long, line string")
    good, bad = records.parse_extractions(df)
    got = {r["ord"]: r["error"] for r in validate.with_error(good).collect()}
    assert bad.count() == 0
    for i, (_, _, want) in enumerate(cases):
        assert (got[i] is None) if want is None else want in got[i], (i, got[i])


def test_lenient_lines(spark):
    lines = ['{"entities": [], "relations": []}', "nope", "[]", '[{"entities": [], "relations": []}]', '{"entities": []}', '{"entities": {}, "relations": []}', '{"entities": [{"name": null}], "relations": []}', '{"entities": [], "relations": [], "more": 1}', '"text"', "{"]
    good, bad = records.parse_extractions(spark.createDataFrame(list(enumerate(lines)), "ord long, line string"))
    assert sorted(r["ord"] for r in good.collect()) == [0, 7]
    assert bad.count() == len(lines) - 2


def test_stats_formats(spark):
    assert stats.malformed_rate(1, 16) == "1/16 (6.2%)" and stats.malformed_rate(0, 0) == "0/0 (0.0%)"
    rows = spark.createDataFrame([(0, "b"), (1, "a"), (2, "a"), (3, "c")], "ord long, kind string")
    assert [tuple(r) for r in stats.counts_by(rows, "kind").collect()] == [("a", 2), ("b", 1), ("c", 1)]


def test_sampling_and_resume(spark):
    rows = spark.createDataFrame([(f"k{i}", "codex" if i < 3 else "wiki" if i < 20 else "other") for i in range(40)], "chunk_id string, doc_type string")
    got = [r["chunk_id"] for r in sample.stratified(rows, 5, 15).collect()]
    assert len(got) == len(set(got)) == 15 and {"k0", "k1", "k2"} <= set(got)
    assert sorted(got) == sorted(r["chunk_id"] for r in sample.stratified(rows.repartition(3), 5, 15).collect())
    assert sample.stratified(rows.limit(4), 5, 15).count() == 4
    done = spark.createDataFrame([("k0",), ("k0",), (None,)], "chunk_id string")
    assert sample.pending(rows, done).count() == 39
