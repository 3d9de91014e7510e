"""DuckDB SQL for the named queries that SQL can express."""

from __future__ import annotations

from ..functions import vocab

PATHS = """paths AS (SELECT *, concat_ws('/', ['codex', 'wiki', 'novel', 'ephemera', 'misc'][doc_id % 5 + 1], source, doc_id || '.txt') AS path FROM documents),
kinds AS (SELECT *, CASE WHEN contains(lower(path), 'codex') THEN 'codex' WHEN contains(lower(path), 'wiki') THEN 'wiki' WHEN contains(lower(path), 'novel') THEN 'novel' WHEN contains(lower(path), 'ephemera') THEN 'ephemera' ELSE 'unknown' END AS doc_type,
  replace(regexp_replace(path, '[.][^./]*$', ''), '/', '__') AS id FROM paths),
pages_ AS (SELECT id AS doc_id, doc_type, CASE doc_type WHEN 'codex' THEN 'high' WHEN 'wiki' THEN 'medium' WHEN 'novel' THEN 'medium' ELSE 'low' END AS source_reliability FROM kinds)"""

RAW = """raw AS (
  SELECT event_id AS ord, CASE event_id % 3 WHEN 0 THEN 'User ' || user_id WHEN 1 THEN ' user ' || user_id || ' ' ELSE 'USER ' || user_id END AS s,
    ['allied_with', 'enemy_of', 'reports_to', 'leads', 'member_of', 'has_property'][event_id % 6 + 1] AS relation_type,
    CASE WHEN event_id % 5 <> 0 THEN 'Group ' || event_type WHEN event_id % 2 = 0 THEN 'Team ' || event_type ELSE 'TEAM ' || event_type END AS t,
    CASE WHEN event_id % 6 = 5 AND event_id % 4 <> 0 THEN ' level ' || floor(value / 25)::BIGINT || ' ' END AS property_value,
    CASE WHEN event_id % 10 = 9 THEN false ELSE value < 20 END AS negated, CASE WHEN event_id % 10 = 9 THEN 0.5::DOUBLE ELSE (event_id % 10) / 10::DOUBLE END AS confidence,
    CASE WHEN event_id % 10 = 9 THEN '' ELSE 'j' || event_id % 3 END AS justification,
    'e' || event_id AS source_chunk_id, 'd' || user_id % 10 AS source_doc_id, ['high', 'medium', 'low'][user_id % 3 + 1] AS source_reliability, event_id % 7 AS page
  FROM events)"""

CANON = """canon AS (SELECT lower(c) AS norm, c AS canonical FROM (SELECT DISTINCT 'User ' || user_id AS c FROM events WHERE user_id % 4 <> 0 UNION SELECT DISTINCT 'Group ' || event_type FROM events))"""

RES = f"""{RAW}, {CANON},
ends AS (SELECT lower(trim(s)) AS norm, s AS name, ord FROM raw UNION ALL SELECT lower(trim(t)), t, ord FROM raw WHERE relation_type <> 'has_property'),
stubs AS (SELECT norm, arg_min(name, ord) AS canonical FROM ends WHERE norm NOT IN (SELECT norm FROM canon) GROUP BY norm),
every AS (SELECT * FROM canon UNION ALL SELECT * FROM stubs),
res AS (SELECT raw.*, a.canonical AS source_entity, CASE WHEN relation_type = 'has_property' THEN t ELSE b.canonical END AS target_entity
  FROM raw JOIN every a ON lower(trim(s)) = a.norm LEFT JOIN every b ON lower(trim(t)) = b.norm),
edges AS (SELECT ord, source_entity, relation_type, target_entity, negated, confidence, justification, source_chunk_id, source_doc_id, source_reliability FROM res WHERE relation_type <> 'has_property')"""

NAMES = """names AS (SELECT DISTINCT unnest([p_name, upper(p_name), upper(left(p_name, 1)) || substr(p_name, 2), 'One of the ' || p_name, 'Part that is ' || p_name || ' of ' || p_brand]) AS name FROM part)"""
LEAK = "CASE " + " ".join(f"WHEN contains(lower(name), '{p}') THEN '{p}'" for p in vocab.LEAK_PATTERNS) + " END"
CLAUSE = " OR ".join(f"contains(lower(trim(name)), '{m}')" for m in vocab.CLAUSE_MARKERS)
WORDS = "len(list_filter(string_split(trim(name), ' '), lambda w: w <> ''))"
FIRST = "left(trim(name), 1)"
PROPER = f"NOT (trim(name) = '' OR {LEAK} IS NOT NULL OR ({WORDS} = 1 AND {FIRST} = lower({FIRST}) AND {FIRST} <> upper({FIRST})) OR trim(name) = lower(trim(name)) OR (({CLAUSE}) AND {WORDS} > 3) OR {WORDS} > 8)"
TAGS = "CASE WHEN negated THEN ' **[NEGATED]**' ELSE '' END || CASE WHEN confidence < 0.4 THEN ' `[low confidence]`' ELSE '' END"

PLACES = """level AS (SELECT ['high', 'medium', 'low'] AS l),
edges AS (
  SELECT c_name AS s, 'located_in' AS r, n_name AS t, (c_custkey % 10) / 10::DOUBLE AS confidence, 'customer:' || c_custkey AS chunk, 'customers' AS doc, l[c_custkey % 3 + 1] AS rel FROM customer JOIN nation ON c_nationkey = n_nationkey, level
  UNION ALL SELECT s_name, 'located_in', n_name, (s_suppkey % 10) / 10::DOUBLE, 'supplier:' || s_suppkey, 'suppliers', l[s_suppkey % 3 + 1] FROM supplier JOIN nation ON s_nationkey = n_nationkey, level
  UNION ALL SELECT n_name, 'part_of', r_name, 0.9::DOUBLE, 'nation:' || n_nationkey, 'nations', l[n_nationkey % 3 + 1] FROM nation JOIN region ON n_regionkey = r_regionkey, level),
ways AS (SELECT s AS here, t AS there FROM edges UNION SELECT t, s FROM edges)"""
RANK = "CASE rel WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"

def sql() -> dict[str, str]:
    out = {}
    out["q_doc_metadata"] = f"WITH {PATHS} SELECT doc_id, doc_type, source_reliability, 'txt' AS extension FROM pages_"
    out["q_norm_names"] = f"WITH {RAW} SELECT lower(trim(s)) AS norm, count(*) AS n FROM raw GROUP BY 1"
    out["q_proper_name"] = f"WITH {NAMES} SELECT name, {PROPER} AS proper, {LEAK} AS leak FROM names"
    out["q_valid_extractions"] = """
SELECT ord, m < 2 AS valid, CASE WHEN m < 2 THEN 1 END::INTEGER AS entities, CASE m WHEN 0 THEN 0 WHEN 1 THEN 1 END::INTEGER AS relations,
  CASE m WHEN 2 THEN 'not JSON' WHEN 3 THEN 'not an object' WHEN 4 THEN 'missing or invalid ''relations''' WHEN 5 THEN 'missing or invalid ''entities''' WHEN 7 THEN 'element without a required field' END AS error
FROM (SELECT event_id AS ord, event_id % 8 AS m FROM events) WHERE m <> 6"""
    out["q_validate_extractions"] = """
SELECT event_id AS ord, CASE event_id % 9
  WHEN 1 THEN 'Entity 0 has invalid entity_type: Planet' WHEN 2 THEN 'Relation 0 target_entity ''somewhere'' is not a proper name' WHEN 3 THEN 'Relation 0 target_entity ''Elsewhere'' is not defined'
  WHEN 4 THEN 'Relation 0 has invalid relation_type: likes' WHEN 5 THEN 'Relation 0 ''confidence'' out of range [0, 1]' WHEN 6 THEN 'Relation 0 is has_property without ''property_value'''
  WHEN 7 THEN 'Relation 0 missing ''confidence''' WHEN 8 THEN 'Relation 0 target_entity ''gv'' is not a proper name' END AS error FROM events"""
    out["q_stratified_sample"] = f"""
WITH {PATHS}, hashed AS (SELECT doc_id, doc_type, md5('0' || doc_id) AS h FROM pages_
), ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_type ORDER BY h, doc_id) AS r FROM hashed
), taken AS (SELECT * FROM ranked WHERE doc_type <> 'unknown' AND r <= 3
), rest AS (SELECT * FROM hashed WHERE doc_id NOT IN (SELECT doc_id FROM taken)
), ordered AS (SELECT *, row_number() OVER (ORDER BY h, doc_id) AS q FROM rest)
SELECT doc_id, doc_type FROM taken UNION ALL SELECT doc_id, doc_type FROM ordered WHERE q <= greatest(0, 15 - (SELECT count(*) FROM taken))"""
    out["q_indel_pairs"] = """
WITH n AS (SELECT DISTINCT lower(trim(p_name)) AS s FROM part
), c AS (SELECT s, list_transform(string_split(s, ''), lambda x: [ord(x)]) AS l FROM n
), p AS (SELECT x.s AS a, y.s AS b, x.l AS la, y.l AS lb FROM c x JOIN c y ON x.s < y.s
), d AS (SELECT a, b, list_reduce(list_prepend(list_transform(list_prepend([0], la), lambda z: 0), lb), lambda prev, ch:
    list_reduce(list_prepend([0], list_transform(range(1, len(la) + 1), lambda j: [j::INTEGER])), lambda acc, j: list_append(acc, CASE WHEN la[j[1]][1] = ch[1] THEN prev[j[1]] + 1 ELSE greatest(acc[j[1]], prev[j[1] + 1]) END)))[-1] AS lcs FROM p)
SELECT a, b, round_even(200.0 * lcs / (len(a) + len(b)), 0)::INTEGER AS ratio FROM d WHERE round_even(200.0 * lcs / (len(a) + len(b)), 0) >= 60"""
    out["q_resolve_relations"] = f"WITH {RES} SELECT ord, source_entity, relation_type, target_entity, negated, confidence, justification, source_chunk_id, source_doc_id, source_reliability FROM res"
    out["q_stub_entities"] = f"""
WITH {RES}, named AS (SELECT source_entity AS canonical_name, ord, source_chunk_id FROM res UNION ALL SELECT target_entity, ord, source_chunk_id FROM edges)
SELECT canonical_name, 'unknown' AS entity_type, min(ord) AS ord, arg_min(source_chunk_id, ord) AS chunk_id FROM named WHERE canonical_name NOT IN (SELECT canonical FROM canon) GROUP BY canonical_name"""
    out["q_properties"] = f"WITH {RES} SELECT ord, source_entity AS owner, coalesce(property_value, t, '') AS property_value, negated, confidence, source_doc_id FROM res WHERE relation_type = 'has_property'"
    out["q_dedup_relations"] = f"WITH {RES} SELECT source_entity, relation_type, target_entity, negated, justification, source_doc_id, source_reliability, min(ord) AS ord FROM edges GROUP BY ALL"
    out["q_negation_conflicts"] = f"""
WITH {RES}, g AS (
  SELECT source_entity AS owner, lower(trim(source_entity)) AS source, lower(trim(target_entity)) AS target, relation_type,
    string_agg(source_doc_id, ', ' ORDER BY ord) FILTER (NOT negated) AS affirmed_by, string_agg(source_doc_id, ', ' ORDER BY ord) FILTER (negated) AS negated_by FROM edges GROUP BY ALL)
SELECT *, 'NEGATION CONFLICT on ''' || relation_type || ''' between ' || source || ' and ' || target || ': affirmed by [' || affirmed_by || '] vs negated by [' || negated_by || ']' AS description
FROM g WHERE affirmed_by IS NOT NULL AND negated_by IS NOT NULL"""
    sets = ", ".join(str(list(s)) for s in vocab.CONTRADICTORY)
    out["q_contradictory_types"] = f"""
WITH {RES}, sets AS (SELECT unnest([{sets}]) AS types
), g AS (
  SELECT source_entity AS owner, lower(trim(source_entity)) AS source, lower(trim(target_entity)) AS target, array_to_string(types, ', ') AS types,
    string_agg('''' || relation_type || ''' from ' || source_doc_id || ' (reliability: ' || source_reliability || ')', '; ' ORDER BY ord) AS involved, count(DISTINCT relation_type) AS k
  FROM edges JOIN sets ON list_contains(types, relation_type) WHERE NOT negated GROUP BY ALL)
SELECT owner, source, target, types, involved, 'CONTRADICTORY RELATIONS {{' || types || '}} between ' || source || ' and ' || target || ': ' || involved AS description FROM g WHERE k >= 2"""
    out["q_relation_type_counts"] = f"WITH {RES} SELECT relation_type, count(*) AS n FROM edges GROUP BY 1"
    out["q_entity_type_counts"] = f"""
WITH {RES}, ent AS (SELECT CASE WHEN starts_with(canonical, 'User') THEN 'Character' ELSE 'Faction' END AS entity_type FROM canon
  UNION ALL SELECT 'unknown' FROM (SELECT source_entity AS c FROM res UNION SELECT target_entity FROM edges) WHERE c NOT IN (SELECT canonical FROM canon))
SELECT entity_type, count(*) AS n FROM ent GROUP BY 1"""
    out["q_graph_stats"] = f"WITH {RES} SELECT count(*) AS total_relations, count(*) FILTER (negated) AS negated_relations, count(*) FILTER (confidence < 0.4) AS low_confidence_relations FROM edges"
    first = lambda c: f"arg_min({c}, ord)"
    tail = "coalesce(string_agg('; also: \"' || justification || '\" [' || source_doc_id || ']', '' ORDER BY ord) FILTER (r > 1), '')"
    out["q_note_rollup"] = f"""
WITH {RES}, n AS (SELECT *, row_number() OVER (PARTITION BY source_entity, target_entity, relation_type, negated ORDER BY ord) AS r FROM edges
), g AS (SELECT source_entity, target_entity, relation_type, negated, count(*)::INTEGER AS sources, {first("confidence")} AS confidence, {first("source_doc_id")} AS doc, {first("source_reliability")} AS level,
    {first("justification")} || {tail} AS j FROM n GROUP BY ALL)
SELECT source_entity, target_entity, relation_type, negated, sources, '- [[' || target_entity || ']] (`' || relation_type || '`)' || {TAGS} || ' — "' || j || '" [source: ' || doc || ', reliability: ' || level || ']' AS line FROM g"""
    out["q_property_rollup"] = f"""
WITH {RES}, p AS (SELECT ord, source_entity AS owner, coalesce(property_value, t, '') AS pv, negated, confidence, justification, source_doc_id, source_reliability FROM res WHERE relation_type = 'has_property'
), n AS (SELECT *, trim(pv) AS v, row_number() OVER (PARTITION BY owner, trim(pv), negated ORDER BY ord) AS r FROM p WHERE trim(pv) <> ''
), g AS (SELECT owner, v, negated, count(*)::INTEGER AS sources, {first("pv")} AS property_value, {first("confidence")} AS confidence, {first("source_doc_id")} AS doc, {first("source_reliability")} AS level,
    {first("justification")} || {tail} AS j FROM n GROUP BY ALL)
SELECT owner, property_value, negated, sources, '- ' || property_value || {TAGS} || ' — "' || j || '" [source: ' || doc || ', reliability: ' || level || ']' AS line FROM g"""
    out["q_first_mentions"] = f"WITH {RAW} SELECT lower(trim(s)) AS canonical_name, t AS doc_id, min(ord) AS ord FROM raw GROUP BY 1, 2"
    out["q_name_audit"] = f"""
WITH {NAMES}, a AS (SELECT {LEAK} AS leak, NOT ({PROPER}) AS d, len(name) % 2 = 0 AS u FROM names)
SELECT count(*) AS notes, count(leak) AS leaks, count(*) FILTER (d) AS descriptive, count(*) FILTER (u) AS unknown, count(leak) + count(*) FILTER (d) AS total_problems FROM a"""
    out["q_pending_chunks"] = f"WITH {PATHS} SELECT doc_id, source_reliability FROM pages_ WHERE source_reliability <> 'low'"
    out["q_display_text"] = rf"""
WITH {RAW} SELECT ord, replace(relation_type, '_', ' ') AS label, CASE WHEN ord % 2 = 0 THEN '[' || source_doc_id || ', p. ' || page || ']' ELSE '[' || source_doc_id || ', ' || source_chunk_id || ']' END AS citation,
  left(trim(regexp_replace(s || '/' || t || '?. ', '[<>:"/\\|?*]', '_', 'g'), '. '), 200) AS filename, CASE WHEN len(t) > 8 THEN left(t, 8) || '... [excerpt truncated]' ELSE t END AS excerpt FROM raw"""
    out["q_seed_link"] = """
WITH names AS (SELECT r_name AS n FROM region UNION SELECT n_name FROM nation UNION SELECT c_name FROM customer UNION SELECT s_name FROM supplier
), q AS (SELECT r_regionkey::BIGINT AS qid, ' ' || regexp_replace(lower('What belongs to ' || r_name || '?'), '[^a-z0-9_#-]+', ' ', 'g') || ' ' AS t FROM region)
SELECT qid, n AS canonical_name, 100 AS ratio FROM q JOIN names ON contains(t, ' ' || regexp_replace(lower(n), '[^a-z0-9_#-]+', ' ', 'g') || ' ')"""
    out["q_multi_hop"] = f"""
WITH RECURSIVE {PLACES}, walk AS (
  SELECT r_regionkey::BIGINT AS qid, r_name AS node, 0 AS hop, [r_name] AS nodes FROM region
  UNION ALL SELECT qid, there, hop + 1, list_append(nodes, there) FROM walk JOIN ways ON node = here WHERE hop < 2 AND NOT list_contains(nodes, there))
SELECT qid, node, hop, array_to_string(nodes, '>') AS path FROM (SELECT *, row_number() OVER (PARTITION BY qid, node ORDER BY hop, nodes) AS k FROM walk) WHERE k = 1"""
    out["q_evidence_topk"] = f"""
WITH {PLACES}, touched AS (SELECT DISTINCT n_nationkey::BIGINT AS qid, edges.* FROM nation JOIN edges ON n_name = s OR n_name = t
), kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {RANK}, confidence DESC, s, r, t, doc, chunk) AS k FROM touched) WHERE k <= 40
), ev AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {RANK}, chunk) AS k2 FROM kept)
SELECT qid, k2 AS rank, chunk AS chunk_id, doc AS doc_id, s || ' ' || replace(r, '_', ' ') || ' ' || t AS chunk_text FROM ev WHERE k2 <= 10"""
    out["q_fallback_answer"] = f"""
WITH {PLACES}, touched AS (SELECT r_regionkey::BIGINT AS qid, edges.* FROM region JOIN edges ON r_name = t OR r_name = s
), kept AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {RANK}, confidence DESC, s, r, t, doc, chunk) AS k FROM touched
), ev AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {RANK}, chunk) AS e FROM kept WHERE k <= 40
), lines AS (SELECT qid, string_agg('- ' || s || ' --' || replace(r, '_', ' ') || '--> ' || t || ' ' || CASE WHEN e <= 10 THEN '[' || doc || ', ' || chunk || ']' ELSE '[?, ' || chunk || ']' END || CASE WHEN e <= 10 AND rel = 'low' THEN ' (low reliability)' ELSE '' END, chr(10) ORDER BY k) AS body,
    string_agg(chunk, ',' ORDER BY k) FILTER (e <= 10) AS used FROM ev WHERE k <= 5 GROUP BY qid)
SELECT qid, 'What belongs to ' || r_name || '?' AS question, 'The available document evidence shows the following connections:' || chr(10) || body AS answer, used AS used_chunk_ids, true AS grounded, true AS fallback_used
FROM lines JOIN region ON qid = r_regionkey"""
    turned = ", ".join(f"('{a}', '{b}')" for a, b in vocab.INVERSES.items())
    out["q_inverse_edges"] = f"""
WITH {RES}, inv(r, i) AS (VALUES {turned})
SELECT ord, source_entity, relation_type, target_entity, negated, false AS derived FROM edges
UNION ALL SELECT ord, target_entity, i, source_entity, negated, true FROM edges JOIN inv ON relation_type = r"""
    clash = f"""{RES}, sets AS (SELECT unnest([{sets}]) AS types
), keyed AS (SELECT *, lower(trim(target_entity)) AS tn FROM edges
), negs AS (SELECT source_entity, tn, relation_type FROM keyed GROUP BY ALL HAVING bool_or(negated) AND bool_or(NOT negated)
), excl AS (SELECT source_entity, tn, types FROM keyed JOIN sets ON list_contains(types, relation_type) WHERE NOT negated GROUP BY ALL HAVING count(DISTINCT relation_type) > 1
), clash AS (SELECT * FROM negs UNION SELECT source_entity, tn, unnest(types) FROM excl
), kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_entity ORDER BY ord) AS k FROM keyed) WHERE k <= 40
), con AS (SELECT *, row_number() OVER (PARTITION BY source_entity ORDER BY k) AS c FROM kept SEMI JOIN clash USING (source_entity, tn, relation_type))"""
    out["q_kept_conflicts"] = f"WITH {clash} SELECT source_entity AS qid, ord, relation_type, target_entity, negated FROM con"
    line = "source_entity || ' --' || replace(relation_type, '_', ' ') || '--> ' || target_entity || ' ' || CASE WHEN e IS NULL THEN '[?, ' || source_chunk_id || ']' WHEN ord % 2 = 0 THEN '[' || source_doc_id || ', p. ' || ord % 7 || ']' ELSE '[' || source_doc_id || ', ' || source_chunk_id || ']' END"
    out["q_disputed_answer"] = f"""
WITH {clash}, ev AS (
  SELECT * FROM (SELECT source_entity, ord, row_number() OVER (PARTITION BY source_entity ORDER BY {RANK.replace("rel", "source_reliability")}, source_chunk_id) AS e
    FROM kept WHERE ord % 3 <> 0 AND source_entity NOT LIKE '%7') WHERE e <= 10
), shown AS (SELECT kept.*, 0 AS part, k AS place, e FROM kept LEFT JOIN ev USING (source_entity, ord) WHERE k <= 5
  UNION ALL SELECT con.* EXCLUDE (c), 1, c, e FROM con LEFT JOIN ev USING (source_entity, ord) WHERE c <= 5
), lines AS (SELECT source_entity,
    string_agg('- ' || {line} || CASE WHEN e IS NOT NULL AND source_reliability = 'low' THEN ' (low reliability)' ELSE '' END, chr(10) ORDER BY place) FILTER (part = 0) AS facts,
    string_agg('- (Disputed) ' || {line}, chr(10) ORDER BY place) FILTER (part = 1) AS disputes FROM shown GROUP BY 1
), cited AS (SELECT source_entity, ord, any_value(source_chunk_id) AS chunk, any_value(source_doc_id || '/' || source_reliability || CASE WHEN ord % 2 = 0 THEN '/' || ord % 7 ELSE '' END) AS place_, min(part * 100 + place) AS first_ FROM shown WHERE e IS NOT NULL GROUP BY 1, 2
), used AS (SELECT source_entity, string_agg(chunk, ',' ORDER BY first_) AS ids, string_agg(chunk || '/' || place_, ',' ORDER BY first_) AS places FROM cited GROUP BY 1)
SELECT source_entity AS qid, CASE WHEN source_entity NOT IN (SELECT source_entity FROM ev) THEN 'I cannot answer this question because the available evidence does not contain relevant information.'
    ELSE 'The available document evidence shows the following connections:' || chr(10) || facts || coalesce(chr(10) || chr(10) || 'Disputed Findings:' || chr(10) || disputes, '') END AS answer,
  coalesce(ids, '') AS used_chunk_ids, coalesce(places, '') AS citations, ids IS NOT NULL AS grounded
FROM lines LEFT JOIN used USING (source_entity)"""
    return out
