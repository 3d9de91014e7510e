"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER
from .urlrep import RULES, STRONGEST, WEAKEST

OP2 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM words
), flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM sets LEFT JOIN least ON doc_id = x
"""

OP3 = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows
), spans AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, s.n, i, item_id FROM spans s JOIN windows v ON s.g = v.g AND s.n = v.n
), covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT docs.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


def op9(z: float = 1.645, threshold: float = 0.5) -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ordered) + " END"
    said = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ordered) + " END"

    def weight(level: str) -> str:
        return f"""(SELECT CASE WHEN n = 0 OR g < 2 OR n * n <= nn OR between_ <= 0 OR within <= 0 THEN {STRONGEST}
            ELSE least({STRONGEST}, greatest({WEAKEST}, within / between_ - 1)) END FROM (
          SELECT *, CASE WHEN n * n > nn THEN (yy - n * (y / n) * (y / n) - (g - 1) * within) / (n - nn / n) ELSE 0 END AS between_ FROM (
            SELECT *, (y / n) * (1 - y / n) AS within FROM (
              SELECT coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS y, coalesce(sum(CASE WHEN n > 0 THEN bad::DOUBLE * bad / n END), 0) AS yy,
                coalesce(sum(n::DOUBLE * n), 0) AS nn, count(CASE WHEN n > 0 THEN 1 END) AS g FROM {level}))))"""

    return rf"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)
), parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), judged AS (SELECT *, {rule} AS rule, {said} AS said FROM parts
), hosts AS (
  SELECT host, CASE WHEN len(string_split(host, '.')) > 2 THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END AS domain, string_split(host, '.')[-1] AS suffix,
    count(said) AS n, coalesce(sum(CASE WHEN said = 'block' THEN 1 WHEN said = 'allow' THEN 0 END), 0)::BIGINT AS bad FROM judged GROUP BY host
), domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY domain, suffix
), suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domains GROUP BY suffix
), w AS (SELECT {weight("hosts")} AS wh, {weight("domains")} AS wd, {weight("suffixes")} AS ws, CASE WHEN sum(n) > 0 THEN (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1) ELSE 0 END AS base FROM suffixes
), s AS (SELECT suffix, (bad + ws * base) / (n + ws) AS r FROM suffixes, w
), d AS (SELECT domain, (bad + wd * r) / (n + wd) AS r FROM domains JOIN s USING (suffix), w
), h AS (SELECT host, bad + wh * r AS a, n - bad + wh * (1 - r) AS b FROM hosts JOIN d USING (domain), w
), bound AS (SELECT host, greatest(0, a / (a + b) - {z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1))) >= {threshold} AS refused FROM h)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN refused THEN 'block' ELSE 'allow' END) AS verdict FROM judged JOIN bound USING (host)
"""


def sql() -> dict[str, str]:
    return {"op2_near_duplicates": OP2, "op3_decontamination": OP3, "op5_warc": OP5, "op9_url_filters": op9()}
