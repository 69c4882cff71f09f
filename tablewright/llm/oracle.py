"""DuckDB SQL for the corpus queries that SQL can express, over the driver's tables."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
UNSPACED = r"'[^\x20\x09-\x0D]+'"

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, {LETTERS}) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWERED}, {LETTERS}) AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT k FROM windows),
runs AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS run FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes)),
found AS (SELECT DISTINCT doc_id, item_id, s, windows.k AS k FROM runs JOIN windows ON runs.run = windows.run AND runs.k = windows.k),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, {UNSPACED}) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM d WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM common JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * c >= 90 * (a.n + b.n - c)),
pairs AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT u AS a, u AS b FROM pairs UNION SELECT reach.a, pairs.v FROM reach JOIN pairs ON reach.b = pairs.u),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id
FROM d LEFT JOIN sizes ON d.doc_id = sizes.doc_id LEFT JOIN roots ON d.doc_id = a
"""

# The keywords of assigned secrets; kinds, patterns, the group that is measured and its least size.
KEYWORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
KINDS = (
    ("assign", rf"""({KEYWORDS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
    ("forge", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
)


def spans_of(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    """A match begins after all earlier matches and the gaps up to it."""
    total = lambda what: f"coalesce(list_sum(list_transform({what}, lambda v: length(v))), 0)"
    return f"""
  SELECT doc_id, {number} AS rule, '{kind}' AS kind, {total("gaps[1:k]")} + {total("m[1:k - 1]")} AS a, length(m[k]) AS size
  FROM (
    SELECT *, unnest(range(1, len(m) + 1)) AS k
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS measured, string_split_regex(t, '{pattern}') AS gaps FROM d)
  ) WHERE length(measured[k]) >= {least}"""


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(spans_of(i, *k) for i, k in enumerate(KINDS))}),
listed AS (
  SELECT doc_id, count(*) FILTER (rule = 0) AS n_assign, count(*) FILTER (rule = 1) AS n_access, count(*) FILTER (rule = 2) AS n_hex,
    string_agg(kind || ':' || a || ':' || (a + size), ',' ORDER BY a, rule) FILTER (rule < 3) AS base,
    string_agg(kind || ':' || a || ':' || (a + size), ',' ORDER BY a, rule) AS spans
  FROM found GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed ON d.doc_id = listed.doc_id
"""
