"""DuckDB SQL for those queries of the training-data operators that SQL can express."""

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_HEX = "('0x' || substr(h, {}, 5))::BIGINT"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_HEX.format(1 + 5 * i)} >> {s}) & 31)::INT + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))

OP1 = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to, url
FROM g
"""

OP2 = """
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM l),
g AS (SELECT key, count(DISTINCT source) AS sites, min((doc_id, pos)) AS home FROM t WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= 3),
m AS (SELECT t.*, g.key IS NOT NULL AND (t.doc_id, t.pos) <> g.home AS gone FROM t LEFT JOIN g ON t.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM m GROUP BY doc_id
"""

OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)] END) AS g FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n_shingles + y.n_shingles - shared)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS node, doc_id AS goal FROM n UNION SELECT node, edge.b FROM reach JOIN edge ON edge.a = reach.goal)
SELECT doc_id, n_shingles, min(goal) AS component_id, doc_id = min(goal) AS kept FROM n JOIN reach ON node = doc_id GROUP BY doc_id, n_shingles
"""

OP9 = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP10 = f"""
WITH d AS (SELECT doc_id, sha256({_LOW.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1, "op2_line_dedup": OP2, "op6_near_dedup": OP6, "op9_topk_search": OP9, "op10_exact_dedup": OP10}
