"""DuckDB SQL for the search queries, written apart from the Spark plans."""

from __future__ import annotations

from ..config import FINANCE_TERMS, SMALL_CHUNKS, STOPWORDS, Chunking, Settings
from . import fixtures

_A = Settings().chunking
_SENTENCE = "[^.!?。！？]*[.!?。！？]|[^.!?。！？]+$"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: _text(x) if isinstance(x, str) else str(x)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names}))"


_STOP = ", ".join(map(_text, STOPWORDS))
_ASKED = f"asked AS {_values(fixtures.QUERIES, 'qid, query')}"
_NORM = r"norm AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS n FROM source)"
_SOURCE = "source AS (SELECT doc_id, text FROM documents)"


def _pieces(hard: int, least: int = 0) -> str:
    """Sentences, split where over-long: CTE p(doc_id, j, s, b)."""
    prefix = ", ".join(f"try(decode(encode(rest)[1:{hard - i}]))" for i in range(4))
    return f"""{_NORM},
sent AS (SELECT doc_id, i, trim(s) AS s FROM (
    SELECT doc_id, unnest(regexp_extract_all(n, '{_SENTENCE}')) AS s, generate_subscripts(regexp_extract_all(n, '{_SENTENCE}'), 1) AS i
    FROM norm WHERE strlen(n) >= {least}) WHERE trim(s) <> ''),
cut AS (
    SELECT doc_id, i, 0 AS k, s AS rest, CAST(NULL AS VARCHAR) AS piece FROM sent
    UNION ALL
    SELECT doc_id, i, k + 1, trim(decode(encode(rest)[c + 1:])), trim(decode(encode(rest)[1:c])) FROM (
        SELECT *, CASE WHEN sp > 300 THEN sp ELSE strlen(pre) END AS c FROM (
            SELECT *, strlen(pre) - strlen(regexp_extract(pre, '[^ ]*$')) - 1 AS sp FROM (
                SELECT *, coalesce({prefix}) AS pre FROM cut WHERE strlen(rest) > {hard})))),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS j, s, strlen(s) AS b FROM (
    SELECT doc_id, i, k, piece AS s FROM cut WHERE k > 0
    UNION ALL SELECT doc_id, i, k + 1, rest FROM cut WHERE strlen(rest) <= {hard} AND rest <> ''))"""


def _chunks(c: Chunking) -> str:
    bare = "trim(ltrim({}, '# '))"
    heading = lambda s: f"(strlen({bare.format(s)}) BETWEEN 8 AND 160 AND (NOT regexp_matches({bare.format(s)}, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]') OR starts_with({bare.format(s)}, 'BAB ') OR starts_with({bare.format(s)}, 'Chapter ')))"
    cut = lambda s: f"substr(ltrim({s}, '# '), 1, 120)"
    return f"""{_pieces(c.hard, c.least)},
f AS (
    SELECT doc_id, j, [s] AS buf, b + 1 AS len, CASE WHEN {heading('s')} THEN {cut('s')} ELSE '' END AS h, CAST(NULL AS VARCHAR) AS content FROM p WHERE j = 1
    UNION ALL
    SELECT doc_id, j, CASE WHEN brk THEN list_append(tail, s) ELSE list_append(buf, s) END,
           CASE WHEN brk THEN list_sum([strlen(x) + 1 FOR x IN tail])::BIGINT + b + 1 ELSE len + b + 1 END, nh,
           CASE WHEN brk AND strlen(array_to_string(buf, ' ')) >= {c.least} THEN array_to_string(buf, ' ') END
    FROM (SELECT p.doc_id, p.j, p.s, p.b, f.buf, f.len, f.len + p.b + 1 > {c.target} AS brk,
                 CASE WHEN len(f.buf) = 1 OR strlen(f.buf[-1]) + 1 >= {c.overlap} THEN f.buf[-1:] ELSE f.buf[-2:] END AS tail,
                 CASE WHEN {heading('p.s')} THEN {cut('p.s')} ELSE f.h END AS nh
          FROM f JOIN p ON p.doc_id = f.doc_id AND p.j = f.j + 1)),
last AS (SELECT doc_id, max(j) AS j FROM p GROUP BY doc_id),
chunks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY j, e) - 1)::INT AS chunk_no, heading, content FROM (
    SELECT doc_id, j, 0 AS e, h AS heading, content FROM f WHERE content IS NOT NULL
    UNION ALL SELECT f.doc_id, f.j, 1, f.h, array_to_string(f.buf, ' ') FROM f JOIN last USING (doc_id, j) WHERE strlen(array_to_string(f.buf, ' ')) >= {c.least}))"""


def _grams(w: str) -> str:
    return f"[substr('#' || {w} || '#', i, 3) FOR i IN range(1, length({w}) + 1)]"


_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"


def _lex(base: str) -> str:
    return f"list_concat({base}, [{base}[i] || '_' || {base}[i + 1] FOR i IN range(1, len({base})) IF strlen({base}[i]) > 2 AND strlen({base}[i + 1]) > 2])"


_TOK = f"""toks AS (
    SELECT doc_id, chunk_no, heading, content, words, base, {_lex('base')} AS lex, flatten([{_grams('w')} FOR w IN words IF length(w) >= 4]) AS tri
    FROM (SELECT *, list_filter(words, lambda x: x NOT IN ({_STOP})) AS base FROM (SELECT *, {_WORDS.format('content')} AS words FROM chunks))),
tok AS (SELECT * FROM toks WHERE len(lex) > 0 OR len(tri) > 0)"""

_B = f"WITH RECURSIVE {_SOURCE}, {_chunks(SMALL_CHUNKS)}"
_BT = f"{_B}, {_TOK}"
_MD5 = "md5(array_to_string({}, ' '))"


def _listed(column: str, name: str) -> str:
    return f"{_BT} SELECT doc_id, chunk_no, len({column})::INT AS n, {_MD5.format(column)} AS {name} FROM toks"


_QTOK = f"""qtok AS (SELECT qid, query, words, base, {_lex('base')} AS lex, flatten([{_grams('w')} FOR w IN words IF length(w) >= 4 AND NOT regexp_full_match(w, '[0-9]{{1,3}}(\\.[0-9]{{3}})+(,[0-9]+)?')]) AS tri
    FROM (SELECT *, list_filter(words, lambda x: x NOT IN ({_STOP})) AS base
          FROM (SELECT *, regexp_extract_all(lower(query), '[0-9]{{1,3}}(?:\\.[0-9]{{3}})+(?:,[0-9]+)?|[\\p{{L}}\\p{{N}}]+') AS words FROM asked)))"""


def _bm25(field: str, name: str) -> str:
    """CTE {name}(qid, doc_id, chunk_no, raw, matched, nq)."""
    return f"""{name}_q AS (SELECT qid, term, count(*) AS qf FROM (SELECT qid, unnest({field}) AS term FROM qtok) GROUP BY qid, term),
{name}_n AS (SELECT qid, count(*) AS nq FROM {name}_q GROUP BY qid),
{name}_p AS (SELECT doc_id, chunk_no, term, count(*) AS tf FROM (SELECT doc_id, chunk_no, unnest({field}) AS term FROM tok) GROUP BY ALL),
{name}_s AS (SELECT term, ln((N - df + 0.5) / (df + 0.5) + 1) AS idf FROM (SELECT term, count(*) AS df FROM {name}_p GROUP BY term), (SELECT count(*) AS N FROM tok)),
{name} AS (SELECT qid, doc_id, chunk_no, nq,
    sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(avg_len, 1))) * (1 + 0.1 * (qf - 1))) AS raw, count(*) AS matched
    FROM {name}_q JOIN {name}_n USING (qid) JOIN {name}_p USING (term) JOIN {name}_s USING (term)
    JOIN (SELECT doc_id, chunk_no, len({field}) AS dl FROM tok) USING (doc_id, chunk_no), (SELECT avg(len({field})) AS avg_len FROM tok)
    WHERE idf > 0 GROUP BY ALL)"""


def _covered(name: str, k: int) -> str:
    """CTE {name}_r(qid, doc_id, chunk_no, score, rank)."""
    return f"""{name}_r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id, chunk_no)::INT AS rank FROM (
    SELECT *, raw * (0.4 + 0.6 * matched / nq + CASE WHEN matched = nq THEN 0.5 ELSE 0 END) AS score FROM {name})) WHERE rank <= {k})"""


def _fusion(asked: str = _ASKED) -> str:
    return f"""{_BT}, {asked}, {_QTOK}, {_bm25('lex', 'w')}, {_bm25('tri', 't')}, {_covered('w', 200)}, {_covered('t', 200)},
fused AS (SELECT qid, doc_id, chunk_no, sum(x) AS score FROM (
    SELECT qid, doc_id, chunk_no, 0.72::DOUBLE / (60 + rank) AS x FROM w_r UNION ALL SELECT qid, doc_id, chunk_no, 0.28::DOUBLE / (60 + rank) FROM t_r) GROUP BY ALL)"""


def _found(k: int, asked: str = _ASKED) -> str:
    return f"""{_fusion(asked)},
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id, chunk_no)::INT AS rank FROM fused) WHERE rank <= {k}),
nexts AS (SELECT *, lead(content) OVER (PARTITION BY doc_id ORDER BY chunk_no) AS next FROM tok),
results AS (SELECT qid, rank, doc_id, chunk_no, score, doc_id::VARCHAR AS source, heading, substr(content, 1, 300) AS snippet,
    substr(CASE WHEN next IS NULL THEN content ELSE content || ' ' || substr(next, 1, 600) END, 1, 900) AS expanded FROM ranked JOIN nexts USING (doc_id, chunk_no))"""


_TERMS = r"list_filter(string_split_regex(lower(coalesce({}, '')), '\s+'), lambda x: x <> '')"
_VOCAB = f"""vocab AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_TERMS.format('text')})) AS term FROM documents) GROUP BY term),
idf AS (SELECT term, ln(n / (df + 1.0)) AS idf FROM vocab, (SELECT count(*)::DOUBLE AS n FROM documents) WHERE strlen(term) > 2)"""


def _pairs(words: str) -> str:
    """Two-character strings of the words that a vocabulary may hold."""
    return f"flatten([[substr(w, i, 2) FOR i IN range(1, length(w)) IF regexp_matches(substr(w, i, 1), '[A-Za-z]') AND strlen(substr(w, i, 2)) > 2] FOR w IN {words}])"


def _vectors(rows: str, keys: str, column: str, name: str) -> str:
    words = _TERMS.format(column)
    return f"""{name}_t AS (SELECT {keys}, term, count(*) AS tf FROM (SELECT {keys}, unnest(list_concat(ws, {_pairs('ws')})) AS term FROM (SELECT {keys}, {words} AS ws FROM {rows})) GROUP BY ALL),
{name} AS (SELECT {keys}, term, CASE WHEN s > 0 THEN raw / sqrt(s) ELSE raw END AS weight FROM (
    SELECT *, sum(raw * raw) OVER (PARTITION BY {keys}) AS s FROM (SELECT {keys}, term, tf * idf AS raw FROM {name}_t JOIN idf USING (term))))"""


_AV = f"WITH RECURSIVE {_SOURCE}, {_chunks(_A)}, {_VOCAB}, {_vectors('chunks', 'doc_id, chunk_no', 'content', 'vec')}"
_AS = f"""{_AV}, {_ASKED}, {_vectors('asked', 'qid', 'query', 'qvec')},
scores AS (SELECT qid, doc_id, chunk_no, sum(v.weight * q.weight) AS sparse FROM vec v JOIN qvec q USING (term) GROUP BY ALL)"""
_AC = f"""{_AS},
cand AS (SELECT * FROM (SELECT qid, doc_id, chunk_no, coalesce(sparse, 0) AS sparse,
    row_number() OVER (PARTITION BY qid ORDER BY round(coalesce(sparse, 0), 9) DESC, doc_id, chunk_no)::INT AS rank
    FROM (SELECT qid, doc_id, chunk_no FROM asked, chunks) LEFT JOIN scores USING (qid, doc_id, chunk_no)) WHERE rank <= 200)"""


def _boost(column: str, terms: tuple[str, ...]) -> str:
    return f"CASE WHEN regexp_matches(lower({column}), '{'|'.join(terms)}') AND len(regexp_extract_all({column}, '[0-9]')) > 20 THEN 0.3 ELSE 0.0 END::DOUBLE"


def _overlap(rows: str, keys: str, column: str) -> str:
    """CTEs qgram(qid, g) and overlap(qid, keys, overlap)."""
    grams = "list_distinct(flatten([" + _grams("w") + " FOR w IN {} IF length(w) >= 4]))"
    return f"""qgram AS (SELECT qid, {grams.format(_TERMS.format('query'))} AS g FROM asked),
ow AS (SELECT {keys}, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT {keys}, {_TERMS.format(column)}[1:120] AS ws FROM {rows})),
os AS (SELECT *, coalesce(sum(length(w)) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ow WHERE length(w) >= 4),
overlap AS (SELECT qid, {keys}, sum(len(list_filter({_grams('w')}, lambda x: list_contains(g, x)))) AS hit, sum(length(w)) AS tot, any_value(len(g)) AS m
    FROM os, qgram WHERE before <= 400 GROUP BY ALL)"""


_AR = f"""{_AC}, {_overlap('chunks', 'doc_id, chunk_no', 'content')},
scored AS (SELECT qid, doc_id, chunk_no, sparse, 0.4 * sparse AS combined, finance, heading, content, 0.4 * sparse + finance + coalesce(2.0 * hit / (m + tot), 0) AS score FROM (
    SELECT c.*, k.content, k.heading, {_boost('k.content', fixtures.TERMS)} AS finance, o.hit, o.tot, o.m FROM cand c JOIN chunks k USING (doc_id, chunk_no) LEFT JOIN overlap o USING (qid, doc_id, chunk_no)))"""

_FNV = """words AS (SELECT doc_id, w, count(*) AS n FROM (SELECT {keys} AS doc_id, unnest(""" + _TERMS.format("{column}") + """) AS w FROM {rows}) GROUP BY ALL),
codes AS (SELECT w, '#' || w || '#' AS p FROM (SELECT DISTINCT w FROM words WHERE length(w) >= 3)),
grams AS (SELECT w, unnest(flatten([[substr(p, i, n) FOR i IN range(1, length(p) - n + 2)] FOR n IN [3, 4, 5]])) AS g FROM codes),
dims AS (SELECT g, (list_reduce(list_prepend(14695981039346656037::HUGEINT, [ascii(substr(g, i, 1))::HUGEINT FOR i IN range(1, length(g) + 1)]), lambda h, c: (xor(h, c) * 1099511628211) % 18446744073709551616) % 384)::INT AS dim FROM (SELECT DISTINCT g FROM grams)),
hist AS (SELECT doc_id, dim, sum(n)::BIGINT AS n FROM words JOIN grams USING (w) JOIN dims USING (g) GROUP BY ALL)"""
_DOC_FNV = _FNV.format(keys="doc_id", column="text", rows="documents")

_OUT = "source AS (SELECT doc_id, text FROM documents UNION ALL " + "UNION ALL ".join(f"SELECT {i}, {_text(t)} " for i, t in fixtures.OUTLINES).replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '") + ")"
_LINES = r"""lines AS (SELECT doc_id, line_no, line, CASE WHEN regexp_matches(lower(line), '^(bab |chapter |bagian )') THEN 1
    WHEN regexp_matches(line, '^[0-9]') AND strpos(substr(line, 1, 20), '.') > 0 AND strlen(ltrim(substr(substr(line, 1, 20), strpos(line, '.') + 1))) >= 5
         AND NOT regexp_matches(ltrim(substr(substr(line, 1, 20), strpos(line, '.') + 1)), '^[0-9]') THEN 2 ELSE 0 END AS level FROM (
    SELECT doc_id, line_no, regexp_replace(regexp_replace(line, '^\s+', ''), '\s+$', '') AS line FROM (
        SELECT doc_id, unnest(string_split(nfc_normalize(coalesce(text, '')), chr(10))) AS line, (generate_subscripts(string_split(nfc_normalize(coalesce(text, '')), chr(10)), 1) - 1)::INT AS line_no FROM source)) WHERE line <> '')"""


def _nodes(least: int = 100) -> str:
    return f"""{_LINES},
blocks AS (SELECT *, sum((level > 0)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM lines),
heads AS (SELECT doc_id, block, 0 AS kind, level, substr(line, 1, 200) AS heading, '' AS content FROM blocks WHERE level > 0),
body AS (SELECT b.doc_id, b.block, 1 AS kind, 0 AS level, coalesce(h.heading, '') AS heading, b.content FROM (
    SELECT doc_id, block, string_agg(line, ' ' ORDER BY line_no) AS content FROM blocks WHERE level = 0 GROUP BY ALL) b LEFT JOIN heads h USING (doc_id, block) WHERE strlen(b.content) >= {least}),
every AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY block, kind) - 1)::INT AS node_id FROM (SELECT * FROM heads UNION ALL SELECT * FROM body)),
nodes AS (SELECT doc_id, node_id, level, heading, content, (SELECT max(p.node_id) FROM every p WHERE p.doc_id = e.doc_id AND p.node_id < e.node_id
    AND ((e.level = 2 AND p.level = 1) OR (e.level = 0 AND p.level > 0))) AS parent_id FROM every e)"""


_ROLL = """seconds AS (SELECT n.doc_id, n.node_id, n.level, n.parent_id, coalesce((SELECT string_agg(c.content, ' ' ORDER BY c.node_id) FROM nodes c WHERE c.doc_id = n.doc_id AND c.parent_id = n.node_id AND c.level = 0), '') AS content FROM nodes n WHERE n.level = 2),
lower AS (SELECT doc_id, node_id, level, parent_id, content FROM nodes WHERE level = 0 UNION ALL SELECT * FROM seconds),
rolled AS (SELECT * FROM lower UNION ALL SELECT n.doc_id, n.node_id, n.level, n.parent_id, coalesce((SELECT string_agg(c.content, ' ' ORDER BY c.node_id) FROM lower c WHERE c.doc_id = n.doc_id AND c.parent_id = n.node_id AND c.content <> ''), '') FROM nodes n WHERE n.level = 1)"""

_TRUTH = """lines AS (SELECT trim(value) AS v FROM """ + _values([(x,) for x in fixtures.TRUTH], "value") + """),
truth AS (SELECT regexp_extract(v, '^([0-9]+)', 1)::INT AS qid, trim(regexp_replace(substr(v, 1, strpos(v, '->') - 1), '^[0-9.]+', '')) AS query,
    list_filter([lower(trim(x)) FOR x IN string_split(substr(v, strpos(v, '->') + 2), ',')], lambda x: x <> '') AS keywords FROM lines WHERE strpos(v, '->') > 0)"""
_HITS = f"""{_found(10, f'{_TRUTH}, asked AS (SELECT qid, query FROM truth)')},
blob AS (SELECT qid, lower(string_agg(snippet || ' ' || expanded, ' ' ORDER BY rank)) AS b FROM results GROUP BY qid),
hits AS (SELECT qid, len(list_filter(keywords, lambda x: contains(coalesce(b, ''), x))) > 0 AS hit FROM truth LEFT JOIN blob USING (qid))"""


def oracle_sql() -> dict[str, str]:
    md5 = _MD5.format
    posted = lambda c: f"{_BT} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf, max(tf) AS most, sum(('0x' || substr(md5(doc_id || ':' || chunk_no || ':' || tf), 1, 8))::BIGINT)::BIGINT AS postings_sum FROM (SELECT doc_id, chunk_no, term, count(*) AS tf FROM (SELECT doc_id, chunk_no, unnest({c}) AS term FROM tok) GROUP BY ALL) GROUP BY term"
    df = f"df AS (SELECT 'w' AS field, term, count(*) AS df FROM (SELECT unnest(list_distinct(lex)) AS term FROM tok) GROUP BY term UNION ALL SELECT 't', term, count(*) FROM (SELECT unnest(list_distinct(tri)) AS term FROM tok) GROUP BY term)"
    stats = f"{_BT}, {df} SELECT (SELECT count(*) FROM tok) AS chunks, count(*) FILTER (WHERE field = 'w') AS word_terms, count(*) FILTER (WHERE field = 't') AS tri_terms FROM df"
    added = "source AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - conv_id * 1000 - turn, text FROM conversations)"
    chunk = "SELECT doc_id, chunk_no, strlen(content)::INT AS n_bytes, md5(content) AS content_md5 FROM chunks"
    words = _TERMS.format("text")
    expanded = "CASE WHEN next IS NULL THEN content ELSE content || ' ' || substr(next, 1, 600) END"
    numbers = r"regexp_full_match(token, '[0-9]{1,3}(\.[0-9]{3})+(,[0-9]+)?')"
    outline = f"WITH {_OUT}, "
    cjk = _values([(w,) for w in fixtures.CJK_WORDS], "word")
    hashed = "(SELECT doc_id, dim, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS weight FROM hist)"
    asked_fnv = _FNV.format(keys="qid", column="query", rows="asked").replace("words", "qwords").replace("codes", "qcodes").replace("grams", "qgrams").replace("dims AS", "qdims AS").replace("JOIN dims", "JOIN qdims").replace("hist", "qhist")
    top_nodes = f"""{outline}{_nodes()}, {_ROLL}, {_VOCAB}, {_ASKED}, {_vectors('rolled', 'doc_id, node_id', 'content', 'vec')}, {_vectors('asked', 'qid', 'query', 'qvec')},
s AS (SELECT qid, doc_id, node_id, sum(v.weight * q.weight) AS sparse FROM vec v JOIN qvec q USING (term) GROUP BY ALL HAVING sum(v.weight * q.weight) > 0),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sparse, 9) DESC, doc_id, node_id) AS k FROM s) WHERE k <= 50)"""
    node_value = "0.6 * sparse + CASE WHEN regexp_matches(lower(content), 'revenue|pendapatan') THEN 0.3 ELSE 0 END"
    chunk_fnv = _FNV.format(keys="doc_id * 100000 + chunk_no", column="content", rows="(SELECT doc_id, chunk_no, content FROM chunks JOIN (SELECT DISTINCT doc_id, chunk_no FROM cand) USING (doc_id, chunk_no))")
    node_fnv = _FNV.format(keys="doc_id * 100000 + node_id", column="content", rows="rolled")
    return {
        "normalize_docs": f"WITH {_SOURCE}, {_NORM} SELECT doc_id, strlen(n)::INT AS n_bytes, md5(n) AS text_md5 FROM norm",
        "tokenize_words": _listed("words", "words_md5"),
        "ws_terms": f"SELECT doc_id, len({words})::INT AS n, {md5(words)} AS words_md5 FROM documents",
        "numeric_tokens": f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({words}) AS token FROM documents) WHERE {numbers} GROUP BY ALL",
        "stopword_filtered": _listed("base", "words_md5"),
        "word_bigrams": f"{_BT} SELECT doc_id, chunk_no, (len(lex) - len(base))::INT AS n, {md5('lex[len(base) + 1:]')} AS bigrams_md5 FROM toks",
        "char_trigrams": _listed("tri", "trigrams_md5"),
        "analyze_chunks": f"{_BT} SELECT doc_id, chunk_no, len(lex)::INT AS n_lex, len(tri)::INT AS n_tri, {md5('lex')} AS lex_md5, {md5('tri')} AS tri_md5 FROM tok",
        "snippets": r"SELECT doc_id, substr(regexp_replace(text, '\s', ' ', 'g'), 1, 300) AS short, substr(text, 1, 600) AS long FROM documents",
        "digit_count": "SELECT doc_id, len(regexp_extract_all(text, '[0-9]'))::INT AS digits FROM documents",
        "cjk_bigrams": f"SELECT word, array_to_string([substr(word, i, 2) FOR i IN range(1, length(word)) IF unicode(substr(word, i, 1)) >= 19968], ' ') AS indexed, array_to_string([substr(word, i, 2) FOR i IN range(1, length(word)) IF unicode(substr(word, i, 1)) >= 19968 OR regexp_matches(substr(word, i, 1), '[A-Za-z]')], ' ') AS looked_up FROM {cjk}",
        "url_query_params": r"SELECT page_id, replace(substr(x, 1, strpos(x, '=') - 1), '%20', ' ') AS key, replace(substr(x, strpos(x, '=') + 1), '%20', ' ') AS value FROM (SELECT page_id, unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS x FROM pages) WHERE contains(x, '=')",
        "min_len_filter": f"WITH {_SOURCE}, {_NORM} SELECT doc_id FROM norm WHERE strlen(n) >= 100",
        "sentence_split": f"WITH {_SOURCE}, {_NORM} SELECT doc_id, count(*) AS n, sum(strlen(s))::BIGINT AS n_bytes, max(strlen(s))::INT AS longest FROM (SELECT doc_id, trim(unnest(regexp_extract_all(n, '{_SENTENCE}'))) AS s FROM norm) WHERE s <> '' GROUP BY doc_id",
        "hard_split": f"WITH RECURSIVE {_SOURCE}, {_pieces(SMALL_CHUNKS.hard)} SELECT doc_id, (j - 1)::INT AS no, md5(s) AS sentence_md5 FROM p",
        "chunk_b": f"{_B} {chunk}",
        "chunk_a": f"WITH RECURSIVE {_SOURCE}, {_chunks(_A)} {chunk}",
        "chunk_headings": f"{_B} SELECT doc_id, chunk_no, heading FROM chunks WHERE heading <> ''",
        "chunks_per_source": f"{_B} SELECT doc_id::VARCHAR AS source, count(*) AS n FROM chunks GROUP BY doc_id",
        "b_postings_word": posted("lex"),
        "b_postings_tri": posted("tri"),
        "b_df": f"{_BT}, {df} SELECT field, term, df FROM df",
        "b_idf": f"{_BT}, {df} SELECT field, term, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM df, (SELECT count(*) AS n FROM tok)",
        "b_doc_len": f"{_BT} SELECT count(*) AS n, round(avg(len(lex)), 6) AS w_avg, round(avg(len(tri)), 6) AS t_avg FROM tok",
        "b_stats": stats,
        "b_add_counts": f"WITH RECURSIVE {added}, {_chunks(SMALL_CHUNKS)}, {_TOK} SELECT CASE WHEN doc_id < 0 THEN 'conversations' ELSE 'documents' END AS added, count(*) AS chunks FROM tok GROUP BY 1",
        "b_roundtrip_stats": stats,
        "b_bm25_word": f"{_BT}, {_ASKED}, {_QTOK}, {_bm25('lex', 'w')} SELECT qid, doc_id, chunk_no, round(raw, 6) AS raw, matched, nq FROM w",
        "b_bm25_tri": f"{_BT}, {_ASKED}, {_QTOK}, {_bm25('tri', 't')}, {_covered('t', 50)} SELECT qid, rank, doc_id, chunk_no, round(score, 6) AS score FROM t_r",
        "b_coverage": f"{_BT}, {_ASKED}, {_QTOK}, {_bm25('lex', 'w')}, {_covered('w', 200)} SELECT qid, rank, doc_id, chunk_no, round(score, 6) AS score FROM w_r",
        "b_rrf": f"{_fusion()} SELECT qid, doc_id, chunk_no, round(score, 6) AS score FROM fused",
        "b_numeric_boost": "SELECT 4 AS qid, doc_id, CASE WHEN contains(coalesce(text, ''), '62.714') THEN 1.1 ELSE 0.5 END::DOUBLE AS boosted FROM documents",
        "b_search": f"{_found(10)} SELECT qid, rank, doc_id, chunk_no, round(score, 6) AS score, source, heading, snippet, expanded FROM results",
        "context_expand": f"{_B}, nexts AS (SELECT *, lead(content) OVER (PARTITION BY doc_id ORDER BY chunk_no) AS next FROM chunks) SELECT doc_id, chunk_no, md5(substr({expanded}, 1, 900)) AS b_md5, md5(substr({expanded}, 1, 2000)) AS a_md5 FROM nexts",
        "empty_query": "SELECT 1::INT AS qid, 1::INT AS rank, doc_id, 0::INT AS chunk_no FROM documents WHERE false",
        "result_json": f"{_found(3)} SELECT qid, rank, doc_id, round(score, 4) AS score, source FROM results",
        "a_vocab_df": f"WITH {_VOCAB} SELECT term, df FROM vocab",
        "a_vocab_idf": f"WITH {_VOCAB} SELECT term, round(idf, 6) AS idf FROM idf",
        "a_sparse_vectors": f"{_AV} SELECT doc_id, chunk_no, term, round(weight, 6) AS weight FROM vec",
        "a_sparse_scores": f"{_AS} SELECT qid, doc_id, chunk_no, round(sparse, 6) AS sparse FROM scores",
        "a_candidates": f"{_AC} SELECT qid, rank, doc_id, chunk_no, round(sparse, 6) AS sparse FROM cand",
        "a_combined": f"{_AR} SELECT qid, doc_id, chunk_no, round(combined, 6) AS combined, finance, round(score, 6) AS score FROM scored",
        "fin_boost": f"SELECT doc_id, {_boost('text', fixtures.TERMS)} AS boost, regexp_matches(lower(text), '{'|'.join(FINANCE_TERMS)}') AS has_term FROM documents",
        "a_trigram_overlap": f"WITH {_ASKED}, {_overlap('documents', 'doc_id', 'text')} SELECT qid, d.doc_id, round(coalesce(2.0 * hit / (m + tot), 0), 6) AS overlap FROM (SELECT qid, doc_id FROM asked, documents) d LEFT JOIN overlap o USING (qid, doc_id)",
        "a_search": f"""{_AR}, nexts AS (SELECT doc_id, chunk_no, lead(content) OVER (PARTITION BY doc_id ORDER BY chunk_no) AS next FROM chunks),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, round(sparse, 9) DESC, doc_id, chunk_no)::INT AS rank FROM scored)
SELECT qid, rank, doc_id, chunk_no, round(score, 6) AS score, doc_id::VARCHAR AS source, heading, md5(substr(content, 1, 600)) AS snippet_md5, md5(substr({expanded}, 1, 2000)) AS expanded_md5
FROM r JOIN nexts USING (doc_id, chunk_no) WHERE rank <= 10""",
        "a_search_dense": f"""{_AR}, {chunk_fnv}, {asked_fnv},
hn AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM hist GROUP BY doc_id), qn AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM qhist GROUP BY doc_id),
near AS (SELECT q.doc_id AS qid, h.doc_id AS node, sum(h.n * q.n) / (any_value(hn.norm) * any_value(qn.norm)) AS dense
    FROM hist h JOIN qhist q USING (dim) JOIN hn ON hn.doc_id = h.doc_id JOIN qn ON qn.doc_id = q.doc_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(total, 9) DESC, round(sparse, 9) DESC, doc_id, chunk_no)::INT AS rank FROM (
    SELECT s.*, s.score + 0.6 * coalesce(dense, 0) AS total FROM scored s LEFT JOIN near n ON n.qid = s.qid AND n.node = s.doc_id * 100000 + s.chunk_no))
SELECT qid, rank, doc_id, chunk_no, round(total, 6) AS score FROM r WHERE rank <= 10""",
        "d_cosine_topk": "SELECT vec_id, round(s, 6) AS cosine FROM (SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s FROM embeddings a, embeddings b WHERE b.vec_id = 0) ORDER BY s DESC, vec_id LIMIT 10",
        "d_dim_df": "SELECT (dim - 1)::INT AS dim, count(*) AS df FROM (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings) WHERE v > 0 GROUP BY dim",
        "fnv_gram_hist": f"WITH {_DOC_FNV} SELECT dim, sum(n)::BIGINT AS n, count(*) AS df FROM hist GROUP BY dim",
        "d_hash_embed": f"WITH {_DOC_FNV} SELECT doc_id, count(*) AS dims, round(max(weight), 6) AS most, round(sum(weight), 6) AS total FROM {hashed} GROUP BY doc_id",
        "d_hash_embed_idf": f"""WITH {_ASKED}, {_DOC_FNV}, {asked_fnv}, ddf AS (SELECT dim, count(*) AS df FROM hist GROUP BY dim),
x AS (SELECT doc_id AS qid, dim, n * ln((k - df + 0.5) / (df + 0.5) + 1) AS raw FROM qhist JOIN ddf USING (dim), (SELECT count(*) AS k FROM documents))
SELECT qid, dim, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY qid)), 6) AS weight FROM x""",
        "tree_lines": f"{outline}{_LINES} SELECT doc_id, count(*) AS n, sum(strlen(line))::BIGINT AS n_bytes FROM lines GROUP BY doc_id",
        "tree_levels": f"{outline}{_LINES} SELECT doc_id, line_no, level FROM lines WHERE level > 0",
        "tree_parents": f"{outline}{_nodes()} SELECT doc_id, node_id, level, parent_id FROM nodes",
        "tree_nodes": f"{outline}{_nodes()} SELECT doc_id, node_id, level, heading, md5(content) AS content_md5 FROM nodes",
        "tree_rollup": f"{outline}{_nodes()}, {_ROLL} SELECT doc_id, node_id, strlen(content)::INT AS n_bytes, md5(content) AS content_md5 FROM rolled",
        "tree_search": f"""{top_nodes},
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id, node_id)::INT AS rank FROM (
    SELECT qid, doc_id, node_id, content, {node_value} AS score FROM top JOIN rolled USING (doc_id, node_id)))
SELECT qid, rank, doc_id, node_id, round(score, 6) AS score, md5(substr(content, 1, 300)) AS snippet_md5 FROM r WHERE rank <= 10""",
        "tree_search_dense": f"""{top_nodes}, {node_fnv}, {asked_fnv}, ddf AS (SELECT dim, count(*) AS df FROM hist GROUP BY dim),
x AS (SELECT doc_id AS qid, dim, n * ln((k - df + 0.5) / (df + 0.5) + 1) AS raw FROM qhist JOIN ddf USING (dim), (SELECT count(*) AS k FROM rolled)),
y AS (SELECT qid, dim, raw / sqrt(sum(raw * raw) OVER (PARTITION BY qid)) AS w FROM x),
h AS (SELECT doc_id AS node, dim, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS w FROM hist),
near AS (SELECT qid, node, sum(h.w * y.w) AS dense FROM h JOIN y USING (dim) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id, node_id)::INT AS rank FROM (
    SELECT t.qid, t.doc_id, t.node_id, 0.4 * coalesce(dense, 0) + {node_value} AS score
    FROM top t JOIN rolled USING (doc_id, node_id) LEFT JOIN near n ON n.qid = t.qid AND n.node = t.doc_id * 100000 + t.node_id))
SELECT qid, rank, doc_id, node_id, round(score, 6) AS score FROM r WHERE rank <= 10""",
        "tree_flat": f"""WITH RECURSIVE {_SOURCE}, {_nodes(1500)}, {_chunks(SMALL_CHUNKS)}
SELECT doc_id, chunk_no AS node_id, md5(content) AS content_md5 FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM nodes)""",
        "gt_parse": f"WITH {_TRUTH} SELECT qid, query, array_to_string(keywords, '|') AS keywords FROM truth",
        "eval_hits": f"{_HITS} SELECT qid, hit FROM hits",
        "eval_recall": f"{_HITS} SELECT count(*) FILTER (WHERE hit) AS hits, count(*) AS queries, round(avg(hit::INT), 6) AS recall FROM hits",
        "eval_ranking": f"""{_found(50)}, best AS (SELECT qid, doc_id, min(rank) AS rank FROM results GROUP BY ALL),
judged AS {_values(fixtures.JUDGED, 'qid, lang')},
wanted AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY gain DESC, doc_id) AS i FROM (
    SELECT j.qid, d.doc_id, b.rank, l.quality AS gain FROM judged j JOIN documents d ON d.lang = j.lang JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN best b ON b.qid = j.qid AND b.doc_id = d.doc_id) WHERE gain > 0)
SELECT qid, round(avg((rank IS NOT NULL)::INT), 6) AS recall, round(coalesce(1 / min(rank), 0), 6) AS mrr,
       round(coalesce(sum(gain / log2(rank + 1)), 0) / sum(gain / log2(i + 1)) FILTER (WHERE i <= 50), 6) AS ndcg FROM wanted GROUP BY qid""",
    }
