"""DuckDB SQL of the catalog's queries."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda x: x <> '')"
_TOKENS = "greatest(1, length({0}) // 4)::INT"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_PREVIEW = "CASE WHEN length({0}) > {1} THEN substr({0}, 1, {1}) || '...' ELSE {0} END"
_COS = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])))"

FIXED = f"""
w AS (SELECT doc_id, source, text AS body, {_WORDS.format('text')} AS ws FROM documents),
k AS (SELECT doc_id, source, body, ws, unnest(range(0, len(ws), 112)) AS st FROM w),
fixed AS (SELECT doc_id, source, body, st, (st // 112)::INT AS chunk_index, array_to_string(ws[st + 1:st + 128], ' ') AS text FROM k),
chunks AS (SELECT *, {_TOKENS.format('text')} AS token_count FROM fixed)"""

LINES = """
l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
pages_ AS (SELECT doc_id AS document_id, unnest(ls) AS text, unnest(range(1, len(ls) + 1))::INT AS page_number FROM l),
offsets_ AS (SELECT *, (coalesce(sum(length(text) + 1) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS char_start FROM pages_),
pg AS (SELECT *, (char_start + length(text))::INT AS char_end FROM offsets_)"""

OFFSETS = FIXED + "," + LINES + r""",
gaps AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n]+'), lambda x: x <> '') AS gw, regexp_extract_all(regexp_replace(text, '^[ \t\n]+', ''), '[ \t\n]+') AS gs, length(text) - length(regexp_replace(text, '^[ \t\n]+', '')) AS lead FROM documents),
placed AS (SELECT c.doc_id, c.chunk_index, c.text, CASE WHEN c.st < len(g.gw) THEN g.lead + coalesce(list_sum(list_transform(g.gw[1:c.st], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(g.gs[1:c.st], lambda x: length(x))), 0) ELSE 0 END::INT AS char_start FROM chunks c JOIN gaps g USING (doc_id)),
spans AS (SELECT *, (char_start + length(text))::INT AS char_end FROM placed),
ends AS (SELECT document_id, max(page_number) AS last_page FROM pg GROUP BY 1),
on_pages AS (SELECT s.*, coalesce((SELECT min(p.page_number) FROM pg p WHERE p.document_id = s.doc_id AND s.char_start BETWEEN p.char_start AND p.char_end), e.last_page)::INT AS page_start,
  coalesce((SELECT min(p.page_number) FROM pg p WHERE p.document_id = s.doc_id AND s.char_end BETWEEN p.char_start AND p.char_end), e.last_page)::INT AS page_end FROM spans s JOIN ends e ON e.document_id = s.doc_id)"""

CANDIDATES = f"""
v AS (SELECT vec_id AS chunk_id, embedding, label AS document_id FROM embeddings),
q AS (SELECT document_id AS query_id, arg_min(embedding, chunk_id) AS query FROM v GROUP BY 1),
sims AS (SELECT query_id, chunk_id, {_COS.format('embedding', 'query')} AS cos FROM v, q),
ranked_ AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, chunk_id))::INT AS rank FROM sims),
cand AS (SELECT query_id, chunk_id, round((1 + cos) / 2, 4) AS score, rank FROM ranked_ WHERE rank <= 20),
blend AS (SELECT *, round(0.85::DOUBLE * score + 0.15::DOUBLE * (count(*) OVER (PARTITION BY query_id) - (row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1)) / count(*) OVER (PARTITION BY query_id), 4) AS rerank_score FROM cand)"""


def _topk(where: str, k: int) -> str:
    return f"""WITH v AS (SELECT vec_id AS chunk_id, embedding, label AS document_id FROM embeddings), q AS (SELECT arg_min(embedding, chunk_id) AS query FROM v),
s AS (SELECT chunk_id, document_id, {_COS.format('embedding', 'query')} AS cos FROM v, q WHERE {where})
SELECT chunk_id, document_id, round((1 + cos) / 2, 4) AS score, (row_number() OVER (ORDER BY cos DESC, chunk_id))::INT AS rank FROM s QUALIFY rank <= {k}"""


def _take(score: str, source: str) -> str:
    return f"SELECT query_id, chunk_id, {score} AS rerank_score, (row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, rank))::INT AS n FROM {source} QUALIFY n <= 5"


def _clean(x: str) -> str:
    for old, new in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        x = f"replace({x}, '{old}', '{new}')"
    x = f"translate({x}, '‘’“”–—' || chr(160) || chr(173), '''''\"\"-- ')"
    for pattern, new in ((r"-\n\s*", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")):
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return _STRIP.format(x)


def _title(x: str) -> str:
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    parts = f"regexp_extract_all({x}, '[{cased}]+|[^{cased}]+')"
    return f"array_to_string(list_transform({parts}, lambda w: upper(w[1:1]) || lower(w[2:])), '')"


_STEM = r"regexp_replace(string_split({0}, '/')[-1], '(.)\.[^.]*$', '\1')"
_FILES = "files AS (SELECT page_id, 'docs/report_' || page_id || CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.txt' ELSE '.pdf' END AS path, CASE WHEN page_id % 3 = 0 THEN '<htm' ELSE '%PDF' END AS head, page_id * 200000 AS length FROM pages)"
_DECIDE = f"""WITH {_FILES}, t AS (SELECT page_id, {_title("translate(" + _STEM.format("path") + ", '_-', '  ')")} AS title FROM files),
known AS (SELECT doc_id AS id, 'Report ' || (doc_id % 40 * 3) AS title, CASE WHEN doc_id % 2 = 0 THEN 'ready' ELSE 'failed' END AS status, n_chars FROM documents),
newest AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY title ORDER BY n_chars DESC, id DESC) = 1),
d AS (SELECT page_id, t.title, id AS existing_id, CASE WHEN id IS NULL THEN 'create' WHEN status = 'ready' THEN 'skip' ELSE 'reprocess' END AS decision FROM t LEFT JOIN newest ON newest.title = t.title)"""
_STATS = "coalesce(min({0}), 0)::BIGINT AS min_tokens, coalesce(max({0}), 0)::BIGINT AS max_tokens, coalesce(round_even(avg({0}), 0), 0)::BIGINT AS avg_tokens, coalesce(floor(median({0})), 0)::BIGINT AS median_tokens, coalesce(sum({0}), 0)::BIGINT AS total_tokens, count({0})::BIGINT AS n_chunks"
_NAME = "source || '-' || doc_id"
_RANKED = "r AS (SELECT source AS query_id, doc_id, text, (row_number() OVER (PARTITION BY source ORDER BY doc_id))::INT AS n FROM documents)"
_BUDGET = _RANKED + """,
c AS (SELECT *, length(text) // 4 + 20 AS cost FROM r),
u AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY query_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM c),
f AS (SELECT *, min(CASE WHEN used + cost > 6000 THEN n END) OVER (PARTITION BY query_id) AS first_bad, (6000 - used) * 4 - 80 AS room FROM u),
b AS (SELECT *, CASE WHEN first_bad IS NULL OR n < first_bad THEN text WHEN n = first_bad AND room >= 200 THEN substr(text, 1, room) || chr(10) || '[... truncated for length ...]' END AS shown FROM f)"""
_LABEL = "CASE WHEN {0} = {1} THEN 'p.' || {0} ELSE 'p.' || {0} || '{2}' || {1} END"
_HEADER = "'[Source ' || {0} || '] ' || {1} || ' - ' || {2} || ' (relevance: ' || printf('%.2f', {3}) || ')'"
_ANSWERS = r"a AS (SELECT conv_id, turn, text || ' [Source ' || (turn % 3 + 1) || '] and [Source  2], [Source' || chr(10) || (turn % 7) || '] [Source ' || (turn % 3 + 1) || '] [Source x]' AS answer FROM conversations WHERE role = 'assistant')"
_CITES = _ANSWERS + r""",
e AS (SELECT conv_id, turn, regexp_extract_all(answer, '\[Source\s+\d+\]') AS x FROM a),
o AS (SELECT conv_id, turn, unnest(x) AS raw, unnest(range(len(x))) AS i FROM e),
c AS (SELECT conv_id, turn, regexp_replace(raw, '\s+', ' ', 'g') AS label, min(i) AS i FROM o GROUP BY ALL)"""
_HISTORY = "h AS (SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {0})"
_BLOCK = _HISTORY.format(12) + f""",
hb AS (SELECT conv_id AS session_id, '## CONVERSATION HISTORY' || chr(10) || string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || {_PREVIEW.format('text', 400)}, chr(10) ORDER BY turn) AS history FROM h GROUP BY 1)"""
_SESSIONS = "s AS (SELECT conv_id AS id, max(turn) AS updated_at, CASE WHEN conv_id % 4 <> 0 THEN 'Chat ' || conv_id ELSE '' END AS title, conv_id % 3 <> 0 AS is_active, count(*) AS message_count FROM conversations GROUP BY conv_id)"


_SEPARATORS = ("chr(10) || chr(10) || chr(10)", "chr(10) || chr(10)", "chr(10)", "'. '", "'? '", "'! '", "'; '", "', '", "' '")


def _recursive(size: int, overlap: int) -> str:
    """Pieces level by level, then two folds over lists of states: merging, and the cursor search."""
    tok = "greatest(1, length({0}) // 4)::INT"
    pieces = "[text]"
    for sep in _SEPARATORS:
        pieces = f"flatten(list_transform({pieces}, lambda x: CASE WHEN {tok.format('x')} <= {size} THEN [x] ELSE list_filter(list_transform(string_split(x, {sep}), lambda y: {_STRIP.format('y')}), lambda y: y <> '') END))"
    words = _WORDS.format("s.cur")
    tail = f"CASE WHEN len({words}) > {overlap} THEN array_to_string(({words})[-{overlap}:], ' ') ELSE s.cur END"
    return f"""p AS (SELECT doc_id, text, {pieces} AS ps FROM documents),
m AS (SELECT doc_id, text, list_reduce(list_prepend({{out: []::VARCHAR[], cur: NULL::VARCHAR, n: 0::INT}}, list_transform(ps, lambda x: {{out: []::VARCHAR[], cur: x, n: {tok.format('x')}}})),
 lambda s, e: CASE WHEN s.cur IS NOT NULL AND s.n + e.n > {size} THEN {{out: list_append(s.out, s.cur), cur: concat_ws(' ', nullif({tail}, ''), e.cur), n: ({tok.format(tail)} + e.n)::INT}}
 ELSE {{out: s.out, cur: CASE WHEN s.cur IS NULL THEN e.cur ELSE s.cur || ' ' || e.cur END, n: (s.n + e.n)::INT}} END) AS s FROM p),
c AS (SELECT doc_id, text, list_filter(CASE WHEN s.cur IS NULL THEN s.out ELSE list_append(s.out, s.cur) END, lambda x: {_STRIP.format('x')} <> '') AS cs FROM m),
f AS (SELECT doc_id, list_reduce(list_prepend({{out: []::STRUCT(i INT, t VARCHAR, b INT)[], spot: 0::INT, c: ''}}, list_transform(cs, lambda x: {{out: []::STRUCT(i INT, t VARCHAR, b INT)[], spot: 0::INT, c: x}})),
 lambda s, e: {{out: list_append(s.out, {{i: len(s.out)::INT, t: e.c, b: CASE WHEN strpos(substr(text, s.spot + 1), e.c) > 0 THEN (s.spot + strpos(substr(text, s.spot + 1), e.c) - 1)::INT ELSE s.spot END}}),
 spot: greatest(s.spot, CASE WHEN strpos(substr(text, s.spot + 1), e.c) > 0 THEN (s.spot + strpos(substr(text, s.spot + 1), e.c))::INT ELSE s.spot + 1 END)::INT, c: ''}}).out AS placed FROM c),
r AS (SELECT doc_id, unnest(placed) AS x FROM f)
SELECT doc_id, x.i AS chunk_index, {_STRIP.format('x.t')} AS text, x.b AS char_start, (x.b + length(x.t))::INT AS char_end, {tok.format(_STRIP.format('x.t'))} AS token_count FROM r WHERE length({_STRIP.format('x.t')}) > 20"""


def _sentences() -> str:
    """Abbreviations and cuts are marked by characters of the private use area."""
    held = "text"
    for k, a in enumerate(("Dr.", "Prof.", "Fig.", "Tab.", "Eq.", "et al.", "e.g.", "i.e.", "vs.", "approx.", "No.", "Vol.", "p.", "pp.", "ibid.")):
        held = f"regexp_replace({held}, '(?i){a.replace('.', chr(92) + '.')}', chr({0xE100 + k}), 'g')"
    back = "x"
    for k, a in enumerate(("Dr.", "Prof.", "Fig.", "Tab.", "Eq.", "et al.", "e.g.", "i.e.", "vs.", "approx.", "No.", "Vol.", "p.", "pp.", "ibid.")):
        back = f"replace({back}, chr({0xE100 + k}), '{a}')"
    cut = rf"string_split(regexp_replace({held}, '([.!?])\s+([A-Z0-9])', '\1' || chr({0xE200}) || '\2', 'g'), chr({0xE200}))"
    whole = f"list_filter(list_transform({cut}, lambda x: {_STRIP.format(back)}), lambda x: length(x) > 15)"
    return f"WITH s AS (SELECT doc_id, {whole} AS ss FROM documents) SELECT doc_id, unnest(range(len(ss)))::INT AS pos, unnest(ss) AS sentence FROM s"


def _more() -> dict[str, str]:
    docs = "SELECT doc_id AS id, 'Doc ' || doc_id AS title, n_chars // 1024 AS file_size_kb, 1::INT AS page_count, doc_id % 7 AS chunk_count, CASE WHEN doc_id % 5 = 0 THEN 'pending' ELSE 'ready' END AS status, 'fixed' AS chunk_strategy, doc_id AS created_at FROM documents"
    said = "b AS (SELECT 's' || (item_id % 7) AS session_id, text AS question, 'On ' || text AS answer, item_id, (item_id * 3)::INT AS prompt_tokens FROM benchmark)"
    context = oracle_sql_context()
    return {
        "chunk_recursive": f"WITH {_recursive(128, 16)}",
        "chunk_recursive_native": f"WITH {_recursive(128, 16)}",
        "sentence_split": _sentences(),
        "document_page": docs,
        "document_detail_page": f"WITH {FIXED}, d AS ({docs}) SELECT id, title, status, (SELECT string_agg(chunk_index || ':' || token_count, ',' ORDER BY chunk_index) FROM chunks WHERE doc_id = 7 AND chunk_index < 10) AS chunks FROM d WHERE id = 7",
        "search_stats": "WITH c AS (SELECT doc_id AS document_id, count(*) AS chunk_count, count(*) FILTER (quality = 1) AS embedded_chunks FROM labels GROUP BY 1) SELECT doc_id AS document_id, 'Doc ' || doc_id AS title, coalesce(chunk_count, 0) AS chunk_count, coalesce(embedded_chunks, 0) AS embedded_chunks, coalesce(embedded_chunks, 0) AS vector_count, coalesce(embedded_chunks, 0) = coalesce(chunk_count, 0) AS fully_indexed FROM documents LEFT JOIN c ON document_id = doc_id WHERE doc_id % 5 <> 0",
        "search_rows": f"WITH h AS ({_topk('true', 20)}), t AS (SELECT *, 'text of ' || repeat(chunk_id::VARCHAR, 60) AS text, chunk_id % 9 AS a, chunk_id % 9 + chunk_id % 2 AS b FROM h) SELECT chunk_id, rank, {_PREVIEW.format('text', 120)} AS preview, {_LABEL.format('a', 'b', '–')} AS page_label, 'T' || document_id || ' · ' || {_LABEL.format('a', 'b', '–')} AS source_label FROM t",
        "debug_documents": f"WITH {FIXED} SELECT d.doc_id AS id, {_STATS.format('c.token_count')} FROM documents d LEFT JOIN chunks c ON c.doc_id = d.doc_id GROUP BY d.doc_id",
        "debug_chunk_stats": f"WITH {FIXED}, s AS (SELECT * FROM chunks WHERE doc_id = 3 AND 2 BETWEEN chunk_index + 1 AND chunk_index + 2) SELECT chunk_index, {_PREVIEW.format('text', 120)} AS preview, (SELECT min(token_count) FROM s)::BIGINT AS min_tokens, (SELECT max(token_count) FROM s)::BIGINT AS max_tokens, (SELECT count(*) FROM s) AS n_chunks FROM s",
        "title_accents": f"""SELECT page_id, {_title("translate(" + _STEM.format("translate(url, 'aeou', 'áéöü')") + ", '_-', '  ')")} AS title FROM pages""",
        "chunk_own_sizes": f"""WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS ws, doc_id % 3 * 32 + 64 AS size, doc_id % 4 * 20 AS lap FROM documents), s AS (SELECT *, greatest(1, size - least(lap, size // 2)) AS step FROM w),
k AS (SELECT *, unnest(range(0, len(ws), step)) AS st FROM s), c AS (SELECT doc_id, (st // step)::INT AS chunk_index, array_to_string(ws[st + 1:st + size], ' ') AS text FROM k) SELECT *, {_TOKENS.format('text')} AS token_count FROM c""",
        "vector_topk_copies": f"""WITH v AS (SELECT vec_id + 1000000 * i AS chunk_id, embedding FROM embeddings, (SELECT unnest([0, 1, 2])::BIGINT AS i)), q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS query FROM embeddings GROUP BY 1),
s AS (SELECT query_id, chunk_id, {_COS.format('embedding', 'query')} AS cos FROM v, q) SELECT query_id, chunk_id, round((1 + cos) / 2, 4) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, chunk_id))::INT AS rank FROM s QUALIFY rank <= 20""",
        "upsert_versions": "WITH n AS (SELECT user_id, event_id, event_type AS kind FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, event_type DESC) = 1) SELECT * FROM n UNION ALL SELECT id, -1, 'old' FROM range(400) t(id) WHERE id NOT IN (SELECT user_id FROM n)",
        "hydrate_with_documents": f"WITH h AS ({_topk('true', 50)}) SELECT chunk_id, l.doc_id % 50 AS document_id, d.source, score FROM h JOIN labels l ON l.doc_id = chunk_id JOIN documents d ON d.doc_id = l.doc_id % 50",
        "rerank_pairs": f"WITH {CANDIDATES}, x AS (SELECT query_id, chunk_id, rank, (length(substr(text, 1, 512)) - length(replace(substr(text, 1, 512), 'the', '')))::DOUBLE AS raw FROM cand JOIN documents ON doc_id = chunk_id), z AS (SELECT *, round((raw - min(raw) OVER w) / CASE WHEN max(raw) OVER w > min(raw) OVER w THEN max(raw) OVER w - min(raw) OVER w ELSE 1 END, 4) AS rerank_score FROM x WINDOW w AS (PARTITION BY query_id)) {_take('rerank_score', 'z')}",
        "chat_messages": f"WITH {said} SELECT session_id || '-' || item_id * 1000000 || '-u' AS id, session_id, 'user' AS role, question AS content, NULL::INT AS prompt_tokens, NULL::BOOLEAN AS was_streamed, item_id * 1000000 AS created_at FROM b UNION ALL SELECT session_id || '-' || item_id * 1000000 || '-a', session_id, 'assistant', answer, prompt_tokens, true, item_id * 1000000 + 1 FROM b",
        "chat_links": f"WITH {said} SELECT session_id || '-' || item_id * 1000000 || '-a' AS message_id, unnest([item_id::VARCHAR, 'x']) AS chunk_id FROM b",
        "stream_lines": f"""WITH {said}, t AS (SELECT item_id, prompt_tokens, string_split(question, ' ') AS ws FROM b), x AS (SELECT item_id, list_append(list_transform(ws, lambda w: 'data: ' || to_json({{type: 'token', text: w}})::VARCHAR), CASE WHEN item_id % 5 = 0 THEN 'data: {{"type":"error","text":"model gone"}}' ELSE 'data: {{"type":"done","payload":{{"prompt_tokens":' || prompt_tokens || '}}}}' END) AS ls FROM t)
SELECT item_id, unnest(range(len(ls)))::INT AS seq, unnest(ls) AS line FROM x""",
        "session_open": f"""WITH {_SESSIONS}, k AS (SELECT 'c' || id AS id, id % 2 AS user_id, title, is_active FROM s), w AS (SELECT 'c' || i * 7 AS id, CASE WHEN i % 3 <> 0 THEN i % 2 END AS user_id FROM range(30) t(i)),
n AS (SELECT CASE WHEN k.id IS NULL THEN w.id ELSE w.id || '-' || w.user_id END AS id, w.user_id FROM w LEFT JOIN k ON k.id = w.id WHERE k.id IS NULL OR (w.user_id IS NOT NULL AND w.user_id <> k.user_id))
SELECT id, user_id, title, is_active, NULL::BIGINT AS n_links FROM k UNION ALL SELECT id, user_id, '', true, 2 FROM n""",
        "session_documents": f"""WITH {_SESSIONS}, t AS (SELECT * FROM s WHERE is_active ORDER BY updated_at DESC, id LIMIT 50), l AS (SELECT DISTINCT conv_id, conv_id * 3 + turn % 2 AS doc FROM conversations),
x AS (SELECT conv_id, string_agg(doc || ':' || source, ',' ORDER BY doc) AS ds FROM l JOIN documents ON doc_id = doc GROUP BY 1) SELECT id, CASE WHEN title = '' THEN 'Untitled' ELSE title END AS title, message_count, coalesce(ds, '') AS documents FROM t LEFT JOIN x ON conv_id = id""",
        "prompt_with_context": f"WITH c AS ({context}) SELECT query_id, concat_ws(chr(10) || chr(10), '## CONTEXT PASSAGES', context, '## INSTRUCTIONS', 'First name the passages that bear on the question, then put together what they say, then answer with citations.', '## QUESTION' || chr(10) || 'What does ' || query_id || ' hold?', '## YOUR ANSWER') AS prompt FROM c",
    }


def oracle_sql_context() -> str:
    return _core()["context_block"]


def oracle_sql() -> dict[str, str]:
    return _core() | _more()


def _core() -> dict[str, str]:
    long_enough = f"length({_STRIP.format('text')}) > 20"
    return {
        "chunk_fixed_stats": f"WITH {FIXED} SELECT source, {_STATS.format('token_count')} FROM chunks WHERE {long_enough} GROUP BY source",
        "chunk_fixed": f"WITH {FIXED} SELECT doc_id, chunk_index, text, token_count FROM chunks WHERE {long_enough}",
        "chunk_fixed_offsets": f"WITH {OFFSETS} SELECT doc_id, chunk_index, char_start, char_end, page_start, page_end FROM on_pages",
        "semantic_breakpoints": f"""WITH s AS (SELECT label AS document_id, vec_id AS chunk_id, embedding, lag(embedding) OVER w AS prev FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
c AS (SELECT document_id, chunk_id, CASE WHEN prev IS NOT NULL THEN {_COS.format('prev', 'embedding')} END AS similarity FROM s)
SELECT document_id, chunk_id, round(similarity, 4) AS similarity, coalesce(sum((similarity < 0)::INT) OVER (PARTITION BY document_id ORDER BY chunk_id), 0)::INT AS group_id FROM c""",
        "merge_small_groups": f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), r AS (SELECT doc_id, unnest(ls) AS t, unnest(range(len(ls)))::INT AS pos FROM l),
g AS (SELECT *, (pos // 2)::INT AS group_id, {_TOKENS.format('t')} AS tok FROM r), z AS (SELECT *, sum(tok) OVER (PARTITION BY doc_id, group_id) AS size, row_number() OVER (PARTITION BY doc_id, group_id ORDER BY pos) AS k FROM g)
SELECT doc_id, pos, group_id, (sum((k = 1 AND size >= 100 AND group_id > 0)::INT) OVER (PARTITION BY doc_id ORDER BY pos))::INT AS merged_id FROM z""",
        "clean_text": f"SELECT page_id, {_clean('html')} AS cleaned FROM pages",
        "clean_ocr_lines": f"""WITH x AS (SELECT page_id, list_transform(string_split(html, chr(10)), lambda s: {_STRIP.format('s')}) AS ls FROM pages),
y AS (SELECT page_id, array_to_string(list_transform(list_filter(ls, lambda s: s = '' OR length(s) > 1 OR regexp_matches(s, '^[\\p{{L}}\\p{{N}}]$')), lambda s: regexp_replace(regexp_replace(s, '\\|{{3,}}', '', 'g'), '\\s{{3,}}', '  ', 'g')), chr(10)) AS t FROM x)
SELECT page_id, {_clean('t')} AS cleaned FROM y""",
        "table_text": f"""WITH r AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: list_transform(string_split(x, ' | '), lambda c: {_STRIP.format('c')})) AS rows_ FROM documents WHERE contains(text, ' | '))
SELECT doc_id, array_to_string(list_transform(list_filter(rows_, lambda r: len(list_filter(r, lambda c: c <> '')) > 0), lambda r: '| ' || array_to_string(r, ' | ') || ' |'), chr(10)) AS table_text FROM r""",
        "text_measures": f"SELECT doc_id, len({_WORDS.format('text')})::INT AS word_count, {_TOKENS.format('text')} AS token_count, {_PREVIEW.format('text', 120)} AS preview, length({_STRIP.format('text')}) < 50 AS needs_ocr FROM documents",
        "repeated_lines": f"""WITH p AS (SELECT source || '/' || (doc_id % 7) AS document_id, doc_id, regexp_replace(text, '[A-Za-z ]{{30,}}', 'line', 'g') AS text FROM documents),
x AS (SELECT DISTINCT document_id, doc_id, unnest(string_split(text, chr(10))) AS raw FROM p), c AS (SELECT document_id, {_STRIP.format('raw')} AS line, count(*) AS n FROM x GROUP BY 1, 2),
t AS (SELECT document_id, count(*) AS n_pages FROM p GROUP BY 1)
SELECT document_id, line, n, n_pages FROM c JOIN t USING (document_id) WHERE line <> '' AND length(line) < 80 AND n >= greatest(2, n_pages * 0.4)""",
        "strip_repeated_lines": f"""WITH p AS (SELECT source AS document_id, doc_id AS page_number, 'Header of ' || source || chr(10) || text AS text FROM documents),
x AS (SELECT DISTINCT document_id, page_number, unnest(string_split(text, chr(10))) AS raw FROM p), c AS (SELECT document_id, {_STRIP.format('raw')} AS line, count(*) AS n FROM x GROUP BY 1, 2),
t AS (SELECT document_id, count(*) AS n_pages FROM p GROUP BY 1),
rep AS (SELECT document_id, list(line) AS lines FROM c JOIN t USING (document_id) WHERE line <> '' AND length(line) < 80 AND n >= greatest(2, n_pages * 0.4) AND n_pages > 2 GROUP BY 1)
SELECT document_id, page_number, CASE WHEN lines IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda s: NOT list_contains(lines, {_STRIP.format('s')})), chr(10)) END AS text FROM p LEFT JOIN rep USING (document_id)""",
        "page_offsets": f"WITH {LINES} SELECT document_id, page_number, char_start, char_end, len({_WORDS.format('text')})::INT AS word_count, length({_STRIP.format('text')}) < 50 AS is_empty FROM pg",
        "page_offsets_exact": f"""WITH {LINES} SELECT document_id, page_number, s AS char_start, (s + length(text))::INT AS char_end FROM (SELECT *, coalesce(sum(CASE WHEN {_STRIP.format('text')} <> '' THEN length(text) + 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS s FROM pages_)""",
        "page_assembly": f"""WITH {LINES}, g AS (SELECT document_id, coalesce(string_agg(text, chr(10) ORDER BY page_number) FILTER ({_STRIP.format('text')} <> ''), '') AS full_text, count(*)::INT AS page_count,
coalesce(string_agg(page_number::VARCHAR, ',' ORDER BY page_number) FILTER (length({_STRIP.format('text')}) < 50), '') AS empty_pages FROM pages_ GROUP BY 1)
SELECT document_id, full_text, page_count, length(full_text)::INT AS char_count, {_STRIP.format('full_text')} <> '' AS has_text, empty_pages FROM g""",
        "page_for_char": f"""WITH {LINES}, w AS (SELECT DISTINCT doc_id AS document_id, unnest([0, n_chars // 2, n_chars + 5])::INT AS position FROM documents), e AS (SELECT document_id, max(page_number) AS last_page FROM pg GROUP BY 1)
SELECT w.document_id, position, coalesce(min(p.page_number), min(last_page))::INT AS page_number FROM w JOIN e USING (document_id) LEFT JOIN pg p ON p.document_id = w.document_id AND position BETWEEN p.char_start AND p.char_end GROUP BY 1, 2""",
        "page_filter": f"WITH {OFFSETS} SELECT doc_id, chunk_index, {_PREVIEW.format('text', 120)} AS preview FROM on_pages WHERE page_start <= 2 AND page_end >= 2",
        "title_from_filename": f"SELECT page_id, {_title('translate(' + _STEM.format('url') + ', ' + chr(39) + '_-' + chr(39) + ', ' + chr(39) + '  ' + chr(39) + ')')} AS title FROM pages",
        "highlight_terms": r"SELECT item_id, regexp_replace(text, '(that|tion)', '<mark>\1</mark>', 'gi') AS marked FROM benchmark",
        "vector_topk": _topk("true", 20),
        "vector_topk_scoped": _topk("document_id = 3", 5),
        "vector_topk_multi": _topk("document_id IN (1, 2, 5)", 20),
        "vector_topk_batch": f"WITH {CANDIDATES} SELECT * FROM cand",
        "hydrate_hits": f"WITH h AS ({_topk('true', 50)}) SELECT chunk_id, score, quality FROM h JOIN labels ON doc_id = chunk_id",
        "collection_name": f"SELECT doc_id, 'doc_' || replace({_NAME}, '-', '') AS per_document, CASE WHEN lang IS NULL THEN 'strataq_chunks' ELSE 'user_' || lang END AS per_user, 'strataq_chunks' AS all_in_one FROM documents",
        "upsert_latest": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
        "upsert_vectors": "SELECT vec_id AS chunk_id, CASE WHEN label = 1 THEN 99 ELSE label END::INT AS document_id FROM embeddings UNION ALL SELECT -1, 99",
        "delete_document": "SELECT vec_id AS chunk_id, label AS document_id FROM embeddings WHERE label <> 4",
        "delete_cascade": "SELECT 'documents' AS name, count(DISTINCT label) AS n FROM embeddings WHERE label >= 3 UNION ALL SELECT 'chunks', count(*) FROM embeddings WHERE label >= 3 UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE label >= 3",
        "replace_document_chunks": f"WITH {FIXED}, x AS (SELECT c.doc_id AS document_id, chunk_index, token_count, t.doc_id IS NOT NULL AS fresh FROM chunks c LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) t ON t.doc_id = c.doc_id) SELECT document_id, chunk_index, CASE WHEN fresh THEN 1 ELSE token_count END::INT AS token_count, 'chunk_' || document_id || '_' || chunk_index AS chunk_id FROM x WHERE NOT fresh OR chunk_index = 0",
        "index_completeness": "WITH d AS (SELECT doc_id AS document_id FROM documents WHERE doc_id % 5 <> 0), c AS (SELECT doc_id AS document_id, count(*) AS chunk_count, count(*) FILTER (quality = 1) AS embedded_chunks FROM labels GROUP BY 1) SELECT document_id, coalesce(chunk_count, 0) AS chunk_count, coalesce(embedded_chunks, 0) AS embedded_chunks, coalesce(embedded_chunks, 0) AS vector_count, coalesce(chunk_count, 0) = coalesce(embedded_chunks, 0) AS fully_indexed FROM d LEFT JOIN c USING (document_id)",
        "unembedded_docs": "SELECT doc_id AS id, 'ready' AS status FROM documents WHERE doc_id % 5 <> 0 AND doc_id IN (SELECT doc_id FROM labels WHERE quality <> 1)",
        "mark_embedded": "SELECT doc_id AS chunk_id, toxic = 1 AS is_embedded, CASE WHEN toxic = 1 THEN 'hash-embedder-v1' END AS embedding_model FROM labels",
        "rerank_fallback": f"WITH {CANDIDATES} {_take('rerank_score', 'blend')}",
        "rerank_minmax": f"WITH {CANDIDATES}, m AS (SELECT *, (chunk_id % 7)::DOUBLE AS raw FROM cand), z AS (SELECT *, round((raw - min(raw) OVER w) / CASE WHEN max(raw) OVER w > min(raw) OVER w THEN max(raw) OVER w - min(raw) OVER w ELSE 1 END, 4) AS rerank_score FROM m WINDOW w AS (PARTITION BY query_id)) {_take('rerank_score', 'z')}",
        "rerank_listwise": f"WITH {CANDIDATES}, z AS (SELECT *, coalesce(([0.3, 0.95, 1.0, 0.025, 0.7])[row_number() OVER (PARTITION BY query_id ORDER BY rank)], 0)::DOUBLE AS rerank_score FROM cand) {_take('rerank_score', 'z')}",
        "parse_listwise_scores": r"WITH x AS (SELECT event_id, list_transform(regexp_extract_all(props, '\d+(?:\.\d+)?'), lambda s: round(least(greatest(s::DOUBLE, 0), 10) / 10, 4)) AS s FROM events) SELECT event_id, array_to_string(list_transform(list_concat(s, [0.0, 0.0, 0.0, 0.0]::DOUBLE[])[1:4], lambda v: printf('%.4f', v)), ',') AS scores FROM x",
        "context_budget": f"WITH {_BUDGET} SELECT query_id, n, length(shown)::INT AS shown_chars, right(shown, 40) AS ends FROM b WHERE shown IS NOT NULL",
        "context_block": f"""WITH {_BUDGET}, x AS (SELECT query_id, n, shown, {_HEADER.format('n', "'Doc ' || doc_id", _LABEL.format('n', '(n + n % 2)', '-'), '1.0::DOUBLE / n')} AS header FROM b WHERE shown IS NOT NULL)
SELECT query_id, string_agg(repeat('─', 50) || chr(10) || header || chr(10) || repeat('─', 50) || chr(10) || shown, chr(10) || chr(10) ORDER BY n) AS context FROM x GROUP BY 1""",
        "citation_labels": f"""WITH x AS (SELECT doc_id, doc_id % 5 + 1 AS n, doc_id % 5 + 1 + doc_id % 2 AS e, 'Doc ' || doc_id AS title, n_chars / 40000.0::DOUBLE AS s FROM documents)
SELECT doc_id, {_HEADER.format('n', 'title', _LABEL.format('n', 'e', '-'), 's')} AS header, title || ' · ' || {_LABEL.format('n', 'e', '–')} AS label FROM x""",
        "extract_citations": f"WITH {_CITES} SELECT conv_id, turn, string_agg(label, '|' ORDER BY i) AS citations FROM c GROUP BY 1, 2",
        "uncited": f"WITH {_CITES}, n AS (SELECT conv_id, turn, unnest(range(1, 6))::INT AS n FROM a) SELECT n.conv_id || '-' || n.turn AS query_id, n FROM n WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = n.conv_id AND c.turn = n.turn AND c.label = '[Source ' || n.n || ']')",
        "retrieval_scores_record": f"WITH {CANDIDATES}, t AS ({_take('rerank_score', 'blend')}) SELECT query_id, chunk_id, c.score AS retrieval_score, coalesce(t.rerank_score, 0) AS rerank_score, t.n AS citation_n, coalesce(t.n <= 2, false) AS was_cited FROM cand c LEFT JOIN t USING (query_id, chunk_id)",
        "history_last_n": f"WITH {_HISTORY.format(4)} SELECT conv_id AS session_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS pos, CASE WHEN role = 'user' THEN 'user' ELSE 'model' END AS role, text FROM h",
        "history_block": f"WITH {_BLOCK} SELECT session_id, history FROM hb",
        "prompt_build": f"""WITH {_BLOCK}, q AS (SELECT conv_id AS session_id, arg_max(text, turn) AS question FROM conversations GROUP BY 1),
p AS (SELECT session_id, concat_ws(chr(10) || chr(10), '## CONTEXT PASSAGES', 'No relevant context passages found.', '## INSTRUCTIONS', 'First name the passages that bear on the question, then put together what they say, then answer with citations.', history, '## QUESTION' || chr(10) || question, '## YOUR ANSWER') AS prompt FROM q JOIN hb USING (session_id))
SELECT session_id, prompt, length(prompt) // 4 AS token_estimate FROM p""",
        "session_list": f"WITH {_SESSIONS} SELECT id, CASE WHEN title = '' THEN 'Untitled' ELSE title END AS title, updated_at, message_count FROM s WHERE is_active ORDER BY updated_at DESC, id LIMIT 50",
        "session_detail": f"""WITH {LINES}, m AS (SELECT conv_id || '-' || turn AS id, role FROM conversations WHERE conv_id = 2), src AS (SELECT source AS title FROM documents d JOIN pages_ p ON p.document_id = d.doc_id WHERE d.doc_id = 2 AND page_number = 1)
SELECT id, role, CASE WHEN role = 'assistant' THEN (SELECT count(*) FROM src) ELSE NULL END::INT AS n_sources, CASE WHEN role = 'assistant' THEN (SELECT any_value(title) FROM src) END AS title, CASE WHEN role = 'assistant' THEN 3 END::INT AS total_tokens FROM m""",
        "session_soft_delete": f"WITH {_SESSIONS} SELECT id, is_active AND id <> 1 AS is_active FROM s",
        "document_stats": f"WITH {FIXED} SELECT d.doc_id AS id, {_STATS.format('c.token_count')} FROM documents d LEFT JOIN (SELECT * FROM chunks WHERE token_count > 150) c ON c.doc_id = d.doc_id GROUP BY d.doc_id",
        "document_list": "SELECT doc_id AS id, n_chars // 1024 AS file_size_kb, source FROM documents ORDER BY doc_id DESC",
        "document_detail": f"WITH {FIXED} SELECT doc_id AS document_id, chunk_index, token_count FROM chunks WHERE chunk_index < 10",
        "token_bars": f"WITH {FIXED} SELECT doc_id AS document_id, chunk_index, round(100 * token_count / max(token_count) OVER (PARTITION BY doc_id))::INT AS token_bar FROM chunks",
        "cited_documents": "SELECT doc_id AS id, source FROM documents WHERE doc_id IN (SELECT doc_id % 50 FROM labels WHERE doc_id % 3 = 1)",
        "upload_validation": f"WITH {_FILES} SELECT page_id, CASE WHEN lower(right(path, 4)) <> '.pdf' THEN 'unsupported type ' || lower(right(path, 4)) WHEN head <> '%PDF' THEN 'not a PDF' WHEN length > 20971520 THEN 'too large' END AS error FROM files",
        "ingest_decision": f"{_DECIDE} SELECT * FROM d",
        "ingest_summary": f"{_DECIDE} SELECT decision, count(*) AS n FROM d GROUP BY 1",
        "status_machine": "WITH e AS (SELECT event_id, event_id % 3 = 0 AS ready, CASE WHEN event_id % 7 = 0 THEN 'damaged file' WHEN event_id % 5 = 0 THEN 'No text extracted.' WHEN event_id % 4 = 0 THEN 'No chunks.' END AS problem FROM events) SELECT event_id, CASE WHEN ready OR problem IS NULL THEN 'ready' ELSE 'failed' END AS status, CASE WHEN ready OR problem IS NULL THEN '' ELSE problem END AS error_message FROM e",
        "event_windows": "SELECT epoch(time_bucket(INTERVAL '5 minutes', ts))::BIGINT AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    }
