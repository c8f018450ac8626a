"""DuckDB SQL of the queries of this package that SQL can express: chat formatting, embedding near-duplicates, the n-gram
join, source mixing and sharding. The tokenizer, the learned models and the container format are tested in ``tests/llm``."""

from __future__ import annotations

from . import chat_template, source_mix

#: Rows that the chat query adds to the table.
_SAID = "'\\### Assistant: </turn> ok'"


def chat_format() -> str:
    escaped = "replace({0}, '\\', '\\\\')"
    for c in chat_template.CONTROLS:
        escaped = f"replace({escaped}, '{c}', '{c[0]}\\{c[1:]}')"
    frame = len("<turn><says></turn>\n")
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', {_SAID} UNION ALL SELECT -7, 1, 'assistant', {_SAID})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
(sum(length({escaped.format('role')}) + length({escaped.format('text')}) + {frame}) + {len('<end>')})::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""


_REACH = """reach AS (SELECT id, id AS other FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)"""

EMBEDDING = f"""WITH RECURSIVE u AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
nodes AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS s FROM u WHERE len(e) > 0 AND list_dot_product(e, e) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM nodes x JOIN nodes y ON x.id <> y.id AND list_dot_product(x.e, y.e) / (x.s * y.s) >= 0.95),
{_REACH}, parts AS (SELECT id, min(other) AS component_id FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN parts ON id = vec_id LEFT JOIN n ON a = vec_id"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS sh FROM w),
nodes AS (SELECT id, len(sh)::BIGINT AS n FROM s), e AS (SELECT id, unnest(sh) AS g FROM s), often AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1), f AS (SELECT id, g FROM e SEMI JOIN often USING (g)),
c AS (SELECT x.id AS a, y.id AS b, count(*) AS both_ FROM f x JOIN f y ON x.g = y.g AND x.id <> y.id GROUP BY 1, 2),
links AS (SELECT a, b FROM c JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b WHERE 100 * both_ >= 90 * (x.n + y.n - both_)),
{_REACH} SELECT nodes.id AS doc_id, any_value(n) AS n_shingles, min(other) AS component_id FROM nodes JOIN reach USING (id) GROUP BY 1"""


def source_mixing() -> str:
    """The cells are raked in a recursive query: each of its rounds fits the margins in turn, full cells held."""
    parts, wanted, joins = [], [], []
    for m in source_mix.MARGINS:
        parts.append(f"""a_{m} AS (SELECT {m}, sum(n) AS a FROM cells GROUP BY 1), g_{m} AS (SELECT {m}, a, pow(a, 0.7::DOUBLE) / (SELECT sum(pow(a, 0.7::DOUBLE)) FROM a_{m}) AS g FROM a_{m}),
f_{m} AS (SELECT max(f) AS f FROM (SELECT ((SELECT budget FROM b) - coalesce(sum(a) OVER (ORDER BY a / g, {m} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(g) OVER (ORDER BY a / g DESC, {m} DESC ROWS UNBOUNDED PRECEDING) AS f FROM g_{m}))""")
        wanted.append(f"least(g_{m}.a, (SELECT f FROM f_{m}) * g_{m}.g) AS to_{m}")
        joins.append(f"JOIN g_{m} USING ({m})")
    step = "it"
    for m in source_mix.MARGINS:
        sums = f"sum(CASE WHEN part >= n THEN n ELSE 0 END) OVER (PARTITION BY {m}) AS held, sum(CASE WHEN part >= n THEN 0 ELSE part END) OVER (PARTITION BY {m}) AS open_"
        where = f" WHERE off >= {source_mix.SETTLED}::DOUBLE AND round < {source_mix.ROUNDS}" if step == "it" else ""
        step = f"(SELECT * EXCLUDE (held, open_) REPLACE (part * CASE WHEN to_{m} > held AND open_ > 0 THEN (to_{m} - held) / open_ ELSE to_{m} / (held + open_) END AS part) FROM (SELECT *, {sums} FROM {step}{where}))"
    errors = ", ".join(f"abs(sum(least(n, part)) OVER (PARTITION BY {m}) / to_{m} - 1) AS e_{m}" for m in source_mix.MARGINS)
    worst = ", ".join(f"max(e_{m}) OVER ()" for m in source_mix.MARGINS)
    to = ", ".join(f"to_{m}" for m in source_mix.MARGINS)
    return f"""WITH RECURSIVE d AS (SELECT doc_id, text, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(CASE WHEN contains(text, 'License') OR contains(text, 'rights reserved') THEN 'licence' WHEN contains(text, '@') OR contains(text, '+1 (') THEN 'contact'
WHEN contains(text, ' | ') THEN 'table' WHEN length(text) < 1000 THEN 'note' ELSE 'article' END, '') AS topic, greatest(1, (coalesce(length(text), 0) + 3) // 4)::BIGINT AS tokens FROM documents),
cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS n FROM d GROUP BY ALL), b AS (SELECT 0.5::DOUBLE * sum(n) AS budget FROM cells), {', '.join(parts)},
it AS (SELECT source, lang, topic, n, {', '.join(wanted)}, n AS part, 0 AS round, 1::DOUBLE AS off FROM cells {' '.join(joins)}
UNION ALL SELECT source, lang, topic, n, {to}, part, round + 1 AS round, greatest({worst}) AS off FROM (SELECT *, {errors} FROM {step}) AS raked),
r AS (SELECT source, lang, topic, round(least(1.0::DOUBLE, part / n), 9) AS p FROM it WHERE round = (SELECT max(round) FROM it))
SELECT doc_id, d.source, d.lang, d.topic, tokens AS n_tokens, round(p, 6) AS probability FROM d JOIN r ON r.source = d.source AND r.lang = d.lang AND r.topic = d.topic WHERE ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 12))::UBIGINT::DOUBLE / 281474976710656 < p"""


def _crc_table() -> str:
    """The table of the reflected polynomial edb88320, by its rule."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return "[" + ", ".join(map(str, table)) + "]::BIGINT[]"


def jump_shards() -> str:
    return f"""WITH RECURSIVE k AS (SELECT DISTINCT doc_id FROM documents),
j AS (SELECT doc_id, (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616 AS key, -1::BIGINT AS b, 0::BIGINT AS j FROM k
UNION ALL SELECT doc_id, key2 AS key, j AS b, floor((j + 1) * (2147483648::DOUBLE / ((key2 >> 33)::DOUBLE + 1)))::BIGINT AS j FROM (SELECT doc_id, (key * 2862933555777941757 + 1) % 18446744073709551616 AS key2, j FROM j WHERE j < 9)),
s AS (SELECT doc_id, max(b) FILTER (b < 8)::INT AS shard, max(b) FILTER (b < 9)::INT AS grown_shard FROM j GROUP BY 1),
h AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
t AS (SELECT {_crc_table()} AS tbl),
c AS (SELECT doc_id, size::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, b: xor(a >> 8, tbl[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM h, t)
SELECT c.doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY c.doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM c JOIN s ON s.doc_id IS NOT DISTINCT FROM c.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat_format(), "op4_embedding_dedup": EMBEDDING, "op5_jaccard_join": JACCARD, "op6_source_mix": source_mixing(), "op8_jump_shards": jump_shards()}
