"""DuckDB SQL that gives the rows of those queries that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CHECKS = {
    "op1_minhash_near_dedup": f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
s AS MATERIALIZED (
    SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
                        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
x AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS sh FROM s),
p AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (min(a.n) + min(b.n) - count(*))),
e AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(root, node) AS (SELECT a, b FROM e UNION SELECT r.root, e.b FROM r JOIN e ON e.a = r.node),
c AS (SELECT root, least(root, min(node)) AS component_id FROM r GROUP BY root)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id, coalesce(c.component_id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON c.root = s.doc_id
""",
    "op3_line_dedup": r"""
WITH raw AS MATERIALIZED (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL),
keyed AS MATERIALIZED (SELECT doc_id, line, trim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM raw),
l AS MATERIALIZED (
    SELECT doc_id, line, s, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS spot FROM keyed WHERE s <> ''),
near AS MATERIALIZED (
    SELECT *, lead(s, 1) OVER o AS s1, lead(n, 1) OVER o AS n1, lead(s, 2) OVER o AS s2, lag(s, 1) OVER o AS b1, lag(n, 1) OVER o AS m1, lag(s, 2) OVER o AS b2
    FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY spot)),
win AS MATERIALIZED (
    SELECT doc_id, spot, CASE WHEN n >= 4 THEN 1 WHEN n + n1 >= 4 THEN 2 WHEN s2 IS NOT NULL THEN 3 END AS size, false AS few,
           CASE WHEN n >= 4 THEN s WHEN n + n1 >= 4 THEN s || chr(10) || s1 ELSE s || chr(10) || s1 || chr(10) || s2 END AS body FROM near
    UNION
    SELECT doc_id, spot - CASE WHEN n >= 4 THEN 0 WHEN n + m1 >= 4 THEN 1 ELSE 2 END, CASE WHEN n >= 4 THEN 1 WHEN n + m1 >= 4 THEN 2 WHEN b2 IS NOT NULL THEN 3 END, false,
           CASE WHEN n >= 4 THEN s WHEN n + m1 >= 4 THEN b1 || chr(10) || s ELSE b2 || chr(10) || b1 || chr(10) || s END FROM near
    UNION SELECT doc_id, spot, 1, true, s FROM l WHERE n < 4),
held AS (SELECT body, few FROM win WHERE size IS NOT NULL GROUP BY body, few HAVING NOT few OR count(DISTINCT doc_id) >= 20),
late AS (
    SELECT doc_id, spot, size FROM (SELECT *, row_number() OVER (PARTITION BY body, few ORDER BY doc_id, spot) AS place FROM win JOIN held USING (body, few) WHERE size IS NOT NULL) WHERE place > 1),
gone AS (SELECT DISTINCT l.doc_id, l.line FROM l JOIN late ON l.doc_id = late.doc_id AND l.spot >= late.spot AND l.spot < late.spot + late.size),
kept AS (
    SELECT raw.doc_id, count(gone.line) AS n_deleted, string_agg(body, chr(10) ORDER BY raw.line) FILTER (gone.line IS NULL) AS text
    FROM raw LEFT JOIN gone ON raw.doc_id = gone.doc_id AND raw.line = gone.line GROUP BY raw.doc_id)
SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS text_sha256
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
""",
    "op4_mtree_top_k": """
WITH v AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
""",
    "op5_chat_formatting": r"""
WITH t AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
g AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
           coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
           sum(length('### : </turn>') + 1 + length(role) + length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/'))) AS chars,
           string_agg(CASE WHEN role IN ('system', 'user', 'assistant') THEN role[1] ELSE 'x' END, '' ORDER BY turn, role, text) AS roles
    FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars,
       regexp_full_match(roles, 's?(ua)+') AS valid,
       CASE WHEN length(regexp_extract(roles, '^s?(ua)*u?')) < length(roles) THEN CAST(length(regexp_extract(roles, '^s?(ua)*u?')) AS INTEGER) ELSE -1 END AS broken_at
FROM g
""",
    "op8_substring_dedup": f"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
win AS MATERIALIZED (SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS body FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w)),
late AS MATERIALIZED (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY body ORDER BY doc_id, p) AS place FROM win) WHERE place > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM late),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
    SELECT word.doc_id, count(gone.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY word.p) FILTER (gone.p IS NULL), '') AS text
    FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
""",
}
