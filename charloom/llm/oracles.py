"""DuckDB forms of the queries that SQL can express within a verify run's time."""

from __future__ import annotations

from .chat import HOSTILE

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SMALL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
COUNT = "(length(t) - length(regexp_replace(t, '{}', '', 'g')))"

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, i, word, lag(word) OVER o AS before, CASE WHEN lead(word, 4) OVER o IS NOT NULL THEN [word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] END AS five FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, word, before, five IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, five) > 1 AS twice FROM g),
c AS (SELECT doc_id, word, before, max(twice::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS inside FROM r),
n AS (SELECT doc_id, sum(inside)::BIGINT AS n_repeat_words, count(DISTINCT word) AS v, count(*) FILTER (word = before) AS stutter, max(k) AS bars FROM (SELECT *, count(*) FILTER (word IN ('|', '-', '*', '>', '<', '#')) OVER (PARTITION BY doc_id) AS k FROM c) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, {COUNT.format('[#*$%&|<>]')}::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(v, 0) AS v, coalesce(stutter, 0) AS stutter, coalesce(bars, 0) AS bars,
  {COUNT.format('[A-Z]')} AS capitals, {COUNT.format('[a-z]')} AS small, {COUNT.format(chr(10))} AS breaks, strlen(regexp_replace(t, '[\x00-@\[-`{{-\x7f]', '', 'g')) AS letters, {COUNT.format('[!?]')} AS calls FROM d LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed
  OR n_symbols > 3 AND 20 * n_symbols > word_chars OR capitals > small AND capitals > 20 OR n_dup_lines > 2 AND 10 * n_dup_lines > 3 * (breaks + 1)
  OR NOT word_chars BETWEEN 2 * n_words AND 20 * n_words OR n_words >= 50 AND v * v < n_words OR n_words >= 8 AND 4 * stutter >= n_words
  OR 4 * bars >= n_words OR 2 * letters < word_chars OR 3 * calls > n_words) AS kept FROM b
"""

CHAT = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{HOSTILE}' UNION ALL SELECT -1, 1, 'assistant', '{HOSTILE}'),
t AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 'start') AS before,
  12 + length(role) + 1 + length(text) + (length(text) - length(replace(text, '\', ''))) + 2 * ((length(text) - length(replace(text, '<|im_start|>', ''))) / 12 + (length(text) - length(replace(text, '<|im_end|>', ''))) / 10) + 11 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars,
  count(*) FILTER (before || '>' || role NOT IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user', 'assistant>tool', 'tool>assistant')) AS n_breaches
FROM t GROUP BY conv_id
"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce({SMALL}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT doc_id, hash(g) AS h FROM s),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM k x JOIN k y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) m ON m.a = d.doc_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to FROM g
"""

SUBSTRING = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, i, hash(w[i:i + 12]) AS h, w[i:i + 12] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d)),
q AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h, g) < doc_id AS dup FROM p),
w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT doc_id, i, word, coalesce(max(q.dup::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) AS gone FROM w LEFT JOIN q USING (doc_id, i)),
a AS (SELECT doc_id, count(*) AS n, sum(gone) AS r, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND x.n > 0 AND y.n > 0 WHERE list_inner_product(x.e, y.e) / (x.n * y.n) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT vec_id, least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id FROM v)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c USING (vec_id) LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = v.vec_id
"""

SQL: dict[str, str] = {
    "op3_quality_cascade": QUALITY,
    "op4_chat_format": CHAT,
    "op7_ngram_jaccard": JACCARD,
    "op8_zip_warc": WARC,
    "op10_debruijn_dedup": SUBSTRING,
    "op13_grid_order_join": VECTORS,
}
