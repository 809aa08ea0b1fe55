"""DuckDB SQL for the operators that SQL can express. The others are tested against brute force in tests/llm."""

from __future__ import annotations

OP3 = """
WITH g AS (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(g.t) AS text_sha256
FROM documents d JOIN g ON coalesce(d.text, '') = g.t
"""

OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS sh
  FROM w),
post AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
overlap AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i
  FROM post a JOIN post b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM overlap WHERE 100 * i >= 75 * (na + nb - i)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(node, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.node)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(root) AS component_id
FROM s JOIN reach ON s.doc_id = reach.node GROUP BY s.doc_id, len(sh)
"""

OP5 = r"""
WITH r(rule_host, rule_path, rule_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN instr(url, '://') > 0
  THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT k, page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT k, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT p.*, r.*, row_number() OVER (PARTITION BY k ORDER BY length(rule_host) + length(rule_path) DESC NULLS LAST,
  length(rule_host) DESC) AS nth
  FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict
FROM m WHERE nth = 1
"""


OP11 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k AS words, unnest(list_transform(range(1, len(w) - k + 2),
    lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) r(k) WHERE len(w) >= k),
f AS (SELECT lang, words, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
cut AS (SELECT c.lang, c.phrase, c.words, c.a, k, l.a AS l, r.a AS r FROM f c JOIN range(1, 5) s(k) ON k < c.words
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(string_split(c.phrase, ' ')[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ')),
scored AS (SELECT cut.*, n, (CAST(1000 AS HUGEINT) * a * n) // (CAST(l AS HUGEINT) * r) AS score FROM cut JOIN total USING (lang)),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
kept AS (SELECT * FROM best b WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM f q WHERE q.lang = b.lang AND q.words > b.words
  AND 100 * q.a >= 100 * b.a AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

OP12 = r"""
WITH dw AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS span, unnest(list_transform(range(1, greatest(len(w) - 8, 2)),
    lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS win FROM iw WHERE len(w) > 0),
spans AS (SELECT DISTINCT span FROM win),
dwin AS (SELECT k, span, unnest(range(1, len(w) - span + 2)) AS pos,
    unnest(list_transform(range(1, len(w) - span + 2), lambda i: array_to_string(w[i:i + span - 1], ' '))) AS win
  FROM dw, spans WHERE len(w) >= span),
hit AS (SELECT DISTINCT k, pos, span, item FROM dwin JOIN win USING (span, win)),
words AS (SELECT k, count(DISTINCT pos + j) AS n_hit FROM (SELECT DISTINCT k, pos, span FROM hit), range(10) r(j)
  WHERE j < span GROUP BY k),
items AS (SELECT k, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT k, item FROM hit) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN words USING (k) LEFT JOIN items USING (k)
"""

#: crc32 as SQL: the table of the reflected polynomial 0xEDB88320, then one step a byte (the keys are ASCII).
CRC = """
tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM range(CAST(256 AS BIGINT)) r(i)),
"""

#: Edits as a walk over grammar states: '' nothing yet, s after the system turn, U after a pair, A after a user turn.
OP13 = r"""
WITH RECURSIVE """ + CRC + r"""
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
  list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM k, tab),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
  regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS shown FROM d),
f AS (SELECT *, CASE WHEN shown = '' THEN 'b'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM o),
ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
r AS (SELECT ids.c, f.i, f.role, f.text, f.turn, f.fault, f.prev, max(f.i) OVER (PARTITION BY ids.c) AS n
  FROM f JOIN ids ON f.conv_id IS NOT DISTINCT FROM ids.conv_id),
moves(state, inserted, after) AS (VALUES ('', 0, ''), ('', 1, 'A'), ('', 2, 'U'), ('s', 0, 's'), ('s', 1, 'A'), ('s', 2, 'U'),
  ('U', 0, 'U'), ('U', 1, 'A'), ('U', 2, 'U'), ('A', 0, 'A'), ('A', 1, 'U'), ('A', 2, 'A')),
walk(c, i, n, state, cost, audit, body) AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT), n, '', CAST(0 AS BIGINT), '', '' FROM r
  UNION ALL
  SELECT c, i, n, state, best.cost, best.audit, best.body FROM (
    SELECT c, i, n, state, min({'cost': cost, 'audit': audit, 'body': body}) AS best FROM (
      SELECT w.c, w.i + 1 AS i, w.n, e.state, w.cost + 2 * m.inserted + e.cost AS cost,
        w.audit || repeat('I', m.inserted) || e.edit AS audit,
        w.body || CASE WHEN m.inserted = 0 THEN '' WHEN w.state = 'A' THEN chr(10) || 'assistant:'
            ELSE chr(10) || 'user:' END
          || CASE WHEN m.inserted < 2 THEN '' WHEN w.state = 'A' THEN chr(10) || 'user:' ELSE chr(10) || 'assistant:' END
          || e.line AS body
      FROM walk w JOIN moves m ON m.state = w.state JOIN r ON r.c = w.c AND r.i = w.i + 1,
      LATERAL (
        SELECT m.after AS state, 3 AS cost, 'D' AS edit, '' AS line
        UNION ALL
        SELECT CASE WHEN m.after = 'A' THEN 'U' ELSE 'A' END,
          CASE WHEN left(r.role, 1) = CASE WHEN m.after = 'A' THEN 'a' ELSE 'u' END THEN 0 ELSE 2 END
            + CASE WHEN r.fault = 't' THEN 1 ELSE 0 END,
          CASE WHEN left(r.role, 1) = CASE WHEN m.after = 'A' THEN 'a' ELSE 'u' END THEN 'K' ELSE 'R' END,
          chr(10) || CASE WHEN left(r.role, 1) = CASE WHEN m.after = 'A' THEN 'a' ELSE 'u' END THEN r.role
            WHEN m.after = 'A' THEN 'assistant' ELSE 'user' END || ':' || r.text
        WHERE r.fault NOT IN ('b', 'd')
        UNION ALL
        SELECT 's', CASE WHEN r.fault = 't' THEN 1 ELSE 0 END, 'K', chr(10) || r.role || ':' || r.text
        WHERE r.fault NOT IN ('b', 'd') AND m.after = '' AND left(r.role, 1) = 's') e)
    GROUP BY c, i, n, state)),
ends AS (SELECT w.c, min({'cost': w.cost + 2 * m.inserted, 'audit': w.audit || repeat('I', m.inserted),
    'body': w.body || CASE WHEN m.inserted = 0 THEN '' WHEN w.state = 'A' THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' END
      || CASE WHEN m.inserted < 2 THEN '' WHEN w.state = 'A' THEN chr(10) || 'user:' ELSE chr(10) || 'assistant:' END}) AS best
  FROM walk w JOIN moves m ON m.state = w.state WHERE w.i = w.n AND m.after IN ('', 'U') GROUP BY w.c),
s AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
  count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (i > 1 AND prev || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY c)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.body, 2), '')) AS repaired_sha256
FROM ids LEFT JOIN ends ON ids.c = ends.c LEFT JOIN s ON ids.c = s.c
"""


def sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3, "op4_ngram_join": OP4, "op5_url_filter": OP5, "op11_collocations": OP11, "op12_winnow": OP12, "op13_conversation": OP13}
