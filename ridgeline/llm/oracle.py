"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

_SPACE = "[ \\t\\n\\x0B\\f\\r]+"

LM_SCORING = f"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS row_id,
         [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}') IF x <> ''] AS ws
  FROM documents),
places AS (
  SELECT row_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM words),
grams AS (
  SELECT row_id, i, w, lag(w) OVER doc AS v, lag(w, 2) OVER doc AS u
  FROM places WINDOW doc AS (PARTITION BY row_id ORDER BY i)),
c1 AS (SELECT w, count(*) AS n FROM grams GROUP BY 1),
c2 AS (SELECT v, w, count(*) AS n FROM grams WHERE i >= 2 GROUP BY 1, 2),
c3 AS (SELECT u, v, w, count(*) AS n FROM grams WHERE i >= 3 GROUP BY 1, 2, 3),
total AS (SELECT count(*) AS n FROM grams),
scored AS (
  SELECT g.row_id,
    CASE WHEN i >= 3 AND t.n >= 2 THEN t.n / b.n
         WHEN i >= 2 AND p.n >= 2 THEN (CASE WHEN i = 2 THEN 1.0 ELSE 0.4 END)::DOUBLE * p.n / o.n
         ELSE (CASE WHEN i = 1 THEN 1.0 WHEN i = 2 THEN 0.4 ELSE 0.16 END)::DOUBLE * s.n / total.n END AS value,
    CASE WHEN i = 1 OR (i >= 3 AND t.n >= 2) OR (i = 2 AND p.n >= 2) THEN 0 ELSE 1 END AS backed
  FROM grams g CROSS JOIN total
  JOIN c1 s ON s.w = g.w
  LEFT JOIN c1 o ON o.w = g.v
  LEFT JOIN c2 p ON p.v = g.v AND p.w = g.w
  LEFT JOIN c2 b ON b.v = g.u AND b.w = g.v
  LEFT JOIN c3 t ON t.u = g.u AND t.v = g.v AND t.w = g.w),
sums AS (SELECT row_id, sum(ln(value)) AS s, sum(backed) AS b FROM scored GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, round(coalesce(s, 0), 4) AS log_score, coalesce(b, 0)::BIGINT AS n_backed_off
FROM words LEFT JOIN sums USING (row_id)
"""


QUOTATIONS = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, turn * 4294967296 + conv_id AS message, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations),
texts AS (SELECT conv_id, turn, max(text) AS text FROM turns GROUP BY 1, 2),
keyed AS (
  SELECT m.*, nullif(lower(trim(regexp_replace(m.text, '\s+', ' ', 'g'))), '') AS said,
         nullif(lower(trim(regexp_replace(a.text, '\s+', ' ', 'g'))), '') AS one,
         nullif(lower(trim(regexp_replace(b.text, '\s+', ' ', 'g'))), '') AS two
  FROM turns m
  LEFT JOIN texts a ON a.conv_id = m.conv_id AND a.turn = m.turn - 1
  LEFT JOIN texts b ON b.conv_id = m.conv_id AND b.turn = m.turn - 2),
alone AS (SELECT said, min(message) AS source FROM keyed WHERE said IS NOT NULL GROUP BY 1),
answers AS (SELECT said, one, min(message) AS source FROM keyed WHERE said IS NOT NULL AND one IS NOT NULL GROUP BY 1, 2),
linked AS (
  SELECT k.message, k.conv_id, k.turn, k.role, k.text, k.one, k.two,
         CASE WHEN p.source < k.message THEN p.source WHEN s.source < k.message THEN s.source END AS source1,
         CASE WHEN t.source < k.message THEN t.source END AS source2
  FROM keyed k
  LEFT JOIN answers p ON p.said = k.one AND p.one = k.two
  LEFT JOIN alone s ON s.said = k.one
  LEFT JOIN alone t ON t.said = k.two),
parents AS (SELECT message, coalesce(source1, source2) AS parent FROM linked),
tree AS (
  SELECT message, message AS root, 0 AS depth FROM parents WHERE parent IS NULL
  UNION ALL
  SELECT p.message, root, depth + 1 FROM parents p JOIN tree ON p.parent = tree.message)
SELECT message, conv_id, turn, role, parent, root, depth::INTEGER AS depth,
       (row_number() OVER (PARTITION BY root ORDER BY message))::INTEGER AS place, trim(text, chr(10)) AS text,
       (one IS NOT NULL)::BIGINT + (two IS NOT NULL)::BIGINT AS n_quotes,
       (source1 IS NOT NULL)::BIGINT + (source2 IS NOT NULL)::BIGINT AS n_linked
FROM linked JOIN parents USING (message) JOIN tree USING (message)
"""

TOKEN_COUNTS = f"""
WITH docs AS (
  SELECT doc_id, source, lang, string_split(text, chr(10)) AS lines,
         row_number() OVER (PARTITION BY text ORDER BY doc_id) AS copy
  FROM documents),
kept AS (
  SELECT doc_id, source, lang,
         CASE WHEN len(list_distinct(lines)) < len(lines) THEN list_distinct(lines) ELSE lines END AS lines
  FROM docs WHERE copy = 1),
joined AS (SELECT doc_id, source, lang, array_to_string(lines, chr(10)) AS text FROM kept),
counts AS (
  SELECT source, lang, len([x FOR x IN string_split_regex(text, '{_SPACE}') IF x <> '']) AS words,
         octet_length(encode(text)) AS bytes FROM joined)
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS docs, sum(words)::BIGINT AS tokens FROM counts GROUP BY 1, 2
UNION ALL
SELECT source, lang, 'bytes-1', count(*), sum(bytes)::BIGINT FROM counts GROUP BY 1, 2
"""


SOURCE_AUDIT = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
words AS (
  SELECT row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY 1, 2 HAVING count(DISTINCT row_id) >= 30),
occurring AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY 1, 2),
lang_counts AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY 1, 2),
lang_totals AS (SELECT lang, sum(n) AS total FROM lang_counts GROUP BY 1),
grid AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (coalesce(total, 0)::HUGEINT + 5 * v) AS p
  FROM occurring JOIN kept USING (lang) JOIN sizes USING (lang)
  LEFT JOIN totals USING (lang, source) LEFT JOIN counts USING (lang, source, term)),
langs AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (total::HUGEINT + 5 * v) AS q
  FROM lang_counts JOIN lang_totals USING (lang) JOIN sizes USING (lang)),
distances AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(d.value, 0)::BIGINT AS value
  FROM occurring a JOIN occurring b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
leads AS (
  SELECT lang, source, term AS item, (p - q)::BIGINT AS value
  FROM grid JOIN langs USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER FROM leads)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

#: An automaton stands in for the targets: 0 nothing yet, 1 after the system turn, 2 after a user
#: turn, 3 after an assistant turn. Each step keeps the cheapest, then least, edits per state.
CONVERSATION_REPAIR = r"""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([ord(c) FOR c IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')],
      lambda h, c: list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END,
                               xor(h, c::BIGINT)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS damage
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN damage = 1 THEN '' WHEN damage = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN damage = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE damage <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy) AS i FROM damaged),
marked AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
faults AS (
  SELECT *, body = '' AS blank, body <> '' AND again AS duplicate,
         body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS truncated
  FROM marked),
steps(q, inserts, cost, spot) AS (
  VALUES (0, '', 0, 0), (0, 'I', 3, 2), (0, 'II', 6, 3), (1, '', 0, 1), (1, 'I', 3, 2), (1, 'II', 6, 3),
         (2, '', 0, 2), (2, 'I', 3, 3), (2, 'II', 6, 2), (3, '', 0, 3), (3, 'I', 3, 2), (3, 'II', 6, 3)),
moves(spot, initial, op, cost, after) AS (
  VALUES (0, 's', 'K', 0, 1), (0, 'u', 'K', 0, 2), (1, 'u', 'K', 0, 2), (3, 'u', 'K', 0, 2), (2, 'a', 'K', 0, 3),
         (0, '', 'R', 3, 2), (1, '', 'R', 3, 2), (3, '', 'R', 3, 2), (2, '', 'R', 3, 3)),
options AS (
  SELECT f.conv_id, f.i, s.q, s.inserts || m.op AS edits, s.cost + m.cost + CASE WHEN f.truncated THEN 3 ELSE 0 END AS cost, m.after
  FROM faults f, steps s JOIN moves m ON m.spot = s.spot
  WHERE NOT f.blank AND NOT f.duplicate AND (m.initial = f.initial OR m.op = 'R')
  UNION ALL
  SELECT f.conv_id, f.i, s.q, s.inserts || 'D', s.cost + 4, s.spot FROM faults f, steps s),
best AS (
  SELECT conv_id, i, q, after, min({'cost': cost, 'edits': edits}) AS least FROM options GROUP BY 1, 2, 3, 4),
walks(conv_id, i, q, cost, edits) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, 0, '' FROM faults
  UNION ALL
  SELECT conv_id, i, q, least.cost, least.edits FROM (
    SELECT w.conv_id, b.i, b.after AS q, min({'cost': w.cost + b.least.cost, 'edits': w.edits || b.least.edits}) AS least
    FROM walks w JOIN best b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.i = w.i + 1 AND b.q = w.q
    GROUP BY 1, 2, 3)),
ended AS (
  SELECT conv_id, min({'cost': cost + CASE q WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END,
                       'edits': edits || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}) AS least
  FROM walks JOIN (SELECT conv_id AS c, max(i) AS n FROM faults GROUP BY 1) ON c IS NOT DISTINCT FROM conv_id AND i = n
  GROUP BY 1),
letters AS (
  SELECT conv_id, unnest(string_split(least.edits, '')) AS op, unnest(range(1, length(least.edits) + 1)) AS place FROM ended),
numbered AS (
  SELECT conv_id, op, place, sum((op <> 'I')::BIGINT) OVER w AS i, sum((op <> 'D')::BIGINT) OVER w AS spot,
         sum((op <> 'D')::BIGINT) OVER (PARTITION BY conv_id) AS length
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)),
lines AS (
  SELECT n.conv_id, place,
    CASE WHEN op = 'K' THEN f.role WHEN (spot - length) % 2 = 0 THEN 'assistant' ELSE 'user' END || ':'
      || CASE WHEN op = 'I' THEN '' ELSE f.text END AS line
  FROM numbered n LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.i = n.i
  WHERE op <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY place) AS repaired FROM lines GROUP BY 1),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.least.cost, 0)::BIGINT AS cost,
       coalesce(e.least.edits, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_lm_scoring": LM_SCORING,
        "op2_quotations": QUOTATIONS,
        "op3_token_counts": TOKEN_COUNTS,
        "op11_conversation_repair": CONVERSATION_REPAIR,
        "op12_source_audit": SOURCE_AUDIT,
    }
