"""SQL twins of the queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {}

ORACLES["op1_ngram_jaccard_join"] = rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, len(sh) AS n, sh FROM (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[]
      WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w)),
t AS MATERIALIZED (SELECT doc_id, n, unnest(sh) AS g FROM s),
shared AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k
  FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS MATERIALIZED (SELECT a, b FROM shared WHERE 100 * k >= 80 * (na + nb - k)),
e AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(node, root) AS (
  SELECT a, a FROM e UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node WHERE reach.root < e.b),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT s.doc_id, s.n AS n_shingles, coalesce(least(least.root, s.doc_id), s.doc_id) AS component_id
FROM s LEFT JOIN least ON least.node = s.doc_id
"""

ORACLES["op7_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS ws FROM d),
g AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM again, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}')),
per_line AS (SELECT doc_id, line, count(*) AS k FROM lines GROUP BY ALL),
dup AS (SELECT doc_id, sum(k) AS n_lines, sum(k - 1) AS n_dup FROM per_line GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]') AND strlen(x) > 1)) AS n_upper_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT *, CAST(n_words < 50 AS BIGINT) AS b0, CAST(100 * n_repeat_words > 50 * n_words AS BIGINT) AS b1,
    CAST(100 * n_symbols > 10 * n_words AS BIGINT) AS b2, CAST(n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines AS BIGINT) AS b3,
    CAST(n_words > 0 AND word_chars < 2 * n_words AS BIGINT) AS b4, CAST(n_words > 0 AND word_chars > 20 * n_words AS BIGINT) AS b5,
    CAST(100 * n_upper_words > 50 * n_words AS BIGINT) AS b6, CAST(n_words = 0 AS BIGINT) AS b7 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b0 + b1 > 0 AS base_failed,
  b0 + b1 + b2 + b3 + b4 + b5 + b6 = 0 AS kept, b0 + 2 * b1 + 4 * b2 + 8 * b3 + 16 * b4 + 32 * b5 + 64 * b6 + 128 * b7 AS failed
FROM f
"""

ORACLES["op4_substring_dedup"] = rf"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
g AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM g) WHERE r > 1),
gone AS MATERIALIZED (
  SELECT DISTINCT doc_id, i + o AS i FROM later, (SELECT unnest(range(20)) AS o)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS k
  FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(k, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

# The given conversations hold no tool calls.
ORACLES["op9_chat_format"] = """
WITH m AS (
  SELECT conv_id, turn // 256 AS part, turn, role, to_json({'content': text, 'role': role}) AS json FROM conversations)
SELECT conv_id, part, CAST(0 AS BIGINT) AS piece, count(*) AS n_messages, CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_invalid_calls,
  CAST(0 AS BIGINT) AS n_answers, CAST(0 AS BIGINT) AS n_orphans,
  '[' || string_agg(CAST(json AS VARCHAR), ',' ORDER BY turn, role, json) || ']' AS messages
FROM m GROUP BY conv_id, part
"""

ORACLES["op11_filter_audit"] = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS ws FROM d),
f AS MATERIALIZED (
  SELECT doc_id, part, {{'A': len(ws) < 50, 'B': 100 * len(list_distinct(ws)) < 65 * len(ws),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(least < doc_id, false)}} AS fails FROM w),
bits AS (
  SELECT doc_id, part, CASE WHEN fails.A THEN 'A' ELSE '' END || CASE WHEN fails.B THEN 'B' ELSE '' END || CASE WHEN fails.C THEN 'C' ELSE '' END
    || CASE WHEN fails.D THEN 'D' ELSE '' END || CASE WHEN fails.E THEN 'E' ELSE '' END AS failing FROM f),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
cells AS MATERIALIZED (
  SELECT part, failing, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM bits LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS MATERIALIZED (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x <> b.x AND a.x <> c.x AND a.x <> d.x AND a.x <> e.x AND b.x <> c.x AND b.x <> d.x AND b.x <> e.x AND c.x <> d.x AND c.x <> e.x AND d.x <> e.x),
first_fail AS (
  SELECT part, filter_order, failing, n, good, toxic,
    list_min(list_transform(string_split(failing || '', ''), lambda x: CASE WHEN x = '' THEN 6 ELSE strpos(filter_order, x) END)) AS place
  FROM cells, orders),
steps AS (SELECT unnest([1, 2, 3, 4, 5]) AS step),
sums AS MATERIALIZED (
  SELECT part, filter_order, step, filter_order[step] AS letter,
    sum(CASE WHEN failing = '' OR place > step THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN failing <> '' AND place = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failing <> '' AND place < step AND contains(failing, filter_order[step]) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failing = filter_order[step] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failing <> '' AND place = step THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN failing <> '' AND place = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM first_fail, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM sums
"""

ORACLES["op12_warc_captures"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS digest FROM pages),
l AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(digest, 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM l
"""
