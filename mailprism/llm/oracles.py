"""DuckDB SQL of queries whose operators have no shorter form; crc32 is computed from its table of steps."""

CRC_STEPS = """
crc_table AS (
  SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
  FROM (SELECT unnest(range(256)) AS i)),
"""


def crc32(hex_text: str) -> str:
    """Unsigned crc32 of the bytes that a hexadecimal text names; ``steps`` has to be in scope."""
    return f"""xor(4294967295, list_reduce([4294967295] || list_transform(range(length({hex_text}) // 2), lambda i: ('0x' || substr({hex_text}, 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])))"""


SPELLING = "WITH RECURSIVE" + CRC_STEPS + f"""
runs AS (
  SELECT k, word, count(*) AS times FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS k, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS word
    FROM documents) WHERE length(word) >= 6 GROUP BY ALL),
hashed AS (SELECT word, times, {crc32("key")} AS h FROM (SELECT word, times, hex(k || ':' || word) AS key FROM runs), crc_table),
counted AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(word, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, sum(times)::BIGINT AS n
  FROM hashed GROUP BY 1),
words AS (SELECT word, n FROM counted WHERE n >= 5 AND length(word) >= 6),
shorter AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM words, unnest(range(length(word))) AS places(i)),
near AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM shorter x JOIN shorter y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM shorter x JOIN words y ON x.rest = y.word
  UNION SELECT y.word, x.word, x.n FROM shorter x JOIN words y ON x.rest = y.word),
best AS (SELECT word, count(*) AS n_near FROM near GROUP BY word),
tops AS (SELECT word, other, other_n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
forms AS (SELECT w.word, t.other AS form, t.other_n AS form_n FROM words w JOIN tops t USING (word) WHERE t.other_n >= 5 * w.n),
chains(word, root) AS (
  SELECT word, word FROM words
  UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.root)
SELECT w.word, f.form, c.root, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, f.form_n
FROM words w LEFT JOIN forms f USING (word) LEFT JOIN best b USING (word)
JOIN chains c ON c.word = w.word AND c.root NOT IN (SELECT word FROM forms)
"""

REPAIR = "WITH RECURSIVE" + CRC_STEPS + rf"""
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    hex(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS k FROM conversations),
coded AS (
  SELECT conv_id, turn, role, text, {crc32("k")} % 20 AS h FROM keyed, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM coded, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copies(n)),
placed AS (
  SELECT *, rtrim(text, E' \t\n\x0B\f\r') AS rest, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM damaged),
judged AS (
  SELECT *, CASE WHEN rest = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN right(rest, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM placed),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
inserted(p, q, put) AS (VALUES (0, 0, []::VARCHAR[]), (1, 1, []), (2, 2, []), (3, 3, []), (0, 2, ['user:']), (0, 3, ['user:', 'assistant:']),
  (1, 2, ['user:']), (1, 3, ['user:', 'assistant:']), (2, 3, ['assistant:']), (3, 2, ['user:'])),
moves(p, q, initial, name) AS (VALUES (0, 1, 's', NULL), (0, 2, 'u', 'user'), (1, 2, 'u', 'user'), (3, 2, 'u', 'user'), (2, 3, 'a', 'assistant')),
edits AS (
  SELECT conv_id, pos, p, q, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END + 0 AS cost, 'K' AS edit, [role || ':' || text] AS put
  FROM judged JOIN moves USING (initial) WHERE fault IN ('none', 'truncated')
  UNION ALL
  SELECT conv_id, pos, p, q, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END + 3, 'R', [name || ':' || text]
  FROM judged, moves WHERE fault IN ('none', 'truncated') AND name IS NOT NULL
  UNION ALL
  SELECT conv_id, pos, p, p, 4, 'D', [] FROM judged, unnest(range(4)) AS states(p)),
paths AS (
  SELECT conv_id, 0::BIGINT AS pos, 0 AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS put FROM facts
  UNION ALL
  SELECT conv_id, pos, q, cost, audit, put FROM (
    SELECT x.conv_id, e.pos, e.q, x.cost + 3 * len(i.put) + e.cost AS cost, x.audit || repeat('I', len(i.put)) || e.edit AS audit, x.put || i.put || e.put AS put
    FROM paths x JOIN inserted i ON i.p = x.q JOIN edits e ON e.conv_id IS NOT DISTINCT FROM x.conv_id AND e.pos = x.pos + 1 AND e.p = i.q)
  QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
ends AS (
  SELECT * FROM (
    SELECT x.conv_id, x.cost + 3 * len(i.put) AS cost, x.audit || repeat('I', len(i.put)) AS audit, x.put || i.put AS put
    FROM paths x JOIN inserted i ON i.p = x.q JOIN facts f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.n = x.pos WHERE i.q IN (0, 3))
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(put, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

NEIGHBOURS = """
WITH usable AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, q.v AS asked, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, (row_number() OVER best)::INT AS rank, vec_id, score FROM scored
WINDOW best AS (PARTITION BY query_id, asked ORDER BY score DESC, vec_id NULLS LAST)
QUALIFY row_number() OVER best <= 5
"""
