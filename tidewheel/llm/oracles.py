"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import line_rules

_PHRASES = " OR ".join(f"contains(lower(line), '{p}')" for p in line_rules.PHRASES)

OP3 = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w, text FROM docs
),
windows AS (
  SELECT doc_id, i, w[i:i + 4] AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM words WHERE len(w) >= 5)
),
twins AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeats AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) FROM twins) GROUP BY doc_id
),
lines AS (
  SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n_words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
judged AS (
  SELECT doc_id, line,
    regexp_matches(line, '[.!?…。！？]')
    AND NOT len(regexp_replace(line, '[^|»›•·]+', '', 'g')) >= greatest(2.0, n_words * {line_rules.SEPARATORS_PER_WORD})
    AND NOT len(regexp_replace(line, '[^#*$%&<>=_~^]+', '', 'g')) >= greatest(3.0, n_words * {line_rules.MARKS_PER_WORD})
    AND NOT len(regexp_replace(line, '[^!]+', '', 'g')) >= greatest(4.0, n_words * {line_rules.SHOUTS_PER_WORD})
    AND NOT ({_PHRASES}) AS ok
  FROM lines
),
by_line AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dup,
    coalesce(sum(len(line)) FILTER (ok), 0) / sum(len(line))::DOUBLE AS left_share
  FROM judged GROUP BY doc_id
),
measures AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(left_share, 0) AS left_share
  FROM words LEFT JOIN repeats USING (doc_id) LEFT JOIN by_line USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND left_share >= {line_rules.MIN_LEFT} AS kept
FROM measures
"""

#: All pairs of documents that share a shingle, and components by paths; fit for small tables.
OP6 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN w ELSE w[i:i + 3] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.other
),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""

ORACLES = {"op3_line_rules": OP3, "op6_near_duplicates": OP6}
