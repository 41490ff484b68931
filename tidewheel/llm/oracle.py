"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from .quality_rules import DEPLETED, LINE_LIMIT, LINE_SHARE, MIN_WORDS, REPEAT_PERCENT, WINDOW

_SPACE = r"[\x20\x09-\x0D]"

QUALITY_RULES = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT *, list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_SPACE}', '', 'g') <> '') AS held
  FROM docs
), runs AS (
  SELECT r, i, list_slice(words, i, i + {WINDOW - 1}) AS run
  FROM worded, unnest(range(1, len(words) - {WINDOW - 2})) AS u(i)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM runs) WHERE n > 1
), covered AS (
  SELECT r, sum(least({WINDOW}, coalesce(following - i, {WINDOW}))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS following FROM again) GROUP BY r
), measured AS (
  SELECT w.r, doc_id, host, text, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(held) - len(list_distinct(held)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM worded w LEFT JOIN covered c ON c.r = w.r
), lines AS (
  SELECT DISTINCT r, host, substr(md5(line), 1, 16) AS line, n
  FROM (SELECT r, host, lower(trim(regexp_replace(x, '[ \t\x0B\f\r]+', ' ', 'g'))) AS line, len(list_filter(regexp_split_to_array(x, '{_SPACE}+'), lambda y: y <> '')) AS n
        FROM (SELECT r, host, unnest(string_split(text, chr(10))) AS x FROM docs))
  WHERE line <> ''
), sets AS (
  SELECT r, string_agg(line, ' ' ORDER BY line) AS held_lines, sum(n) AS all_words FROM (SELECT r, line, min(n) AS n FROM lines GROUP BY r, line) GROUP BY r
), hosts AS (
  SELECT host, count(*) AS host_docs FROM docs GROUP BY host
), frequent AS (
  SELECT l.host, l.line FROM lines l JOIN sets s ON s.r = l.r JOIN hosts h ON h.host = l.host
  GROUP BY l.host, l.line, h.host_docs
  HAVING count(DISTINCT s.held_lines) > {LINE_LIMIT} AND count(DISTINCT s.held_lines) > h.host_docs * {LINE_SHARE}::DOUBLE
), gone AS (
  SELECT l.r FROM lines l JOIN frequent f ON f.host = l.host AND f.line = l.line JOIN sets s ON s.r = l.r
  GROUP BY l.r, s.all_words HAVING sum(l.n) >= s.all_words * {DEPLETED}::DOUBLE
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND g.r IS NULL AS kept
FROM measured m LEFT JOIN gone g ON g.r = m.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_quality_rules": QUALITY_RULES}
