"""Quality rules over all documents."""

from devident.llm.quality_rules import STOP_WORDS, judge
from devident.llm.text import documents

NAME = "op9_quality_rules"
COLUMNS = (
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
)


def query(spark, sf_dir):
    return judge(documents(spark, sf_dir)).select(*COLUMNS)


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d
), g AS (
  SELECT doc_id, p, CASE WHEN lead(word, 4) OVER o IS NOT NULL THEN
    concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) END AS win
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)
), r AS (
  SELECT doc_id, p, win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) > 1 AS twice FROM g
), c AS (
  SELECT doc_id, max(twice) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM r
), n AS (
  SELECT doc_id, count(*) FILTER (WHERE covered) AS n_repeat_words FROM c GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(words) AS n_words, coalesce(length(array_to_string(words, '')), 0) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(lines) AS n_lines, len(list_filter(words, lambda x: x IN ({_STOP}))) AS n_stop,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN n USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars::DOUBLE / n_words BETWEEN 2 AND 20 AND n_symbols::DOUBLE / n_words <= 0.25
  AND (n_words < 50 OR n_stop::DOUBLE / n_words >= 0.01) AND n_dup_lines::DOUBLE / n_lines <= 0.5 AS kept
FROM b
"""
