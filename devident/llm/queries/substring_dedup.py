"""Windows of 50 words removed where an earlier document has them."""

from devident.llm.substring_dedup import dedupe
from devident.llm.text import documents

NAME = "op2_substring_dedup"
LENGTH = 50
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS p FROM d WHERE len(words) >= 50
), h AS (
  SELECT doc_id, p, array_to_string(words[p:p + 49], ' ') AS win FROM w
), m AS (
  SELECT win, min(doc_id) AS least FROM h GROUP BY win HAVING min(doc_id) < max(doc_id)
), r AS (
  SELECT DISTINCT h.doc_id, unnest(generate_series(p, p + 49)) AS place FROM h JOIN m USING (win) WHERE doc_id > least
), g AS (
  SELECT doc_id, list(place) AS places FROM r GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
  sha256(coalesce(array_to_string([words[i] FOR i IN generate_series(1, len(words))
    IF NOT coalesce(list_contains(places, i), false)], ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


def query(spark, sf_dir):
    return dedupe(documents(spark, sf_dir), LENGTH).select("doc_id", "n_words", "n_removed", "kept_sha256")
