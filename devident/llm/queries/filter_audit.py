"""What five filters remove from all documents, by source and in every order."""

from devident.llm.filter_audit import audit
from devident.llm.text import read

NAME = "op12_filter_audit"


def query(spark, sf_dir):
    return audit(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), read(spark, sf_dir, "labels"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
     100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'),
     coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM d LEFT JOIN g USING (doc_id)
), h AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic
  FROM f GROUP BY ALL
), o AS (
  SELECT '' AS filter_order
  UNION ALL
  SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)
), s AS (
  SELECT filter_order, step, instr('ABCDE', filter_order[step]) AS filter
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(filter_order) = 5
), m AS (
  SELECT h.*, filter_order,
    list_min([i FOR i IN [1, 2, 3, 4, 5] IF fails[instr('ABCDE', filter_order[i])]]) AS gone
  FROM h, o WHERE length(filter_order) = 5
), c AS (
  SELECT part, filter_order, step, filter,
    coalesce(sum(n) FILTER (WHERE gone IS NULL OR gone > step), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE gone = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE fails[filter] AND gone < step), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE fails[filter] AND len(list_filter(fails, lambda x: x)) = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(n_good) FILTER (WHERE gone = step), 0)::BIGINT AS good_lost,
    coalesce(sum(n_toxic) FILTER (WHERE gone = step), 0)::BIGINT AS toxic_lost
  FROM m JOIN s USING (filter_order) GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley
FROM c
"""
