"""Every page's URL judged by host rules and, beyond these, by rules mined from what they say."""

from devident.llm.text import read
from devident.llm.url_rules import HOST_LABELS, KEYS, SEGMENTS, TOKEN_LENGTH, HostRule, Mining, filter_urls

NAME = "op11_url_rules"
# fixed values: the rules that are given
HOST_RULES = (
    HostRule("block", "net", "/"), HostRule("allow", "example.net", "/en/"), HostRule("block", "example.com", "/de/"), HostRule("allow", "org", "/fr/"),
)
MINING = Mining()


def query(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, HOST_RULES, MINING).select("page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence")


# all labelled URLs are mined from, as in the query up to the bound of its sample
SQL = rf"""
WITH u AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), a AS (
  SELECT page_id, url, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM a
), t AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS label,
    list_sort(list_distinct(
      list_transform(list_reverse(list_filter(string_split(host, '.'), lambda p: p <> ''))[1:{HOST_LABELS}],
        lambda p, i: substr('h' || i || '=' || regexp_replace(p, '[0-9]+', '#', 'g'), 1, {TOKEN_LENGTH}))
      || list_transform(list_filter(string_split(path, '/'), lambda p: p <> '')[1:{SEGMENTS}],
        lambda p, i: substr('p' || i || '=' || regexp_replace(p, '[0-9]+', '#', 'g'), 1, {TOKEN_LENGTH}))
      || CASE WHEN regexp_matches(path, '\.[A-Za-z]{{1,8}}\z') THEN ['x=' || regexp_extract(path, '\.([A-Za-z]{{1,8}})\z', 1)] ELSE [] END
      || list_transform(list_sort(list_distinct(list_filter(list_transform(
        string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda k: string_split(k, '=')[1]), lambda k: k <> '')))[1:{KEYS}],
        lambda k: substr('q=' || k, 1, {TOKEN_LENGTH}))
      || CASE WHEN contains(rest, '#') THEN ['f'] ELSE [] END)) AS tokens
  FROM r
), l AS (
  SELECT DISTINCT url, label, tokens FROM t WHERE label IS NOT NULL AND len(tokens) > 0
), k AS (
  SELECT url, label, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS i FROM l
), s AS (
  SELECT [tok] AS tokens, label, url, i FROM k
  UNION ALL SELECT [a.tok, b.tok], a.label, a.url, b.i FROM k a JOIN k b ON a.url = b.url AND a.label = b.label AND a.i < b.i
  UNION ALL SELECT [a.tok, b.tok, c.tok], a.label, a.url, c.i FROM k a JOIN k b ON a.url = b.url AND a.label = b.label AND a.i < b.i
    JOIN k c ON a.url = c.url AND a.label = c.label AND b.i < c.i
  UNION ALL SELECT [a.tok, b.tok, c.tok, d.tok], a.label, a.url, d.i FROM k a JOIN k b ON a.url = b.url AND a.label = b.label AND a.i < b.i
    JOIN k c ON a.url = c.url AND a.label = c.label AND b.i < c.i JOIN k d ON a.url = d.url AND a.label = d.label AND c.i < d.i
), n AS (
  SELECT count(*) AS total, ceil({MINING.support} * count(*)) AS least FROM l
), p AS (
  SELECT label, count(*) AS labelled FROM l GROUP BY label
), c AS (
  SELECT tokens, label, count(*) AS support, sum(count(*)) OVER (PARTITION BY tokens) AS uses FROM s GROUP BY tokens, label
), m AS (
  SELECT tokens, label, support, support::DOUBLE / uses AS confidence FROM c JOIN p USING (label), n
  WHERE support >= least AND support::DOUBLE / uses >= {MINING.confidence} AND support::DOUBLE / uses > labelled::DOUBLE / total
), w AS (
  SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.label = m.label AND len(o.tokens) < len(m.tokens)
    AND o.confidence >= m.confidence AND list_has_all(m.tokens, o.tokens))
), b AS (
  SELECT t.tokens, min(row(-confidence, -support, len(w.tokens), w.tokens, w.label)) AS best
  FROM (SELECT DISTINCT tokens FROM t) t JOIN w ON list_has_all(t.tokens, w.tokens) GROUP BY t.tokens
)
SELECT page_id, host, path, rule, coalesce(label, best[5], 'allow') AS verdict,
  CASE WHEN rule IS NULL THEN array_to_string(best[4], ' ') END AS mined_rule, CASE WHEN rule IS NULL THEN -best[1] END AS confidence
FROM t LEFT JOIN b USING (tokens)
"""
