"""Boilerplate lines dropped from all raw pages, by host."""

from pyspark.sql import functions as F

from devident.llm.line_dedup import BLOCK_TAG, HIDDEN, HOST, TAG, drop_boilerplate, host, visible_text
from devident.llm.text import read
from devident.session import materialize

NAME = "op5_line_dedup"
RATIO, LEAST = 0.05, 2


def query(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", host(F.col("url")).alias("site"), visible_text(F.col("html")).alias("text"))
    # lines are counted in one pass and dropped in another: the texts are made of the pages once
    found = drop_boilerplate(materialize(pages), ratio=RATIO, least=LEAST)
    return found.select("page_id", "site", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


SQL = rf"""
WITH p AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS site,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN}', ' ', 'g'), '[\r\n]+', ' ', 'g'),
      '{BLOCK_TAG}', chr(10), 'g'), '{TAG}', '', 'g') AS text
  FROM pages
), l AS (
  SELECT page_id, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM p
), b AS (
  SELECT page_id, site, line, i, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM l
), c AS (
  SELECT site, bare FROM b JOIN (SELECT site, count(*) AS total FROM p GROUP BY site) USING (site)
  WHERE bare <> '' GROUP BY site, bare, total
  HAVING count(DISTINCT page_id) >= {LEAST} AND count(DISTINCT page_id) > {RATIO} * total
)
SELECT page_id, any_value(b.site) AS site, count(*) FILTER (WHERE b.bare <> '') AS n_lines,
  count(*) FILTER (WHERE c.bare IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.bare IS NULL), '')) AS text_sha256
FROM b LEFT JOIN c ON b.site = c.site AND b.bare = c.bare GROUP BY page_id
"""
