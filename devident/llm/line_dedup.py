"""Boilerplate lines by their frequency on a site.

A line's ratio is the number of the site's pages that contain it over the number of the site's pages; lines
above a ratio go from all pages of that site. Counting is one partial aggregation of distinct
lines per page; lines on fewer than `least` pages are dropped from the count before anything is joined. Two is the least number that makes a
line recur; with a ratio r, a line on two pages of a site goes if the site has fewer than 2 / r pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devident.session import materialize


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\x0b\f\r"))


def boilerplate(pages: DataFrame, ratio: float, least: int) -> DataFrame:
    """(site, lines): hashes of the lines of each site that exceed the ratio, from `pages(site, text)`.

    A line exceeds it on `ratio` of the site's pages at most 1 / ratio times as often as a page has lines on average, so
    that a site's list is about as long as a few pages.
    """
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: _bare(x) != ""), lambda x: F.xxhash64(_bare(x))))
    known = pages.filter("site IS NOT NULL")
    counts = (
        known.select("site", F.explode(lines).alias("line")).groupBy("site", "line").agg(F.count("*").alias("n"))
        .filter(F.col("n") >= least)
    )
    totals = known.groupBy("site").agg(F.count("*").alias("total"))
    common = counts.join(totals, "site").filter(F.col("n") > ratio * F.col("total"))
    return common.groupBy("site").agg(F.collect_set("line").alias("lines"))


def drop_boilerplate(
    pages: DataFrame, site: str = "site", text: str = "text", ratio: float = 0.05, least: int = 2
) -> DataFrame:
    """The frame with `text` freed from boilerplate lines, `n_lines` (not blank) and `n_dropped`.

    A line is what stands between \\n, compared without outer white space, by a 64-bit hash; blank lines stay. A page counts once
    for a line however often it has it; repeated rows are pages of their own. NULL texts stay NULL with no lines; a NULL site
    has no lines to drop.
    """
    columns = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    common = materialize(boilerplate(pages.select(F.col(site).alias("site"), F.col(text).cast("string").alias("text")), ratio, least))
    common = common.select(F.col("site").alias("_ld_site"), F.col("lines").alias("_ld_lines"))
    joined = pages.select(*[F.col(f"`{c}`") for c in columns]).join(common, F.col(f"`{site}`") == F.col("_ld_site"), "left")
    split = joined.withColumn("_ld_split", F.split(F.col(text).cast("string"), "\n"))
    split = split.withColumn(
        "_ld_kept",
        F.when(F.col("_ld_lines").isNull(), F.col("_ld_split")).otherwise(
            F.filter("_ld_split", lambda x: (_bare(x) == "") | ~F.array_contains(F.col("_ld_lines"), F.xxhash64(_bare(x))))
        ),
    )
    return split.select(
        *[F.array_join("_ld_kept", "\n").alias(c) if c == text else F.col(f"`{c}`") for c in columns],
        F.coalesce(F.size(F.filter("_ld_split", lambda x: _bare(x) != "")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_ld_split") - F.size("_ld_kept"), F.lit(0)).cast("long").alias("n_dropped"),
    )


# fixed values: elements whose tags end a line
BLOCKS = (
    "address article aside blockquote body br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "li main nav ol p pre section table tbody td tfoot th thead title tr ul"
).split()
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BLOCK_TAG = r"(?i)</?(?:" + "|".join(BLOCKS) + r")\b[^>]*>"
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def visible_text(html: Column) -> Column:
    """The text of a raw page, one line per block element; entities stay as they are."""
    shown = F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), r"[\r\n]+", " ")
    return F.regexp_replace(F.regexp_replace(shown, BLOCK_TAG, "\n"), TAG, "")


def host(url: Column) -> Column:
    """The host of a URL in lower case; NULL without one."""
    found = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(found != "", found)
