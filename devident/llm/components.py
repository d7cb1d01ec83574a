"""Connected components of a link table by large-star and small-star rounds.

Every round is two aggregations and two joins; its links are written to the shared folder, which cuts
the lineage. Nothing but one count per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devident.session import materialize


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Large star: link each node's larger neighbours to its least one; small star: the smaller ones and itself."""
    if small:
        both = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            links.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(least, "u")
    if small:
        out = linked.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
    else:
        out = linked.filter("v > u").select("v", "m")
    return out.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of `links(a, b)`: the smallest node reachable.

    Loops and NULL ends are ignored; no links: no rows.
    """
    links = materialize(links.filter("a <> b").select("a", "b").distinct())
    before = None
    while True:
        links = materialize(_star(_star(links, small=False), small=True))
        sums = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == before:
            break
        before = sums
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
