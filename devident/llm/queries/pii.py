"""Personal data in all documents."""

from pyspark.sql import functions as F

from devident.llm.pii import BASE_KINDS, find, joined
from devident.llm.text import documents

NAME = "op6_pii"
SQL = None


def _count(kind):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def query(spark, sf_dir):
    found = find(documents(spark, sf_dir))
    counts = [_count(kind) for kind in BASE_KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
    )
