"""SimHash classes of all documents, linked at two bits or fewer."""

from pyspark.sql import functions as F

from devident.llm.simhash import TWO_BITS, near_duplicates
from devident.llm.text import documents

NAME = "op7_simhash"
SQL = None


def query(spark, sf_dir):
    found = near_duplicates(documents(spark, sf_dir), TWO_BITS)
    return found.select("doc_id", F.lower(F.lpad(F.hex("lane0"), 16, "0")).alias("fingerprint"), "component_id")
