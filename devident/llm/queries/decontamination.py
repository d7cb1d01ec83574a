"""Documents that hold a benchmark item, exact or edited."""

from devident.llm.decontamination import matches
from devident.llm.text import documents, read

NAME = "op3_decontamination"
SQL = None


def query(spark, sf_dir):
    return matches(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))
