"""The language of all documents."""

from devident.llm.language import held_out, identify, learn
from devident.llm.text import read

NAME = "op4_language"
SQL = None


def query(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, learn(docs)).withColumn("held_out", held_out())
    return found.select("doc_id", "held_out", "lang_pred", "score")
