"""Toxicity of all documents."""

from devident.llm.text import documents, read
from devident.llm.toxicity import held_out, learn, score

NAME = "op1_toxicity"
SQL = None


def query(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = learn(docs, read(spark, sf_dir, "labels"))
    found = score(docs, model, keep=["doc_id"]).withColumn("held_out", held_out())
    return found.select("doc_id", "held_out", "score", "predicted")
