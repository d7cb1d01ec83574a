"""Spelling variants over the words of all documents."""

from devident.llm.spelling import group_variants, misspelt, runs, vocabulary
from devident.llm.text import documents
from devident.session import materialize

NAME = "op13_spelling"
SQL = None


def query(spark, sf_dir):
    known = materialize(vocabulary(misspelt(runs(documents(spark, sf_dir)))))
    return group_variants(known)
