"""Word-piece counts of all documents."""

from devident.llm.text import documents
from devident.llm.wordpiece import build, sentencepiece_vocabulary, token_counts

NAME = "op10_token_counts"
SQL = None


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir):
    return token_counts(documents(spark, sf_dir), build(*sentencepiece_vocabulary(vocabulary_path())))
