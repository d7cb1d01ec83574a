"""All documents packed into sequences of 4096 tokens."""

from devident.llm.packing import Capacity, pack, pieces
from devident.llm.text import documents

NAME = "op8_packing"
SEQUENCE = 4096
END_ID = 1
# the number of documents and the attention cost don't bind before the tokens do
CAPACITY = Capacity(tokens=SEQUENCE, documents=SEQUENCE, attention=SEQUENCE * SEQUENCE)
SQL = None


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir):
    return pack(pieces(documents(spark, sf_dir), tokenizer_path(), SEQUENCE, END_ID), CAPACITY)
