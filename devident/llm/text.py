"""What the corpus operators share: words, hashes, reading the tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from devident.session import configure

# fixed values: white space between words, as a character class of a pattern and as its characters
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"
SPACE = rf"[{SPACE_CLASS}]+"

MASK64 = (1 << 64) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table, read by a session with the runtime settings."""
    return configure(spark).read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8 bytes."""
    binary = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(binary).to_pylist()


def words(text: bytes | None) -> list[bytes]:
    """The words of a text: `bytes.split` parts at the six ASCII white-space bytes, which is what WORD says."""
    return text.split() if text else []


class Recent:
    """What was worked out for the words met of late, in two generations of `limit` bytes each.

    When the younger one is full it becomes the older one, and that goes; words that are met again move to the younger
    one, so that frequent words stay. Meant to live as long as one task's iterator.
    """

    #: bytes of an entry besides its word and value: their headers and a share of the table
    OVERHEAD = 160

    def __init__(self, make: Callable[[list[bytes]], Iterable], limit: int = 12 << 20):
        self.make, self.limit = make, limit
        self.young: dict[bytes, object] = {}
        self.old: dict[bytes, object] = {}
        self.used = 0

    def of(self, parts: list[bytes]) -> Iterable:
        """The value of each word."""
        if self.used > self.limit:
            self.old, self.young, self.used = self.young, {}, 0
        young, old = self.young, self.old
        before = len(young)
        missing = set(parts).difference(young)
        if old:
            again = old.keys() & missing
            young.update(zip(again, map(old.__getitem__, again)))
            missing -= again
        missing = list(missing)
        if missing:
            young.update(zip(missing, self.make(missing)))
        self.used += (len(young) - before) * self.OVERHEAD + sum(map(len, missing))
        return map(young.__getitem__, parts)
