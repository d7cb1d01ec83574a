"""Language identification by language-bitmask n-gram filters.

One Bloom filter serves all languages: a slot holds a bit per language, so the conjunction of an
n-gram's slots gives all languages that contain it at once. Per language the hits over all n-grams of a text are
counted, freed from expected false positives, and the largest count decides.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devident.llm.text import utf8

SIZES = (2, 3, 4)
HASHES = 3
_STRETCH = 1 << 19
_PRIME = np.uint64(0x100000001B3)


@dataclass(frozen=True)
class Learning:
    """`documents` of each language are learned from (an expected number, chosen by a hash of doc_id). An n-gram
    is a language's if it makes up `share` of its n-grams or more, which bounds their number, and
    `relative` of the largest share that a language has. `slots_per_gram` sizes the filter."""

    documents: int = 2000
    share: float = 1e-5
    relative: float = 0.2
    slots_per_gram: int = 16


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: bytes | None):
    """Hashes of a text's n-grams, some at a time: of runs of letters in lower case, with the place before and
    the place behind a run as boundary."""
    if not text:
        return
    points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), dtype="<u4")
    points = np.concatenate([[32], points, [32]]).astype(np.uint32)
    for begin in range(0, len(points), _STRETCH):  # n-grams that begin there
        own = points[begin : begin + _STRETCH + max(SIZES) - 1]
        letter = _letters()[own]
        code = np.where(letter, own, 32).astype(np.uint64)
        rolled = np.zeros(len(code), dtype=np.uint64)
        inner = np.ones(len(code), dtype=bool)
        for n in range(1, max(SIZES) + 1):
            if n > len(code):
                break
            rolled = (rolled[: len(code) - n + 1] ^ code[n - 1 :]) * _PRIME
            if n > 2:
                inner = inner[: len(code) - n + 1] & letter[n - 2 : len(code) - 1]
            if n in SIZES:
                chosen = inner if n > 2 else letter[:-1] | letter[1:]  # with a letter
                chosen = chosen[: min(_STRETCH, len(code) - n + 1)]
                found = rolled[: len(chosen)][chosen] + np.uint64(n)
                found = (found ^ (found >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                yield found ^ (found >> np.uint64(32))


@dataclass(frozen=True)
class Filter:
    """`slots[w, s]`: bits of languages 64·w and on; languages in the order of `names`."""

    names: list[str]
    slots: np.ndarray

    def places(self, hashes: np.ndarray) -> list[np.ndarray]:
        mask, step = np.uint64(self.slots.shape[1] - 1), hashes >> np.uint64(33) | np.uint64(1)
        return [((hashes + np.uint64(i) * step) & mask).astype(np.int64) for i in range(HASHES)]

    def false_positives(self) -> np.ndarray:
        fill = [((self.slots[i // 64] >> self.slots.dtype.type(i % 64)) & self.slots.dtype.type(1)).mean() for i in range(len(self.names))]
        return np.array(fill) ** HASHES

    def counts(self, text: bytes | None) -> tuple[np.ndarray, int]:
        """Hits per language, and the number of n-grams."""
        hits, number = np.zeros(len(self.names)), 0
        for hashes in grams(text):
            places = self.places(hashes)
            number += len(hashes)
            for w, slots in enumerate(self.slots):
                both = slots[places[0]]
                for p in places[1:]:
                    both &= slots[p]
                for bit in range(min(64, len(self.names) - 64 * w)):
                    hits[64 * w + bit] += np.count_nonzero(both & slots.dtype.type(1 << bit))
        return hits, number


def build(names: list[str], members: list[tuple[int, np.ndarray]], slots: int) -> Filter:
    """The filter of (language number, n-gram hashes)."""
    kind = np.uint8 if len(names) <= 8 else np.uint64
    made = Filter(names, np.zeros((max(1, -(-len(names) // 64)), slots), dtype=kind))
    for number, hashes in members:
        for p in made.places(hashes):
            np.bitwise_or.at(made.slots[number // 64], p, kind(1 << number % 64))
    return made


def held_out(column="doc_id"):
    """Rows that are not learned from: crc32 of the doc_id's text, mod 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learn(docs: DataFrame, learning: Learning = Learning()) -> Filter:
    """The filter from `docs(doc_id, text, lang)`: rows with a language that are not held out.

    Counts per language read one column; n-grams are counted in tasks and summed by Spark; the driver gets
    the n-grams of each language, at most 1 / share of each size. No labelled row: a filter without languages.
    """
    own = docs.filter(F.col("lang").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    sizes = own.groupBy("lang").agg(F.count("*").alias("n"))
    # one row per language
    drawn = own.join(F.broadcast(sizes), "lang").filter(
        F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0) < F.lit(float(learning.documents)) / F.col("n")
    )

    def count(batches):
        for batch in batches:
            by = {}
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text"))):
                for i, hashes in enumerate(grams(text)):
                    by.setdefault((lang, i % len(SIZES)), []).append(hashes)
            for (lang, size), parts in by.items():
                found, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array([size] * len(found), pa.int32()), pa.array(found.view(np.int64)), pa.array(n)],
                    names=["lang", "size", "gram", "n"],
                )

    counted = drawn.select("lang", F.col("text").cast("string")).mapInArrow(count, "lang string, size int, gram long, n long")
    summed = counted.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    totals = summed.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    shares = summed.join(F.broadcast(totals), ["lang", "size"]).withColumn("share", F.col("n") / F.col("total"))
    best = shares.groupBy("gram").agg(F.max("share").alias("best"))
    kept = shares.filter(F.col("share") >= learning.share).join(best, "gram").filter(
        F.col("share") >= learning.relative * F.col("best")
    )
    rows = kept.select("lang", "gram").toArrow()
    names = sorted({r for r in rows.column("lang").to_pylist()} | {r.lang for r in sizes.select("lang").collect()})
    lang, gram = np.array(rows.column("lang").to_pylist(), dtype=object), rows.column("gram").to_numpy().view(np.uint64)
    slots = 1 << max(10, int(learning.slots_per_gram * max(1, len(np.unique(gram))) - 1).bit_length())
    return build(names, [(i, gram[lang == name]) for i, name in enumerate(names)], slots)


def decide(filter_: Filter, wrong: np.ndarray, text: bytes | None) -> tuple[str, float]:
    """The language and its share of the corrected hits; `und` and 0 without a letter or a learned language.

    Ties go to the language that comes first by name.
    """
    hits, number = filter_.counts(text)
    if not number or not filter_.names:
        return "und", 0.0
    corrected = np.maximum(0.0, (hits - number * wrong) / np.maximum(1e-9, 1 - wrong))
    best = int(corrected.argmax())
    return filter_.names[best], float(corrected[best] / corrected.sum()) if corrected.sum() > 0 else 0.0


def identify(docs: DataFrame, filter_: Filter, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """Per row the columns `keep`, `lang_pred` and `score` (0 to 1). NULL texts and texts without a letter: `und`, 0.

    Columns of `keep` with the names of the new ones are replaced by these; `_li_text` is taken.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(filter_)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        own = shared.value
        wrong = own.false_positives()
        for batch in batches:
            found = [decide(own, wrong, t) for t in utf8(batch.column("_li_text"))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*keep, "lang_pred", "score"],
            )

    read = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_li_text"))
    return read.mapInArrow(run, f"{fields}, lang_pred string, score double")
