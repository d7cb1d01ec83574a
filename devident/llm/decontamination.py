"""Benchmark decontamination: rare n-gram seeds, then local alignment.

Test items give n-grams of words; a fixed-size bitmap of their hashes tells each document which of its n-grams may be among
them, so only passages around such places leave the scan. Seeds are the n-grams that are rare among the distinct
passages compared with the others of their item, and the least frequent one of a passage without any. Passages meet items on
seeds by a join, and a Smith-Waterman alignment of words scores exact, edited and paraphrased copies alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devident.llm.text import Recent, utf8, words
from devident.session import materialize

GRAM = 4
BITMAP_BITS = 26
MARGIN = 64
MISMATCH = GAP = 0.5

_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _bare_hashes(missing: list[bytes]) -> Iterator[int]:
    for w in missing:
        bare = _OUTER.sub("", w.decode("utf-8", "replace").lower())
        yield xxhash.xxh64_intdigest(bare.encode("utf-8", "replace")) if bare else 0


def token_hashes(text: bytes | None, known: Recent | None = None) -> np.ndarray:
    """64-bit hashes of a text's words in lower case without outer punctuation; 0 for words that are nothing else."""
    parts = words(text)
    return np.fromiter((known or Recent(_bare_hashes)).of(parts), dtype=np.uint64, count=len(parts))


def gram_hashes(tokens: np.ndarray) -> np.ndarray:
    """The hash of the n-gram at each place."""
    if len(tokens) < GRAM:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(tokens) - GRAM + 1, dtype=np.uint64)
    for i in range(GRAM):
        out = out * _BASE + tokens[i : i + len(out)]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def item_grams(items: DataFrame) -> DataFrame:
    """(item_id, tokens, grams) of items with GRAM words or more; shorter ones are no evidence of a copy."""

    def run(batches):
        known = Recent(_bare_hashes)
        for batch in batches:
            out = []
            for item_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                tokens = token_hashes(text, known)
                tokens = tokens[tokens != 0]
                if len(tokens) >= GRAM and item_id is not None:
                    out.append((item_id, tokens.view(np.int64), gram_hashes(tokens).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), type=t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))],
                names=["item_id", "tokens", "grams"],
            )

    return items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "item_id long, tokens array<long>, grams array<long>"
    )


def bitmap(grams: DataFrame) -> np.ndarray:
    """A bitmap of 2^BITMAP_BITS bits with the grams' bits set: Spark folds them, the driver gets 64-bit words of it."""
    place = F.col("gram").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    folded = grams.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, CAST(gram & 63 AS int))").alias("bit"))
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.uint64)
    for batch in folded.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow().to_batches():
        out[batch.column("word").to_numpy()] = batch.column("bits").to_numpy().view(np.uint64)
    return out


def passages(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Passages with n-grams that may be an item's: place of the passage's first word, its tokens, and place and hash of each
    such n-gram, counted in the document's words that have a token."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        own, number, task = shared.value, 0, TaskContext.get().partitionId()
        known = Recent(_bare_hashes)
        low_bits = np.uint64((1 << BITMAP_BITS) - 1)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                tokens = token_hashes(text, known)
                places = np.flatnonzero(tokens)
                tokens = tokens[places]
                grams = gram_hashes(tokens)
                bit = grams & low_bits
                hits = np.flatnonzero((own[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
                if not len(hits):
                    continue
                for part in np.split(hits, np.flatnonzero(np.diff(hits) > MARGIN) + 1):
                    low, high = max(0, int(part[0]) - MARGIN), int(part[-1]) + GRAM + MARGIN
                    out.append((
                        (task << 40) + number, doc_id, tokens[low:high].view(np.int64), places[low:high],
                        (part - low).astype(np.int32), grams[part].view(np.int64),
                    ))
                    number += 1
            kinds = (pa.int64(), pa.int64(), *[pa.list_(t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), type=t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)],
                names=["passage", "doc_id", "words", "places", "at", "grams"],
            )

    return docs.mapInArrow(
        run, "passage long, doc_id long, words array<long>, places array<long>, at array<int>, grams array<long>"
    )


def align(passage: np.ndarray, item: np.ndarray) -> tuple[float, int, int]:
    """The best local alignment's score and its first and last place in the passage.

    A match counts 1, another word or a gap -0.5. A row of the table is worked out at once: gaps along it
    are a running maximum.
    """
    n = len(passage)
    slope = GAP * np.arange(n + 1)
    before, start_before = np.zeros(n + 1), np.arange(n + 1)
    best, first, last = 0.0, 0, 0
    for token in item:
        step = np.where(passage == token, 1.0, -MISMATCH)
        row, start = np.zeros(n + 1), np.arange(n + 1)
        diagonal, above = before[:-1] + step, before[1:] - GAP
        row[1:] = np.maximum(0.0, np.maximum(diagonal, above))
        taken = np.where(row[1:] == diagonal, start_before[:-1], start_before[1:])
        start[1:] = np.where(row[1:] > 0, taken, np.arange(1, n + 1))
        lifted = row + slope
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        along = top - slope
        start = np.where(along > row, start[source], start)
        before, start_before = np.maximum(row, along), start
        at = int(before.argmax())
        if before[at] > best:
            best, first, last = float(before[at]), int(start_before[at]), at - 1
    return best, first, last


def matches(docs: DataFrame, items: DataFrame, threshold: float = 0.5, rarity: float = 10.0) -> DataFrame:
    """(doc_id, item_id, score, n_seeds, first_word, last_word): the best aligned passage of each document and item
    with a score of `threshold` or more; the score is the alignment's over the item's words, 1 for a whole copy.

    An item's n-gram is rare if at most `rarity` times as many distinct passages have it as the item's median n-gram. A
    passage's seeds are the rare n-grams that it shares with an item, or, where it shares frequent ones only, the least
    frequent of these: every passage meets every item with a common n-gram. NULL and empty texts and NULL items match
    nothing; rows with the same doc_id are reported as one document, those without as another. Repeated items are one.
    """
    listed = materialize(item_grams(items).dropDuplicates(["item_id", "tokens"]))
    pairs = listed.select("item_id", F.explode(F.array_distinct("grams")).alias("gram")).distinct()
    found = materialize(
        passages(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), bitmap(pairs)).withColumns(
            {"grams_id": F.xxhash64("grams"), "words_id": F.xxhash64("words")}
        )
    )
    # passages with the same n-grams, as very many copies have, count and meet the items as one
    sets = materialize(found.groupBy("grams_id").agg(F.any_value("grams").alias("grams")))
    hits = sets.select("grams_id", F.explode(F.array_distinct("grams")).alias("gram"))
    counts = hits.join(pairs.select("gram").distinct(), "gram").groupBy("gram").agg(F.count("*").alias("n"))
    counted = pairs.join(counts, "gram")
    usual = counted.groupBy("item_id").agg(F.percentile_approx("n", 0.5).alias("usual"))
    seeds = materialize(counted.join(usual, "item_id").select("item_id", "gram", (F.col("n") <= rarity * F.col("usual")).alias("rare")))
    met = hits.join(seeds, "gram").groupBy("grams_id", "item_id").agg(
        F.greatest(F.count_if("rare"), F.lit(1)).alias("n_seeds")
    )
    # equal passages are aligned once
    distinct = found.groupBy("words_id", "grams_id").agg(F.any_value("words").alias("words"))
    candidates = materialize(met).join(distinct, "grams_id").join(listed.select("item_id", "tokens"), "item_id")

    def run(batches):
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("words_id", "item_id", "n_seeds")]
            for words_id, item_id, seeds_, words_, tokens in zip(*columns, *[batch.column(c) for c in ("words", "tokens")]):
                passage, item = np.asarray(words_.values), np.asarray(tokens.values)
                # words that the passage lacks match nothing, so that their number bounds the score
                if np.isin(item, passage).sum() < threshold * len(item):
                    continue
                score, first, last = align(passage, item)
                if score >= threshold * len(item):
                    out.append((words_id, item_id, score / len(item), seeds_, first, last))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), type=t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)],
                names=["words_id", "item_id", "score", "n_seeds", "first", "last"],
            )

    aligned = candidates.mapInArrow(run, "words_id long, item_id long, score double, n_seeds long, first int, last int")
    scored = materialize(aligned).join(found.select("words_id", "doc_id", "places"), "words_id").withColumns(
        {"first_word": F.expr("places[first]"), "last_word": F.expr("places[last]")}
    )
    best = scored.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("score", "n_seeds", F.negative("first_word").alias("before"), "last_word")).alias("b")
    )
    return best.select(
        "doc_id", "item_id", "b.score", "b.n_seeds", F.negative("b.before").alias("first_word"), "b.last_word"
    )
