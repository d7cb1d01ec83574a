"""Vector best-fit packing of token sequences.

A bin has three residual capacities: tokens, documents and attention cost (the sum of squared piece
lengths). Pieces are taken longest first; of the open bins that have room in every dimension, the one
with the best score takes the piece: the smallest weighted residual norm after placing it, or the
largest weighted dot product of demand and residual.

Pieces are dealt over groups of a bounded size by a hash of their place in the input, so a group
neither holds all pieces nor depends on hot keys; a group wastes part of one bin.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devident.llm.merges import of_tokenizer
from devident.llm.text import Recent, utf8, words
from devident.session import materialize

#: characters whose lower case and kind no version of Unicode changes: visible ASCII and the letters up to U+00FF
PLAIN = r"[!-~À-ÖØ-öø-ÿ]+"
#: bytes of words, and of parts of words, whose ids a task remembers (twice this, as there are two generations)
REMEMBERED = 32 << 20
#: bytes of text that are worked on together: a batch, so that a word that it repeats is looked for once
TOGETHER = 4 << 20
#: no id is this number, nor do the bytes of ids hold it: their upper half is zero
END_OF_WORD = b"\xff\xff\xff\xff"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, spread long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


_worker: dict[str, WordIds] = {}


class WordIds(Recent):
    """`of` gives the ids of words; `words` cuts a text into words with the same ids in a row as the text's."""

    def __init__(self, make, words: Callable[[bytes | None], list[bytes]]):
        super().__init__(make, REMEMBERED)
        self.words = words


def word_ids(path: str) -> WordIds:
    """The ids of single words as little-endian unsigned 32-bit numbers, by the tokenizer in the file.

    A word is cut into the parts that the tokenizer's splitter makes, and the merges of its model give the ids of each. Words that
    differ in case or punctuation share parts, so that a part is worked on once while it is remembered. Words with other
    characters than those of PLAIN or with one of the tokenizer's added tokens, and all words of other kinds of tokenizers, are
    encoded as a whole. The tokenizer works in the task's own thread.

    A worker remembers the words of one tokenizer from task to task, within the bound of REMEMBERED: most words of a task are
    those of the task before.
    """
    if path in _worker:
        return _worker[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    (parted, written), merges, model = _splitter(whole), of_tokenizer(whole), whole.model
    plain, control = re.compile(PLAIN).fullmatch, re.compile(r"[\x00-\x09\x0b-\x20\x7f]").search
    added_bytes = [t.content.lower().encode() for t in whole.get_added_tokens_decoder().values()]
    added = re.compile("|".join(re.escape(t.content) for t in whole.get_added_tokens_decoder().values()) or r"(?!)").search

    def packed(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def part_ids(missing: list[str]) -> Iterator[bytes]:
        missing = _rewritten(missing, written)
        found = merges.ids(missing) if merges else [None] * len(missing)
        for part, ids in zip(missing, found):
            yield END_OF_WORD if part == "\n" else packed([t.id for t in model.tokenize(part)]) if ids is None else ids

    parts = Recent(part_ids, REMEMBERED)

    def make(missing: list[bytes]) -> Iterator[bytes]:
        # one line per word; a word has no line feed
        joined = b"\n".join(missing).decode("utf-8", "replace")
        texts, clear = joined.split("\n"), not control(joined) and not added(joined)
        odd = [n for n, t in enumerate(texts) if not (clear and t.isascii()) and not (parted and plain(t) and not added(t))] if parted else range(len(texts))
        others = {n: packed(whole.encode(texts[n], add_special_tokens=False).ids) for n in odd}
        for n in odd:
            texts[n] = ""
        ids = b"".join(parts.of(parted("\n".join(texts) + "\n"))).split(END_OF_WORD) if parted else [b""] * len(texts)
        for n, own in others.items():
            ids[n] = own
        return ids[: len(texts)]

    def equal_words(text: bytes | None) -> list[bytes]:
        # a tokenizer that lower-cases has fewer words to remember; no text may turn into an added token by that
        low = text.lower() if parted and text else text
        return words(text if low and any(t in low for t in added_bytes) else low)

    _worker.clear()
    return _worker.setdefault(path, WordIds(make, equal_words))


def _rewritten(parts: list[str], written: dict[str, str]) -> list[str]:
    """The parts with characters replaced, for all parts at once; what is written holds none of the characters."""
    wide = [n for n, p in enumerate(parts) if not p.isascii()]
    joined = "\n".join([parts[n] for n in wide])
    for letter, own in written.items():
        joined = joined.replace(letter, own)
    out = parts.copy()
    for n, part in zip(wide, joined.split("\n")):
        out[n] = part
    return out


def _splitter(whole) -> tuple[Callable[[str], list[str]] | None, dict[str, str]]:
    """For a tokenizer that lower-cases, splits by a pattern and writes bytes as characters: how lines of PLAIN characters, which
    are composed and have one lower case, fall into parts and line ends, and how its model's alphabet writes them. None for others."""
    steps = json.loads(whole.to_str())
    kinds = [n.get("type") for n in (steps["normalizer"] or {}).get("normalizers", ())]
    splits = (steps["pre_tokenizer"] or {}).get("pretokenizers", ())
    spaces = [n for n in (steps["normalizer"] or {}).get("normalizers", ()) if n["type"] == "Replace"]
    fits = (
        kinds == ["NFC", "Replace", "Lowercase"] and spaces[0]["pattern"] == {"Regex": r"\s+"}
        and [s["type"] for s in splits] == ["Split", "ByteLevel"] and "Regex" in splits[0]["pattern"]
        and (splits[0]["behavior"], splits[0]["invert"]) == ("Removed", True)
        and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"] and steps["post_processor"] is None
    )
    if not fits:
        return None, {}
    import regex

    # no part holds white space, so the line's end after each word is a part of its own
    find = regex.compile(splits[0]["pattern"]["Regex"] + r"|\n").findall
    letters = [chr(c) for c in range(256) if re.fullmatch(PLAIN, chr(c)) and chr(c).lower() == chr(c) and not chr(c).isascii()]
    written = {c: whole.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}
    if any(c in own for c in written for own in written.values()):
        return None, {}

    return (lambda lines: find(lines.lower())), written


def token_bytes(known: WordIds, texts: list[bytes | None]) -> Iterator[bytes]:
    """The ids of each text, for a tokenizer that never joins across ASCII white space.

    Such a tokenizer gives a text the ids of its words in a row, so a word is encoded once while it is remembered.
    """
    held, size = [], 0

    def of_held() -> Iterator[bytes]:
        ids = known.of([w for own in held for w in own])
        return (b"".join(islice(ids, len(own))) for own in held)

    for text in texts:
        held.append(known.words(text))
        size += len(text or b"")
        if size >= TOGETHER:
            yield from of_held()
            held, size = [], 0
    yield from of_held()


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece of each document: its ids and then `end_id`, cut only beyond `capacity` ids.

    NULL or empty text: the single id `end_id`. `path`: a tokenizers file that executors can read.
    Repeated doc_ids and NULL ones are documents of their own.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        seen, task, known = 0, TaskContext.get().partitionId(), word_ids(path)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), token_bytes(known, utf8(batch.column(1)))):
                ids += end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part), (task << 40) + seen))
                    seen += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(zip(*rows) if rows else [[]] * 6, _PIECE_TYPES)],
                names=[f.name for f in _PIECE_FIELDS],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


_PIECE_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
_PIECE_FIELDS = [pa.field(d.split()[0], t) for d, t in zip(PIECES.split(", "), _PIECE_TYPES)]


@dataclass(frozen=True)
class Capacity:
    """What a bin holds, and how bins are scored: `weights` for tokens, documents, attention cost."""

    tokens: int
    documents: int
    attention: int
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    score: str = "norm"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], dtype=float)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece. Ties: the earlier piece, the lower bin."""
    limits = capacity.vector()
    weights = np.array(capacity.weights)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    residual = np.empty((256, 3))  # of open bins, as shares of the limits
    number = np.empty(256, dtype=np.int64)
    filled: list[int] = []
    n_open, smallest = 0, lengths.min() / limits[0] if len(lengths) else 0.0
    for at in order:
        length = int(lengths[at])
        demand = np.array([length, 1, length * length]) / limits
        if (demand > 1 + 1e-12).any():
            raise ValueError(f"a piece of {length} tokens doesn't fit an empty bin")
        left = residual[:n_open] - demand
        fits = np.flatnonzero((left >= -1e-12).all(axis=1))
        if len(fits):
            if capacity.score == "norm":
                best = fits[np.argmin((weights * left[fits] ** 2).sum(axis=1))]
            else:
                best = fits[np.argmax(residual[fits] @ (weights * demand))]
        else:
            if n_open == len(residual):
                residual, number = np.concatenate([residual, residual]), np.concatenate([number, number])
            best, n_open = n_open, n_open + 1
            residual[best], number[best] = 1.0, len(filled)
            filled.append(0)
        bins[at], offsets[at] = number[best], filled[number[best]]
        filled[number[best]] += length
        residual[best] -= demand
        if residual[best, 0] < smallest - 1e-12 or residual[best, 1] < 1 / limits[1] - 1e-12:  # closed
            n_open -= 1
            residual[best], number[best] = residual[n_open], number[n_open]
    return bins, offsets


def pack(cut: DataFrame, capacity: Capacity, group_pieces: int = 16_384) -> DataFrame:
    """Every piece with its sequence and its place there; places of a sequence leave no gap.

    `cut` is what `pieces` returns. It is written once; the number of groups follows its count.
    An empty table packs to an empty table.
    """
    stored = materialize(cut)
    groups = max(1, -(-stored.count() // group_pieces))

    def place(key, table):
        lengths = table.column("length").to_numpy()
        order = np.lexsort((table.column("spread").to_numpy(),))
        table, lengths = table.take(pa.array(order)), lengths[order]
        bins, offsets = best_fit(lengths, capacity)
        sequence = (int(key[0].as_py()) << 32) + bins
        return pa.table(
            [table.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            + [pa.array(sequence), pa.array(offsets)],
            names=[f.split()[0] for f in PACKED.split(", ")],
        )

    return (
        stored.withColumn("deal", F.pmod(F.xxhash64("spread"), F.lit(groups)))
        .groupBy("deal")
        .applyInArrow(place, PACKED)
    )
