"""Substring deduplication by prefix-partitioned suffix trees.

A window is `length` consecutive words. Every window has an anchor: the place of its least hashed run
of PREFIX words, the leftmost of equal ones. Neighbouring windows mostly have the same anchor, so a text
of n words has about n / 21 anchored suffixes instead of n. The anchor's prefix partitions the
suffixes: windows of equal words have the same prefix at the same offset and meet in the same part.

The windows of an anchored suffix cover its segment; equal segments fold into a class with its least
doc_id. Parts of one class need no tree. Other parts become suffix
subtrees in memory: the windows' suffixes of their distinct segments are sorted, neighbours' common
prefixes are measured, and an internal node at depth `length` or more is a repeat; the least doc_id below
it keeps its copy. Parts with more than `part` distinct segments are split by longer prefixes, up to the
whole window, which is the node itself; its least doc_id is a partial aggregate. So no part
has to fit in memory whose size grows with the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devident.llm.text import Recent, utf8, words
from devident.session import materialize

PREFIX = 10
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SUFFIXES = 1 << 15


def _hashes(missing: list[bytes]) -> Iterator[int]:
    return map(xxhash.xxh64_intdigest, missing)


def word_hashes(parts: list[bytes], known: Recent | None = None) -> np.ndarray:
    """The 64-bit hash of each word."""
    return np.fromiter((known or Recent(_hashes)).of(parts), dtype=np.uint64, count=len(parts))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Spans:
    """Hashes of any span of a sequence of word hashes."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_BASE, n), dtype=np.uint64)])
        self.back = _powers(_INVERSE, n + 1)

    def of(self, low, high) -> np.ndarray:
        return _mix((self.sums[high] - self.sums[low]) * self.back[low])


def anchored(hashes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Per anchored suffix: its prefix's hash, the first window start and the number of further ones, and the
    hash of the segment of words that its windows cover."""
    n = len(hashes)
    if n < length:
        empty = np.empty(0, dtype=np.int64)
        return empty.astype(np.uint64), empty, empty, empty.astype(np.uint64)
    spans = _Spans(hashes)
    at = np.arange(n - PREFIX + 1)
    prefix = spans.of(at, at + PREFIX)
    starts = np.arange(n - length + 1)
    anchor = starts + np.lib.stride_tricks.sliding_window_view(prefix, length - PREFIX + 1).argmin(axis=1)
    low = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    more = np.concatenate([low[1:], [len(starts)]]) - low - 1
    segment = spans.of(low, low + more + length) ^ _mix((more * 64 + anchor[low] - low).astype(np.uint64))
    return prefix[anchor[low]], low, more, segment


def _digest(parts: list[bytes]) -> tuple[str, int]:
    sha = hashlib.sha256(b" ".join(parts))
    return sha.hexdigest(), int.from_bytes(sha.digest()[:8], "little", signed=True)


def _index(docs: DataFrame, length: int) -> DataFrame:
    """Per document: its words' count and digest, and its anchored suffixes."""

    def run(batches):
        known = Recent(_hashes)
        for batch in batches:
            out = [[] for _ in range(8)]
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                parts = words(text)
                sha, print_ = _digest(parts)
                # a NULL doc_id is neither smaller nor larger than another
                suffixes = anchored(word_hashes(parts if doc_id is not None else [], known), length)
                key, low, more, segment = (c.view(np.int64) for c in suffixes)
                for column, value in zip(out, (doc_id, print_, len(parts), sha, key, low, more, segment)):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.list_(t) for t in (pa.int64(), pa.int32(), pa.int16(), pa.int64())]]
            out[5] = [c.astype(np.int32) for c in out[5]]
            out[6] = [c.astype(np.int16) for c in out[6]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(out, types)],
                names=["doc_id", "print", "n_words", "sha", "key", "low", "more", "segment"],
            )

    return docs.mapInArrow(
        run,
        "doc_id long, print long, n_words long, sha string, "
        "key array<long>, low array<int>, more array<short>, segment array<long>",
    )


def _segments(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The word hashes of wanted segments, taken from one document each."""

    def run(batches):
        known = Recent(_hashes)
        for batch in batches:
            rows = []
            lists = batch.column("wanted").to_pylist()
            for text, print_, doc_id, own in zip(utf8(batch.column("text")), batch.column("print").to_pylist(), batch.column("doc_id").to_pylist(), lists):
                parts = words(text)
                if _digest(parts)[1] != print_:
                    continue  # another row with the same doc_id
                hashes = word_hashes(parts, known).view(np.int64)
                rows += [(w["key"], w["segment"], w["n"], doc_id, hashes[w["low"] : w["low"] + w["more"] + length]) for w in own]
            columns = zip(*rows) if rows else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), type=t) for c, t in zip(columns, types)], names=["key", "segment", "n", "least", "hashes"]
            )

    lists = wanted.groupBy("doc_id", "print").agg(
        F.collect_set(F.struct("key", "segment", "n", "low", "more")).alias("wanted")
    )
    return docs.join(lists, "doc_id").mapInArrow(run, "key long, segment long, n long, least long, hashes array<long>")


def _spans_of_nodes(owner: np.ndarray, offset: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Places where a new span of offsets with the same owner and the same least doc_id begins."""
    if not len(owner):
        return np.empty(0, dtype=np.int64)
    return np.flatnonzero(
        np.concatenate([[True], (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1) | (least[1:] != least[:-1])])
    )


def subtree(parts: np.ndarray, segments: list[np.ndarray], least: np.ndarray, length: int):
    """Deep nodes of the suffix subtrees of several parts.

    `parts`: the part of each segment. Returns, per window: its segment, its offset there, and the least
    `least` of the segments below its node at depth `length`.
    """
    counts = np.array([len(s) - length + 1 for s in segments])
    owner = np.repeat(np.arange(len(segments)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    suffixes = np.empty((len(owner), length + 1), dtype=np.int64)
    suffixes[:, 0] = parts[owner]
    suffixes[:, 1:] = np.concatenate([np.lib.stride_tricks.sliding_window_view(s, length) for s in segments])
    order = np.argsort(suffixes.view(np.dtype((np.void, suffixes.itemsize * (length + 1)))).ravel(), kind="stable")
    ordered = suffixes[order]
    differs = ordered[1:] != ordered[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1) - 1, length)  # words in common with the one before
    node = np.cumsum(np.concatenate([[0], common < length]))
    lowest = np.full(node[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(lowest, node, least[owner[order]])
    found = np.empty(len(owner), dtype=np.int64)
    found[order] = lowest[node]
    return owner, offset, found


VERDICT = "key long, segment long, first int, last int, least long"


def _trees(segments: DataFrame, length: int) -> DataFrame:
    # a set: rows that repeat in the input give their segments once
    groups = segments.groupBy("key").agg(F.collect_set(F.struct("segment", "least", "hashes")).alias("members"))

    def emit(keys, flat, low, high, sizes):
        parts = np.repeat(keys, sizes)
        hashes = [np.asarray(h.values) for h in flat.field("hashes").slice(low, high - low)]
        least = flat.field("least").slice(low, high - low).to_numpy()
        names = flat.field("segment").slice(low, high - low).to_numpy()
        owner, offset, found = subtree(parts, hashes, least, length)
        earlier = found < least[owner]  # windows that the segment's own least document doesn't own
        owner, offset, found = owner[earlier], offset[earlier], found[earlier]
        first = _spans_of_nodes(owner, offset, found)
        last = np.concatenate([first[1:], [len(owner)]]).astype(np.int64)[: len(first)] - 1
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (parts[owner[first]], names[owner[first]], offset[first].astype(np.int32), offset[last].astype(np.int32), found[first])],
            names=["key", "segment", "first", "last", "least"],
        )

    def run(batches):
        for batch in batches:
            keys, members = batch.column("key").to_numpy(), batch.column("members")
            ends, flat = members.offsets.to_numpy(), members.values
            begin = 0
            for at in range(1, len(keys) + 1):  # some parts at a time
                if at == len(keys) or (ends[at + 1] - ends[begin]) * length > _SUFFIXES:
                    yield emit(keys[begin:at], flat, int(ends[begin]), int(ends[at]), np.diff(ends[begin : at + 1]))
                    begin = at

    return groups.mapInArrow(run, VERDICT)


def _whole_prefixes(segments: DataFrame, length: int) -> DataFrame:
    """The same for parts of any size, by the prefix of `length` words of each window."""

    def run(batches):
        for batch in batches:
            out = []
            for key, segment, least, hashes in zip(*[batch.column(c).to_pylist() for c in ("key", "segment", "least")], batch.column("hashes")):
                own = _Spans(np.asarray(hashes.values).view(np.uint64))
                starts = np.arange(len(hashes.values) - length + 1)
                nodes = own.of(starts, starts + length).view(np.int64)
                out += [(key, segment, int(s), least, int(node)) for s, node in zip(starts, nodes)]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), type=t) for c, t in zip(zip(*out) if out else [[]] * 5, types)],
                names=["key", "segment", "first", "own", "node"],
            )

    windows = materialize(segments.mapInArrow(run, "key long, segment long, first int, own long, node long"))
    least = materialize(windows.groupBy("key", "node").agg(F.min("own").alias("least")))
    found = windows.alias("w").join(
        least.alias("l"), F.expr("w.key = l.key AND w.node = l.node AND w.own > l.least")
    )
    return found.select("w.key", "segment", "first", F.col("first").alias("last"), "least").distinct()


def _remove(joined: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            spans = batch.column("spans").to_pylist()
            for doc_id, print_, text, own in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "print")], utf8(batch.column("text")), spans):
                parts = words(text)
                if _digest(parts)[1] != print_:
                    continue  # another row with the same doc_id
                cover = np.zeros(len(parts) + 1, dtype=np.int64)
                np.add.at(cover, [s["first"] for s in own], 1)
                np.add.at(cover, [s["last"] + length for s in own], -1)
                gone = np.cumsum(cover[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                kept = [w for w, g in zip(parts, gone.tolist()) if not g]
                sha = hashlib.sha256(b" ".join(kept)).hexdigest()
                rows.append((doc_id, len(parts), int(gone.sum()), sha, edge.tolist(), b" ".join(kept).decode("utf-8", "replace")))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), type=t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"],
            )

    return joined.mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<long>, kept string"
    )


def removals(docs: DataFrame, length: int = 50, part: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The index of `docs(doc_id, text)`, and (doc_id, print, first, last): the starts of windows that also
    start in a document with a smaller doc_id."""
    index = materialize(_index(docs, length))
    runs = index.select("doc_id", "print", F.explode(F.arrays_zip("key", "low", "more", "segment")).alias("s")).select(
        "doc_id", "print", "s.*"
    )
    met = runs.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    met = materialize(met.filter("least < most").select("key"))
    shared = materialize(runs.join(met, "key"))
    classes = shared.groupBy("key", "segment").agg(
        F.min(F.struct("doc_id", "print", "low", "more")).alias("rep"), F.max("doc_id").alias("most")
    )
    classes = materialize(classes.select("key", "segment", "rep.*", "most"))
    sizes = materialize(classes.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    segments = materialize(_segments(docs, classes.join(sizes, "key"), length))
    # all windows of a segment start in its least document, and some in an earlier one
    own = classes.filter("doc_id < most").select(
        "key", "segment", F.lit(0).alias("first"), F.lit(length).alias("last"), F.col("doc_id").alias("least")
    )
    verdicts = own.unionByName(_trees(segments.filter(F.col("n") <= part), length)).unionByName(
        _whole_prefixes(segments.filter(F.col("n") > part), length)
    )
    gone = shared.join(materialize(verdicts), ["key", "segment"]).filter(F.col("doc_id") > F.col("least"))
    return index, gone.select(
        "doc_id", "print", (F.col("low") + F.col("first")).alias("first"),
        (F.col("low") + F.least("last", F.col("more").cast("int"))).alias("last"),
    )


def dedupe(docs: DataFrame, length: int = 50, part: int = 4096) -> DataFrame:
    """Per row of `docs(doc_id, text)`: n_words, n_removed, kept_sha256, `spans` (begin, end, … of removed words)
    and `kept`, the text left where words were removed (NULL: nothing was).

    A word goes if a window of `length` words that covers it also starts in a document with a smaller
    doc_id; windows are judged on the input. NULL and empty texts have no words. Rows with the same doc_id
    don't remove each other's words; rows without a doc_id neither remove nor lose any.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    index, gone = removals(docs, length, part)
    lists = materialize(gone.groupBy("doc_id", "print").agg(F.collect_set(F.struct("first", "last")).alias("spans")))
    cut = _remove(docs.join(lists, "doc_id"), length)
    whole = index.join(lists.select("doc_id", "print"), ["doc_id", "print"], "left_anti").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"),
        F.expr("CAST(array() AS array<long>)").alias("spans"), F.lit(None).cast("string").alias("kept"),
    )
    return whole.unionByName(cut)
