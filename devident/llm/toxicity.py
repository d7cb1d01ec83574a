"""Toxicity of whole texts: a recurrent network over all overlapping windows of words.

The network learns from a bounded sample of labelled documents on the driver; every document is scored in
tasks. A document's score is that of its most toxic window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devident.llm import gru
from devident.llm.text import utf8, words

WINDOW, STRIDE = 64, 32
CACHED_WORDS = 300_000
_BATCH = 2048


@dataclass(frozen=True)
class Training:
    """The bounds of what is learned from: labelled documents of either class (expected numbers, chosen by
    a hash of doc_id) and windows of each, spread over the whole text; the number
    of steps and their batch; and in how many documents a known word or n-gram must be."""

    positives: int = 1500
    negatives: int = 2500
    windows: int = 16
    steps: int = 240
    batch: int = 128
    least: int = 3
    seed: int = 17


def window_starts(n: int) -> np.ndarray:
    """Starts of overlapping windows that cover n words; the last may be shorter."""
    return np.arange(0, max(1, -(-(n - WINDOW) // STRIDE) + 1)) * STRIDE if n else np.empty(0, dtype=np.int64)


def window_ids(ids: np.ndarray) -> np.ndarray:
    """(windows, WINDOW) of word ids, -1 behind the end."""
    starts = window_starts(len(ids))
    padded = np.full((starts[-1] if len(starts) else 0) + WINDOW, -1, dtype=np.int64)
    padded[: len(ids)] = ids
    return padded[starts[:, None] + np.arange(WINDOW)] if len(starts) else np.empty((0, WINDOW), dtype=np.int64)


def sample(docs: DataFrame, labels: DataFrame, training: Training) -> list:
    """(doc_id, start, toxic, text) of up to `windows` windows per sampled document, collected.

    `labels(doc_id, toxic)`: NULL labels are left out, a repeated doc_id counts once and as toxic if any of its rows
    says so. The sample is bounded by the training's numbers, whatever the size of the tables.
    """
    own = labels.filter("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {k: bound / max(1, counts.get(k, 0)) for k, bound in ((1, training.positives), (0, training.negatives))}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    drawn = own.filter(place < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, toxic, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "toxic")], utf8(batch.column("text"))):
                parts = words(text)
                starts = window_starts(len(parts))
                picked = starts[np.linspace(0, len(starts) - 1, min(len(starts), training.windows)).astype(int)] if len(starts) else starts
                out += [(doc_id, int(s), toxic, b" ".join(parts[s : s + WINDOW]).decode("utf-8", "replace")) for s in picked]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), type=t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.string()))],
                names=["doc_id", "start", "toxic", "text"],
            )

    # a bounded number of rows: expected positives + negatives
    joined = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(
        F.broadcast(drawn.select("doc_id", F.col("toxic").cast("int"))), "doc_id"
    )
    rows = joined.mapInArrow(run, "doc_id long, start long, toxic int, text string").collect()
    rows.sort(key=lambda r: (r.doc_id, r.start, r.text))
    return rows


@dataclass(frozen=True)
class Model:
    """Parameters, the hashes of the words and n-grams that the tables know, and how a document's largest
    logit becomes a probability: by `scale` and `shift`."""

    params: dict
    words: np.ndarray
    grams: np.ndarray
    scale: float = 1.0
    shift: float = 0.0


def calibrate(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and shift that fit documents' largest logits to their labels; both classes weigh the same, and
    targets are a little off 0 and 1, so that separable ones don't end in a step."""
    size = np.array([(labels == 0).sum(), (labels == 1).sum()])
    target = np.where(labels == 1, (size[1] + 1) / (size[1] + 2), 1 / (size[0] + 2))
    weight = 0.5 / size[labels]
    x = np.stack([logits, np.ones(len(logits))], axis=1).astype(float)
    beta = np.array([1.0, 0.0])
    for _ in range(100):
        p = gru.sigmoid(x @ beta)
        slope = x.T @ (weight * (p - target)) + 1e-4 * (beta - [1, 0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta = beta - step * min(1.0, 2.0 / np.abs(step).max(initial=1e-12))
    return (float(beta[0]), float(beta[1])) if beta[0] > 0.05 else (1.0, 0.0)


def _lexicon(labels, owner, ids, feats, least: int):
    """Of words and of n-grams: those in `least` documents or more, and how much more often toxic documents have
    them, from -1 to 1."""
    word_hash, gram_hash, begins = feats
    known_words, word_row = np.unique(word_hash, return_inverse=True)
    # without the inverse of np.unique, which sorts places of 64 bits
    known_grams = np.unique(gram_hash)
    gram_row = np.empty(len(gram_hash), dtype=np.int32)
    for i in range(0, len(gram_hash), 1 << 16):
        gram_row[i : i + (1 << 16)] = np.searchsorted(known_grams, gram_hash[i : i + (1 << 16)])
    has_word, has_gram = (np.zeros((2, len(k)), dtype=np.int64) for k in (known_words, known_grams))
    total = np.zeros(2)
    cuts = np.flatnonzero(np.diff(owner)) + 1  # rows are ordered by document
    for own in np.split(np.arange(len(owner)), cuts):
        label, met = labels[own[0]], np.unique(ids[own])
        met = met[met >= 0]
        has_word[label][np.unique(word_row[met])] += 1
        has_gram[label][np.unique(gru.subset((word_hash, gram_row, begins), met)[1])] += 1
        total[label] += 1
    out = []
    for known, has in ((known_words, has_word), (known_grams, has_gram)):
        p0, p1 = has[0] / total[0], has[1] / total[1]
        mean = (has.sum(axis=0) + 3) / (total.sum() + 6)  # rare ones say little
        z = (p1 - p0) / np.sqrt(mean * (1 - mean) * (1 / total[0] + 1 / total[1]))
        kept = has.sum(axis=0) >= least
        out.append((known[kept], np.tanh(z * np.abs(z) / 36)[kept]))
    return out


def train(rows: list, training: Training) -> Model:
    """The network. Windows of a toxic document count as toxic only where the network finds
    them the most toxic ones of the document; every window of a clean document is clean.

    Without a row of each class the network says 0 for every text.
    """
    labels = np.array([r.toxic for r in rows], dtype=np.int64)
    if not len(rows) or labels.min() == labels.max():
        params, none = gru.initial(training.seed), np.empty(0, np.uint64)
        params["bias"][:] = -20.0
        params["out"][:] = 0.0
        return Model(params, none, none)
    owner = np.array([r.doc_id for r in rows])
    index: dict[bytes, int] = {}
    ids = np.full((len(rows), WINDOW), -1, dtype=np.int32)
    for i, row in enumerate(rows):
        parts = words(row.text.encode())
        ids[i, : len(parts)] = [index.setdefault(w, len(index)) for w in parts]
    rows = row = None  # the texts aren't needed any more
    hashed = gru.features(list(index))
    (known_words, word_start), (known_grams, gram_start) = _lexicon(labels, owner, ids, hashed, training.least)
    params = gru.initial(training.seed, len(known_words), len(known_grams))
    params["word"][1:, 0] += word_start
    params["char"][1:, 0] += gram_start
    feats = gru.resolve(hashed, gru.Rows(known_words), gru.Rows(known_grams))
    del hashed, index
    adam, rng = gru.Adam(params, word=0.0005, char=0.0005), np.random.default_rng(training.seed)
    toxic, clean = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    groups = np.split(toxic, np.flatnonzero(np.diff(owner[toxic])) + 1)
    targets = hard = None

    def window_logits():
        projected = gru.project_all(params, feats)
        return np.concatenate([gru.forward(params, projected, ids[i : i + _BATCH])[0] for i in range(0, len(ids), _BATCH)])

    for step in range(training.steps):
        if step % 20 == 0:
            logits = window_logits()
            # per toxic document its best window, and those that are near it or already found toxic
            targets = np.concatenate([g[(logits[g] >= logits[g].max()) | (logits[g] > 1.0)] for g in groups])
            hard = clean[np.argsort(-logits[clean], kind="stable")[: max(1, len(clean) // 4)]]
        half = training.batch // 2
        taken = np.concatenate([rng.choice(targets, half), rng.choice(clean, half // 2), rng.choice(hard, half - half // 2)])
        y = labels[taken].astype(np.float32)
        met, own = np.unique(ids[taken], return_inverse=True)
        own = own.reshape(len(taken), WINDOW) - (met[0] < 0)  # an ended window stays at -1
        some = gru.subset(feats, met[met >= 0])
        vectors = gru.embed(params, *some)
        logit, cache = gru.forward(params, gru.project(params, vectors), own, keep=True)
        d_logit = ((gru.sigmoid(logit) - y) / len(taken)).astype(np.float32)
        grad = gru.gradients(params, vectors, some, own, d_logit, cache)
        adam.update(params, grad)
    logits = window_logits()
    documents, number = np.unique(owner, return_inverse=True)
    largest, flag = np.full(len(documents), -np.inf), np.zeros(len(documents), dtype=np.int64)
    np.maximum.at(largest, number, logits)
    flag[number] = labels
    return Model(params, known_words, known_grams, *calibrate(largest, flag))


class Scorer:
    """Scores texts; keeps the projected vectors of words already met."""

    def __init__(self, model: Model):
        self.model, self.params = model, model.params
        self.rows = gru.Rows(model.words), gru.Rows(model.grams)
        self.known: dict[bytes, int] = {}
        # pages of an array are taken as its rows are filled, and rows are never copied to make room
        self.forth = np.empty((CACHED_WORDS, 3 * gru.HIDDEN), np.float32)
        self.back = np.empty_like(self.forth)

    def _learn(self, parts: set[bytes]) -> None:
        new = [w for w in parts if w not in self.known]
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known.clear()
            new = list(parts)
        if not new:
            return
        begin = len(self.known)
        if len(self.forth) < begin + len(new):  # a stretch with more words than are kept
            self.forth, self.back = (np.concatenate([a, np.empty((begin + len(new) - len(a), a.shape[1]), a.dtype)]) for a in (self.forth, self.back))
        for i in range(0, len(new), 1 << 15):
            some = new[i : i + (1 << 15)]
            forth, back = gru.project(self.params, gru.embed(self.params, *gru.resolve(gru.features(some), *self.rows)))
            at = slice(begin + i, begin + i + len(some))
            self.forth[at], self.back[at] = forth, back
        self.known.update((w, begin + i) for i, w in enumerate(new))

    def windows(self, parts: list[bytes]) -> np.ndarray:
        self._learn(set(parts))
        return window_ids(np.fromiter(map(self.known.__getitem__, parts), dtype=np.int64, count=len(parts)))

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        out = [
            gru.sigmoid(
                self.model.scale * gru.forward(self.params, (self.forth, self.back), ids[i : i + _BATCH])[0] + self.model.shift
            )
            for i in range(0, len(ids), _BATCH)
        ]
        return np.concatenate(out) if out else np.empty(0, np.float32)

    def scores(self, texts: list[bytes | None]) -> list[float]:
        """The score of each text: of its most toxic window; 0 without a word."""
        out, waiting, owners, size = [0.0] * len(texts), [], [], 0

        def flush():
            nonlocal waiting, owners, size
            if waiting:
                found = self.probabilities(np.concatenate(waiting))
                for at, p in zip(np.concatenate(owners).tolist(), found.tolist()):
                    out[at] = max(out[at], p)
            waiting, owners, size = [], [], 0

        for at, text in enumerate(texts):
            parts = words(text)
            for begin in range(0, len(parts), CACHED_WORDS // 2 // STRIDE * STRIDE or STRIDE):
                # very long texts by stretches that overlap by a window's rest
                ids = self._stretch(parts, begin, flush)
                waiting.append(ids)
                owners.append(np.full(len(ids), at))
                size += len(ids)
                if size >= _BATCH:
                    flush()
        flush()
        return out

    def _stretch(self, parts, begin, flush):
        own = parts[begin : begin + CACHED_WORDS // 2 // STRIDE * STRIDE + WINDOW - STRIDE]
        if len(self.known) + len(set(own)) > CACHED_WORDS:
            flush()  # before the vectors of waiting windows go
        return self.windows(own)


def score(docs: DataFrame, model: Model, text: str = "text", keep=None, threshold: float = 0.3) -> DataFrame:
    """The columns `keep` (None: all) with `score` (0 to 1) and `predicted` (1 from `threshold` on).

    NULL, empty and blank texts score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    read = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, text])])

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            found = scorer.scores(utf8(batch.column(text)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(found, type=pa.float64())], names=[*names, "score"]
            )

    scored = read.mapInArrow(run, f"{fields}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(column="doc_id"):
    """Rows that are not learned from: crc32 of the doc_id's text, mod 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> Model:
    """The network learned from the labelled documents that are not held out."""
    return train(sample(docs, labels.select("doc_id", "toxic").filter(~held_out()), training), training)
