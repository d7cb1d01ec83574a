"""A bidirectional gated recurrent network with attention pooling, in numpy.

Each step's input is the sum of a word's vector and the mean of its character n-grams' vectors. Both tables hold
what was met in training; other words and n-grams are zero. Two GRUs read a window in either direction, attention weighs their states, and one
logit comes out.
"""

from __future__ import annotations

import numpy as np

EMBED, HIDDEN, ATTEND = 12, 12, 8
GRAMS = (3, 4, 5)
_PRIME = np.uint64(0x100000001B3)
_SLOTS = 1 << 21


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return hashes ^ (hashes >> np.uint64(29))


class Rows:
    """The row of each known 64-bit hash; 0 for others. Of known hashes with one slot the first counts."""

    def __init__(self, known: np.ndarray):
        self.known = np.concatenate([np.zeros(1, np.uint64), known])
        self.at = np.zeros(_SLOTS, dtype=np.int32)
        self.at[(known & np.uint64(_SLOTS - 1)).astype(np.int64)[::-1]] = np.arange(len(known), 0, -1)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        row = self.at[(hashes & np.uint64(_SLOTS - 1)).astype(np.int64)]
        return np.where(self.known[row] == hashes, row, 0)


def features(vocabulary: list[bytes], some: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`_features` of a whole vocabulary, worked out for `some` words at a time."""
    parts = [_features(vocabulary[i : i + some]) for i in range(0, max(1, len(vocabulary)), some)]
    before = np.cumsum([0] + [len(p[1]) for p in parts[:-1]])
    return (
        np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]),
        np.concatenate([p[2] + b for p, b in zip(parts, before)]),
    )


def _features(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word in lower case: its hash; the hashes of its character n-grams, flat, with the place
    where each word's begin. A word has one n-gram at least."""
    texts = [w.decode("utf-8", "replace").lower() for w in vocabulary]
    marked = "".join(f"\x02{t}\x03" for t in texts)
    points = np.frombuffer(marked.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    lengths = np.array([len(t) + 2 for t in texts])
    begins = np.cumsum(lengths) - lengths
    ends = np.repeat(begins + lengths, lengths)
    place = np.arange(len(points))
    owners, grams = [], []
    rolled = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        shifted = np.zeros(len(points), dtype=np.uint64)
        shifted[: max(0, len(points) - n + 1)] = points[n - 1 :]
        rolled = (rolled ^ shifted) * _PRIME
        if n in GRAMS:
            inside = np.flatnonzero(place + n <= ends)
            owners.append(inside)
            grams.append(_mixed(rolled[inside] + np.uint64(n)))
    owner, gram = np.concatenate(owners), np.concatenate(grams)
    word_of = np.repeat(np.arange(len(texts)), lengths)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(word_of[owner], minlength=len(texts))
    powers = np.full(int(lengths.max(initial=1)), 0x9E3779B97F4A7C15, dtype=np.uint64)
    powers[0] = 1
    inside = place - np.repeat(begins, lengths)
    spelled = points * np.cumprod(powers, dtype=np.uint64)[inside]
    words = _mixed(np.add.reduceat(spelled, begins) if len(texts) else spelled)
    return words, gram[order], np.cumsum(counts) - counts


def subset(features_, chosen: np.ndarray):
    """The features of some words of a vocabulary."""
    words, grams, begins = features_
    counts = np.diff(np.concatenate([begins, [len(grams)]]))[chosen]
    firsts = np.cumsum(counts) - counts
    spans = np.arange(counts.sum()) + np.repeat(begins[chosen] - firsts, counts)
    return words[chosen], grams[spans], firsts


def resolve(features_, word_rows: Rows, char_rows: Rows):
    """Features as rows of the tables instead of hashes."""
    return word_rows.of(features_[0]), char_rows.of(features_[1]), features_[2]


def initial(seed: int = 11, words: int = 0, grams: int = 0) -> dict[str, np.ndarray]:
    """Parameters with tables for so many words and n-grams; row 0 stands for those not known and stays zero."""
    rng = np.random.default_rng(seed)

    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    params = {"word": normal(words + 1, EMBED, scale=0.02), "char": normal(grams + 1, EMBED, scale=0.02)}
    params["word"][0] = params["char"][0] = 0
    for side in "fb":
        params |= {
            f"w{side}": normal(EMBED, 3 * HIDDEN, scale=EMBED**-0.5),
            f"u{side}": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
            f"c{side}": np.zeros(3 * HIDDEN, np.float32),
        }
    return params | {
        "wa": normal(2 * HIDDEN, ATTEND, scale=(2 * HIDDEN) ** -0.5), "va": normal(ATTEND, scale=ATTEND**-0.5),
        "out": normal(2 * HIDDEN, scale=(2 * HIDDEN) ** -0.5), "bias": np.zeros(1, np.float32),
    }


def embed(params, words, grams, begins) -> np.ndarray:
    """One vector per word of a vocabulary."""
    if not len(words):
        return np.empty((0, EMBED), np.float32)
    counts = np.diff(np.concatenate([begins, [len(grams)]]))
    return params["word"][words] + np.add.reduceat(params["char"][grams], begins, axis=0) / counts[:, None].astype(np.float32)


def _gru(x, u, mask, keep):
    """States (T, B, H) from projected inputs (T, B, 3H)."""
    steps, batch, _ = x.shape
    hidden = u.shape[0]
    h = np.zeros((batch, hidden), x.dtype)
    states, kept = np.empty((steps, batch, hidden), x.dtype), []
    for t in range(steps):
        g = h @ u
        zr = sigmoid(x[t, :, : 2 * hidden] + g[:, : 2 * hidden])
        z, r = zr[:, :hidden], zr[:, hidden:]
        n = np.tanh(x[t, :, 2 * hidden :] + r * g[:, 2 * hidden :])
        if keep:
            kept.append((h, z, r, n, g[:, 2 * hidden :]))
        h = (n + z * (h - n)) * mask[t]
        states[t] = h
    return states, kept


def _gru_back(d_states, kept, u, mask):
    """Gradients of projected inputs and of u."""
    steps, batch, hidden = d_states.shape
    dx, du = np.empty((steps, batch, 3 * hidden), d_states.dtype), np.zeros_like(u)
    dh = np.zeros((batch, hidden), d_states.dtype)
    for t in range(steps - 1, -1, -1):
        h, z, r, n, gn = kept[t]
        dh = (dh + d_states[t]) * mask[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dn], axis=1)
        dg = np.concatenate([dz, dr, dn * r], axis=1)
        du += h.T @ dg
        dh = dh * z + dg @ u.T
    return dx, du


def project_all(params, features_, some: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """The projections of a whole vocabulary, `some` words at a time."""
    number = len(features_[0])
    parts = [
        project(params, embed(params, *subset(features_, np.arange(i, min(i + some, number)))))
        for i in range(0, max(1, number), some)
    ]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def project(params, vectors) -> tuple[np.ndarray, np.ndarray]:
    return vectors @ params["wf"] + params["cf"], vectors @ params["wb"] + params["cb"]


def forward(params, projected, ids, keep=False):
    """Logits of windows. ids: (B, T) rows of the projected vocabulary, -1 where a window has ended."""
    steps = ids.T
    mask = (steps >= 0).astype(np.float32)[:, :, None]
    forth, kept_f = _gru(projected[0][steps], params["uf"], mask, keep)
    back, kept_b = _gru(projected[1][steps[::-1]], params["ub"], mask[::-1], keep)
    states = np.concatenate([forth, back[::-1]], axis=2)
    hidden = np.tanh(states @ params["wa"])
    energy = np.where(mask[:, :, 0] > 0, hidden @ params["va"], -1e9)
    weight = np.exp(energy - energy.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = (weight[:, :, None] * states).sum(axis=0)
    logit = pooled @ params["out"] + params["bias"][0]
    return logit, (mask, kept_f, kept_b, states, hidden, weight, pooled) if keep else None


def gradients(params, vectors, features_, ids, d_logit, cache) -> dict[str, np.ndarray]:
    """Gradients of all parameters, given those of the logits; of the tables as (rows, values)."""
    mask, kept_f, kept_b, states, hidden, weight, pooled = cache
    size = params["uf"].shape[0]
    grad = {"out": pooled.T @ d_logit, "bias": np.array([d_logit.sum()], np.float32)}
    d_pooled = d_logit[:, None] * params["out"]
    d_weight = (states * d_pooled).sum(axis=2)
    d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
    grad["va"] = np.einsum("tba,tb->a", hidden, d_energy)
    d_hidden = d_energy[:, :, None] * params["va"] * (1 - hidden * hidden)
    grad["wa"] = np.einsum("tbh,tba->ha", states, d_hidden)
    d_states = weight[:, :, None] * d_pooled + d_hidden @ params["wa"].T
    dx_f, grad["uf"] = _gru_back(d_states[:, :, :size], kept_f, params["uf"], mask)
    dx_b, grad["ub"] = _gru_back(d_states[::-1, :, size:], kept_b, params["ub"], mask[::-1])
    steps, d_vectors = ids.T, np.zeros_like(vectors)
    for side, dx, at in (("f", dx_f, steps), ("b", dx_b, steps[::-1])):
        used = at >= 0
        rows, d = at[used], dx[used]
        grad[f"w{side}"], grad[f"c{side}"] = vectors[rows].T @ d, d.sum(axis=0)
        at, values = _by_row(rows + 1, d @ params[f"w{side}"].T)
        d_vectors[at - 1] += values
    words, grams, begins = features_
    counts = np.diff(np.concatenate([begins, [len(grams)]]))
    grad["word"] = _by_row(words, d_vectors)
    grad["char"] = _by_row(grams, np.repeat(d_vectors / counts[:, None], counts, axis=0))
    return grad


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the rows of a table that were used, without row 0."""
    rows, values = rows[rows > 0], values[rows > 0]
    if not len(rows):
        return rows, values
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[first], np.add.reduceat(values[order], first, axis=0)


class Adam:
    """`rate` by parameter; those not named have `other`."""

    def __init__(self, params, other=0.01, **rate):
        self.rates, self.step = {k: rate.get(k, other) for k in params}, 0
        self.first = {k: np.zeros_like(v) for k, v in params.items()}
        self.second = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, params, grad):
        self.step += 1
        scale = (1 - 0.999**self.step) ** 0.5 / (1 - 0.9**self.step)
        for k, g in grad.items():
            at, g = g if isinstance(g, tuple) else (slice(None), g)
            g = g.astype(np.float32)
            self.first[k][at] += 0.1 * (g - self.first[k][at])
            self.second[k][at] += 0.001 * (g * g - self.second[k][at])
            params[k][at] -= scale * self.rates[k] * self.first[k][at] / (np.sqrt(self.second[k][at]) + 1e-8)
