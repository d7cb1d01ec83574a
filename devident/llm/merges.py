"""The merges of a byte-pair model, applied to many words at once.

A part of a word starts as its characters, the last one marked. In every round each part merges its leftmost pair of the
least rank; parts without a pair that can merge are done. Rounds are array operations over all parts of a size class.
"""

from __future__ import annotations

import json

import numpy as np

#: parts beyond this length are left to the tokenizer itself, since rounds grow with the longest part
LONGEST = 48
_NEVER = np.iinfo(np.int32).max


class Merges:
    """Ids of parts, for a model without fallbacks. `fits` tells whether a tokenizer's model is one."""

    @staticmethod
    def fits(model: dict) -> bool:
        plain = ("dropout", "unk_token", "continuing_subword_prefix")
        return (
            model["type"] == "BPE" and not any(model.get(k) for k in plain) and bool(model.get("end_of_word_suffix"))
            and not any(model.get(k) for k in ("fuse_unk", "byte_fallback", "ignore_merges"))
        )

    def __init__(self, model: dict):
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max(vocabulary.values()) + 1
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        points = range(1 << 10)
        self.inner = np.array([vocabulary.get(chr(c), -1) for c in points], dtype=np.int64)
        self.last = np.array([vocabulary.get(chr(c) + suffix, -1) for c in points], dtype=np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], _NEVER)

    def ids(self, parts: list[str]) -> list[bytes | None]:
        """The ids of each part as little-endian unsigned 32-bit numbers; None for parts that are too long or not in the alphabet."""
        out: list[bytes | None] = [None] * len(parts)
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        for width in (4, 8, 12, 16, 24, LONGEST):
            some = np.flatnonzero((lengths <= width) & (lengths > 0))
            if len(some):
                self._same_width([parts[i] for i in some], some, lengths[some], out)
                lengths[some] = 0
        return out

    def _same_width(self, parts: list[str], places: np.ndarray, lengths: np.ndarray, out: list) -> None:
        width = int(lengths.max())
        column = np.arange(width)
        inside = column[None, :] < lengths[:, None]
        points = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)
        symbols = np.full((len(parts), width), -1, dtype=np.int64)
        symbols[inside] = self.inner[np.minimum(points, len(self.inner) - 1)]
        ends = points[np.cumsum(lengths) - 1]
        symbols[np.arange(len(parts)), lengths - 1] = self.last[np.minimum(ends, len(self.last) - 1)]
        known = ((symbols >= 0) | ~inside).all(axis=1) & (np.maximum.reduceat(points, np.cumsum(lengths) - lengths) < len(self.inner))
        final, left = symbols.copy(), lengths.copy()
        rows = np.flatnonzero(known)
        symbols = symbols[rows]
        ranks = np.full((len(rows), width), _NEVER, dtype=np.int32)
        ranks[:, :-1] = self._rank(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            going = least < _NEVER
            final[rows[~going]] = symbols[~going]
            rows, symbols, ranks, at, least = rows[going], symbols[going], ranks[going], at[going], least[going]
            if not len(rows):
                break
            line = np.arange(len(rows))
            # the pair becomes one symbol and what stands behind moves up
            from_ = np.minimum(column[None, :] + (column[None, :] > at[:, None]), width - 1)
            symbols, ranks = np.take_along_axis(symbols, from_, axis=1), np.take_along_axis(ranks, from_, axis=1)
            symbols[:, -1], ranks[:, -1] = -1, _NEVER
            symbols[line, at] = self.merged[least]
            left[rows] -= 1
            after = symbols[line, np.minimum(at + 1, width - 1)]
            ranks[line, at] = np.where(at + 1 < width, self._rank(symbols[line, at], after), _NEVER)
            has_before = np.flatnonzero(at > 0)
            before = at[has_before] - 1
            ranks[has_before, before] = self._rank(symbols[has_before, before], symbols[has_before, at[has_before]])
        packed = final[column[None, :] < left[:, None]].astype("<u4").tobytes()
        stops = (4 * np.cumsum(left)).tolist()
        start = 0
        for place, stop, is_known in zip(places.tolist(), stops, known.tolist()):
            if is_known:
                out[place] = packed[start:stop]
            start = stop


def of_tokenizer(tokenizer) -> Merges | None:
    """The merges of a tokenizer's model, None if it works otherwise."""
    model = json.loads(tokenizer.to_str())["model"]
    return Merges(model) if Merges.fits(model) else None
