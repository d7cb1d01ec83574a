"""A bidirectional FM-index over a delimited vocabulary, searched for many words at once.

The text is every word between delimiters, words in order; a second index holds the reversed words. A pattern is a range of
suffix ranks in each: prepending a letter in one index narrows its range, and the letters smaller than it in that range move
the other one's. Ranks come from a wavelet matrix over the Burrows-Wheeler transform, so all steps are array
operations over many patterns.
"""

from __future__ import annotations

import numpy as np

DELIMITER = 0
#: words that are searched for in one go, which bounds the memory of a search
QUERIES_AT_ONCE = 4096


def _suffix_ranks(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling.

    Words are distinct and in order, so delimiters compare by their place, the last one being the least; no comparison goes
    beyond a delimiter, and the rounds are the binary logarithm of the longest word.
    """
    size = len(text)
    rank = text.astype(np.int64) + len(ends)
    rank[ends[:-1]] = np.arange(1, len(ends))
    rank[ends[-1]] = 0
    width = 1
    while True:
        key = rank * (size + len(ends) + 1 + int(text.max()))
        key[:-width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        steps = np.empty(size, dtype=np.int64)
        steps[0] = 0
        np.cumsum(np.diff(key[order]) != 0, out=steps[1:])
        rank = np.empty(size, dtype=np.int64)
        rank[order] = steps
        if steps[-1] == size - 1:
            return order
        width *= 2
        if width >= size:
            raise ValueError("words must be distinct")


class Ranks:
    """One direction: suffix ranks of a text of words, whose letters are numbers from 1."""

    def __init__(self, words: list[np.ndarray], n_letters: int):
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths + 1)])
        text = np.zeros(ends[-1] + 1, dtype=np.int32)
        inside = np.ones(len(text), dtype=bool)
        inside[ends] = False
        text[inside] = np.concatenate(words)
        suffixes = _suffix_ranks(text, ends)
        self.size = len(text)
        #: of each rank that starts with a delimiter: the number of the word behind it
        self.word_of = np.searchsorted(ends, suffixes[: len(ends)])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_letters + 1))])
        row = text[suffixes - 1]
        self.bits = max(1, int(n_letters).bit_length())
        self.ones, self.zeros = [], []
        start = np.zeros(n_letters + 1, dtype=np.int64)
        letters = np.arange(n_letters + 1)
        for level in reversed(range(self.bits)):
            bit = (row >> level) & 1
            ones = np.zeros(self.size + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = int(self.size - ones[-1])
            self.ones.append(ones)
            self.zeros.append(zeros)
            start = np.where((letters >> level) & 1, zeros + ones[start], start - ones[start])
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        #: from where a letter ends up in the last level to its first suffix rank
        self.shift = self.first[:-1] - start

    def step(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of the patterns with the letters prepended."""
        for level, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros):
            bit = (letter >> level) & 1
            a, b = ones[low], ones[high]
            low = np.where(bit, zeros + a, low - a)
            high = np.where(bit, zeros + b, high - b)
        shift = self.shift[letter]
        return low + shift, high + shift

    def smaller(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many suffixes of each range have a smaller letter than the given one before them."""
        found = np.zeros(len(low), dtype=np.int64)
        for level, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros):
            bit = (letter >> level) & 1
            a, b = ones[low], ones[high]
            found += np.where(bit, (high - b) - (low - a), 0)
            low = np.where(bit, zeros + a, low - a)
            high = np.where(bit, zeros + b, high - b)
        return found

    def letters(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All letters that stand before a range's suffixes: (number of the range, letter, its new range)."""
        at, letter = np.arange(len(low)), np.zeros(len(low), dtype=np.int64)
        for level, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros):
            a, b = ones[low], ones[high]
            left, right = np.flatnonzero(high - b > low - a), np.flatnonzero(b > a)
            at = np.concatenate([at[left], at[right]])
            letter = np.concatenate([letter[left], letter[right] + (1 << level)])
            low, high = (
                np.concatenate([low[left] - a[left], zeros + a[right]]), np.concatenate([high[left] - b[left], zeros + b[right]])
            )
        shift = self.shift[letter]
        return at, letter, low + shift, high + shift


class Index:
    """Both directions over distinct words. `find` returns the words at one error from each query."""

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        points = [np.frombuffer(w.encode("utf-32-le"), dtype=np.uint32) for w in self.words]
        self.alphabet = np.unique(np.concatenate(points)) if points else np.zeros(0, dtype=np.uint32)
        coded = [self._coded(p) for p in points]
        mirrored = sorted(range(len(coded)), key=lambda i: self.words[i][::-1])
        self.places = (np.arange(len(coded)), np.array(mirrored, dtype=np.int64))
        if coded:
            self.forward = Ranks(coded, len(self.alphabet))
            self.backward = Ranks([coded[i][::-1] for i in mirrored], len(self.alphabet))

    def _coded(self, points: np.ndarray) -> np.ndarray:
        """Numbers of code points from 1; those that no word has share the number -1."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, -1).astype(np.int64)

    def find(self, queries: list[str], prefix: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of all pairs at exactly one inserted, deleted or replaced code point, where the query's first
        half (with `prefix`) or its second half is also the word's. Each pair comes once."""
        if not self.words:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        found = [
            (q + start, w)
            for start in range(0, len(queries), QUERIES_AT_ONCE)
            for q, w in [self._find(queries[start : start + QUERIES_AT_ONCE], prefix)]
        ]
        return tuple(np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in zip(*found)) if found else (
            np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))

    def _find(self, queries: list[str], prefix: bool) -> tuple[np.ndarray, np.ndarray]:
        # the exact half is matched from the middle outwards in one index, then the other half from the middle outwards in the
        # other one; for a prefix that is leftwards in the forward index, then rightwards in the backward one
        outer, inner = (self.forward, self.backward) if prefix else (self.backward, self.forward)
        place = self.places[1 if prefix else 0]
        lengths = np.array([len(q) for q in queries], dtype=np.int64)
        halves = lengths // 2
        exact_size, free_size = (halves, lengths - halves) if prefix else (lengths - halves, halves)
        grid = np.zeros((len(queries), int(lengths.max()) + 2), dtype=np.int64)
        flat = self._coded(np.frombuffer("".join(queries).encode("utf-32-le"), dtype=np.uint32))
        grid[np.arange(grid.shape[1])[None, :] < lengths[:, None]] = flat
        if not prefix:  # mirrored, so that the exact half comes first
            back = lengths[:, None] - 1 - np.arange(grid.shape[1])[None, :]
            grid = np.where(back >= 0, np.take_along_axis(grid, np.maximum(back, 0), axis=1), DELIMITER)

        query = np.arange(len(queries))
        low, size, other = (np.full(len(queries), v, dtype=np.int64) for v in (0, outer.size, 0))
        for done in range(int(exact_size.max()) + 1):
            open_ = np.flatnonzero((done <= exact_size) & (size > 0))
            if not len(open_):
                break
            left = exact_size[open_] - 1 - done
            letter = np.where(left >= 0, grid[query[open_], np.maximum(left, 0)], DELIMITER)
            known = letter >= 0
            size[open_[~known]] = 0
            open_, letter = open_[known], letter[known]
            a, b = low[open_], low[open_] + size[open_]
            other[open_] += outer.smaller(letter, a, b)
            low[open_], b = outer.step(letter, a, b)
            size[open_] = b - low[open_]
        alive = np.flatnonzero(size > 0)
        return self._extended(inner, place, grid, exact_size, free_size, alive, other[alive], other[alive] + size[alive])

    @staticmethod
    def _extended(ranks, place, grid, exact_size, free_size, query, low, high):
        """One error in the other half. Of edits with the same outcome one is made: letters of a run are inserted and deleted
        at its end only."""

        def letter_at(q, step):
            return np.where(step < free_size[q], grid[q, np.minimum(exact_size[q] + step, grid.shape[1] - 1)], DELIMITER)

        none = np.zeros(0, dtype=np.int64)
        once = (none, none, none)  # patterns with an error: query, range
        out_query, out_word = [none], [none]
        for step in range(int(free_size.max()) + 1 if len(free_size) else 0):
            if not len(query) and not len(once[0]):
                break
            inside = step < free_size[query]
            expected = letter_at(query, step)
            at, letter, lower, upper = ranks.letters(low, high)
            edit = (letter != DELIMITER) & (letter != expected[at])
            replaced = edit & inside[at]
            last_of_run = inside & (expected != letter_at(query, step + 1))
            here = [np.concatenate([x, y]) for x, y in zip(once, (query[at[edit]], lower[edit], upper[edit]))]
            wanted = letter_at(here[0], step)
            known = wanted >= 0
            here, wanted = [x[known] for x in here], wanted[known]
            here[1], here[2] = ranks.step(wanted, here[1], here[2])
            ended, going = (here[2] > here[1]) & (step >= free_size[here[0]]), (here[2] > here[1]) & (step < free_size[here[0]])
            # a pattern between two delimiters is one word: its range is one rank
            out_query.append(here[0][ended])
            out_word.append(place[ranks.word_of[here[1][ended]]])
            once = tuple(
                np.concatenate([x[going], y[replaced], z[last_of_run]])
                for x, y, z in zip(here, (query[at], lower, upper), (query, low, high))
            )
            same = (letter == expected[at]) & inside[at]
            query, low, high = query[at[same]], lower[same], upper[same]
        return np.concatenate(out_query), np.concatenate(out_word)
