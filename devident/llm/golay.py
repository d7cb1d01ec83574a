"""The binary Golay code (23, 12, 7) as a fuzzy hash of 23-bit words.

The code is perfect: every word lies within 3 bits of one codeword. The keys of a word are all
codewords within 4 bits of it: one codeword if the nearest is within 2 bits, else six, the nearest
and the five weight-7 neighbours that the Steiner system S(4, 7, 23) gives. Words that differ in at
most 2 bits always share a key.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

BITS = 23
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101
#: most keys of a word
KEYS = 6


def _remainder(word: np.ndarray) -> np.ndarray:
    rest = word.astype(np.int64)
    for bit in range(BITS - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@lru_cache(maxsize=1)
def _steps() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the steps from a word to its keys' codewords (unused places repeat the first), and their number."""
    info = np.arange(1 << 12, dtype=np.int64) << 11
    codewords = info | _remainder(info)
    heavy = codewords[np.bitwise_count(codewords) == 7]
    steps, count = np.zeros((1 << 11, KEYS), dtype=np.int64), np.ones(1 << 11, dtype=np.int64)
    for weight in range(4):
        for places in combinations(range(BITS), weight):
            error = sum(1 << p for p in places)
            at = int(_remainder(np.array([error]))[0])
            steps[at] = error
            if weight == 3:
                steps[at, 1:] = error ^ heavy[(heavy & error) == error]
                count[at] = KEYS
    return steps, count


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 12-bit indices of each word's keys, (n, 6), and a mask of the places in use."""
    steps, count = _steps()
    words = words.astype(np.int64)
    at = _remainder(words)
    return (words[:, None] ^ steps[at]) >> 11, np.arange(KEYS) < count[at][:, None]
