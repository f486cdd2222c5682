"""Word shingle sets as sorted 64-bit hashes.

Words are maximal runs of characters other than \\x20 and \\x09-\\x0D, with A-Z lower-cased: what bytes.lower().split()
gives. A set holds the distinct shingles of k words; a text of fewer words has its whole sequence as its only shingle, and
one without words the empty set. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import xxhash

_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    words = text.encode().lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words."""
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out = out * _MULT + h[i : i + n]
    return mix(out)


def shingle_set(text: str, k: int) -> np.ndarray:
    h = word_hashes(text)
    if not len(h):
        return h
    return np.unique(rolled(h, min(k, len(h))))
