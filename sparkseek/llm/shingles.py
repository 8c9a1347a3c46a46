"""Word shingles: sorted distinct 64-bit hashes of runs of words."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORDS = re.compile(r"\w+")
SIZE = 5
_CACHE_LIMIT = 1 << 17


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) > _CACHE_LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_hashes = _Hashes()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Hashes of the text's shingles, sorted and distinct.

    Words are runs of word characters in lower case. A text of fewer words is one
    shingle of all of them; a text without words has none.
    """
    words = WORDS.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(size, len(w))
    out = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i]
    return np.unique(mix64(out))
