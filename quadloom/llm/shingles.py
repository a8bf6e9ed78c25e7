"""Word shingles as 64-bit hashes, in numpy; used inside Arrow workers."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


class BoundedCache(dict):
    """A dict that fills itself by ``make(key)``; its memory is bounded.

    At ``limit`` entries it starts anew and keeps the entries so far as an older generation, from which those that are
    still in use come back.
    """

    def __init__(self, make, limit: int = 300_000):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


_WORDS = BoundedCache(xxhash.xxh3_64_intdigest, 100_000)


def forget_words() -> None:
    """Free what ``shingle_hashes`` has kept; a worker that is done with a task may be used for other work next."""
    _WORDS.clear()
    _WORDS.older.clear()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` lower-cased, blank-separated words.

    A text of fewer words is one shingle; a text without words (or null) has none.
    """
    tokens = (text or "").lower().split()
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, tokens), np.uint64, n)
    k = min(n, words)
    run = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        run = run * _ODD + h[i : n - k + 1 + i]
    return np.unique(mix64(run))
