"""Word hashes for numpy work inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from vigil.llm.worker import keep

MAX_CACHED = 400_000


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, kept between documents of a task; emptied when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= MAX_CACHED:
            self.clear()
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes() -> WordHashes:
    """The worker process's table."""
    return keep("word hashes", WordHashes)


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that sums of scaled hashes spread over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every window of ``n`` words (none if there are fewer words)."""
    if len(h) < n:
        return h[:0]
    acc = h[:len(h) - n + 1].copy()
    for k in range(1, n):
        acc = acc * MULTIPLIER + h[k:len(h) - n + 1 + k]
    return mix(acc)
