"""Word shingle sets and MinHash signatures, in numpy inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from vigil.llm.words import WordHashes, mix, window_hashes

SHINGLE_WORDS = 5
N_HASHES = 64
_RNG = np.random.default_rng(20240601)
_XOR = _RNG.integers(0, 2 ** 64, N_HASHES, np.uint64)
_MUL = _RNG.integers(0, 2 ** 64, N_HASHES, np.uint64) | np.uint64(1)
_STEP = 4096


def shingle_set(data: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of a text, A-Z lower-cased; a shorter text is one shingle."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    if len(words) < SHINGLE_WORDS:
        return mix(window_hashes(h, len(words)) + np.uint64(len(words)))
    w = np.sort(window_hashes(h, SHINGLE_WORDS))
    return w[np.concatenate(([True], w[1:] != w[:-1]))]


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set, as two signed 64-bit numbers."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def signature(s: np.ndarray) -> bytes:
    """``N_HASHES`` minimum hashes of 16 bits, big-endian, so that byte order is value order.

    Two different minima agree in 16 bits once in 65,536 columns, which next to the similarities looked for is nothing.
    """
    low = np.full(N_HASHES, 2 ** 64 - 1, np.uint64)
    for k in range(0, len(s), _STEP):
        np.minimum(low, (((s[k:k + _STEP, None]) ^ _XOR) * _MUL).min(0), out=low)
    return (low >> np.uint64(48)).astype(">u2").tobytes()


def pack_set(s: np.ndarray) -> bytes:
    """The high 48 bits of each hash; two sets of 20,000 shingles share one by chance once in 700,000 pairs."""
    return s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_set(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(">u8").astype(np.uint64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
