"""Elias-Fano coding of non-decreasing integers with select."""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 512  # bits of the high part between two counts
_HEAD = struct.Struct("<QqBQ")  # number of values, smallest value, low bits, bits of the high part


def _pack_low(values: np.ndarray, bits: int) -> bytes:
    if not bits:
        return b""
    shifts = np.arange(bits, dtype=np.uint64)
    return np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def encode(values: np.ndarray) -> bytes:
    """Non-decreasing int64 values as low bits stored plainly and high bits in unary, with counts for select."""
    n = len(values)
    base = int(values[0]) if n else 0
    v = (values.astype(np.int64).view(np.uint64) - np.uint64(base % 2 ** 64)) if n else np.zeros(0, np.uint64)
    top = int(v[-1]) if n else 0
    bits = max(0, (top // n).bit_length() - 1) if n else 0
    high = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n, dtype=np.int64)
    size = int(high[-1]) + 1 if n else 0
    unary = np.zeros(-(-size // BLOCK) * BLOCK, np.uint8)
    unary[high] = 1
    counts = np.concatenate(([0], np.cumsum(unary.reshape(-1, BLOCK).sum(1, dtype=np.int64))))[:-1].astype("<u4")
    return _HEAD.pack(n, base, bits, size) + _pack_low(v & np.uint64((1 << bits) - 1), bits) + np.packbits(unary, bitorder="little").tobytes() + counts.tobytes()


class Sequence:
    """Reads an encoded sequence in place; ``end`` is the position after it."""

    def __init__(self, data: bytes | memoryview, at: int = 0):
        self.n, self.base, self.bits, self.size = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        n_low, n_blocks = -(-self.n * self.bits // 8), -(-self.size // BLOCK)
        self.low = np.frombuffer(data, np.uint8, n_low, at)
        self.high = np.frombuffer(data, np.uint8, n_blocks * BLOCK // 8, at + n_low)
        self.counts = np.frombuffer(data, "<u4", n_blocks, at + n_low + len(self.high))
        self.end = at + n_low + len(self.high) + 4 * n_blocks

    def select(self, i: int) -> int:
        """The i-th value, from one block of the high part and ``bits`` low bits."""
        return int(self.select_many(np.array([i]))[0])

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """The i-th values for an array of numbers: the counts tell each one's block, only these blocks and their low bits are read."""
        if not len(i):
            return np.zeros(0, np.int64)
        block, of = np.unique(np.searchsorted(self.counts, i, side="right") - 1, return_inverse=True)
        bits = np.unpackbits(self.high.reshape(-1, BLOCK // 8)[block], axis=1, bitorder="little")
        ones = np.flatnonzero(bits)
        before = np.concatenate(([0], np.cumsum(bits.sum(1, dtype=np.int64))))[:-1]  # ones of the blocks read, by block
        at = ones[before[of] + (i - self.counts[block[of]].astype(np.int64))]
        v = (block[of] * BLOCK + at % BLOCK - i).astype(np.uint64) << np.uint64(self.bits)
        if self.bits:
            place = i[:, None] * self.bits + np.arange(self.bits)
            low = (self.low[place >> 3] >> (place & 7).astype(np.uint8)) & np.uint8(1)
            v |= (low.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return (v + np.uint64(self.base % 2 ** 64)).view(np.int64)
