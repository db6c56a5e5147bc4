"""Elias-Fano coding of a non-decreasing sequence, with select.

``n`` values below ``u`` take about ``2 + log2(u / n)`` bits each: the low bits stand packed side by side, the high parts are unary
in a bitmap in which value ``i`` is the ``i``-th one. The position of every 512th one is kept, so select reads a bounded stretch for
values that are spread evenly, and no table has 64 bits per value.

Layout, little-endian: n, u, first value (8 bytes each), width of the low bits, width of a sample in bytes (1 byte each), samples,
low bits, bitmap.
"""

from __future__ import annotations

import struct

import numpy as np

HEAD = "<QQqBB"
EVERY = 512


def encode(values: np.ndarray) -> bytes:
    """Bytes of a non-decreasing int64 array, which may be empty and may begin below 0."""
    n = len(values)
    first = int(values[0]) if n else 0
    rel = np.asarray(values).astype(np.uint64) - np.uint64(first & 0xFFFFFFFFFFFFFFFF)
    if n and (np.diff(values) < 0).any():
        raise ValueError("values must not decrease")
    u = int(rel[-1]) + 1 if n else 0
    low = max(0, (u // n).bit_length() - 1) if n else 0
    ones = (rel >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    bits[ones] = 1
    width = 4 if len(bits) < 1 << 32 else 8
    lows = ((rel[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return (struct.pack(HEAD, n, u, first, low, width) + ones[::EVERY].astype(f"<u{width}").tobytes()
            + np.packbits(lows.ravel(), bitorder="little").tobytes() + np.packbits(bits, bitorder="little").tobytes())


class Sequence:
    """Reads a coded sequence without decoding it whole."""

    def __init__(self, data: bytes) -> None:
        self.n, self.u, self.first, self.low, width = struct.unpack_from(HEAD, data)
        at = struct.calcsize(HEAD)
        count = -(-self.n // EVERY)
        self.samples = np.frombuffer(data, f"<u{width}", count, at)
        at += count * width
        size = -(-self.n * self.low // 8)
        self.lows = np.frombuffer(data, np.uint8, size, at)
        self.bits = np.frombuffer(data, np.uint8, -1, at + size)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """Value ``i``."""
        return int(self.range(i, i + 1)[0])

    def range(self, begin: int, end: int) -> np.ndarray:
        """Values ``begin`` to ``end`` (exclusive) as int64."""
        if not 0 <= begin <= end <= self.n:
            raise IndexError(f"{begin}:{end} of {self.n}")
        if begin == end:
            return np.zeros(0, np.int64)
        at = int(self.samples[begin // EVERY])
        stop = int(self.samples[(end - 1) // EVERY + 1]) if (end - 1) // EVERY + 1 < len(self.samples) else len(self.bits) * 8
        ones = np.flatnonzero(np.unpackbits(self.bits[at // 8 : stop // 8 + 1], bitorder="little")) + at // 8 * 8
        ones = ones[np.searchsorted(ones, at) + begin % EVERY :][: end - begin]
        high = (ones - np.arange(begin, end)).astype(np.uint64) << np.uint64(self.low)
        return (high | self._low(begin, end)).astype(np.int64) + self.first

    def _low(self, begin: int, end: int) -> np.ndarray:
        if not self.low:
            return np.zeros(end - begin, np.uint64)
        first = begin * self.low // 8
        bits = np.unpackbits(self.lows[first : -(-end * self.low // 8)], bitorder="little")
        own = bits[begin * self.low - first * 8 :][: (end - begin) * self.low].reshape(-1, self.low).astype(np.uint64)
        return (own << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
