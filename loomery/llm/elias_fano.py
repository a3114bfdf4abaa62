"""Elias-Fano coding of non-decreasing integers, with select samples.

Layout, little-endian: count (8 bytes), smallest value (8), low-bit width (1), number of high bits (8), then the packed
low bits, the high bits in unary and a sample table of 32-bit distances: the position, in the high bits, of every
SAMPLE-th one relative to the expected position ``k * SAMPLE * (bits / count)`` rounded down. That is about
``2 + log2(range / count)`` bits a value; there is no table of 64-bit offsets.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
HEAD = struct.Struct("<QqBQ")
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode(values: np.ndarray) -> bytes:
    """Bytes of a non-decreasing int64 array."""
    v = np.asarray(values, np.int64)
    n = len(v)
    if n == 0:
        return HEAD.pack(0, 0, 0, 0)
    if (v[1:] < v[:-1]).any():
        raise ValueError("values must not decrease")
    least = int(v[0])
    x = (v - least).astype(np.uint64)
    span = int(x[-1]) + 1
    width = max(0, (span // n).bit_length() - 1)
    high = (x >> np.uint64(width)).astype(np.int64) + np.arange(n)
    n_bits = int(high[-1]) + 1
    bits = np.zeros(n_bits, np.uint8)
    bits[high] = 1
    low = b""
    if width:
        planes = (x[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()
    k = np.arange(0, n, SAMPLE)
    samples = (high[k] - k * n_bits // n).astype("<i4")
    return HEAD.pack(n, least, width, n_bits) + low + np.packbits(bits, bitorder="little").tobytes() + samples.tobytes()


class EliasFano:
    """Reads an encoded sequence: ``seq[i]`` by select, ``seq.slice(a, b)`` for a run of values."""

    def __init__(self, data: bytes):
        self.n, self.least, self.width, self.n_bits = HEAD.unpack_from(data)
        at = HEAD.size
        size = (self.n * self.width + 7) // 8
        self.low = np.frombuffer(data, np.uint8, size, at)
        at += size
        size = (self.n_bits + 7) // 8
        self.high = np.frombuffer(data, np.uint8, size, at)
        at += size
        self.samples = np.frombuffer(data, "<i4", -(-self.n // SAMPLE), at)
        self.size = at + 4 * len(self.samples)

    def __len__(self) -> int:
        return self.n

    def _select(self, i: int) -> int:
        """Position of the i-th one of the high bits, from the sample at or before it."""
        k = i // SAMPLE
        at = int(self.samples[k]) + k * SAMPLE * self.n_bits // self.n
        left = i - k * SAMPLE
        byte, bit = at // 8, at % 8
        first = int(self.high[byte]) >> bit << bit
        count = bin(first).count("1")
        while left >= count:
            left -= count
            byte += 1
            first = int(self.high[byte])
            count = int(ONES[first])
        for b in range(8):
            if first >> b & 1:
                if not left:
                    return byte * 8 + b
                left -= 1
        raise AssertionError

    def _low(self, a: int, b: int) -> np.ndarray:
        if not self.width:
            return np.zeros(b - a, np.int64)
        first, last = a * self.width, b * self.width
        bits = np.unpackbits(self.low[first // 8 : (last + 7) // 8], bitorder="little")
        bits = bits[first - first // 8 * 8 :][: last - first].reshape(b - a, self.width)
        return bits.astype(np.int64) @ (np.int64(1) << np.arange(self.width, dtype=np.int64))

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return self.least + (self._select(i) - i << self.width) + int(self._low(i, i + 1)[0])

    def slice(self, a: int, b: int) -> np.ndarray:
        """Values a..b-1."""
        if a >= b:
            return np.zeros(0, np.int64)
        first, last = self._select(a), self._select(b - 1)
        bits = np.unpackbits(self.high[first // 8 : last // 8 + 1], bitorder="little")
        ones = np.flatnonzero(bits) + first // 8 * 8
        ones = ones[(ones >= first) & (ones <= last)]
        return self.least + (ones - np.arange(a, b) << self.width) + self._low(a, b)
