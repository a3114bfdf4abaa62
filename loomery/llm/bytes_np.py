"""Bulk word and n-gram hashing over UTF-8 bytes (numpy over Arrow string columns)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; a longer text is one chunk.
CHUNK = 1_000_000
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
#: Bytes to lower case, A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space and ASCII punctuation; bytes from 128 on belong to letters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_P = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    with np.errstate(over="ignore"):
        out = x >> np.uint64(30)
        out ^= x
        out *= np.uint64(0xBF58476D1CE4E5B9)
        t = out >> np.uint64(27)
        out ^= t
        out *= np.uint64(0x94D049BB133111EB)
        np.right_shift(out, np.uint64(31), out=t)
        out ^= t
        return out


_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
#: A second, independent modulus (2**31 - 1): no string has equal hashes by the structure of 2**64 alone.
_Q, _R = (1 << 31) - 1, 0x2545F491
_VALUES_Q = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) % np.uint64(_Q)
_powers: list[np.ndarray] = []


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for x below 2**62."""
    q, bits = np.uint64(_Q), np.uint64(31)
    x = (x & q) + (x >> bits)
    x = (x & q) + (x >> bits)
    return np.where(x >= q, x - q, x)


def _powers_mod(base: int, size: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < size:
        out = np.concatenate([out, _mod(out * np.uint64(pow(base, len(out), _Q)))])
    return out[:size]


def powers(n: int) -> list[np.ndarray]:
    """P**i and P**-i modulo 2**64, R**i and R**-i modulo Q, for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        with np.errstate(over="ignore"):
            up, down = np.full(size, _P, np.uint64), np.full(size, pow(_P, -1, 2**64), np.uint64)
            up[0] = down[0] = 1
            _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down), _powers_mod(_R, size), _powers_mod(pow(_R, -1, _Q), size)]
    return [x[:n] for x in _powers]


class Sums:
    """Prefix sums of ``data``, by both moduli; the second one is made when it is first asked for."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.first = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_VALUES[data] * powers(len(data) + 1)[0][:-1], out=self.first[1:])
        self._second: np.ndarray | None = None

    @property
    def second(self) -> np.ndarray:
        if self._second is None:
            self._second = np.zeros(len(self.data) + 1, np.uint64)
            x = _VALUES_Q[self.data]
            x *= powers(len(self.data) + 1)[2][:-1]
            high = x >> np.uint64(31)
            x &= np.uint64(_Q)
            x += high  # congruent and below 2**32: sums of 2**32 of them fit
            np.cumsum(x, out=self._second[1:])
        return self._second


def prefix_sums(data: np.ndarray) -> Sums:
    """Sums from which ``span_hash`` gets the hash of any span of ``data``."""
    return Sums(data)


def span_order(sums: Sums, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit numbers of data[start:end], a function of the span's bytes; different spans may share one by design of text."""
    down = powers(len(sums.first))[1]
    with np.errstate(over="ignore"):
        return mixed((sums.first[end] - sums.first[start]) * down[start] + (end - start).astype(np.uint64))


def every_span(sums: Sums, length: int) -> np.ndarray:
    """``span_order`` of every span of ``length`` bytes."""
    n = max(0, len(sums.first) - length)
    with np.errstate(over="ignore"):
        h = sums.first[length:] - sums.first[:n]
        h *= powers(len(sums.first))[1][:n]
        h += np.uint64(length)
    return mixed(h)


def span_hash(sums: Sums, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], a function of the span's bytes alone, by two independent moduli."""
    down = powers(len(sums.first))[3]
    second = _mod(_mod(sums.second[end] - sums.second[start]) * down[start])
    with np.errstate(over="ignore"):
        return mixed(span_order(sums, start, end) + (second + np.uint64(1)) * np.uint64(_P))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null rows are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pa.compute.fill_null(column, b"")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offs


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) over a column, about CHUNK bytes at a time."""
    data, offs = column_bytes(column)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + CHUNK, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def word_spans(data: np.ndarray, offs: np.ndarray, stop: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row and the end): runs of bytes that ``stop`` does not mark, within rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~stop[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes, for every start that has them."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            out += words[k : len(words) - n + 1 + k] * np.uint64(pow(_P, k + 1, 2**64))
    return mixed(out)
