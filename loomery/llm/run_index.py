"""A run-length index of repetitive text: run-compressed Burrows-Wheeler transform with sampled run ends.

``RunIndex`` keeps, for a set of strings, the runs of the transform and the text positions at run starts and ends; the
suffix array is dropped once these are taken. In text order, both the suffix before a suffix in order and the length of
their match (the matching statistics of the text against itself) follow from the samples alone: at the start of a run the
suffix before is the end of the run before, and only there is a match compared; at every other position the suffix before
is the one of the position before, moved on by one symbol, and the match is one symbol shorter. Both are streamed in
stretches of text, so the work beyond sorting is one comparison a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_PACK = 8  # bytes of a first sort key
#: What ends a string: no byte of UTF-8.
END = 0xFF
STREAM = 1 << 20


def packed(t: np.ndarray) -> np.ndarray:
    """The _PACK bytes from each position on as one big-endian integer, zeros after the end."""
    key = np.concatenate([t, np.zeros(_PACK, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        key = (key[:-k] << np.uint64(8 * k)) | key[k:]
    return key[: len(t)]


def suffix_array(t: np.ndarray, key: np.ndarray | None = None) -> np.ndarray:
    """Suffix array of bytes by prefix doubling over the ties; ``key`` is ``packed(t)``."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    kind = np.int32 if n < 2**31 - 1 else np.int64
    key = packed(t) if key is None else key
    sa = np.argsort(key).astype(kind)
    key = key[sa]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    del key
    every = np.arange(n, dtype=kind)
    group = np.maximum.accumulate(np.where(new, every, 0).astype(kind))  # of each row: the first row of its ties
    rank = np.empty(n, kind)
    rank[sa] = group
    h = _PACK
    tied = np.flatnonzero(~(new & np.append(new[1:], True))).astype(kind)
    while len(tied):
        at = sa[tied].astype(np.int64) + h
        second = np.where(at < n, rank[np.minimum(at, n - 1)].astype(np.int64) + 1, 0)
        both = group[tied].astype(np.int64) * (n + 1) + second
        order = np.argsort(both)
        both = both[order]
        moved = sa[tied[order]]
        sa[tied] = moved
        first = np.ones(len(tied), bool)
        first[1:] = both[1:] != both[:-1]
        new[tied[first]] = True
        group[tied] = np.maximum.accumulate(np.where(first, tied, 0).astype(kind))
        rank[moved] = group[tied]
        last = np.append(first[1:], True)
        tied = tied[~(first & last)]
        h *= 2
    return sa


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of 64-bit integers that are not 0."""
    out = np.zeros(len(x), np.int64)
    for k in range(1, _PACK):
        out += x < np.uint64(1 << (8 * (_PACK - k)))
    return out


class RunIndex:
    """Index over strings (uint8 arrays laid end to end, ``ends`` their ends)."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        m = len(ends)
        self.at = np.arange(len(data)) + np.repeat(np.arange(m), np.diff(np.append(0, ends)))  # of each byte, in the text
        text = np.full(len(data) + m, END, np.uint8)
        text[self.at] = data
        self.size = n = len(text)
        key = packed(text)
        rows = suffix_array(text, key)
        before = text[rows - 1].astype(np.int16)
        before[rows == 0] = -1
        head = np.ones(n, bool)
        head[1:] = before[1:] != before[:-1]
        first = np.flatnonzero(head)
        self.run_symbols = before[first]
        self.run_lengths = np.diff(np.append(first, n))
        self.run_starts = rows[first].astype(np.int64)
        self.run_ends = rows[np.append(first[1:], n) - 1].astype(np.int64) if n else self.run_starts
        del rows, before
        # samples in text order: the run starts, the suffix before each, and their match
        order = np.argsort(self.run_starts)
        self.sample = self.run_starts[order]
        prior = np.append(np.int64(-1), self.run_ends[:-1])[: len(order)]
        match = np.zeros(len(order), np.int64)
        match[1:] = self._compare(key, self.run_starts[1:], prior[1:])
        self.prior, self.match = prior[order], match[order]

    def _compare(self, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes a[i] and b[i]."""
        n = self.size
        most = n - np.maximum(a, b)
        out = np.zeros(len(a), np.int64)
        live, k = np.arange(len(a)), 0
        while len(live):
            x = key[a[live] + k] ^ key[b[live] + k]
            differs = x != 0
            done = live[differs]
            out[done] = k + _equal_bytes(x[differs])
            live = live[~differs]
            k += _PACK
            over = most[live] <= k
            out[live[over]] = most[live[over]]
            live = live[~over]
        return np.minimum(out, most)

    def matching_statistics(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first position, lengths of matches, positions matched): each text position with the suffix before it in order."""
        for lo in range(0, self.size, STREAM):
            hi = min(lo + STREAM, self.size)
            a, b = int(np.searchsorted(self.sample, lo, "right")) - 1, int(np.searchsorted(self.sample, hi))
            s = np.repeat(np.arange(a, b), np.diff(np.concatenate([[lo], self.sample[a + 1 : b], [hi]])))
            gone = np.arange(lo, hi) - self.sample[s]
            yield lo, np.maximum(self.match[s] - gone, 0), self.prior[s] + gone

    def least_owner(self, owner: np.ndarray, length: int) -> np.ndarray:
        """For each byte, the least ``owner`` among all places where its next ``length`` bytes are found.

        ``owner`` is by byte; bytes with fewer than ``length`` left in their string get the largest integer. Equal strings
        are neighbours in suffix order, so matches of ``length`` chain them, from one to the one before, to a first one.
        """
        none = np.iinfo(np.int64).max
        root = np.arange(self.size, dtype=np.int32 if self.size < 2**31 else np.int64)
        for lo, match, position in self.matching_statistics():
            long = np.flatnonzero(match >= length)
            root[lo + long] = position[long]
        live = np.flatnonzero(root != np.arange(self.size))
        while len(live):  # every step halves the way to the first
            up = root[live]
            top = root[up]
            root[live] = top
            live = live[top != up]
        own = np.full(self.size, none, np.int64)
        own[self.at] = owner
        least = own.copy()
        chained = np.flatnonzero(root != np.arange(self.size))
        np.minimum.at(least, root[chained], own[chained])
        return np.where(owner == none, none, least[root[self.at]])
