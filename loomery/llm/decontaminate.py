"""Benchmark decontamination: rare n-gram seeds propose passages, Smith-Waterman alignment scores them.

Words are runs of letters and digits, lower case for A-Z. The score of a document and an item is the best local
alignment of their words as a share of a verbatim copy's, so it tells copies with replaced, missing or extra words from
chance hits; from MIN_SCORE on it is reported.

Seeds lose no such alignment. A seed of an item is a pair of its words next to each other or with one word between; a
document has it if the two words stand so in the document. An alignment that scores enough matches m words of the item
at a cost of at most 2 * m - 2 * MIN_SCORE * L (L words of the item). Two consecutive matches that are no common seed
cost 2 or more, so at least MIN_SCORE * L - 1 seeds are common, on at most 2 * L words of the document. Of those that
many most frequent seeds of an item (counted over all documents) can be left out that half of the necessary number
remains: the rare seeds propose a window only where that half meets, and the whole number is asked for before a window
is aligned.

Benchmark items are dealt over blocks of bounded bytes; a block's seeds go to all tasks, documents never move. One
block is the usual case; each more is two more scans.

Defined cases: null and empty texts match nothing, items without words too; an item under MIN_ITEM_WORDS words is found
where it is all the words of a document; items of equal text match alike; a document's null id stays null; one row per
(document row, item), its best alignment, ties by the first; columns of the documents are passed through by ``clean``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import bytes_np as bn

GAPS = (1, 2)
MIN_ITEM_WORDS = 5
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5
#: Bytes of benchmark text whose seeds are broadcast at a time.
BLOCK_BYTES = 2_000_000
SCHEMA = "doc_id long, item_id long, score double, start_word long, end_word long"


def pairs(words: np.ndarray, row: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the first word) of all pairs of words that GAPS allow, within rows."""
    found, places = [], []
    for g in GAPS:
        with np.errstate(over="ignore"):
            h = bn.mixed(words[:-g] * np.uint64(0x9E3779B97F4A7C15) + words[g:] * np.uint64(0xC2B2AE3D27D4EB4F))
        at = np.arange(len(h)) if row is None else np.flatnonzero(row[:-g] == row[g:])
        found.append(h[at])
        places.append(at)
    return np.concatenate(found), np.concatenate(places)


class Seeds:
    """Seeds of a block of items: sorted distinct hashes, each with the items that have it; rare ones propose."""

    def __init__(self, ids: list, words: list[np.ndarray]):
        self.ids, self.words = ids, words
        self.size = np.array([len(w) for w in words], np.int64)
        self.whole: dict[bytes, list[int]] = {}
        for k, w in enumerate(words):
            if 0 < len(w) < MIN_ITEM_WORDS:
                self.whole.setdefault(w.tobytes(), []).append(k)
        long = [k for k, w in enumerate(words) if len(w) >= MIN_ITEM_WORDS]
        self.pairs = {k: pairs(words[k])[0] for k in long}
        h = np.concatenate([self.pairs[k] for k in long]) if long else np.zeros(0, np.uint64)
        self.hashes, back = np.unique(h, return_inverse=True)
        self.seed, self.item = back, np.repeat(np.array(long, np.int64), [len(self.pairs[k]) for k in long])
        #: Seeds that an alignment has in common, and how many of them are rare.
        self.common = np.maximum(np.ceil(MIN_SCORE * self.size).astype(np.int64) - 1, 1)
        self.rare = np.maximum((self.common + 1) // 2, np.minimum(self.common, 2))
        bits = max(16, int(16 * len(self.hashes)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[(self.hashes & self.mask).astype(np.int64)] = True
        self.select(np.zeros(len(self.hashes), np.int64))

    def select(self, frequency: np.ndarray) -> None:
        """Leave each item's most frequent seeds out, as many as may be."""
        order = np.lexsort((self.seed, -frequency[self.seed], self.item))
        first = np.searchsorted(self.item[order], self.item[order], "left")
        keep = np.empty(len(order), bool)
        keep[order] = np.arange(len(order)) - first >= (self.common - self.rare)[self.item[order]]
        seed, item = self.seed[keep], self.item[keep]
        once = np.unique(seed * max(1, len(self.ids)) + item)  # a pair that an item repeats is one
        self.items_of = once % max(1, len(self.ids))
        self.first = np.searchsorted(once // max(1, len(self.ids)), np.arange(len(self.hashes) + 1))

    def hits(self, words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``words``, index in ``hashes``) of every seed found."""
        h, at = pairs(words, row)
        some = np.flatnonzero(self.maybe[(h & self.mask).astype(np.int64)])
        h, at = h[some], at[some]
        k = np.searchsorted(self.hashes, h)
        ok = k < len(self.hashes)
        ok[ok] = self.hashes[k[ok]] == h[ok]
        return at[ok], k[ok]


def item_words(text: str | None) -> np.ndarray:
    data = bn.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    s, e, _ = bn.word_spans(data, np.array([0, len(data)]), bn.NOT_ALNUM)
    return bn.span_hash(bn.prefix_sums(data), s, e) if len(s) else np.zeros(0, np.uint64)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of two word sequences, and the end of that alignment in ``passage``."""
    cols = np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        step = np.where(passage == w, MATCH, MISMATCH)
        new = np.maximum(row + GAP, 0)
        np.maximum(new[1:], row[:-1] + step, out=new[1:])
        # a gap in the item: carry the best of all cells to the left, less GAP a column
        new = np.maximum.accumulate(new - GAP * cols) + GAP * cols
        k = int(new.argmax())
        if new[k] > best:
            best, end = int(new[k]), k
        row = new
    return best, end


def _windows(at: np.ndarray, least: int, size: int) -> Iterator[tuple[int, int]]:
    """Stretches with ``least`` of the ascending places ``at`` on 2 * size words, with room for an alignment about them."""
    if len(at) < least:
        return
    ok = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] < 2 * size)
    lo, hi = at[ok] - 2 * size, at[ok + least - 1] + 2 * size + 1
    begin = None
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        if begin is None:
            begin, end = a, b
        elif a < end:
            end = b
        else:
            yield begin, end
            begin, end = a, b
    if begin is not None:
        yield begin, end


def _best(item: int, seeds: Seeds, words: np.ndarray, at: np.ndarray) -> tuple[float, int, int]:
    """(score, first word, end word) of the best alignment of an item about its rare seeds at the places ``at``."""
    w, found = seeds.words[item], (0.0, 0, 0)
    for lo, hi in _windows(at, int(seeds.rare[item]), len(w)):
        lo = max(lo, 0)
        h, place = pairs(words[lo:hi])
        both = np.unique(place[np.isin(h, seeds.pairs[item])])
        for a, b in _windows(both, int(seeds.common[item]), len(w)):
            a, b = lo + max(a, 0), min(lo + b, len(words))
            score, end = align(w, words[a:b])
            share = score / (MATCH * len(w))
            if share > found[0]:
                back = align(w[::-1], words[a : a + end][::-1])[1]
                found = (share, a + end - back, a + end)
    return found


def matches(words: np.ndarray, first: np.ndarray, seeds: Seeds) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, end word) for every row and item that align; row k is words[first[k] : first[k + 1]]."""
    if seeds.whole:
        for k in np.flatnonzero(np.diff(first) < MIN_ITEM_WORDS).tolist():
            for item in seeds.whole.get(words[first[k] : first[k + 1]].tobytes(), ()):
                yield k, item, 1.0, 0, int(first[k + 1] - first[k])
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at, k = seeds.hits(words, row)
    count = seeds.first[k + 1] - seeds.first[k]
    spot = np.repeat(seeds.first[k] - np.cumsum(count) + count, count) + np.arange(count.sum())
    at, item = np.repeat(at, count), seeds.items_of[spot]
    pair = row[at] * max(1, len(seeds.ids)) + item
    order = np.lexsort((at, pair))
    at, item, pair = at[order], item[order], pair[order]
    ahead = np.arange(len(at)) + seeds.rare[item] - 1
    ok = ahead < len(at)
    ok[ok] = (pair[ahead[ok]] == pair[ok]) & (at[ahead[ok]] - at[ok] < 2 * seeds.size[item[ok]])
    for p in np.unique(pair[ok]):
        lo, hi = np.searchsorted(pair, [p, p + 1])
        r, i = int(row[at[lo]]), int(item[lo])
        a, b = int(first[r]), int(first[r + 1])
        share, begin, end = _best(i, seeds, words[a:b], at[lo:hi] - a)
        if share >= MIN_SCORE:
            yield r, i, share, begin, end


def document_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, first word of each row and the end) for stretches of rows of a text column."""
    for a, _, data, offs in bn.chunks(column):
        data = bn.LOWER[data]
        s, e, first = bn.word_spans(data, offs, bn.NOT_ALNUM)
        yield a, bn.span_hash(bn.prefix_sums(data), s, e), first


def _find(b: pa.RecordBatch, seeds: Seeds) -> pa.RecordBatch:
    rows = [(a + m[0], *m[1:]) for a, w, first in document_words(b.column("text")) for m in matches(w, first, seeds)]
    ids = b.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
    columns = [
        ids,
        pa.array([seeds.ids[r[1]] for r in rows], pa.int64()),
        pa.array([r[2] for r in rows], pa.float64()),
        pa.array([r[3] for r in rows], pa.int64()),
        pa.array([r[4] for r in rows], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "start_word", "end_word"])


def _clean(b: pa.RecordBatch, seeds: Seeds) -> pa.RecordBatch:
    keep = np.ones(b.num_rows, bool)
    for a, w, first in document_words(b.column("text")):
        keep[[a + m[0] for m in matches(w, first, seeds)]] = False
    return b.filter(pa.array(keep))


def _frequencies(docs: DataFrame, seeds: Seeds) -> np.ndarray:
    """The number of documents of each seed, over all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = sent.value
        count = np.zeros(len(seeds.hashes), np.int64)
        for b in batches:
            for _, w, first in document_words(b.column("text")):
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                at, k = seeds.hits(w, row)
                once = np.unique(row[at] * len(count) + k) if len(at) else at
                count += np.bincount(once % max(1, len(count)), minlength=len(count))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["seed", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "seed long, n long")
    out = np.zeros(len(seeds.hashes), np.int64)
    for r in rows.groupBy("seed").agg(F.sum("n").alias("n")).toLocalIterator():  # a row for each seed of the block
        out[r.seed] = r.n
    return out


def seed_blocks(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """Broadcast seeds of each block of benchmark items."""
    spark: SparkSession = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for k in range(n):
        block = items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k) if n > 1 else items
        rows = sorted(block.collect(), key=lambda r: (r.item_id is None, r.item_id, r.text or ""))  # about BLOCK_BYTES
        seeds = Seeds([r.item_id for r in rows], [item_words(r.text) for r in rows])
        if len(seeds.hashes):
            seeds.select(_frequencies(docs, seeds))
        yield spark.sparkContext.broadcast(seeds)


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word for every document and item that align."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for sent in seed_blocks(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _find(b, sent.value)

        part = rows.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that align with a benchmark item."""
    out = docs
    for sent in seed_blocks(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _clean(b, sent.value)

        out = out.mapInArrow(run, docs.schema)
    return out
