"""Conflict-constrained best-fit packing of documents into fixed-size training sequences.

A document's length is its number of words plus one separator. Documents longer than a bin are cut into full bins and
a rest. Pieces are packed longest first, by best fit: open bins are ordered by residual, and the search runs upwards
from the tightest bin that is large enough until one carries neither the piece's source nor its duplicate cluster.
Both are bitmaps in the bin. So a bin never holds two pieces of one source or two copies of one text.

Packing is sequential, so rows are dealt by a hash of the document over shards of bounded size; each shard is packed
alone and bin ids are unique over shards. A hot source or a large group of copies is spread over all shards.

Defined cases: null or blank text has length 1; null sources and null ids are ordinary values, and a table without
sources has null ones; repeated rows are packed each; a text's duplicate cluster is the hash of its words in lower case.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.lines import SPACE_RUN, words

CAPACITY = 2048
#: Rows of a shard, on average; one task packs a shard.
SHARD_ROWS = 4000
SCHEMA = "doc_id long, bin_id long, slot int, piece int, start long, length long, bin_used long, bin_capacity long"


class Bins:
    """Open bins ordered by residual; each carries the sources and clusters it holds as bitmaps."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (residual, bin), ascending
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.used: list[int] = []
        self.slots: list[int] = []

    def place(self, length: int, source_bit: int, cluster_bit: int) -> tuple[int, int]:
        """The bin and slot that a piece of ``length`` goes to."""
        k = bisect_left(self.order, (length, -1))
        while k < len(self.order):
            b = self.order[k][1]
            if not (self.sources[b] & source_bit or self.clusters[b] & cluster_bit):
                break
            k += 1
        if k < len(self.order):
            _, b = self.order.pop(k)
        else:
            b = len(self.used)
            self.used.append(0)
            self.sources.append(0)
            self.clusters.append(0)
            self.slots.append(0)
        self.used[b] += length
        self.sources[b] |= source_bit
        self.clusters[b] |= cluster_bit
        slot = self.slots[b]
        self.slots[b] += 1
        if self.used[b] < self.capacity:
            insort(self.order, (self.capacity - self.used[b], b))
        return b, slot


def pack(lengths, sources, clusters, capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], list[int]]:
    """Pieces as (row, piece, start, length, bin, slot), and the words used of each bin."""
    source_bits: dict = {}
    counts: dict = {}
    for c in clusters:
        counts[c] = counts.get(c, 0) + 1
    cluster_bits: dict = {}
    pieces = []
    for row, n in enumerate(lengths):
        for piece, start in enumerate(range(0, max(n, 1), capacity)):
            pieces.append((row, piece, start, min(capacity, n - start)))
    pieces.sort(key=lambda p: -p[3])
    bins, out = Bins(capacity), []
    for row, piece, start, length in pieces:
        s = source_bits.setdefault(sources[row], 1 << len(source_bits))
        c = clusters[row]
        bit = cluster_bits.setdefault(c, 1 << len(cluster_bits)) if counts[c] > 1 else 0
        b, slot = bins.place(length, s, bit)
        out.append((row, piece, start, length, b, slot))
    return out, bins.used


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: doc_id, bin_id, slot, piece, start, length, bin_used, bin_capacity."""
    spark = docs.sparkSession
    n_shards = max(1, -(-docs.count() // shard_rows))
    t = F.coalesce(F.col("text"), F.lit(""))
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(source, F.lit("\0")).alias("source"),
        (F.size(words(t)) + 1).cast("long").alias("n"),
        F.xxhash64(F.trim(F.regexp_replace(F.lower(t), SPACE_RUN, " "))).alias("cluster"),
    ).withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(n_shards)))

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        # a fixed order: the result must not depend on how rows arrived
        pdf = pdf.sort_values(["n", "doc_id", "cluster", "source"], ascending=[False, True, True, True], kind="stable")
        placed, used = pack(pdf["n"].tolist(), pdf["source"].tolist(), pdf["cluster"].tolist(), capacity)
        ids = pdf["doc_id"].tolist()
        base = int(key[0]) << 32
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if pd.isna(ids[p[0]]) else int(ids[p[0]]) for p in placed], "Int64"),
                "bin_id": [base + p[4] for p in placed],
                "slot": [p[5] for p in placed],
                "piece": [p[1] for p in placed],
                "start": [p[2] for p in placed],
                "length": [p[3] for p in placed],
                "bin_used": [used[p[4]] for p in placed],
                "bin_capacity": capacity,
            }
        )

    return rows.groupBy("shard").applyInPandas(one, SCHEMA)
