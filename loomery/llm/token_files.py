"""Token ids of documents as binary files with Elias-Fano document boundaries.

A data set is a folder of shards, numbered in ascending doc_id order. Shard k is two files:

* ``k.ids``: the ids of its documents, each followed by the end id, as little-endian 16-bit integers (32-bit where the
  vocabulary has more than 65,536 ids);
* ``k.idx``: magic, id width, number of documents with a null doc_id, then two Elias-Fano sequences: document starts
  (with the end as one more value) and doc_ids.

Ids come from the tokenizers library. Byte-level BPE never merges over pre-token borders, so texts are cut into
pre-tokens in bulk (numpy over code points), distinct pre-tokens go through the library once per worker and are kept by
their text, and texts are gathered from those. A hash finds the distinct ones of a chunk; every pre-token is compared in
full with the one that stands for its hash, and a text for which they differ goes through the library whole. Texts with characters whose Unicode class is not settled, or with the text of a
special token, go through the library whole.

Rows are range-partitioned and sorted by doc_id, so each task writes one shard as a stream, under a temporary name that
is renamed at the end; a task that runs again writes the same bytes.

Defined cases: null and empty texts are a single end id; null doc_ids come first; equal doc_ids are ordered by their
text's hash, each a document of its own; an empty table is a data set without documents.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.elias_fano import EliasFano, encode
from loomery.llm.workdir import fresh_path, partitions

MAGIC = b"LMTOK\x001\n"
INDEX_HEAD = struct.Struct("<8sBQQ")
END_ID = 0
#: Distinct pre-tokens that a worker keeps, and characters that it cuts at a time.
KEEP = 1_000_000
CHUNK = 3_000_000
SPACE, LETTER, NUMBER, OTHER, UNSETTLED = range(5)
#: White space of the pattern's \s.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")


def _classes() -> np.ndarray:
    out = np.full(0x110000, UNSETTLED, np.uint8)
    for c in range(0x3000):
        kind = unicodedata.category(chr(c))
        if kind not in ("Cn", "Cs"):
            out[c] = {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)
    out[WHITE] = SPACE
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Encoder:
    """Bulk encoder over a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Python worker has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        # the bulk cut below is this kind's pattern; anything else goes through the library whole
        self.bulk = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 65536 else np.dtype("<u4")
        self.classes = _classes()
        with np.errstate(over="ignore"):
            self.mix = _mixed(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            p = np.full(CHUNK + 1, 0x9E3779B97F4A7C15 | 1, np.uint64)
            p[0] = 1
            self.power = np.multiply.accumulate(p)
            p[1:] = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 2**64))
            self.inverse = np.multiply.accumulate(p)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, self.dtype)
        self.used = 0
        self.spans = np.zeros((2, 1 << 16), np.int64)  # start in flat and length of each pre-token

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, without an end id."""
        out: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(texts)
        group, size = [], 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if not self.bulk or len(t) > CHUNK or any(s in t for s in self.specials):
                out[i] = self.whole(t)
                continue
            if size + len(t) > CHUNK:
                self._chunk(texts, group, out)
                group, size = [], 0
            group.append(i)
            size += len(t)
        if group:
            self._chunk(texts, group, out)
        return out

    def _cuts(self, cp: np.ndarray, cls: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Start of each pre-token; ``first``: start of each text."""
        n = len(cp)
        begins = np.zeros(n + 1, bool)
        begins[first] = True
        begins[n] = True
        begin = begins[:n]
        white = cls == SPACE
        before = np.empty(n, np.uint8)
        before[0] = SPACE
        before[1:] = cls[:-1]
        after_blank = np.zeros(n, bool)
        after_blank[1:] = cp[:-1] == 32
        start = begin | (~white & (before != cls) & ~(after_blank & (before == SPACE)))
        # a run of white space starts a pre-token, and so does its last character if a word follows in the text
        start |= white & (before != SPACE)
        word_next = np.zeros(n, bool)
        word_next[:-1] = ~white[1:] & ~begin[1:]
        start |= white & word_next
        for i in np.flatnonzero((cp == 39) & start & ~(after_blank & ~begin)).tolist():
            tail = cp[i + 1 : i + 3].tolist()
            for c in CONTRACTIONS:
                m = len(c)
                if tail[:m] == [ord(x) for x in c] and not begins[i + 1 : i + 1 + m].any():
                    start[i + 1 : i + 1 + m] = False
                    if i + 1 + m < n and not white[i + 1 + m]:
                        start[i + 1 + m] = True
                    break
        return np.flatnonzero(start)

    def _chunk(self, texts: list, group: list[int], out: list) -> None:
        joined = "".join(texts[i] for i in group)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = self.classes[cp]
        first = np.zeros(len(group) + 1, np.int64)
        np.cumsum([len(texts[i]) for i in group], out=first[1:])
        if (cls == UNSETTLED).any():
            odd = set((np.searchsorted(first, np.flatnonzero(cls == UNSETTLED), "right") - 1).tolist())
            for k in odd:
                out[group[k]] = self.whole(texts[group[k]])
            if rest := [g for k, g in enumerate(group) if k not in odd]:
                self._chunk(texts, rest, out)
            return
        cuts = self._cuts(cp, cls, first[:-1])
        ends = np.append(cuts[1:], len(cp))
        size = ends - cuts
        with np.errstate(over="ignore"):
            sums = np.zeros(len(cp) + 1, np.uint64)
            np.cumsum(self.mix[cp] * self.power[: len(cp)], out=sums[1:])
            h = _mixed((sums[ends] - sums[cuts]) * self.inverse[cuts] + size.astype(np.uint64))
        _, where, back = np.unique(h, return_index=True, return_inverse=True)
        # equal hashes only propose equal pre-tokens: each is compared with the first of its hash, code point by code point
        like = where[back]
        differs = size != size[like]
        if not differs.any():
            differs = np.logical_or.reduceat(cp != cp[np.arange(len(cp)) + np.repeat(cuts[like] - cuts, size)], cuts)
        if differs.any():
            odd = set((np.searchsorted(first, cuts[differs], "right") - 1).tolist())
            for k in odd:
                out[group[k]] = self.whole(texts[group[k]])
            if rest := [g for k, g in enumerate(group) if k not in odd]:
                self._chunk(texts, rest, out)
            return
        del sums, cp, cls, h
        if len(self.known) > KEEP:
            self.forget()
        words = [joined[a:b] for a, b in zip(cuts[where].tolist(), ends[where].tolist(), strict=True)]
        slots = [self.known.get(w, -1) for w in words]
        new = [k for k, s in enumerate(slots) if s < 0]
        for lo in range(0, len(new), 20_000):
            self._learn(words, new[lo : lo + 20_000], slots)
        slot = np.array(slots, np.int64)
        begin, size = self.spans[0, slot][back], self.spans[1, slot][back]
        to = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=to[1:])
        ids = self.flat[np.repeat(begin - to[:-1], size) + np.arange(to[-1])]
        bounds = to[np.searchsorted(cuts, first)]
        for k, g in enumerate(group):
            out[g] = ids[bounds[k] : bounds[k + 1]]

    def _learn(self, words: list[str], new: list[int], slots: list[int]) -> None:
        for k, e in zip(new, self.library.encode_batch_fast([words[k] for k in new], add_special_tokens=False), strict=True):
            ids = e.ids
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), self.dtype)])
            self.flat[self.used : self.used + len(ids)] = ids
            slots[k] = s = len(self.known)
            if s == self.spans.shape[1]:
                self.spans = np.concatenate([self.spans, np.zeros_like(self.spans)], axis=1)
            self.known[words[k]] = s
            self.spans[:, s] = self.used, len(ids)
            self.used += len(ids)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Shard:
    """One shard, read: ``starts`` and ``doc_ids`` by select, ids of a document by offset."""

    def __init__(self, folder: str, k: int):
        self.files, self.base = fs.FileSystem.from_uri(folder)
        self.name = f"{self.base}/{k:06d}"
        with self.files.open_input_file(f"{self.name}.idx") as f:
            data = f.read()
        magic, width, self.n_null, self.n_docs = INDEX_HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError(f"{self.name}.idx is no index of token ids")
        self.dtype = np.dtype(f"<u{width}")
        self.starts = EliasFano(data[INDEX_HEAD.size :])
        self.doc_ids = EliasFano(data[INDEX_HEAD.size + self.starts.size :])

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids with the end id) of each document, read in blocks."""
        with self.files.open_input_stream(f"{self.name}.ids") as f:
            for a in range(0, self.n_docs, 1024):
                b = min(self.n_docs, a + 1024)
                starts = self.starts.slice(a, b + 1)
                ids = np.frombuffer(f.read(int(starts[-1] - starts[0]) * self.dtype.itemsize), self.dtype)
                named = self.doc_ids.slice(max(0, a - self.n_null), max(0, b - self.n_null))
                for k in range(a, b):
                    lo, hi = int(starts[k - a]), int(starts[k - a + 1])
                    doc = None if k < self.n_null else int(named[k - max(a, self.n_null)])
                    yield doc, lo, ids[lo - int(starts[0]) : hi - int(starts[0])]


def _write_shard(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> tuple[int, int, int]:
    """Write this task's shard; its number, documents and ids."""
    task = TaskContext.get()
    k, enc = task.partitionId(), _encoder(tokenizer)
    files, base = fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    name, part = f"{base}/{k:06d}", f"{base}/.{k:06d}.{task.taskAttemptId()}"
    sizes, ids_of, n_null = [], [], 0
    end = np.array([end_id], enc.dtype)
    with files.open_output_stream(f"{part}.ids") as f:
        for b in batches:
            column = b.column("doc_id")
            n_null += column.null_count
            ids_of.append(column.drop_null().to_numpy(zero_copy_only=False))
            for at in range(0, b.num_rows, 1024):
                found = enc.encode(b.column("text").slice(at, 1024).to_pylist())
                sizes += [len(ids) + 1 for ids in found]
                f.write(np.concatenate([x for ids in found for x in (ids, end)]).tobytes())
    starts = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    doc_ids = np.concatenate(ids_of) if ids_of else np.zeros(0, np.int64)
    with files.open_output_stream(f"{part}.idx") as f:
        f.write(INDEX_HEAD.pack(MAGIC, enc.dtype.itemsize, n_null, len(sizes)) + encode(starts) + encode(doc_ids))
    for kind in ("ids", "idx"):
        files.move(f"{part}.{kind}", f"{name}.{kind}")
    return k, len(sizes), int(starts[-1])


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> list[tuple[int, int, int]]:
    """Write a data set under ``folder`` (a URI); (shard, documents, ids) of each shard in order."""
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = _write_shard(batches, folder, tokenizer, end_id)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in done], ["shard", "docs", "ids"])

    done = dealt.mapInArrow(run, "shard long, docs long, ids long").collect()  # a row a shard
    return sorted((r.shard, r.docs, r.ids) for r in done)


def _read_shard(folder: str, k: int, base: int) -> pa.RecordBatch:
    docs, starts, sizes, sums = [], [], [], []
    for doc, lo, ids in Shard(folder, k).documents():
        docs.append(doc)
        starts.append(base + lo)
        sizes.append(len(ids))
        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
    columns = [pa.array(x, pa.int64()) for x in (docs, starts, sizes, sums)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, folder: str, shards: list[tuple[int, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    rows, before = [], 0
    for k, n_docs, n_ids in shards:
        if n_docs:
            rows.append((k, before))
        before += n_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, base in zip(b.column("shard").to_pylist(), b.column("base").to_pylist(), strict=True):
                yield _read_shard(folder, k, base)

    listed = spark.createDataFrame(rows, "shard long, base long").repartition(max(1, len(rows)), "shard")
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the ids of ``docs`` to the shared folder and read them back."""
    folder = fresh_path(docs.sparkSession, "token-ids")
    return read_ids(docs.sparkSession, folder, write_ids(docs, folder, tokenizer))
