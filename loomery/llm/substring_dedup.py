"""Exact removal of long strings that an earlier document has, with run-length indexes over anchored fragments.

Rule: a byte is removed if it lies in a LENGTH-byte string that also starts in a document with a smaller doc_id.
Strings are judged on the input, overlaps count, and no match crosses documents.

One index over a whole corpus cannot be built in one task, so strings are dealt by content. The anchor of a
LENGTH-byte string is the least hash among its ANCHOR-byte substrings, a function of the string alone: equal strings
have equal anchors wherever they occur. Consecutive strings of a document with one anchor form a fragment. Then:

1. per block of documents, the distinct anchors go (as 32-bit keys) to the bucket of their hash, which answers with the
   anchors that more than one document has, and with the hot ones: those with more than HOT_FORMS different fragments;
2. for those, each block sends its distinct fragments, each once with its smallest doc_id and its places. Strings of a hot
   anchor are sent one by one under their own hash, so no phrase, however often it stands in ever new context, gathers in
   one bucket;
3. a bucket lays equal fragments together and builds run-length indexes over all fragments, some millions of bytes of
   whole anchors at a time; it streams their matching statistics, takes the smallest doc_id of every LENGTH-byte string,
   and answers with the places that an earlier document has;
4. blocks mark those places and cut.

Copies of a whole text enter the index once: only the smallest doc_id of each distinct text sends, and the rest are
covered by it. A text, anchor or fragment that any number of documents have is sent at most once by a block, so no bucket
receives more rows for it than there are blocks. Wrongly equal 32-bit keys only make a string a candidate; fragments are
laid together by a 64-bit hash over two moduli.

Defined cases: null text is empty; texts under LENGTH bytes lose nothing; a null doc_id is neither smaller nor larger
than any other, so that row is left whole and serves no match; rows with one doc_id never take from one another unless
an earlier document has the string too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm import bytes_np as bn
from loomery.llm.run_index import RunIndex
from loomery.llm.workdir import partitions

LENGTH = 50
ANCHOR = 24
#: Bytes of text of a block, and of the texts whose strings a bucket indexes, on average.
BLOCK_BYTES = 12_000_000
BUCKET_BYTES = 24_000_000
#: Bytes that one index takes, in whole anchors.
INDEX_BYTES = 2_000_000
#: Different fragments that make an anchor hot; a block reports those of which it has more than FEW.
HOT_FORMS, FEW = 4096, 4
#: What a block is told: smallest doc_ids of distinct texts, shared anchors, covered places.
OWNERS, SHARED, COVERED = range(3)
NONE = np.iinfo(np.int64).max
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
RESULT_PA = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
)
TOLD = "block long, kind int, bucket long, a binary, b binary, c binary, d binary"
TOLD_PA = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), *((k, pa.binary()) for k in "abcd")])
SENT = "bucket long, block long, a binary, b binary, c binary, d binary, e binary, f binary, g binary, h binary"
SENT_PA = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *((k, pa.binary()) for k in "abcdefgh")])


def fragments(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, content hash, row, start, length) of every fragment of the rows of ``data``."""
    empty = np.zeros(0, np.uint64)
    nothing = (empty, empty, *(np.zeros(0, np.int64),) * 3)
    n = len(data)
    if n < LENGTH:
        return nothing
    sums = bn.prefix_sums(data)
    least = bn.every_span(sums, ANCHOR)
    width, step = LENGTH - ANCHOR + 1, 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: step - width], least[width - step :])
    valid = strings_start(offs)[: len(least)]
    goes_on = least[1:] == least[:-1]
    goes_on &= valid[1:]
    goes_on &= valid[:-1]
    start = valid.copy()
    start[1:] &= ~goes_on
    valid[:-1] &= ~goes_on
    start, end = np.flatnonzero(start), np.flatnonzero(valid) + LENGTH
    row = np.searchsorted(offs, start, "right") - 1
    return least[start], bn.span_hash(sums, start, end), row, start, end - start


def strings_start(offs: np.ndarray) -> np.ndarray:
    """Of each byte of the rows: whether a LENGTH-byte string of its row starts there."""
    size = np.diff(offs)
    parts = np.empty((len(size), 2), np.int64)
    parts[:, 0] = np.maximum(size - LENGTH + 1, 0)
    parts[:, 1] = size - parts[:, 0]
    return np.repeat(np.tile([True, False], len(size)), parts.ravel())


class Texts:
    """The documents of one block, ascending by doc_id, and which of them own their text."""

    def __init__(self, docs: pa.Table, told: pa.Table):
        docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()  # the same in every pass
        self.ids = docs.column("doc_id").to_numpy()
        text = docs.column("text")
        text = text.chunk(0) if text.num_chunks else pa.array([], pa.string())
        self.data, self.offs = bn.column_bytes(text)
        self.told: dict[int, list[dict]] = {OWNERS: [], SHARED: [], COVERED: []}
        for r in told.to_pylist():
            self.told[r["kind"]].append(r)
        owners = [np.frombuffer(r["a"], np.int64) for r in self.told[OWNERS]]
        self.owns = np.isin(self.ids, np.concatenate(owners)) if owners else np.zeros(len(self.ids), bool)


class Block(Texts):
    """The documents of one block with the fragments of those that own their text."""

    def __init__(self, docs: pa.Table, told: pa.Table, buckets: int):
        super().__init__(docs, told)
        self.buckets = buckets
        parts, row = [], 0
        while row < len(self.ids):  # some millions of bytes at a time
            stop = max(row + 1, int(np.searchsorted(self.offs, self.offs[row] + bn.CHUNK, "right")) - 1)
            piece = self.data[self.offs[row] : self.offs[stop]]
            anchor, content, r, start, length = fragments(piece, self.offs[row : stop + 1] - self.offs[row])
            keep = self.owns[r + row]
            parts.append((anchor[keep], content[keep], r[keep] + row, start[keep] + self.offs[row], length[keep]))
            row = stop
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else fragments(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        anchor, self.content, self.row, self.start, self.length = columns
        self.key = self._keys(anchor)

    def _keys(self, h: np.ndarray) -> np.ndarray:
        """Bucket and 32-bit key of a hash."""
        return ((h >> np.uint64(32)) % np.uint64(self.buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, ascending, whether several documents of this block have them, and how many forms they have."""
        order = np.lexsort((self.content, self.key))
        key, row, content = self.key[order], self.row[order], self.content[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        if not len(first):
            return key, np.zeros(0, bool), first
        form = np.append(True, (key[1:] != key[:-1]) | (content[1:] != content[:-1]))
        id_of = self.ids[row]
        return key[first], np.minimum.reduceat(id_of, first) != np.maximum.reduceat(id_of, first), np.add.reduceat(form, first)

    def _flagged(self, key: np.ndarray, name: str) -> np.ndarray:
        """The keys, out of the block's ascending ones, whose bits in the column ``name`` are set."""
        on = np.zeros(len(key), bool)
        for r in self.told[SHARED]:
            if r[name] is not None:
                lo, hi = np.searchsorted(key, [np.uint64(r["bucket"] << 32), np.uint64((r["bucket"] + 1) << 32)])
                on[lo:hi] = np.unpackbits(np.frombuffer(r[name], np.uint8), count=hi - lo)
        return key[on]

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """Fragments of shared anchors: their order by (key, content, row) and the first of each form.

        Strings of hot anchors become fragments of their own.
        """
        key = np.unique(self.key)
        at = np.flatnonzero(np.isin(self.key, self._flagged(key, "a")))
        hot = np.isin(self.key[at], self._flagged(key, "b"))
        if hot.any():
            split, at = at[hot], at[~hot]
            n = self.length[split] - LENGTH + 1
            start = np.repeat(self.start[split] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            h = _string_hashes(self.data, start)
            columns = ((self._keys(h), "key"), (bn.mixed(h), "content"), (np.repeat(self.row[split], n), "row"), (start, "start"))
            more = np.arange(len(self.key), len(self.key) + len(start))
            for values, name in (*columns, (np.full(len(start), LENGTH), "length")):
                setattr(self, name, np.concatenate([getattr(self, name), values]))
            at = np.concatenate([at, more])
        at = at[np.lexsort((self.row[at], self.content[at], self.key[at]))]
        new = np.ones(len(at), bool)
        new[1:] = (self.key[at][1:] != self.key[at][:-1]) | (self.content[at][1:] != self.content[at][:-1])
        return at, np.flatnonzero(new)


def _string_hashes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes of the LENGTH-byte strings at ``start``, some at a time."""
    out = [np.zeros(0, np.uint64)]
    for k in range(0, len(start), 50_000):
        s = start[k : k + 50_000]
        text = data[s[:, None] + np.arange(LENGTH)].ravel()
        lo = np.arange(len(s)) * LENGTH
        out.append(bn.span_hash(bn.prefix_sums(text), lo, lo + LENGTH))
    return np.concatenate(out)


def _by_bucket(key: np.ndarray) -> Iterator[tuple[int, int, int]]:
    bucket = (key >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(key) else []
    for lo, hi in zip(cut, [*cut[1:], len(key)], strict=True):
        yield int(bucket[lo]), int(lo), int(hi)


def _rows(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


def send_anchors(block: int, docs: pa.Table, told: pa.Table, buckets: int) -> pa.Table:
    key, several, forms = Block(docs, told, buckets).anchors()
    low = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
    out = []
    for b, lo, hi in _by_bucket(key):
        many = forms[lo:hi] > FEW
        row = {"bucket": b, "block": block, "a": low[lo:hi].tobytes(), "b": np.packbits(several[lo:hi]).tobytes()}
        if many.any():
            row |= {"c": np.packbits(many).tobytes(), "d": forms[lo:hi][many].astype("<u4").tobytes()}
        out.append(row)
    return _rows(out, SENT_PA)


def answer_anchors(sent: pa.Table) -> pa.Table:
    rows = sent.to_pylist()
    keys = [np.frombuffer(r["a"], "<u4") for r in rows]
    several, forms = [], []
    for r, k in zip(rows, keys, strict=True):
        several.append(np.unpackbits(np.frombuffer(r["b"], np.uint8), count=len(k)).astype(bool))
        f = np.ones(len(k), np.int64)
        if r["c"] is not None:
            f[np.unpackbits(np.frombuffer(r["c"], np.uint8), count=len(k)).astype(bool)] = np.frombuffer(r["d"], "<u4")
        forms.append(f)
    every, back, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    shared = count > 1
    shared[back[np.concatenate(several)]] = True
    hot = np.bincount(back, np.concatenate(forms), minlength=len(every)) > HOT_FORMS
    out, at = [], 0
    for r, k in zip(rows, keys, strict=True):
        mine = back[at : at + len(k)]
        at += len(k)
        if shared[mine].any():
            told = {"block": r["block"], "kind": SHARED, "bucket": r["bucket"], "a": np.packbits(shared[mine]).tobytes()}
            if (hot & shared)[mine].any():
                told["b"] = np.packbits((hot & shared)[mine]).tobytes()
            out.append(told)
    return _rows(out, TOLD_PA)


def _spots(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of size[i] places, for every i."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def send_fragments(block: int, docs: pa.Table, told: pa.Table, buckets: int) -> pa.Table:
    b = Block(docs, told, buckets)
    at, first = b.candidates()
    forms = at[first]
    count = np.diff(np.append(first, len(at)))
    owner = b.ids[b.row[forms]]
    of_first = np.add.reduceat(b.ids[b.row[at]] == np.repeat(owner, count), first) if len(first) else first
    out = []
    for bucket, lo, hi in _by_bucket(b.key[forms]):
        f = forms[lo:hi]
        places = at[first[lo] : first[lo] + int(count[lo:hi].sum())]
        out.append(
            {
                "bucket": bucket,
                "block": block,
                "a": (b.key[f] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(),
                "b": b.content[f].tobytes(),
                "c": b.length[f].astype("<u4").tobytes(),
                "d": owner[lo:hi].tobytes(),
                "e": b.data[_spots(b.start[f], b.length[f])].tobytes(),
                "f": b.start[places].astype("<u8").tobytes(),
                "g": count[lo:hi].astype("<u4").tobytes(),
                "h": of_first[lo:hi].astype("<u4").tobytes(),
            }
        )
    return _rows(out, SENT_PA)


def _least(data: np.ndarray, begin: np.ndarray, size: np.ndarray, owner: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The smallest doc_id that has each string of the forms, which are laid end to end by ``group`` (the anchor)."""
    windows = size - LENGTH + 1
    least = np.empty(int(windows.sum()), np.int64)
    lo = done = 0
    total = np.cumsum(size)
    while lo < len(size):
        # whole anchors up to INDEX_BYTES
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + INDEX_BYTES, "right"))
        hi = max(hi, lo + 1)
        if hi < len(size):
            start = int(np.searchsorted(group, group[hi]))
            hi = start if start > lo else int(np.searchsorted(group, group[hi], "right"))
        f = slice(lo, hi)
        own = np.full(int(size[f].sum()), NONE)
        ends = np.cumsum(size[f])
        starts_string = strings_start(np.append(0, ends))
        own[starts_string] = np.repeat(owner[f], windows[f])
        found = RunIndex(data[_spots(begin[f], size[f])], ends).least_owner(own, LENGTH)[starts_string]
        least[done : done + len(found)] = found
        done += len(found)
        lo = hi
    return least


def answer_fragments(sent: pa.Table) -> pa.Table:
    """Per block: the places of its strings that a smaller doc_id than the document's own has."""
    rows = sent.to_pylist()
    key, content, size, owner = (
        np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("a", "<u4"), ("b", np.uint64), ("c", "<u4"), ("d", np.int64))
    )
    size = size.astype(np.int64)
    data = np.concatenate([np.frombuffer(r["e"], np.uint8) for r in rows])
    begin = np.cumsum(size) - size
    order = np.lexsort((owner, content, key))
    new_key = np.append(True, key[order][1:] != key[order][:-1])
    new = new_key | np.append(True, content[order][1:] != content[order][:-1])
    form = np.empty(len(order), np.int64)
    form[order] = np.cumsum(new) - 1
    lead = order[new]  # of each form, the one with the smallest doc_id
    windows = size[lead] - LENGTH + 1
    to = np.cumsum(windows) - windows
    least = _least(data, begin[lead], size[lead], owner[lead], np.cumsum(new_key)[new])
    out, at = [], 0
    for r in rows:
        m = len(r["a"]) // 4
        mine, own = form[at : at + m], owner[at : at + m]
        at += m
        w = windows[mine]
        first = np.cumsum(w) - w
        earlier = least[_spots(to[mine], w)] < np.repeat(own, w)
        piece = np.repeat(np.arange(m), w)
        joins = earlier[1:] & earlier[:-1] & (piece[1:] == piece[:-1])
        s = np.flatnonzero(earlier & ~np.append(False, joins))
        e = np.flatnonzero(earlier & ~np.append(joins, False))
        spots, count, of_first = (np.frombuffer(r[c], t).astype(np.int64) for c, t in (("f", "<u8"), ("g", "<u4"), ("h", "<u4")))
        base = np.cumsum(count) - count
        n = count[piece[s]]  # each stretch at each place of its form
        start = spots[_spots(base[piece[s]], n)] + np.repeat(s - first[piece[s]], n)
        length = np.repeat(e - s + LENGTH, n)
        later = count - of_first  # the form stands in an earlier document of this block
        start = np.concatenate([start, spots[_spots(base + of_first, later)]])
        length = np.concatenate([length, np.repeat(w + LENGTH - 1, later)])
        if len(start):
            told = {"a": start.astype("<u8").tobytes(), "b": length.astype("<u4").tobytes()}
            out.append({"block": r["block"], "kind": COVERED, "bucket": r["bucket"], **told})
    return _rows(out, TOLD_PA)


def covered(b: Texts) -> np.ndarray:
    """Which bytes of the block's owned texts are removed."""
    change = np.zeros(len(b.data) + 1, np.int32)
    for r in b.told[COVERED]:
        start, length = np.frombuffer(r["a"], "<u8").astype(np.int64), np.frombuffer(r["b"], "<u4").astype(np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def cut(docs: pa.Table, told: pa.Table) -> pa.Table:
    b = Texts(docs, told)
    gone = covered(b)
    out = []
    for k, doc in enumerate(b.ids.tolist()):
        lo, hi = int(b.offs[k]), int(b.offs[k + 1])
        text, g = b.data[lo:hi], gone[lo:hi]
        if not b.owns[k] and hi - lo >= LENGTH:
            g = np.ones(hi - lo, bool)  # an earlier document has the whole text
        removed = int(g.sum())
        spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(g[0]) if removed else 0
        kept = text[~g] if removed else text
        out.append((doc, hi - lo, removed, spans, hashlib.sha256(kept.tobytes()).hexdigest()))
    columns = list(zip(*out, strict=True)) or [()] * 5
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, RESULT_PA, strict=True)], schema=RESULT_PA)


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    spark = docs.sparkSession
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(t))).first()[0] or 0
    n, buckets = (max(partitions(spark), -(-size // x)) for x in (BLOCK_BYTES, BUCKET_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("text"))
    named = rows.filter("doc_id is not null").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n)))
    dealt = named.repartition(n, "block")
    owners = (
        named.select("doc_id", F.md5("text").alias("m"))
        .groupBy("m")
        .agg(F.min("doc_id").alias("doc_id"))
        .groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("block"))
        .agg(F.collect_list("doc_id").alias("ids"))  # those of one block
    )

    def pack_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [
                {"block": r["block"], "kind": OWNERS, "bucket": 0, "a": np.array(r["ids"], np.int64).tobytes()} for r in b.to_pylist()
            ]
            yield from pa.Table.from_pylist(out, schema=TOLD_PA).to_batches()

    def first(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return send_anchors(key[0].as_py(), left, right, buckets)

    def second(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return send_fragments(key[0].as_py(), left, right, buckets)

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        return cut(left, right)

    told = owners.mapInArrow(pack_ids, TOLD)

    def with_told(fn, what: DataFrame, schema: str) -> DataFrame:
        return dealt.groupBy("block").cogroup(what.groupBy("block")).applyInArrow(fn, schema)

    shared = with_told(first, told, SENT).groupBy("bucket").applyInArrow(lambda x: answer_anchors(x), TOLD)
    stretches = with_told(second, told.unionByName(shared), SENT).groupBy("bucket").applyInArrow(lambda x: answer_fragments(x), TOLD)
    told = told.unionByName(stretches)
    out = with_told(last, told, RESULT)
    # a null id has no order: such a row stays whole
    odd = rows.filter("doc_id is null").select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )
    return out.unionByName(odd)
