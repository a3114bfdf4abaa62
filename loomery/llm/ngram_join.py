"""Similarity join of documents on word 5-gram sets, with adaptive multi-match prefixes.

A document's set holds its distinct 5-word shingles (64-bit hashes; A-Z in lower case; a text of fewer words is one
shingle). Two documents link when the Jaccard similarity of their sets is at least 75 %; classes are the components.

Tokens are ordered by the number of documents that hold them, rare first. If two sets overlap as much as a link needs,
the first ``n - need + l`` tokens of both share ``l`` tokens or more, for every ``l``. A longer prefix so asks for more
shared tokens: each document takes the ``l`` for which its index lists plus the expected verifications cost least, and
a pair is verified only if it shares as many prefix tokens as the smaller ``l`` of the two.

1. Copies of a text count as one document, the smallest doc_id.
2. Blocks of documents send their distinct tokens to the buckets of their hash and learn how many documents have each.
   A document with too many tokens of its own cannot link and is settled; the others keep their ordered tokens.
3. Documents whose shortest prefixes meet in a token form candidate groups (components of star edges, one a token and
   document). A task joins whole groups; a group beyond a task's fair share of tokens is dealt over several.
4. In a task, documents within the link distance of a leader are its cluster, and a prefix token lists clusters, not
   documents. The distance 1 - similarity is a metric, so a document farther from a leader than the link distance plus
   the cluster's radius links with none of its members, and otherwise only members far enough from the leader are
   looked at. A large group of near copies so costs one verification a document, and no link is lost.
5. Of a group that was dealt, the leaders alone meet, with their radii: near ones link, far ones rule their clusters
   out, and where the radii leave it open, the smaller cluster's members visit those of the larger one.

Defined cases: null and empty texts and texts without words have an empty set and link with nothing; a null doc_id joins
by its text but never names a class (component_id is null where no other id does); rows of one doc_id, with equal or
different texts, are in one class, since the id is what links name; ties cannot occur, since the test is exact in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm import bytes_np as bn
from loomery.llm.graphs import components
from loomery.llm.lines import HAS_WORD
from loomery.llm.workdir import partitions, written
from loomery.operators.relational import skewed_lookup

WORDS = 5
PERCENT = 75
#: Bytes of text of a block, and of the texts whose tokens a bucket counts, on average.
BLOCK_BYTES = 12_000_000
BUCKET_BYTES = 48_000_000
#: Cost of a verification against that of an index entry, per token of the document.
VERIFY_COST = 0.25
#: A group is dealt over tasks if it has more tokens than this share of all, within these bounds.
LEAST_TOKENS, MOST_TOKENS = 16_000, 4_000_000
#: Tokens of the leaders that one task compares in pairs, and clusters that a host sees in one task.
LEADER_TOKENS, VISITORS = 500_000, 4096
#: Stand-ins for null ids take the highest 2**31 numbers.
STAND_IN_BITS = 31
OWNERS, COUNTS = range(2)
TOLD = "block long, kind int, bucket long, a binary, b binary"
TOLD_PA = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
SENT = "bucket long, block long, a binary, b binary, c binary"
SENT_PA = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *((k, pa.binary()) for k in "abc")])
INFO = "doc_id long, m string, n long, ell long, base long, reach long, tokens binary"
INFO_PA = pa.schema([("doc_id", pa.int64()), ("m", pa.string()), *((k, pa.int64()) for k in ("n", "ell", "base", "reach")), ("tokens", pa.binary())])
LINK, MEMBER, OPEN = range(3)
FOUND = "kind int, c long, a long, b long, d double, label long"
FOUND_PA = pa.schema([("kind", pa.int32()), ("c", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("d", pa.float64()), ("label", pa.int64())])
EDGE = "a long, b long"
EDGE_PA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def needed(n: int) -> int:
    """Tokens that a partner of a set of n tokens must share with it, at least."""
    return (PERCENT * n + 99) // 100


def token_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row of a text column."""
    for a, b, data, offs in bn.chunks(column):
        data = bn.LOWER[data]
        s, e, first = bn.word_spans(data, offs)
        h = bn.span_hash(bn.prefix_sums(data), s, e)
        grams = bn.shingles(h, WORDS)
        for k in range(b - a):
            lo, hi = int(first[k]), int(first[k + 1])
            if hi - lo >= WORDS:
                yield a + k, np.unique(grams[lo : hi - WORDS + 1])
            else:
                yield a + k, bn.shingles(h[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64)


class Block:
    """The documents of a block that own their text, with their token sets."""

    def __init__(self, docs: pa.Table, told: pa.Table, buckets: int):
        rows = told.to_pylist()
        owners = [np.frombuffer(r["a"], np.int64) for r in rows if r["kind"] == OWNERS]
        owned = pa.array(np.concatenate(owners) if owners else np.zeros(0, np.int64))
        docs = docs.filter(pa.compute.is_in(docs.column("doc_id"), value_set=owned)).combine_chunks()
        once = {k: i for i, k in enumerate(zip(docs.column("doc_id").to_pylist(), docs.column("m").to_pylist(), strict=True))}
        docs = docs.take(pa.array(sorted(once.values()), pa.int64())).combine_chunks()  # rows repeated in full count once
        text = docs.column("text")
        text = text.chunk(0) if text.num_chunks else pa.array([], pa.string())
        self.ids = docs.column("doc_id").to_numpy()
        self.texts = docs.column("m").to_pylist()
        self.sets = [s for _, s in token_sets(text)]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        token = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        key = ((token >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (token & np.uint64(0xFFFFFFFF))
        self.key, self.back, self.count = np.unique(key, return_inverse=True, return_counts=True)
        self.counts_told = [r for r in rows if r["kind"] == COUNTS]

    def by_bucket(self) -> Iterator[tuple[int, int, int]]:
        bucket = (self.key >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
        for lo, hi in zip(cut, [*cut[1:], len(bucket)], strict=True):
            yield int(bucket[lo]), int(lo), int(hi)

    def frequencies(self) -> np.ndarray:
        """Documents that have each token of ``key``."""
        df = np.ones(len(self.key), np.int64)
        spans = {b: (lo, hi) for b, lo, hi in self.by_bucket()}
        for r in self.counts_told:
            lo, hi = spans[r["bucket"]]
            more = np.flatnonzero(np.unpackbits(np.frombuffer(r["a"], np.uint8), count=hi - lo))
            df[lo + more] = np.frombuffer(r["b"], "<u4")
        return df


def send_tokens(block: int, docs: pa.Table, told: pa.Table, buckets: int) -> pa.Table:
    b = Block(docs, told, buckets)
    low = (b.key & np.uint64(0xFFFFFFFF)).astype("<u4")
    rows = []
    for k, lo, hi in b.by_bucket():
        more = b.count[lo:hi] > 1
        rows.append(
            {
                "bucket": k,
                "block": block,
                "a": low[lo:hi].tobytes(),
                "b": np.packbits(more).tobytes(),
                "c": b.count[lo:hi][more].astype("<u4").tobytes(),
            }
        )
    return pa.Table.from_pylist(rows, schema=SENT_PA)


def answer_tokens(sent: pa.Table) -> pa.Table:
    rows, keys, counts = sent.to_pylist(), [], []
    for r in rows:
        k = np.frombuffer(r["a"], "<u4")
        c = np.ones(len(k), np.int64)
        c[np.unpackbits(np.frombuffer(r["b"], np.uint8), count=len(k)).astype(bool)] = np.frombuffer(r["c"], "<u4")
        keys.append(k)
        counts.append(c)
    _, back = np.unique(np.concatenate(keys), return_inverse=True)
    df = np.bincount(back, np.concatenate(counts)).astype(np.int64)[back]
    out, at = [], 0
    for r, k in zip(rows, keys, strict=True):
        d = df[at : at + len(k)]
        at += len(k)
        more = d > 1
        if more.any():
            out.append(
                {
                    "block": r["block"],
                    "kind": COUNTS,
                    "bucket": r["bucket"],
                    "a": np.packbits(more).tobytes(),
                    "b": np.minimum(d[more], 2**32 - 1).astype("<u4").tobytes(),
                }
            )
    return pa.Table.from_pylist(out, schema=TOLD_PA)


def prefix_choice(n: int, shared_df: np.ndarray) -> tuple[int, int, int]:
    """(l, tokens of the shortest prefix, tokens of the chosen one), among the tokens that other documents have.

    ``shared_df`` are the document counts of those, ascending. The cost of ``l`` is the index entries its prefix reads
    plus the verifications expected, entries / l pairs of so many matches, each VERIFY_COST a token.
    """
    slack = len(shared_df) - needed(n)  # >= 0: tokens of the prefix beyond l
    reads = np.cumsum(shared_df - 1)[slack:]
    ell = np.arange(1, len(reads) + 1)
    best = int(np.argmin(reads + VERIFY_COST * n * reads / ell))
    return best + 1, slack + 1, slack + 1 + best


def ordered_sets(docs: pa.Table, told: pa.Table, buckets: int) -> pa.Table:
    """A row for each owner; those that can still link carry their shared tokens in order."""
    b = Block(docs, told, buckets)
    df = b.frequencies()[b.back]
    out, at = [], 0
    for doc, m, s in zip(b.ids.tolist(), b.texts, b.sets, strict=True):
        n, d = len(s), df[at : at + len(s)]
        at += n
        common = d > 1
        if n and np.count_nonzero(common) >= needed(n):
            s, d = s[common], d[common]
            order = np.lexsort((s, d))
            ell, base, reach = prefix_choice(n, d[order])
            out.append((doc, m, n, ell, base, reach, s[order].tobytes()))
        else:
            out.append((doc, m, n, 0, 0, 0, None))
    columns = list(zip(*out, strict=True)) or [()] * 7
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, INFO_PA, strict=True)], schema=INFO_PA)


def _prefix_rows(b: pa.RecordBatch, buckets: int) -> pa.Table:
    """Tokens of the shortest prefixes and their documents, by bucket."""
    tokens = [np.frombuffer(t, np.uint64)[:k] for t, k in zip(b.column("tokens").to_pylist(), b.column("base").to_pylist(), strict=True)]
    doc = np.repeat(b.column("doc_id").to_numpy(), [len(t) for t in tokens])
    token = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
    bucket = (bn.mixed(token) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, token, doc = bucket[order], token[order], doc[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
    rows = [
        {"bucket": int(bucket[lo]), "block": 0, "a": token[lo:hi].tobytes(), "b": doc[lo:hi].tobytes()}
        for lo, hi in zip(cut, [*cut[1:], len(bucket)], strict=True)
    ]
    return pa.Table.from_pylist(rows, schema=SENT_PA)


def _stars(sent: pa.Table) -> pa.Table:
    """Edges from the documents of each token to the smallest of them."""
    rows = sent.to_pylist()
    token = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in rows])
    doc = np.concatenate([np.frombuffer(r["b"], np.int64) for r in rows])
    order = np.lexsort((doc, token))
    token, doc = token[order], doc[order]
    new = np.append(True, token[1:] != token[:-1])
    head = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
    doc, head = doc[doc != head], head[doc != head]
    order = np.lexsort((head, doc))
    doc, head = doc[order], head[order]
    once = np.append(True, (doc[1:] != doc[:-1]) | (head[1:] != head[:-1]))[: len(doc)]
    return pa.Table.from_arrays([pa.array(doc[once]), pa.array(head[once])], schema=EDGE_PA)


FAR = 1 - PERCENT / 100
#: Distances are compared with this margin, towards looking.
MARGIN = 1e-9


class _Group:
    """The documents of one task by number, with classes; a verification marks one set and counts the marks in others."""

    def __init__(self, n: np.ndarray, tokens: list[np.ndarray]):
        self.n = np.asarray(n, np.int64)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        every, self.flat = np.unique(np.concatenate(tokens), return_inverse=True)
        self.mark = np.zeros(len(every), bool)
        self.up = list(range(len(tokens)))

    def tokens(self, x: int) -> np.ndarray:
        return self.flat[self.starts[x] : self.starts[x] + self.sizes[x]]

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def unite(self, x: int, y: int) -> bool:
        """Whether the two were of different classes, which are one now."""
        x, y = self.find(x), self.find(y)
        self.up[x] = y
        return x != y

    def shared(self, others: np.ndarray) -> np.ndarray:
        """How many of its tokens are marked, for each of ``others``."""
        if len(others) < 8:
            return np.array([np.count_nonzero(self.mark[self.tokens(y)]) for y in others.tolist()], np.int64)
        size = self.sizes[others]
        ends = np.cumsum(size)
        spots = np.repeat(self.starts[others] - (ends - size), size) + np.arange(ends[-1])
        return np.add.reduceat(self.mark[self.flat[spots]], ends - size, dtype=np.int64)

    def judged(self, x: int, others: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it links with x, distance from x) of each of ``others`` that share so many tokens with it."""
        union = self.n[x] + self.n[others] - shared
        return 100 * shared >= PERCENT * union, 1 - shared / union


class _Rows:
    """An array that grows."""

    def __init__(self, kind):
        self.data, self.used = np.zeros(64, kind), 0

    def add(self, value) -> None:
        self.extend((value,))

    def extend(self, values) -> None:
        while self.used + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.used : self.used + len(values)] = values
        self.used += len(values)

    @property
    def all(self) -> np.ndarray:
        return self.data[: self.used]


class _Clusters:
    """Clusters of a group: what each prefix token lists, and what decides whether a document can link with a member."""

    def __init__(self):
        self.lists: dict[int, list[int]] = {}  # prefix token -> clusters
        self.token, self.cluster = _Rows(np.int64), _Rows(np.int64)  # the same as pairs
        self.head, self.least, self.low, self.high = (_Rows(np.int64) for _ in range(4))
        self.widest = _Rows(np.float64)
        self.head_tokens, self.head_starts = _Rows(np.int64), _Rows(np.int64)
        self.has: list[set[int]] = []
        self.members: list[tuple[list[int], list[float]]] = []

    def candidates(self, prefix: np.ndarray, ell: int, n: int, mark: np.ndarray) -> np.ndarray:
        """Clusters with enough of the prefix tokens and lengths that can link, most tokens first."""
        listed = [self.lists[t] for t in prefix.tolist() if t in self.lists]
        if not listed:
            return np.zeros(0, np.int64)
        total = sum(map(len, listed))
        if total < 500 or 16 * total < self.token.used:
            times: dict[int, int] = {}
            for x in listed:
                for c in x:
                    times[c] = times.get(c, 0) + 1
            least, low, high = self.least.data, self.low.data, self.high.data
            fit = [c for c, k in times.items() if k >= min(ell, least[c]) and 100 * high[c] >= PERCENT * n and 100 * n >= PERCENT * low[c]]
            return np.array(sorted(fit, key=lambda c: (-times[c], c)), np.int64)
        mark[prefix] = True  # long lists: all at once
        count = np.bincount(self.cluster.all[mark[self.token.all]], minlength=len(self.has))
        mark[prefix] = False
        ok = (count > 0) & (count >= np.minimum(ell, self.least.all))
        ok &= (100 * self.high.all >= PERCENT * n) & (100 * n >= PERCENT * self.low.all)
        found = np.flatnonzero(ok)
        return found[np.argsort(-count[found], kind="stable")]

    def open(self, x: int, ell: int, n: int, tokens: np.ndarray) -> int:
        """A new cluster about x."""
        self.head.add(x)
        self.least.add(ell)
        self.low.add(n)
        self.high.add(n)
        self.widest.add(0.0)
        self.head_starts.add(self.head_tokens.used)
        self.head_tokens.extend(tokens)
        self.has.append(set())
        self.members.append(([], []))
        return len(self.has) - 1

    def join(self, c: int, x: int, dist: float, ell: int, n: int, prefix: np.ndarray) -> None:
        self.members[c][0].append(x)
        self.members[c][1].append(dist)
        self.least.data[c] = min(self.least.data[c], ell)
        self.low.data[c] = min(self.low.data[c], n)
        self.high.data[c] = max(self.high.data[c], n)
        self.widest.data[c] = max(self.widest.data[c], dist)
        has = self.has[c]
        new = [t for t in prefix.tolist() if t not in has]
        has.update(new)
        for t in new:
            self.lists.setdefault(t, []).append(c)
        if new:
            self.token.extend(new)
            self.cluster.extend([c] * len(new))


def clusters(ids, n, ell, reach, tokens: list[np.ndarray]) -> tuple[list[tuple[int, int]], list[int], list[float], list[int]]:
    """Links that span the classes of a group; the leader of each document, its distance from it, and a document of its class.

    Documents are numbers from 0 by place; every pair that can link is decided. Those whose tokens most others have come
    first, so that leaders stand in the middle of their copies.
    """
    g, k = _Group(n, tokens), _Clusters()
    frequency = np.bincount(g.flat)[g.flat]
    middle = np.add.reduceat(frequency, g.starts) / g.sizes
    of, dist, links = np.full(len(ids), -1), np.zeros(len(ids)), []
    for x in np.lexsort((ids, -middle)).tolist():
        mine, size, own_ell = g.tokens(x), int(g.n[x]), int(ell[x])
        prefix = mine[: int(reach[x])]
        cand = k.candidates(prefix, own_ell, size, g.mark)
        if len(cand):
            g.mark[mine] = True
            heads = k.head.all[cand]
            if 3 * len(cand) > k.head.used > 8:
                shared = np.add.reduceat(g.mark[k.head_tokens.all], k.head_starts.all, dtype=np.int64)[cand]
            else:
                shared = g.shared(heads)
            near, d = g.judged(x, heads, shared)
            if near.any():
                at = np.flatnonzero(near)
                best = at[np.argmin(d[at])]
                of[x], dist[x] = cand[best], d[best]
                links += [(x, y) for y in heads[at].tolist() if g.unite(x, y)]
            for j in np.flatnonzero(~near & (k.widest.all[cand] > 0) & (d <= FAR + k.widest.all[cand] + MARGIN)).tolist():
                if g.find(x) != g.find(int(heads[j])):
                    member, far = (np.array(v) for v in k.members[cand[j]])
                    member = member[far >= d[j] - FAR - MARGIN]
                    at = np.flatnonzero(g.judged(x, member, g.shared(member))[0]) if len(member) else member
                    if len(at):
                        y = int(member[at[0]])
                        g.unite(x, y)
                        links.append((x, y))
            g.mark[mine] = False
        if of[x] < 0:
            of[x] = k.open(x, own_ell, size, mine)
        k.join(int(of[x]), x, float(dist[x]), own_ell, size, prefix)
    return links, k.head.all[of].tolist(), dist.tolist(), [g.find(x) for x in range(len(ids))]


def leaders(n, radius, label, tokens: list[np.ndarray], part=None) -> tuple[list[tuple[int, int]], list[tuple[int, int, float]]]:
    """(links, pairs whose clusters may link although they do not, with their distance) among leaders.

    With ``part`` (0 or 1, ascending), only pairs of different parts are looked at. ``label`` are classes known before.
    """
    g, radius = _Group(n, tokens), np.asarray(radius, np.float64)
    same: dict[int, int] = {}
    for x, c in enumerate(label):
        g.unite(x, same.setdefault(c, x))
    cut = None if part is None else int(np.searchsorted(part, 1))
    links, open_ = [], []
    for x in range(1 if cut is None else max(cut, 1), len(tokens)):
        stop = x if cut is None else cut
        if not stop:
            break
        others = np.arange(stop)
        g.mark[g.tokens(x)] = True
        shared = np.add.reduceat(g.mark[g.flat[: g.starts[stop - 1] + g.sizes[stop - 1]]], g.starts[:stop], dtype=np.int64)
        g.mark[g.tokens(x)] = False
        near, d = g.judged(x, others, shared)
        links += [(x, y) for y in np.flatnonzero(near).tolist() if g.unite(x, y)]
        both = radius[x] + radius[:stop]
        open_ += [(x, y, float(d[y])) for y in np.flatnonzero(~near & (both > 0) & (d <= FAR + both + MARGIN)).tolist()]
    return links, [(x, y, d) for x, y, d in open_ if g.find(x) != g.find(y)]


def visits(n, host: np.ndarray, tokens: list[np.ndarray]) -> list[tuple[int, int]]:
    """A link with one of the hosts for each document that is none and has one; hosts come first."""
    g, m, links = _Group(n, tokens), int(np.count_nonzero(host)), []
    others = np.arange(m)
    for x in range(m, len(tokens) if m else 0):
        g.mark[g.tokens(x)] = True
        shared = np.add.reduceat(g.mark[g.flat[: g.starts[m - 1] + g.sizes[m - 1]]], g.starts[:m], dtype=np.int64)
        g.mark[g.tokens(x)] = False
        at = np.flatnonzero(g.judged(x, others, shared)[0])
        if len(at):
            links.append((x, int(at[0])))
    return links


def _cut(t: pa.Table, keys: tuple[str, ...], *order: str) -> Iterator[dict]:
    """The rows of each group of ``keys`` as columns, in the order given, then ascending by doc_id."""
    rows = t.sort_by([(k, "ascending") for k in (*keys, *order, "doc_id")])
    columns = {k: rows.column(k).to_pylist() if k == "tokens" else rows.column(k).to_numpy() for k in rows.column_names}
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= columns[k][1:] != columns[k][:-1]
    starts = np.flatnonzero(new).tolist()
    for lo, hi in zip(starts, [*starts[1:], len(rows)], strict=True):
        found = {k: v[lo:hi] for k, v in columns.items()}
        found["tokens"] = [np.frombuffer(x, np.uint64) for x in found["tokens"]]
        yield found


def _found(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(FOUND_PA)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND_PA, strict=True)], schema=FOUND_PA)


def _cluster_rows(t: pa.Table) -> pa.Table:
    out = []
    for g in _cut(t, ("c", "p")):
        ids = g["doc_id"].tolist()
        links, leader, dist, label = clusters(g["doc_id"], g["n"], g["ell"], g["reach"], g["tokens"])
        out += [(LINK, None, ids[x], ids[y], None, None) for x, y in links]
        if g["parts"][0] > 1:
            c = int(g["c"][0])
            out += [(MEMBER, c, ids[x], ids[y], d, ids[k]) for x, (y, d, k) in enumerate(zip(leader, dist, label, strict=True))]
    return _found(out)


def _leader_rows(t: pa.Table) -> pa.Table:
    """Links, and open pairs as (host, visitor): the cluster of more members is the host."""
    out = []
    for g in _cut(t, ("c", "i", "j"), "part"):
        ids, part, size = g["doc_id"].tolist(), g["part"] if g["part"][0] >= 0 else None, g["size"].tolist()
        links, open_ = leaders(g["n"], g["radius"], g["label"].tolist(), g["tokens"], part)
        out += [(LINK, None, ids[x], ids[y], None, None) for x, y in links]
        for x, y, d in open_:
            if (size[x], ids[x]) < (size[y], ids[y]):
                x, y = y, x
            out.append((OPEN, None, ids[x], ids[y], d, None))
    return _found(out)


def _visit_rows(t: pa.Table) -> pa.Table:
    out = []
    for g in _cut(t, ("host", "v"), "visits"):
        ids = g["doc_id"].tolist()
        out += [(ids[x], ids[y]) for x, y in visits(g["n"], g["visits"] == 0, g["tokens"])]
    return pa.Table.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], schema=EDGE_PA)


def _parts(rows: DataFrame, bound: int) -> DataFrame:
    """(c, parts): the groups of more than ``bound`` tokens and how many parts of half of it they make."""
    weight = rows.groupBy("c").agg(F.sum(F.octet_length("tokens") / 8).alias("w"))
    return weight.filter(F.col("w") > bound).select("c", F.ceil(2 * F.col("w") / F.lit(bound)).cast("int").alias("parts"))


def _with_part(rows: DataFrame, parts: DataFrame) -> DataFrame:
    # a row for each group beyond the bound, so the broadcast is at most one for so many tokens
    many = F.coalesce("parts", F.lit(1))
    rows = rows.join(F.broadcast(parts), "c", "left").withColumn("parts", many)
    return rows.withColumn("p", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))


def _linked(info: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """Edges that span the classes, from the groups (v, c) of documents that may link."""
    members = written(
        info.join(groups.withColumnRenamed("v", "doc_id"), "doc_id").select("c", "doc_id", "n", "ell", "reach", "tokens"), "members"
    )
    total = members.agg(F.sum(F.octet_length("tokens") / 8)).first()[0] or 0
    fair = min(MOST_TOKENS, max(LEAST_TOKENS, int(total / n)))
    large = written(_parts(members, fair), "large")
    dealt = _with_part(members, large).withColumn("bucket", F.pmod(F.xxhash64("c", "p"), F.lit(4 * n)))
    found = written(dealt.groupBy("bucket").applyInArrow(lambda t: _cluster_rows(t), FOUND), "clusters")
    out = found.filter(F.col("kind") == LINK).select("a", "b")
    if large.isEmpty():
        return out
    of = found.filter(F.col("kind") == MEMBER).select("c", F.col("a").alias("doc_id"), F.col("b").alias("leader"), "d", "label")
    about = of.groupBy("c", "leader").agg(F.max("d").alias("radius"), F.count("*").alias("size"), F.first("label").alias("label"))
    heads = members.drop("ell", "reach").join(about.withColumnRenamed("leader", "doc_id"), ["c", "doc_id"])
    heads = written(heads, "leaders")
    # leaders beyond a task's bound meet part by part: a row goes to each pair of parts that its own is in
    heads = _with_part(heads, written(_parts(heads, min(4 * fair, LEADER_TOKENS)), "large"))
    heads = heads.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    heads = heads.select(
        "c", "doc_id", "n", "radius", "size", "label", "tokens",
        F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"),
        F.when(F.col("p") == F.col("q"), -1).when(F.col("p") < F.col("q"), 0).otherwise(1).alias("part"),
    )
    met = written(heads.groupBy("c", "i", "j").applyInArrow(lambda t: _leader_rows(t), FOUND), "leader-links")
    out = out.unionByName(met.filter(F.col("kind") == LINK).select("a", "b"))
    # an open pair's smaller cluster visits the other: members of a host are sent once for so many visitors
    open_ = met.filter(F.col("kind") == OPEN).select(F.col("a").alias("host"), F.col("b").alias("leader"), F.col("d").alias("between"))
    if open_.isEmpty():
        return out
    rooms = open_.groupBy("host").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("rooms"))
    hosts = of.join(rooms, of["leader"] == rooms["host"]).select("host", "doc_id", F.explode(F.sequence(F.lit(0), F.col("rooms") - 1)).alias("v"))
    wide = about.join(rooms, about["leader"] == rooms["host"]).select("host", "rooms", "radius")
    guests = open_.join(wide, "host").join(of.select("leader", "doc_id", "d"), "leader")
    guests = guests.filter(F.col("d") >= F.col("between") - F.lit(FAR + MARGIN) - F.col("radius"))
    guests = guests.select("host", "doc_id", F.pmod(F.xxhash64("leader"), F.col("rooms")).cast("int").alias("v"))
    both = hosts.withColumn("visits", F.lit(0)).unionByName(guests.withColumn("visits", F.lit(1)))
    both = both.join(members.select("doc_id", "n", "tokens"), "doc_id")
    return out.unionByName(both.groupBy("host", "v").applyInArrow(lambda t: _visit_rows(t), EDGE))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _row_id() -> Column:
    """The doc_id; a null one gets a stand-in above all ids, from the text."""
    stand_in = F.lit(2**63 - 1) - F.pmod(F.xxhash64(_text()), F.lit(1 << STAND_IN_BITS))
    return F.coalesce(F.col("doc_id").cast("long"), stand_in)


def _classes(docs: DataFrame) -> DataFrame:
    """real (the doc_id), doc_id (or its stand-in), m (the text's hash), n_shingles and least, the least id of the class, of every row."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(_text()))).first()[0] or 0
    n, buckets = (max(partitions(spark), -(-size // x)) for x in (BLOCK_BYTES, BUCKET_BYTES))
    named = docs.select(F.col("doc_id").cast("long").alias("real"), _row_id().alias("doc_id"), _text().alias("text"))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(n))
    dealt = named.select("doc_id", F.md5("text").alias("m"), "text").withColumn("block", block).repartition(n, "block")
    texts = named.select("real", "doc_id", F.md5("text").alias("m"))
    owners = texts.groupBy("m").agg(F.min("doc_id").alias("owner"))
    told = (
        owners.select(F.col("owner").alias("doc_id"))
        .withColumn("block", block)
        .groupBy("block")
        .agg(F.collect_list("doc_id").alias("ids"))  # those of one block
    )

    def pack_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [{"block": r["block"], "kind": OWNERS, "bucket": 0, "a": np.array(r["ids"], np.int64).tobytes()} for r in b.to_pylist()]
            yield from pa.Table.from_pylist(out, schema=TOLD_PA).to_batches()

    def first(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return send_tokens(key[0].as_py(), left, right, buckets)

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        return ordered_sets(left, right, buckets)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _prefix_rows(b, buckets).to_batches()

    told = told.mapInArrow(pack_ids, TOLD)
    sent = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(first, SENT)
    told = told.unionByName(sent.groupBy("bucket").applyInArrow(lambda t: answer_tokens(t), TOLD))
    info = written(dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(second, INFO), "sets")
    open_ = info.filter("tokens is not null")
    stars = open_.select("doc_id", "base", "tokens").mapInArrow(prefixes, SENT).groupBy("bucket").applyInArrow(lambda t: _stars(t), EDGE)
    links = _linked(open_, components(stars), partitions(spark))
    classes = components(written(links, "links"))
    # a row per text, with its set size and class, that all rows look up; one text may be a third of all rows
    named_class = classes.select(F.col("v").alias("doc_id"), "c")
    rows_of = texts.groupBy("m").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("k"))
    of_text = info.select("doc_id", "m", F.col("n").alias("n_shingles")).join(rows_of, ["doc_id", "m"]).join(named_class, "doc_id", "left")
    of_text = of_text.select("m", "k", "n_shingles", F.coalesce("c", "doc_id").alias("least"))
    return skewed_lookup(texts, written(of_text, "texts"), "m", "k", ["doc_id"], partitions(spark))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    named = F.when(F.col("least") <= F.lit(2**63 - 1 - (1 << STAND_IN_BITS)), F.col("least"))
    return _classes(docs).select(
        F.col("real").alias("doc_id"), "n_shingles", F.when(F.col("n_shingles") == 0, F.col("real")).otherwise(named).alias("component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, the one that names it; of a class of null ids alone one row.

    A row is known by its id, or the stand-in of a null one, and its text. Rows without words are in no class and stay.
    """
    gone = _classes(docs).filter("n_shingles > 0 and doc_id <> least").select("doc_id", "m").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # no name of a column can clash with ours
    anonymous = F.col("doc_id").isNull() & _text().rlike(HAS_WORD)
    keyed = docs.select(row, _row_id().alias("doc_id"), F.md5(_text()).alias("m"), anonymous.alias("anonymous"))
    once = keyed.filter("anonymous").dropDuplicates(["doc_id", "m"])
    kept = keyed.filter("not anonymous").unionByName(once).join(gone, ["doc_id", "m"], "left_anti")
    return kept.select(*[F.col(f"row.`{c}`") for c in docs.columns])
