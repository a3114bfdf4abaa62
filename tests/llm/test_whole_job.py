"""Cases in which an operator did less than its whole job."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from loomery.llm import bytes_np, decontaminate, ngram_join, quality_rules
from loomery.llm.html_text import main_text

from tests.llm.conftest import WORD, frame


def test_documents_that_share_a_second_line_are_counted_each(spark):
    rnd = random.Random(6)
    prose = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    rows = [(i, "\n".join(["share this page", *(f"also common {k}" for k in range(i % 2 * 20)), prose(60)]), "a") for i in range(120)]
    got = {r.doc_id: r for r in quality_rules.measure(frame(spark, rows)).collect()}
    for i in range(120):
        assert got[i].line_chars_removed == len("sharethispage") + (sum(len(f"alsocommon{k}") for k in range(20)) if i % 2 else 0)


def _verdicts(rows, least: int, share: float):
    """{doc_id: (characters in frequent lines, kept)} by the rule, document by document."""
    norm = lambda x: " ".join(WORD.findall(x.lower()))
    texts, lines = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        n = tuple(norm(x) for x in (t or "").split("\n") if WORD.search(x))
        texts[s].add(n)
        for x in n:
            lines[s, x].add(n)
    out = {}
    for d, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        gone = sum(len("".join(WORD.findall(x))) for x in t.split("\n") if WORD.search(x) and least < len(lines[s, norm(x)]) > share * len(texts[s]))
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        size = sum(map(len, w))
        out[d] = (gone, not failed and size - gone >= 0.5 * size)
    return out


def test_every_distinct_document_of_a_line_counts(spark):
    rnd = random.Random(7)
    prose = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    shared = [prose(3) for _ in range(40)]
    rows = [(i, "\n".join([*shared, prose(30 + i)]), "a") for i in range(200)]
    rows += [(200 + i, prose(90), "a") for i in range(100)]
    got = {r.doc_id: r for r in quality_rules.measure(frame(spark, rows)).collect()}
    removed = sum(len(x.replace(" ", "")) for x in shared)
    assert all(got[i].line_chars_removed == removed for i in range(200))  # all 40 lines
    assert {d: (r.line_chars_removed, r.kept) for d, r in got.items()} == _verdicts(rows, 50, 0.05)
    assert len({r.kept for r in got.values()}) == 2  # the short ones are depleted


def test_rows_that_repeat_a_text_are_one_document(spark, docs):
    rnd = random.Random(9)
    text = "\n".join(" ".join(f"w{rnd.randrange(10**6)}" for _ in range(12)) for _ in range(8))
    rows = [(i, text if i % 2 else text.upper().replace(" ", "  "), "a") for i in range(300)]
    rows += [(1000 + k, t, s) for k, (_, t, s) in enumerate(docs)]  # nulls, empty and long texts, null sources
    got = {r.doc_id: (r.line_chars_removed, r.kept) for r in quality_rules.measure(frame(spark, rows)).collect()}
    assert got == _verdicts(rows, 50, 0.05)
    assert all(got[i] == (0, True) for i in range(300))
    kept = {r.doc_id: r.text for r in quality_rules.apply_rules(frame(spark, rows)).collect()}
    assert set(kept) == {d for d, v in got.items() if v[1]} and kept[1] == text
    bare = frame(spark, rows).drop("source")
    assert quality_rules.apply_rules(bare).columns == bare.columns
    assert quality_rules.apply_rules(bare.limit(0)).count() == 0


def test_texts_with_equal_hashes_keep_their_own_ids():
    """Such strings collide under any polynomial hash modulo 2**64."""
    from loomery.llm.queries import tokenizer_file
    from loomery.llm.token_files import Encoder

    enc = Encoder(tokenizer_file("byte_bpe_50k.json"))
    x = "a"
    while len(x) < 2048:
        x += x.translate({97: "b", 98: "a"})
    y = x.translate({97: "b", 98: "a"})
    for texts in ([x, "and", y], [y], [x], [f"{x} {y}", f"{y} {x}"]):
        for t, ids in zip(texts, enc.encode(texts), strict=True):
            assert ids.tolist() == enc.library.encode(t, add_special_tokens=False).ids
    data = np.frombuffer((x + y).encode(), np.uint8)
    one, two = bytes_np.span_hash(bytes_np.prefix_sums(data), np.array([0, 2048]), np.array([2048, 4096])).tolist()
    assert one != two


def test_edited_copies_are_found_by_their_most_frequent_seeds(spark):
    w = [f"q{k}" for k in range(15)]
    edited = " ".join("new" if k in (3, 7, 11) else x for k, x in enumerate(w))
    long = [f"r{k}" for k in range(60)]
    fourth = " ".join("new" if k % 4 == 3 else x for k, x in enumerate(long))
    rows = [(1, f"before {edited} after", "s0"), (2, f"before {fourth} after", "s0")]
    rows += [(10 + i, " ".join(w[:3]) + f" x{i} " + " ".join(w[12:]), "s0") for i in range(20)]  # intact seeds are frequent
    bench = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(long))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(frame(spark, rows), bench).collect()}
    assert got == {(1, 1), (2, 2)}


@pytest.mark.parametrize("start", ["<body>", "", "</head>", "</head><body>", "<noscript><link href=x></noscript><body>", "<noscript><img src=x><body>"])
def test_a_head_may_be_left_open(start):
    prose = "The quick brown fox jumps over the lazy dog near the river bank while it rains."
    assert main_text(f"<html><head><title>t</title><meta charset=utf-8><script>x</script>\n{start}<div><p>{prose}</p><p>{prose}</p></div>") == f"{prose} {prose}"
    assert main_text(f"<html><head><title>t</title>{start}{prose}") == prose


def test_one_row_stays_of_each_class_with_null_ids(spark):
    rnd = random.Random(8)
    prose = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(100))
    a, b, c = prose(), prose(), prose()
    rows = [(7, a, "s0"), (None, a, "s1"), (None, a + " more", "s0")]  # a class that 7 names
    rows += [(None, b, "s0"), (None, b, "s0"), (None, b, "s1"), (None, b + " more", "s0"), (None, "less " + b, "s2")]
    rows += [(None, c, "s0"), (None, "", "s0"), (None, "", "s0"), (None, None, "s0"), (8, " ", "s0")]
    kept = ngram_join.keep_one(frame(spark, rows)).collect()
    assert [r.doc_id for r in kept if r.text == a] == [7] and not any(r.text == a + " more" for r in kept)
    assert sum(b in (r.text or "") for r in kept) == sum(r.text == c for r in kept) == 1
    assert sum(not (r.text or "").strip() for r in kept) == 4 and len(kept) == 7


def test_seeds_lose_no_alignment():
    """All pairs aligned against the operator's own: every 2nd to 8th word replaced, missing or followed by others."""
    rnd = random.Random(10)
    vocab = [f"v{k}" for k in range(300)]
    some = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [some(rnd.choice([5, 8, 15, 30, 60])) for _ in range(16)]
    copies, texts = [], []
    for it in items:
        for k in range(2, 9):
            copies.append(["new" if i % k == k - 1 else w for i, w in enumerate(it)])
            copies.append([w for i, w in enumerate(it) if i % k])
            copies.append([x for i, w in enumerate(it) for x in [w, *["more"] * (rnd.randint(1, 3) if i % k == 0 else 0)]])
        copies.append(it[: len(it) // 2] + some(len(it) // 2 - 1) + it[len(it) // 2 :])
    texts = [" ".join(some(20) + c + some(20)) for c in copies] + [None, "", "one"]
    words = [decontaminate.item_words(" ".join(x)) for x in items]
    want = {}
    for r, t in enumerate(texts):
        x = decontaminate.item_words(t)
        for i, w in enumerate(words):
            share = decontaminate.align(w, x)[0] / (2 * len(w))
            if share >= 0.5:
                want[r, i] = share
    seeds = decontaminate.Seeds(list(range(len(items))), words)
    for frequency in (np.zeros(len(seeds.hashes), np.int64), np.random.default_rng(0).integers(0, 9, len(seeds.hashes))):
        seeds.select(frequency)
        got = {}
        for a, w, first in decontaminate.document_words(pa.array(texts, pa.string())):
            got |= {(a + m[0], m[1]): m[2] for m in decontaminate.matches(w, first, seeds)}
        assert got == want and len(want) > 200


def test_short_items_are_whole_documents(spark):
    bench = spark.createDataFrame([(1, "Yes."), (2, "not at all"), (3, "not at all"), (4, " ")], "item_id long, text string")
    rows = [(1, "yes", "s"), (2, "yes it is", "s"), (3, "Not at ALL!", "s"), (None, "yes", "s"), (5, "", "s"), (6, None, "s")]
    got = {(r.doc_id, r.item_id, r.score) for r in decontaminate.find(frame(spark, rows), bench).collect()}
    assert got == {(1, 1, 1.0), (None, 1, 1.0), (3, 2, 1.0), (3, 3, 1.0)}
    assert {r.doc_id for r in decontaminate.clean(frame(spark, rows), bench).collect()} == {2, 5, 6}


def test_blocks_of_the_benchmark_find_the_same(spark, docs, monkeypatch):
    items = [(k, " ".join(t.split()[:30])) for k, (_, t, _) in enumerate(docs) if t and len(t.split()) > 5]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, docs)
    once = sorted(map(repr, decontaminate.find(df, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 4000)
    assert sorted(map(repr, decontaminate.find(df, bench).collect())) == once and len(once) >= len(items)


def _family(rng, m: int):
    base = np.arange(100, dtype=np.uint64)
    tokens = [np.delete(base, rng.integers(0, 100, 3)) for _ in range(m)]
    return np.arange(m), np.array([len(t) + 3 for t in tokens]), np.ones(m, int), np.full(m, 30), tokens


def test_a_large_group_of_near_copies_takes_linear_time():
    import time

    rng = np.random.default_rng(0)

    def seconds(m):
        group = _family(rng, m)
        begin = time.process_time()
        links, leader, _, label = ngram_join.clusters(*group)
        assert len(links) == m - 1 and len(set(leader)) == len(set(label)) == 1
        return time.process_time() - begin

    seconds(500)
    assert seconds(16_000) < 12 * seconds(4000)


def _joined(sets, dealt):
    """Classes by ``clusters``, in one task or dealt over three with ``leaders`` and open pairs."""
    df = Counter(t for s in sets for t in s)
    rows = []
    for i, s in enumerate(sets):
        shared = sorted((df[t], t) for t in s if df[t] > 1)
        if s and len(shared) >= ngram_join.needed(len(s)):
            ell, _, reach = ngram_join.prefix_choice(len(s), np.array([x[0] for x in shared]))
            rows.append((i, len(s), ell, reach, np.array([x[1] for x in shared], np.uint64)))
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    def run(f, some, *more):
        columns = [np.array([r[k] for r in some]) for k in range(4)]
        return f(columns[0], columns[1], *(more or columns[2:]), [r[4] for r in some])

    members, heads = defaultdict(list), []
    for q in range(dealt):
        some = [r for r in rows if r[0] % dealt == q]
        if some:
            links, leader, dist, _ = run(ngram_join.clusters, some)
            for x, y in links:
                up[find(some[x][0])] = find(some[y][0])
            for r, y, d in zip(some, leader, dist, strict=True):
                members[some[y][0]].append((r, d))
            heads += [some[y] for y in sorted(set(leader))]
    if dealt > 1 and heads:
        columns = [np.array([h[1] for h in heads]), [max(d for _, d in members[h[0]]) for h in heads], [find(h[0]) for h in heads], [h[4] for h in heads]]
        links, open_ = ngram_join.leaders(*columns)
        half = len(heads) // 2
        parted = ngram_join.leaders(*columns, np.arange(len(heads)) >= half)
        assert {(x, y) for x, y, _ in parted[1]} <= {(x, y) for x in range(half, len(heads)) for y in range(half)}
        for x, y in links:
            up[find(heads[x][0])] = find(heads[y][0])
        for x, y, between in open_:
            host = [r for r, _ in members[heads[x][0]]]
            guests = [r for r, d in members[heads[y][0]] if d >= between - 0.25 - columns[1][x] - 1e-9]
            both = host + guests
            for a, b in ngram_join.visits(np.array([r[1] for r in both]), np.arange(len(both)) < len(host), [r[4] for r in both]):
                up[find(both[a][0])] = find(both[b][0])
    return [find(x) for x in range(len(sets))]


@pytest.mark.parametrize("dealt", [1, 3])
def test_clusters_and_leaders_lose_no_link(dealt):
    for seed in range(60):
        rnd = random.Random(seed)
        bases = [rnd.sample(range(300), 60) for _ in range(3)]
        sets = []
        for _ in range(50):
            s = set(rnd.choice(bases)[: rnd.randint(30, 60)])
            for _ in range(rnd.randrange(10)):
                s.symmetric_difference_update({rnd.randrange(300)})
            sets.append(s)
        up = list(range(len(sets)))

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    up[find(i)] = find(j)
        got = _joined(sets, dealt)
        pairs = {(find(i), got[i]) for i in range(len(sets))}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_an_id_with_several_texts_is_one_class(spark):
    rnd = random.Random(13)
    a, b, c = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    rows = [(1, a, "s"), (2, a, "s"), (2, b, "s"), (3, b, "s"), (3, b, "s"), (4, c, "s")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame(spark, rows)).collect())
    assert got == Counter({(1, 56, 1): 1, (2, 56, 1): 2, (3, 56, 1): 2, (4, 56, 4): 1})
