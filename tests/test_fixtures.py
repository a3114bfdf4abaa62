"""Micro-fixtures worked out by hand, one per quirk."""

from __future__ import annotations

import pytest
from loomery.functions import boxes, numeric, text, urls
from loomery.operators import metrics, ordering, relational, sampling, sequence
from pyspark.sql import functions as F


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v))
    return df.select(column.alias("x")).first().x


def test_stride_drops_the_remainder(spark):
    x = [float(i) for i in range(9)]
    assert one(spark, sequence.resample_stride(F.col("a"), 3), a=x) == [1.0, 4.0]
    assert one(spark, sequence.resample_stride(F.col("a"), 3, keep_remainder=True), a=x) == [1.0, 4.0, 7.0]
    assert one(spark, sequence.resample_stride(F.col("a"), 9), a=x) == []


def test_round_mode(spark):
    x = [float(i) for i in range(10)]
    assert one(spark, sequence.resample_round(F.col("a"), 5), a=x) == [0.5, 2.5, 4.5, 6.5, 8.0]
    assert one(spark, sequence.resample_round(F.col("a"), 4), a=[7.0, 9.0]) == [7.0, 7.0, 9.0, 9.0]
    assert one(spark, sequence.resample_round(F.col("a"), 5, "tail"), a=x) == [1.0, 3.0, 5.0, 7.0, 8.0]
    assert one(spark, sequence.resample_round(F.col("a"), 5, "center"), a=x) == [1.0, 3.0, 5.0, 7.0, 8.0]
    assert len(one(spark, sequence.resample_round(F.col("a"), 5, "random"), a=x)) == 5


def test_sample_indices(spark):
    assert one(spark, numeric.sample_indices(F.col("n"), max_len=4), n=10) == [0, 3, 6, 9]
    assert one(spark, numeric.sample_indices(F.col("n"), max_len=4), n=1) == [0]
    assert one(spark, numeric.sample_indices(F.col("n"), max_len=1), n=7) == [6]
    assert one(spark, numeric.sample_indices(F.col("n"), stride=4), n=10) == [0, 4, 8, 9]
    with pytest.raises(ValueError):
        numeric.sample_indices(F.col("n"))


def test_padding(spark):
    assert one(spark, sequence.pad(F.col("a"), F.lit(4), F.lit(0)), a=[1, 2]) == [1, 2, 0, 0]
    assert one(spark, sequence.pad_last(F.col("a"), F.lit(4)), a=[1, 2]) == [1, 2, 2, 2]
    assert one(spark, sequence.pad_mask(F.col("a"), F.lit(4), "left"), a=[1, 2]) == [0, 0, 1, 1]
    with pytest.raises(Exception, match="longer"):
        one(spark, sequence.pad(F.col("a"), F.lit(1), F.lit(0)), a=[1, 2])


def test_last_wins_and_lower_median(spark):
    df = spark.createDataFrame([("a", 1, "v1"), ("a", 2, "v2")], "k string, o int, v string")
    assert relational.last_by_key(df, ["k"], "o").first().v == "v2"
    m = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 2, 3, 4])], "k string, o int, v double")
    got = [r.median for r in metrics.smoothed(m, ["k"], ["o"], "v").orderBy("o").collect()]
    assert got == [1.0, 1.0, 2.0, 2.0]


def test_spans(spark):
    args = lambda *v: [F.lit(float(x)) for x in v]
    assert one(spark, F.round(boxes.span_iou(*args(0, 10, 5, 15)), 9)) == round(1 / 3, 9)
    assert one(spark, F.round(boxes.span_giou(*args(0, 10, 5, 15)), 9)) == round(2 / 3, 9)
    assert one(spark, boxes.span_iou(*args(3, 3, 3, 3))) is None


def test_boxes(spark):
    b = boxes.xyxy(*[F.lit(float(x)) for x in (0, 0, 9, 4)])
    assert tuple(one(spark, boxes.to_xywh(b))) == (0, 0, 10, 5)
    assert one(spark, boxes.area(b)) == 50
    c = boxes.xyxy(*[F.lit(float(x)) for x in (1, 1, 3, 3)])
    assert tuple(one(spark, boxes.flip_left_right(c, F.lit(10.0)))) == (6, 1, 8, 3)
    assert tuple(one(spark, boxes.flip_top_bottom(c, F.lit(10.0)))) == (1, 7, 3, 9)
    assert tuple(one(spark, boxes.crop(c, *[F.lit(x) for x in (2.0, 2.0, 4.0, 4.0)]))) == (0, 0, 1, 1)


def test_retention_and_ranges(spark):
    df = spark.createDataFrame([(i, 4) for i in range(3)], "i int, size int")
    assert ordering.keep_recent(df, [F.desc("i")], "size", 8, 10).count() == 1
    s = spark.createDataFrame([(0, 3), (1, 0), (2, 2)], "k int, n int")
    r = ordering.lengths_to_ranges(s, "k", "n")
    assert [(x.lo, x.hi) for x in r.orderBy("k").collect()] == [(0, 3), (3, 3), (3, 5)]
    found = relational.interval_lookup(spark.createDataFrame([(3,)], "i int"), "i", r, "lo", "hi", 2).collect()
    assert [(x.k, x.i - x.lo) for x in found] == [(2, 0)]


def test_rank_blocks_and_quota(spark):
    df = spark.range(10).withColumnRenamed("id", "pos")
    got = sampling.rank_block(df, "pos", 10, 4)
    assert sorted((r.slot, r.pos) for r in got.filter("rank = 3").collect()) == [(0, 9), (1, 0), (2, 1)]
    assert sampling.rank_block(df, "pos", 10, 4, drop_last=True).count() == 8
    assert sampling.quotas(5, [1, 4]) == [1, 4]
    parts = sampling.rank_split(df, "pos", 10, 4).groupBy("rank").count().orderBy("rank").collect()
    assert [r["count"] for r in parts] == [3, 3, 2, 2]


def test_batches_never_mix(spark):
    df = spark.range(50).select("id", (F.col("id") % 3).alias("g"))
    got = sampling.grouped_batches(df, "g", "id", 4)
    assert got.groupBy("batch").agg(F.countDistinct("g").alias("n")).filter("n > 1").isEmpty()
    assert got.select("id").distinct().count() == 50
    mixed = sampling.interleave(df, "g", "id")
    assert sorted(r.step for r in mixed.collect()) == list(range(50))


def test_text(spark):
    n = one(spark, text.split_name(F.lit("a/b.c/d.jpg.txt")))
    assert (n.base, n.ext) == ("a/b.c/d", ".jpg.txt")
    assert one(spark, text.clock_to_seconds(F.lit("1:02:03.5"))) == 3723.5
    assert one(spark, text.clock_to_seconds(F.lit("25:00:00"))) is None
    assert one(spark, text.delete_noisy_chars(F.lit(" a,b/c! "))) == "a b c"
    assert one(spark, text.format_with_suffix(F.lit(1234567.0))) == "1.2M"
    assert text.expand_braces("x-{08..11}.{a,b}") == [f"x-{i}.{c}" for i in ("08", "09", "10", "11") for c in "ab"]
    order = [one(spark, text.digit_version(F.lit(v))) for v in ("1.2a1", "1.2b1", "1.2rc1", "1.2", "1.2.post1", "1.10")]
    assert order == sorted(order)
    assert one(spark, text.map_to_text(F.create_map(F.lit("b"), F.lit(2.0), F.lit("a"), F.lit(1.0)), fmt="%.2f")) == "a=1.00, b=2.00"


def test_urls(spark):
    u = lambda f, *x: one(spark, f(*[F.lit(v) for v in x]))
    assert u(urls.url_dir, "http://h/a/b/c.tar?x=1") == "http://h/a/b?x=1"
    assert u(urls.url_dir_base, "http://h/a/b/c.tar?x=1") == "http://h/a/b"
    assert u(urls.url_dir_base, "/a/b.tar") == "file:///a"
    assert u(urls.url_merge, "http://h/a/b", "../c.tar?y") == "http://h/a/c.tar?y"
    assert u(urls.url_merge, "http://h/a/b", "/c/d") == "http://h/c/d"
    assert u(urls.query_id, "https://x/watch?v=abc&t=1") == "abc"


def test_captions(spark):
    rows = [(1, i, lines) for i, lines in enumerate([["A"], ["A"], [" "], ["B"], ["<c>x"], ["B"]])]
    got = sequence.captions(spark.createDataFrame(rows, "k int, o int, lines array<string>"), "k", "o").orderBy("o").collect()
    assert [r.lines for r in got] == [["A"], ["B"]]


def test_borders(spark):
    df = spark.createDataFrame([(1, 0, 2), (1, 2, 5), (1, 7, 9)], "k int, st int, ed int")
    assert [r["at"] for r in sequence.boundaries(df, "k", "st", "ed").orderBy("segment", "k").collect()] and sorted(
        r["at"] for r in sequence.boundaries(df, "k", "st", "ed").collect()
    ) == [0, 2, 5, 7, 9]


def test_byte_ranges(spark):
    got = one(spark, numeric.byte_ranges(F.col("n"), 4), n=10)
    assert [(r.s, r.e) for r in got] == [(0, 2), (3, 5), (6, 8), (9, 9)]


def test_required_lookup_fails_on_a_missing_key(spark):
    facts = spark.createDataFrame([(1,), (2,)], "k int")
    dim = spark.createDataFrame([(1, 0, "x")], "k int, o int, v string")
    assert relational.lookup(facts, dim, "k", "o").count() == 1
    with pytest.raises(Exception, match="no such key"):
        relational.lookup(facts, dim, "k", "o", required=True).collect()


def test_unequal_lists_are_an_error(spark):
    df = spark.createDataFrame([(1, [1, 2], [3])], "k int, a array<int>, b array<int>")
    with pytest.raises(Exception, match="differ"):
        sampling.flatten_lists(df, ["a", "b"], "k").collect()


def test_order_needs_no_single_task(spark):
    df = ordering.with_position(spark.range(1000).repartition(7), [F.desc("id")])
    assert [r.pos for r in df.orderBy(F.desc("id")).limit(5).collect()] == [0, 1, 2, 3, 4]
    assert df.agg(F.max("pos")).first()[0] == 999


def test_members_of_one_partition(spark):
    df = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q")], "node string, part string")
    assert relational.members(df, "node", ["a", "b"], single="part").count() == 2
    with pytest.raises(Exception, match="several values"):
        relational.members(df, "node", ["a", "c"], single="part").collect()


def test_versions(spark):
    known = {"1.8.0+cuda11": [1, 8, 0, 0, 0, 0], "1.0.0+abc": [1, 0, 0, 0, 0, 0], "1.2.dev3": [1, 2, 0, 0, -4, 0], "v2.0RC1": [2, 0, 0, 0, -1, 1], "1.0-3": [1, 0, 0, 0, 1, 3], "nonsense": None, "1.2.3.4.5": [1, 2, 3, 4, 0, 0]}
    for v, want in known.items():
        assert one(spark, text.digit_version(F.lit(v))) == want


def test_cells_are_never_cut(spark):
    assert one(spark, text.cell(F.col("a"), 3), a=[7, 123456]) == "007|123456"


def test_random_frames_are_one_of_each_interval(spark):
    for length in (3, 8, 11, 100):
        got = one(spark, numeric.frame_indices(8, F.col("n"), seed=1), n=length)
        assert got == sorted(set(got)) and len(got) == min(8, length) and 0 <= got[0] and got[-1] < length
    assert one(spark, numeric.frame_indices(8, F.col("n"), key=F.lit("a")), n=1000) != one(spark, numeric.frame_indices(8, F.col("n"), key=F.lit("b")), n=1000)
