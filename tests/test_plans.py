"""Plans that have to hold at scale: pruned scans, pushed filters, no single-task sorts, no cross products."""

from __future__ import annotations

import re

import pytest
from loomery.operators import ordering, relational
from loomery.plans import catalogue
from pyspark.sql import functions as F


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_what_is_used(spark, small):
    text = plan(catalogue.queries()["user_usage"](spark, small))
    assert re.findall(r"ReadSchema: struct<([^>]*)", text) == ["event_id:bigint,user_id:bigint,event_type:string,value:double"]


def test_filters_reach_the_scan(spark, small):
    docs = spark.read.parquet(f"{small}/orders.parquet")
    assert "GreaterThan(o_custkey,100)" in plan(docs.filter("o_custkey > 100").select("o_orderkey"))
    assert "In(n_regionkey, [1,3])" in plan(catalogue.queries()["isin_filter"](spark, small))


def test_limit_with_order_is_a_top_n(spark, small):
    assert "TakeOrderedAndProject" in plan(catalogue.queries()["top_n"](spark, small))


def test_top_k_is_cut_before_the_exchange(spark, small):
    text = plan(catalogue.queries()["topk_per_group"](spark, small))
    assert text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["chunk_shuffle", "length_ranges", "retention_plan", "rank_ntile", "tar_plan"])
def test_total_orders_are_ranges(spark, small, name, monkeypatch):
    monkeypatch.setattr(ordering, "written", lambda df, name: df)  # the whole plan at once
    text = plan(catalogue.queries()[name](spark, small))
    assert "rangepartitioning" in text
    # one task sees a row per partition, never the rows
    for part in text.split("Exchange SinglePartition")[1:]:
        assert re.search(r"HashAggregate\(keys=\[_(pid|placed_in)",  part.split("Exchange")[0])


def test_interval_lookup_is_an_equi_join(spark):
    spans = spark.range(100).select((F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 10).alias("hi"))
    out = relational.interval_lookup(spark.range(1000), "id", spans, "lo", "hi", 16)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    assert out.count() == 1000


def test_positions_are_right_with_many_partitions(spark):
    got = ordering.with_position(spark.range(500).repartition(9), ["id"]).collect()
    assert all(r.pos == r.id for r in got) and len(got) == 500


def test_positions_are_right_when_range_bounds_are_sampled(spark):
    """Ranges of many rows are sampled, and two samples of one table differ."""
    df = spark.range(600_000).select(F.hash("id").alias("k"), "id", F.concat(F.lit("payload"), "id").alias("p"))
    got = ordering.with_position(df, ["k", "id"]).select("k", "id", "pos").toPandas().sort_values(["k", "id"])
    assert got["pos"].tolist() == list(range(600_000))
    got = ordering.group_position(df.withColumn("g", F.when(F.col("id") % 3 > 0, F.col("id") % 7)), "g", ["k", "id"]).toPandas()
    want = got.sort_values(["g", "k", "id"]).groupby("g", dropna=False).cumcount()
    assert (got["pos"] == want.reindex(got.index)).all()


@pytest.mark.parametrize("name", ["source_positions", "source_mix", "grouped_batches", "grouped_samples", "shard_meta", "matching_rows", "nested_batch"])
def test_no_task_sorts_a_whole_source(spark, small, name, monkeypatch):
    monkeypatch.setattr(ordering, "written", lambda df, name: df)
    text = plan(catalogue.queries()[name](spark, small))
    assert set(re.findall(r"windowspecdefinition\((\w+)#", text)) <= {"_pid", "_placed_in"}


def test_hot_keys_alone_are_broadcast(spark):
    left = spark.range(9000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 700).alias("k"), "id")
    right = left.filter("k <> 5").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first")).cache()
    out = relational.skewed_lookup(left, right, "k", "n", ["id"], 4)
    assert out.columns == ["k", "id", "first"] and right.filter(F.col("n") * 4 > 9000).count() == 1
    want = left.join(right, "k", "left").select("k", "id", "first")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert re.search(r"hashpartitioning\(k#\w+, _salt#", plan(out.hint("merge")) + plan(relational.skewed_lookup(left.hint("merge"), right.hint("merge"), "k", "n", ["id"], 4)))
    assert relational.skewed_lookup(left, right.limit(0), "k", "n", ["id"], 4).filter("first is null").count() == 9000
