"""Values on which Spark's own rounding and text functions differ from the SQL."""

from __future__ import annotations

import random
import struct

import duckdb
import pytest
from loomery.functions import numeric, text
from loomery.plans import catalogue
from oracle import connect
from pyspark.sql import functions as F


def both(spark, name: str, folder) -> tuple[list, list]:
    """The rows of a query and of its SQL as text, so that signs of zero count."""
    df = catalogue.queries()[name](spark, str(folder))
    rel = connect(str(folder)).sql(catalogue.oracle_sql()[name])
    want = rel.fetchall()
    return sorted(repr(tuple(r)) for r in df.select(*rel.columns).collect()), sorted(repr(tuple(r)) for r in want)


@pytest.mark.parametrize("name", ["matrix_patterns", "segment_round", "segment_stride"])
def test_small_negative_numbers_round_to_negative_zero(spark, tmp_path, name):
    sign = F.when(F.col("id") % 2 == 0, -1).otherwise(1)
    x = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: (sign * k * 1.7e-8).cast("float"))
    spark.range(0, 4, 1, 1).select(F.col("id").alias("vec_id"), x.alias("embedding"), F.lit(1).alias("label")).toPandas().to_parquet(tmp_path / "embeddings.parquet")
    got, want = both(spark, name, tmp_path)
    assert got == want and "-0.0," in str(got)


def test_rounded(spark):
    rows = [(x,) for x in (0.5, -0.5, 2.5e-6, -4.9e-7, -0.0, 0.0, 1e300, float("inf"), float("nan"), None, 0.1234565, -7.0000005)]
    got = [r.x for r in spark.createDataFrame(rows, "v double").coalesce(1).select(numeric.rounded(F.col("v"), 6).alias("x")).collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", r).fetchone()[0] for r in rows]
    assert repr(got) == repr(want)


def test_one_decimal_is_of_the_exact_number(spark):
    draw = random.Random(5)
    values = [0.05, 0.25, 0.75, 752.25, 1.45, 0.35, -0.04, -2.25, 0.0, -0.0, 999.95, 999.9500000000001, 9.96, 2.0**52 + 0.5, 2.0**60, 1e-300, 1e12]
    values += [draw.randrange(10**6) / 1000 for _ in range(300)] + [draw.randrange(1 << 20) / 64 for _ in range(300)]
    values += [struct.unpack("d", struct.pack("Q", struct.unpack("Q", struct.pack("d", draw.randrange(10**4) / 20 + 0.05))[0] + draw.choice([-1, 0, 1])))[0] for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.s for r in df.select("i", text.one_decimal(F.col("v")).alias("s")).orderBy("i").collect()]
    assert got == [f"{v:.1f}" for v in values]
    assert df.limit(1).select(text.one_decimal(F.lit(None).cast("double")).alias("s")).first().s is None


def test_suffixes_of_large_keys(spark, tmp_path):
    keys = [1, 4509, 5, 164398, 164399, 899999]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").toPandas().to_parquet(tmp_path / "customer.parquet")
    got, want = both(spark, "size_suffix", tmp_path)
    assert got == want and "752.2M" in str(got) and "1000.0G" in str(got)


def test_ranges_without_a_time(spark, tmp_path):
    rows = "SELECT * FROM (VALUES (1, TIMESTAMP '2024-01-02 03:04:05.9'), (2, TIMESTAMP '2024-01-02 03:04:05'), (3, NULL), (4, NULL), (NULL, TIMESTAMP '2024-01-02 23:59:59'), (-6, TIMESTAMP '1969-12-31 23:59:59.5'), (-7, TIMESTAMP '1969-12-31 23:59:59.5')) t(event_id, ts)"
    duckdb.execute(f"COPY ({rows}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got, want = both(spark, "parse_range", tmp_path)
    assert got == want
