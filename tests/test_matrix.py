"""The similarity matrix: every query row against every row, in even tasks whatever the labels are."""

from __future__ import annotations

import math

from loomery.operators import matrix
from loomery.plans import catalogue
from pyspark.sql import functions as F


def vectors(spark, folder, n, label):
    x = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: (F.pmod(F.xxhash64("id", k), F.lit(2001)) / 1000.0 - 1).cast("float"))
    df = spark.range(0, n, 1, 4).select(F.col("id").alias("vec_id"), x.alias("embedding"), label.cast("int").alias("label"))
    df.write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_pairs_of_all_labels(spark, tmp_path):
    folder = vectors(spark, tmp_path, 300, F.col("id") % 7)
    got = catalogue.queries()["cosine_matrix"](spark, folder).toPandas()
    assert len(got) == 15 * 300 and not got.duplicated(["vec_id", "o_vec_id"]).any()
    assert set(got["vec_id"]) == set(range(0, 300, 20)) and set(got["o_vec_id"]) == set(range(300))


def test_a_label_of_all_rows_is_dealt_evenly(spark, tmp_path):
    folder = vectors(spark, tmp_path, 6000, F.lit(1))
    sizes = catalogue.queries()["cosine_matrix"](spark, folder).groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.sum() == 300 * 6000 and len(sizes) > 3 and sizes.max() < sizes.sum() / 2


def test_cosines_of_odd_vectors(spark):
    rows = [(0, [3.0, 4.0]), (1, [-4.0, 3.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [1.0, 2.0, 2.0]), (None, [1.0, 1.0]), (7, []), (8, [1.0, -1.0 - 1e-6])]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    got = {(r.k, r.o_k): r.sim for r in matrix.cosine_pairs(df, df, "k", "v", 5).collect()}
    assert len(got) == len(rows) ** 2

    def want(x, y):
        if x is None or y is None or len(x) != len(y) or None in x + y:
            return None
        size = lambda v: math.sqrt(sum(a * a for a in v))
        return round(sum(a * b for a, b in zip(x, y)) / (size(x) * size(y) + 1e-8), 5)

    assert got == {(a, b): want(x, y) for a, x in rows for b, y in rows}
    assert math.copysign(1, got[None, 8]) == -1  # a small negative cosine becomes a negative zero, as in SQL
