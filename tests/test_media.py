from __future__ import annotations

from loomery.sources import media
from pyspark.sql import functions as F


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_geometry(spark):
    assert tuple(one(spark, media.resized(F.lit(100), F.lit(201), 50))) == (50, 100)
    assert tuple(one(spark, media.resized(F.lit(201), F.lit(100), 50))) == (100, 50)
    assert tuple(one(spark, media.center_crop(F.lit(100), F.lit(101), 50, 50))) == (25, 26)


def test_pixels(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, media.normalize(a(255, 0), 0.5, 0.5)) == [1.0, -1.0]
    assert one(spark, media.flip_rows(F.array(a(1, 2), a(3, 4)))) == [[2.0, 1.0], [4.0, 3.0]]
    assert [round(x, 6) for x in one(spark, media.grayscale(a(1), a(1), a(1)))] == [1.0]
    assert one(spark, media.channels_first(F.array(a(1, 2), a(3, 4)))) == [[1.0, 3.0], [2.0, 4.0]]


def test_clips(spark):
    df = spark.createDataFrame([("frame", 30.0, 60.0, 30.0), ("second", 1.5, 2.0, 30.0)], "unit string, start double, end double, fps double")
    assert [(r.start, r.end) for r in media.clip_plan(df).collect()] == [(1.0, 2.0), (1.5, 2.0)]
