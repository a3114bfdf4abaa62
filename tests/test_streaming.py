from __future__ import annotations

from loomery.operators.metrics import smoothed
from loomery.streaming import meters
from pyspark.sql import functions as F


def test_stream_ends_as_the_batch_does(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").select("event_id", "user_id", "value", "ts")
    parts = tmp_path / "in"
    events.repartitionByRange(3, "event_id").write.parquet(str(parts))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(parts))
    got = {}

    def keep(rows, k):
        for r in rows.collect():
            if r.key not in got or r["count"] > got[r.key]["count"]:
                got[r.key] = r

    q = meters.log_batches(meters.smoothed_stream(stream, "user_id", "event_id", "value"), keep).start()
    q.processAllAvailable()
    q.stop()
    totals = {str(r.user_id): r for r in events.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("s")).collect()}
    assert {k: r["count"] for k, r in got.items()} == {k: r.n for k, r in totals.items()}
    assert all(abs(got[k].total - r.s) < 1e-6 for k, r in totals.items())


def test_window_totals(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    got = meters.windowed_totals(events, "ts", "value", ["event_type"], "1 day", "1 hour")
    assert got.agg(F.sum("n")).first()[0] == events.count()
