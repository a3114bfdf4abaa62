"""Meters over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

METER = "key string, n long, median double, avg double, max double, last double, total double, count long"
STATE = "window array<double>, total double, count long"


def smoothed_stream(events: DataFrame, key: str, order: str, value: str, window: int = 20) -> DataFrame:
    """Per key and micro-batch the meter after its rows: window statistics, running total and count.

    State per key is the window (bounded) and two numbers. Rows of a batch count in ``order``.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, total, count = state.get if state.exists else ([], 0.0, 0)
        rows = pd.concat(list(batches)).sort_values("o", kind="stable")["v"].dropna().tolist()
        if not rows:
            return
        held = (list(held) + rows)[-window:]
        total, count = total + sum(rows), count + len(rows)
        state.update((held, total, count))
        mid = sorted(held)[(len(held) - 1) // 2]
        yield pd.DataFrame(
            {
                "key": [k[0]], "n": [len(rows)], "median": [mid], "avg": [sum(held) / len(held)], "max": [max(held)],
                "last": [held[-1]], "total": [total], "count": [count],
            }
        )

    rows = events.select(F.col(key).cast("string").alias("k"), F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("k").applyInPandasWithState(update, METER, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_totals(events: DataFrame, ts: str, value: str, keys: list[str], size: str, late: str) -> DataFrame:
    """Totals of event-time windows with a watermark; the time column is cast, as watermarks need a timestamp."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    g = e.groupBy(F.window("_ts", size), *keys).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "total", "n")


def log_batches(stream: DataFrame, sink, every: int = 1):
    """``sink(rows, batch_id)`` for every ``every``-th micro-batch."""
    return stream.writeStream.outputMode("update").foreachBatch(lambda rows, k: sink(rows, k) if k % every == 0 else None)
