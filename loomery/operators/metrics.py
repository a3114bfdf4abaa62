"""Meters: sliding-window and global statistics, evaluation and periodic log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _frame(keys: list[str], order: list[str], window: int):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - window, 0)


def smoothed(df: DataFrame, keys: list[str], order: list[str], value: str, window: int = 20) -> DataFrame:
    """Lower median, mean, largest and last value of the last ``window`` rows of each key."""
    w = _frame(keys, order, window)
    values = F.sort_array(F.collect_list(value).over(w))
    return df.withColumns(
        {
            "median": F.get(values, F.floor((F.size(values) - 1) / 2).cast("int")),
            "avg": F.avg(value).over(w),
            "max": F.max(value).over(w),
            "last": F.last(value).over(w),
        }
    )


def running(df: DataFrame, keys: list[str], order: list[str], value: str, total_steps: int | None = None) -> DataFrame:
    """Running total and count of each key, and the time left: mean so far times the steps that remain."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({"total": F.sum(value).over(w), "count": F.count(value).over(w)})
    if total_steps is not None:
        out = out.withColumn("eta", F.try_divide(F.col("total"), F.col("count")) * (F.lit(total_steps) - F.col("count")))
    return out


def global_avg(value: Column, n: Column) -> Column:
    """Weighted mean; counts and totals combine over partitions, windows do not."""
    return F.try_divide(F.sum(value * n), F.sum(n))


def evaluate(rows: DataFrame, id_: str, order: str, metrics: dict[str, Column]) -> DataFrame:
    """Rows repeated by padding are dropped (the last by ``order`` wins), then one row of metrics."""
    rest = [c for c in rows.columns if c != id_]
    unique = rows.groupBy(id_).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(id_, "_r.*")
    return unique.agg(*[c.alias(k) for k, c in metrics.items()])


def log_every(df: DataFrame, keys: list[str], order: list[str], value: str, every: int, window: int = 20) -> DataFrame:
    """The meters at every ``every``-th row of each key and at its last."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = running(smoothed(df, keys, order, value, window), keys, order, value)
    out = out.withColumns({"step": F.row_number().over(w) - 1, "_next": F.lead(F.lit(1)).over(w)})
    return out.filter((F.col("step") % every == 0) | F.col("_next").isNull()).drop("_next")


def failures(df: DataFrame, shard: str, status: str) -> DataFrame:
    """Rows that exhausted their tries, per shard."""
    return df.groupBy(shard).agg(F.count_if(F.col(status) == "failed").alias("n_failed"), F.count("*").alias("n"))
