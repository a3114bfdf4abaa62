"""Positions and running totals over a total order, without moving all rows to one task.

A window without partitions sorts everything in one task. Here rows are range-partitioned by the order and get their
place inside the partition; partition totals (a row per partition) give the offsets. Range bounds are sampled anew each
time a plan is run, and twice where a plan needs them with different columns, so the placed rows are written once and
both the totals and the result are read from that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.sources.shared import written


def _before(totals: DataFrame, names: dict[str, str], part: str = "_pid") -> DataFrame:
    """The sums over all partitions before each; ``totals`` has a row per partition."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(part, *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(o) for o, t in names.items()])


def with_prefix(df: DataFrame, order: list[Column | str], amounts: dict[str, Column]) -> DataFrame:
    """Adds, for each name, the running sum of its amount up to and with the row.

    Rows whose order values are equal stay in one partition; make the order unique for a defined result.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.withColumns({f"_a_{k}": v for k, v in amounts.items()}).repartitionByRange(*cols)
    dealt = dealt.withColumn("_pid", F.spark_partition_id())
    inside = Window.partitionBy("_pid").orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumns({f"_r_{k}": F.sum(f"_a_{k}").over(inside) for k in amounts})
    placed = written(placed, "placed")
    totals = placed.groupBy("_pid").agg(*[F.sum(f"_a_{k}").alias(f"_t_{k}") for k in amounts])
    offsets = _before(totals, {f"_o_{k}": f"_t_{k}" for k in amounts})
    out = placed.join(F.broadcast(offsets), "_pid")
    out = out.withColumns({k: F.col(f"_r_{k}") + F.col(f"_o_{k}") for k in amounts})
    return out.select(*[c for c in out.columns if not c.startswith(("_a_", "_r_", "_o_", "_pid"))])


def with_position(df: DataFrame, order: list[Column | str], name: str = "pos") -> DataFrame:
    """Adds the row's position (from 0) in the total order: one range exchange and a sort, rows are numbered as they come."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_placed_at", F.monotonically_increasing_id())
    placed = written(dealt, "placed").withColumn("_placed_in", F.shiftright("_placed_at", 33))  # partition, and place in it
    offsets = _before(placed.groupBy("_placed_in").agg(F.count("*").alias("_placed_rows")), {"_placed_before": "_placed_rows"}, "_placed_in")
    out = placed.join(F.broadcast(offsets), "_placed_in")
    return out.withColumn(name, F.col("_placed_before") + F.col("_placed_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_placed_at", "_placed_in", "_placed_before")


def group_position(df: DataFrame, group: str, order: list[Column | str], name: str = "pos") -> DataFrame:
    """Adds the row's position (from 0) within its group, which may be of any size: no task sorts a whole group."""
    out = with_position(df, [group, *order], "_p")
    first = out.groupBy(F.col(group).alias("_g")).agg(F.min("_p").alias("_first"))  # a row per group
    out = out.join(first, F.col(group).eqNullSafe(F.col("_g")))
    return out.withColumn(name, F.col("_p") - F.col("_first")).drop("_p", "_g", "_first")


def lengths_to_ranges(df: DataFrame, order: str, length: str, start: int = 0) -> DataFrame:
    """Half-open [lo, hi) of each length, in order."""
    out = with_prefix(df, [order], {"hi": F.col(length).cast("long")})
    return out.withColumns({"lo": F.col("hi") - F.col(length) + start, "hi": F.col("hi") + start})


def keep_recent(df: DataFrame, order: list[Column | str], size: str, max_size: float, max_files: int) -> DataFrame:
    """Rows kept by retention: in order, while the total size stays below max_size and the rank within max_files."""
    out = with_prefix(df, order, {"_rank": F.lit(1).cast("long"), "_total": F.col(size).cast("double")})
    return out.filter((F.col("_total") < max_size) & (F.col("_rank") <= max_files)).drop("_rank", "_total")
