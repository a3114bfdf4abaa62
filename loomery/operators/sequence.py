"""Resampling, pooling and padding of ordered values: on array columns, and on rows with a position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("maxpool", "avgpool", "center", "tail", "random")


def reduce_segment(x: Column, lo: Column, hi: Column, mode: str, seed: int = 0) -> Column:
    """One value for the elements [lo, hi) of an array; an empty segment is the element at lo.

    ``random`` picks by a hash of seed and position, so a run can be repeated.
    """
    end = F.greatest(hi, lo + 1)
    part = F.slice(x, lo + 1, end - lo)
    if mode == "maxpool":
        return F.array_max(part)
    if mode == "avgpool":
        return F.aggregate(part, F.lit(0.0), lambda s, v: s + v.cast("double")) / (end - lo)
    if mode == "center":
        return F.get(x, lo + F.floor((end - lo) / 2).cast("int"))
    if mode == "tail":
        return F.get(x, end - 1)
    if mode == "random":
        return F.get(x, (lo + F.pmod(F.xxhash64(F.lit(seed), lo), end - lo)).cast("int"))
    raise ValueError(mode)


def resample_round(x: Column, length: int, mode: str = "avgpool") -> Column:
    """Exactly ``length`` values; boundary i is half-even round(i/length*n), clipped to n-1."""
    n = F.size(x)

    def bound(i: Column) -> Column:
        return F.least(F.rint(i / F.lit(float(length)) * n).cast("int"), n - 1)

    made = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: reduce_segment(x, bound(i), bound(i + 1), mode))
    return F.when(n > 0, made)


def resample_stride(x: Column, stride: int, mode: str = "avgpool", keep_remainder: bool = False) -> Column:
    """Segments between consecutive multiples of the stride; what follows the last one is dropped unless kept."""
    n = F.size(x)
    pieces = F.ceil(n / F.lit(float(stride))).cast("int")
    count = pieces if keep_remainder else pieces - 1
    kind = F.array().cast("array<double>") if mode == "avgpool" else F.slice(x, 1, 0)
    made = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: reduce_segment(x, i * stride, F.least((i + 1) * stride, n), mode),
    )
    return F.when(count > 0, made).otherwise(kind)


def stride_rows(df: DataFrame, keys: list[str], pos: str, value: str, stride: int) -> DataFrame:
    """W08 on rows (avgpool): no array is built, so a series may be of any length; one partial aggregation."""
    last = F.max(pos).alias("last")
    n = df.groupBy(*keys).agg(last)
    buckets = df.groupBy(*keys, F.floor(F.col(pos) / stride).cast("long").alias("segment")).agg(F.avg(value).alias("value"))
    return buckets.join(n, keys).filter(F.col("segment") < F.ceil((F.col("last") + 1) / stride) - 1).drop("last")


def slice_array(x: Column, start: int, stop: int) -> Column:
    """W11."""
    return F.slice(x, start + 1, stop - start)


def pad(x: Column, length: Column, fill: Column, side: str = "right") -> Column:
    """Filled up to ``length``; a longer array is an error."""
    n = F.size(x)
    rest = F.array_repeat(fill, length - n)
    made = F.concat(x, rest) if side == "right" else F.concat(rest, x)
    return F.when(n <= length, made).otherwise(F.raise_error(F.lit("array is longer than the padded length")))


def pad_last(x: Column, length: Column, side: str = "right") -> Column:
    """Filled with the last (or first) value."""
    return pad(x, length, F.get(x, F.size(x) - 1 if side == "right" else F.lit(0)), side)


def pad_mask(x: Column, length: Column, side: str = "right") -> Column:
    """1 where a value is, 0 where padding is."""
    n = F.least(F.size(x), length)
    ones, zeros = F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), length - n)
    return F.concat(ones, zeros) if side == "right" else F.concat(zeros, ones)


def pad_batch(df: DataFrame, column: str, batch: list[str], fill: Column) -> DataFrame:
    """Arrays padded to the longest of their batch, with mask (true is padding) and duration.

    The longest is aggregated and joined, so a batch may be spread over many tasks.
    """
    longest = df.groupBy(*[F.col(c).alias(f"_b{k}") for k, c in enumerate(batch)]).agg(F.max(F.size(column)).alias("_n"))
    same = F.lit(True)
    for k, c in enumerate(batch):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{k}"))
    df = df.join(longest, same).drop(*[f"_b{k}" for k in range(len(batch))])
    return df.withColumns(
        {
            column: pad(F.col(column), F.col("_n"), fill),
            "mask": F.transform(pad_mask(F.col(column), F.col("_n")), lambda v: v == 0),
            "duration": F.size(column),
        }
    ).drop("_n")


def subsample(x: Column, stride: int, start: int = 0) -> Column:
    """Every stride-th element from ``start``."""
    return F.filter(x, lambda v, i: (i >= start) & ((i - start) % stride == 0))


def unstack(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """A row per element."""
    return df.select(*keys, F.posexplode(column).alias("pos", "value"))


def dedupe_lines(df: DataFrame, keys: list[str], pos: str, line: str) -> DataFrame:
    """Lines that are blank or equal the non-blank line before them go; order is by ``pos`` within keys."""
    rows = df.filter(F.trim(F.col(line)) != "")
    before = F.lag(line).over(Window.partitionBy(*keys).orderBy(pos))
    return rows.withColumn("_before", before).filter(~F.col("_before").eqNullSafe(F.col(line))).drop("_before")


def captions(df: DataFrame, key: str, order: str, lines: str = "lines") -> DataFrame:
    """Captions of a track without repeated lines; captions with a ``<c>`` line are skipped, empty ones dropped."""
    rows = df.filter(~F.exists(lines, lambda x: x.contains("<c>")))
    rows = rows.select(*[c for c in df.columns if c != lines], F.posexplode(lines).alias("_p", "_line"))
    rows = rows.withColumn("_o", F.struct(order, "_p"))
    kept = dedupe_lines(rows, [key], "_o", "_line")
    rest = [c for c in df.columns if c != lines]
    made = kept.groupBy(*rest).agg(F.array_sort(F.collect_list(F.struct("_p", "_line"))).alias("_l"))
    return made.select(*rest, F.transform("_l", lambda x: x["_line"]).alias(lines))


def boundaries(df: DataFrame, key: str, st: str, ed: str) -> DataFrame:
    """Segment borders in order; a segment that starts where the last one ended adds its end alone."""
    w = Window.partitionBy(key).orderBy(st, ed)
    joined = F.coalesce(F.lag(ed).over(w) == F.col(st), F.lit(False))
    parts = F.when(F.col("_joined"), F.array(ed)).otherwise(F.array(st, ed))
    return df.withColumn("_joined", joined).select(key, st, F.posexplode(parts).alias("_k", "at")).select(key, F.col(st).alias("segment"), F.col("_k").alias("k"), "at")
