"""Reproducible shuffles, splits, mixes and batches.

Random order is the order of ``md5(seed-epoch-scope-id)``: it needs no generator state, any engine can repeat it, and a
resumed run sees the same permutation. Structural promises (each id once an epoch, quotas, unmixed batches) are those of
the samplers it replaces; bit-equal permutations are no goal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.operators.ordering import group_position, with_position


def hash_order(id_: Column, seed: int = 0, epoch: int = 0, scope: str = "") -> Column:
    """The sort key of a shuffle."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), F.lit(str(epoch)), F.lit(scope), id_.cast("string")))


def hash_uniform(id_: Column, seed: int = 0, epoch: int = 0, scope: str = "") -> Column:
    """A uniform number in [0, 1) from the first 48 bits of the hash."""
    head = F.substring(hash_order(id_, seed, epoch, scope), 1, 12)
    return F.conv(head, 16, 10).cast("long") / F.lit(float(1 << 48))


def chunk_shuffle(df: DataFrame, chunk: str, id_: str, seed: int = 0, epoch: int = 0, shuffle_chunks: bool = True, total: int | None = None) -> DataFrame:
    """Chunks in random order, ids random inside each; ``pos`` is the place in the epoch.

    Epoch 0 of a sampler that starts in shard order passes ``shuffle_chunks=False``; ids from ``total`` on wrap around.
    """
    outer = hash_order(F.col(chunk), seed, epoch, "chunk") if shuffle_chunks else F.col(chunk)
    out = df.withColumns({"_outer": outer, "_inner": hash_order(F.col(id_), seed, epoch, "id")})
    out = with_position(out, ["_outer", "_inner", id_]).drop("_outer", "_inner")
    return out.withColumn(id_, F.col(id_) % total) if total else out


def fixed_chunks(id_: Column, size: int, lo: int = 0) -> Column:
    """Consecutive chunks of ``size``."""
    return F.floor((id_ - lo) / size).cast("long")


def shard_groups(shard_order: Column, capacity: int) -> Column:
    """Groups of consecutive shards that a cache can hold."""
    return F.floor(shard_order / capacity).cast("long")


def estimate_chunk_size(shards: DataFrame, n: str, capacity: int) -> DataFrame:
    """Capacity times the mean shard size."""
    return shards.agg(F.floor(capacity * F.avg(n)).cast("long").alias("chunk_size"))


def resume(df: DataFrame, cursor: int, pos: str = "pos") -> DataFrame:
    """What a cursor has not yet handed out."""
    return df.filter(F.col(pos) > cursor)


def rank_block(df: DataFrame, pos: str, total: int, ranks: int, drop_last: bool = False) -> DataFrame:
    """A contiguous block of positions per rank; past the end the head comes again.

    ``df`` needs positions 0..total-1. A row per (rank, slot): rows of the head are repeated, nothing is gathered.
    """
    per = total // ranks if drop_last else -(-total // ranks)
    slots = df.filter(F.col(pos) < per * ranks).withColumn("_slot", F.col(pos).cast("long"))
    extra = per * ranks - total
    if extra > 0:
        again = F.sequence(F.lit(0).cast("long"), F.floor((F.lit(extra - 1) - F.col(pos)) / total).cast("long"))
        more = df.filter(F.col(pos) < extra).withColumn("_slot", F.explode(F.transform(again, lambda k: (k + 1) * total + F.col(pos))))
        slots = slots.unionByName(more)
    return slots.withColumns(
        {"rank": F.floor(F.col("_slot") / per).cast("long"), "slot": (F.col("_slot") % per).cast("long")}
    ).drop("_slot")


def rank_stride(df: DataFrame, pos: str, ranks: int) -> DataFrame:
    """Position modulo ranks."""
    return df.withColumns({"rank": F.col(pos) % ranks, "slot": F.floor(F.col(pos) / ranks).cast("long")})


def rank_split(df: DataFrame, pos: str, total: int, ranks: int) -> DataFrame:
    """Contiguous parts, the first ``total % ranks`` one row longer."""
    small, extra = divmod(total, ranks)
    head = extra * (small + 1)
    p = F.col(pos)
    rest = F.floor((p - head) / max(small, 1)) + extra
    return df.withColumn("rank", F.when(p < head, F.floor(p / (small + 1))).otherwise(rest).cast("long"))


def interleave(df: DataFrame, source: str, order: str, seed: int = 0) -> DataFrame:
    """Sources merged by a random schedule; each source keeps its own order.

    The schedule has a slot for every row; the k-th slot of a source takes its k-th row.
    """
    rows = group_position(df, source, [order], "k").withColumn("k", F.col("k") + 1)
    slot = rows.withColumn("_h", hash_order(F.concat_ws(":", source, F.col("k").cast("string")), seed, 0, "slot"))
    slots = with_position(slot.select(F.col(source).alias("_s"), "_h"), ["_h"], "step")
    slots = group_position(slots, "_s", ["step"], "k").withColumn("k", F.col("k") + 1)
    return rows.join(slots.withColumnRenamed("_s", source).drop("_h"), [source, "k"]).drop("k")


def weighted_draws(sizes: DataFrame, source: str, n: str, ratio: str, draws: int, seed: int = 0) -> DataFrame:
    """``draws`` picks with replacement; a row's weight is (largest size / own size) * its source's ratio.

    So a source is drawn by its ratio, then a row uniformly. ``sizes``: one row per source.
    """
    dim = sizes.select(source, F.col(n).cast("long").alias("_n"), F.col(ratio).cast("double").alias("_w"))
    w = Window.partitionBy(F.lit(1)).orderBy(source)  # a row per source
    total = F.sum("_w").over(Window.partitionBy(F.lit(1)))
    dim = dim.withColumns({"_hi": F.sum("_w").over(w) / total, "_lo": (F.sum("_w").over(w) - F.col("_w")) / total})
    last = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(source))) == 1
    dim = dim.withColumn("_hi", F.when(last, 1.0).otherwise(F.col("_hi")))
    picks = sizes.sparkSession.range(draws).withColumnRenamed("id", "draw")
    picks = picks.withColumn("_u", hash_uniform(F.col("draw"), seed, 0, "source"))
    got = picks.join(F.broadcast(dim), (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    row = F.floor(hash_uniform(F.col("draw"), seed, 0, "row") * F.col("_n")).cast("long")
    return got.select("draw", source, F.least(row, F.col("_n") - 1).alias("row"))


def quotas(batch: int, ratios: list[float]) -> list[int]:
    """Rows of each source in a batch; the first source takes the remainder."""
    q = [int(batch * r / sum(ratios)) for r in ratios]
    q[0] += batch - sum(q)
    return q


def source_batches(df: DataFrame, source: str, order: Column, quota: dict[str, int], batches: int) -> DataFrame:
    """``batches`` batches with each source's quota, every source an endless cycle of its rows in order.

    A row per (batch, slot). Cycles repeat rows by an explode of cycle numbers, so short sources do not end the mix.
    """
    rows = df.filter(F.col(source).isin(list(quota))).withColumn("_o", order)
    rows = group_position(rows, source, ["_o"], "_k").drop("_o")
    size = rows.groupBy(source).agg(F.count("*").alias("_n"))
    rows = rows.join(F.broadcast(size), source)  # a row for each source of ``quota``
    q = F.element_at(F.create_map(*[x for k, v in quota.items() for x in (F.lit(k), F.lit(v))]), F.col(source))
    rows = rows.withColumn("_q", q).filter(F.col("_k") < F.col("_q") * batches)
    cycles = F.floor((F.col("_q") * batches - 1 - F.col("_k")) / F.col("_n"))
    rows = rows.withColumn("_at", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), cycles), lambda c: c * F.col("_n") + F.col("_k"))))
    return rows.withColumns(
        {"batch": F.floor(F.col("_at") / F.col("_q")).cast("long"), "slot": (F.col("_at") % F.col("_q")).cast("long")}
    ).drop("_k", "_n", "_q", "_at")


def grouped_batches(df: DataFrame, group: str, order: str, batch: int, drop_uneven: bool = False) -> DataFrame:
    """Batches of one group each, in the order inside the group; batches are ordered by their first row."""
    rows = group_position(df, group, [order], "_k").withColumn("_b", F.floor(F.col("_k") / batch)).drop("_k")
    first = rows.groupBy(group, "_b").agg(F.min(order).alias("_first"), F.count("*").alias("_n"))
    if drop_uneven:
        first = first.filter(F.col("_n") == batch)
    ranked = with_position(first, ["_first", group], "batch")
    return rows.join(ranked.select(group, "_b", "batch"), [group, "_b"]).drop("_b")


def cycle(df: DataFrame, pos: str, total: int, steps: int) -> DataFrame:
    """``steps`` steps over the rows in order, starting again at the end."""
    again = F.sequence(F.lit(0).cast("long"), F.floor((F.lit(steps - 1) - F.col(pos)) / total).cast("long"))
    return df.filter(F.col(pos) < steps).withColumn("step", F.explode(F.transform(again, lambda k: k * total + F.col(pos))))


def choose_source(step: Column, ratios: dict[str, float], seed: int = 0) -> Column:
    """The source of a step, by a hash-uniform number against cumulative ratios."""
    u, total, at, out = hash_uniform(step, seed, 0, "loader"), sum(ratios.values()), 0.0, F.lit(list(ratios)[-1])
    edges = []
    for name, r in ratios.items():
        at += r / total
        edges.append((at, name))
    for edge, name in reversed(edges[:-1]):
        out = F.when(u < edge, F.lit(name)).otherwise(out)
    return out


def flatten_lists(df: DataFrame, columns: list[str], index: str) -> DataFrame:
    """List columns of equal length to rows, with the parent's index; other lengths are an error."""
    sizes = [F.size(c) for c in columns]
    same = sizes[0] == sizes[0]
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    z = F.when(same, F.arrays_zip(*columns)).otherwise(F.raise_error(F.lit("list columns differ in length")))
    out = df.select(index, F.posexplode(z).alias("pos", "_z"))
    return out.select(index, "pos", *[F.col(f"_z.{c}").alias(c) for c in columns])


def collate(df: DataFrame, batch: str, order: str, columns: list[str]) -> DataFrame:
    """The declared columns of each batch as lists, all in one order."""
    made = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *columns)))
    g = df.groupBy(batch).agg(made.alias("_l"))


    def column(c: str) -> Column:
        return F.transform("_l", lambda x: x[c]).alias(c)

    return g.select(batch, *[column(c) for c in columns])


def random_spans(spark, n: int, duration: float, seed: int = 0) -> DataFrame:
    """Spans inside a duration."""
    a, b = (hash_uniform(F.col("id"), seed, 0, s) * duration for s in ("a", "b"))
    return spark.range(n).select("id", F.least(a, b).alias("st"), F.greatest(a, b).alias("ed"))


def random_boxes(spark, n: int, width: int, height: int, seed: int = 0) -> DataFrame:
    """Xywh boxes inside a canvas."""
    u = [hash_uniform(F.col("id"), seed, 0, s) for s in "xywh"]
    x, y = F.floor(u[0] * width).cast("int"), F.floor(u[1] * height).cast("int")
    w, h = F.floor(u[2] * (F.lit(width) - x)).cast("int") + 1, F.floor(u[3] * (F.lit(height) - y)).cast("int") + 1
    return spark.range(n).select("id", x.alias("x"), y.alias("y"), F.least(w, F.lit(width) - x).alias("w"), F.least(h, F.lit(height) - y).alias("h"))
