"""Vector functions over array columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2(x: Column) -> Column:
    """Euclidean norm."""
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(x: Column, y: Column, norm_x: Column, norm_y: Column, eps: float = 1e-8) -> Column:
    """Eps is added to the product of norms."""
    return dot(x, y) / (norm_x * norm_y + eps)


def mean(x: Column) -> Column:
    return F.try_divide(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double")), F.size(x))


def broadcast_to(x: Column, n: Column) -> Column:
    """An axis of size 1 repeated to n; another size must already be n."""
    return F.when(F.size(x) == n, x).when(F.size(x) == 1, F.flatten(F.array_repeat(x, n)))


def broadcast_concat(x: Column, y: Column) -> Column:
    """Both to the longer length, one after the other."""
    n = F.greatest(F.size(x), F.size(y))
    return F.concat(broadcast_to(x, n), broadcast_to(y, n))


def broadcast_stack(x: Column, y: Column) -> Column:
    """Both to the longer length, as rows of a matrix."""
    n = F.greatest(F.size(x), F.size(y))
    return F.array(broadcast_to(x, n), broadcast_to(y, n))


def fold(x: Column, rows: int, cols: int) -> Column:
    """``(r c) -> r c``; null if the length is not rows * cols."""
    made = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.slice(x, r * cols + 1, cols))
    return F.when(F.size(x) == rows * cols, made)


def unfold(m: Column) -> Column:
    """``r c -> (r c)``."""
    return F.flatten(m)


def transposed(m: Column) -> Column:
    """``r c -> c r``."""
    return F.transform(F.sequence(F.lit(0), F.size(m[0]) - 1), lambda c: F.transform(m, lambda row: F.get(row, c)))


def repeated(x: Column, n: int) -> Column:
    """``d -> (d n)``: each element n times."""
    return F.flatten(F.transform(x, lambda v: F.array_repeat(v, n)))


def reduced(m: Column, how: str = "mean") -> Column:
    """``r c -> r`` by mean, sum, max or min."""
    made = {
        "mean": mean,
        "sum": lambda r: F.aggregate(r, F.lit(0.0), lambda s, v: s + v.cast("double")),
        "max": F.array_max,
        "min": F.array_min,
    }
    return F.transform(m, made[how])


def gather(x: Column, indexes: Column) -> Column:
    """Elements at indexes; out of range is null."""
    return F.transform(indexes, lambda i: F.get(x, i))
