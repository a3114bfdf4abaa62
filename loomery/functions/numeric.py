"""Scalar numeric functions and index plans."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero as SQL rounds a double: a negative number that becomes zero is -0.0 (``F.round`` gives 0.0)."""
    scale = F.lit(10.0**digits)
    made = F.round(F.abs(x) * scale) / scale * F.signum(x)
    return F.when(F.isnan(made) | (F.abs(made) == float("inf")), x).otherwise(made)


def pts_to_secs(pts: Column, time_base: Column, start: Column) -> Column:
    """seconds of a presentation time; infinity stays."""
    return F.when(pts == float("inf"), pts).otherwise((pts - start) * time_base)


def frames_to_secs(frame: Column, fps: Column) -> Column:
    """frame number to seconds; no rate, no time."""
    return F.try_divide(frame, fps)


def inverse_sigmoid(x: Column, eps: float = 1e-5) -> Column:
    """the logit of x clamped to 0..1, both sides at least eps."""
    c = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return F.ln(F.greatest(c, F.lit(eps)) / F.greatest(F.lit(1.0) - c, F.lit(eps)))


def gaussian(n: Column, mean: Column, sigma: Column) -> Column:
    """exp(-(i-mean)^2 / (2 sigma^2)) for i < n."""
    return F.when(n <= 0, F.array().cast("array<double>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.exp(-F.pow(i - mean, 2) / (2 * F.pow(sigma, 2))))
    )


def sample_indices(tot: Column, max_len: int | None = None, stride: int | None = None) -> Column:
    """0, stride, ... and always the last index; exactly one of ``max_len`` and ``stride``.

    ``stride`` is ``ceil((tot-1)/(max_len-1))`` by ``max_len``; lengths up to 1 and a ``max_len`` of 1 give the last
    index alone.
    """
    if (max_len is None) == (stride is None):
        raise ValueError("give either max_len or stride")
    last = F.array((tot - 1).cast("int"))
    if max_len == 1:
        return F.when(tot > 0, last).otherwise(F.array().cast("array<int>"))
    step = F.ceil((tot - 1) / F.lit(float(max_len - 1))).cast("int") if max_len else F.lit(stride)
    return F.when(tot <= 0, F.array().cast("array<int>")).when(tot == 1, last).otherwise(
        F.concat(F.sequence(F.lit(0), (tot - 2).cast("int"), F.greatest(step, F.lit(1))), last)
    )


def frame_indices(n: int, length: Column, mode: str = "rand", offset: int = 0, seed: int = 0, key: Column | None = None) -> Column:
    """One index of each of min(n, length) intervals: ``start`` (plus offset, clamped), ``middle`` or ``rand``.

    ``rand`` draws by a hash of seed, key and interval, so a run can be repeated; the last frame of an interval of
    several is never drawn, as in the sampler that this stands for.

    ``round`` gives n rounded points from 0 to length - 1, whatever the length.
    """
    k = F.least(F.lit(n), length).cast("int")
    index = F.sequence(F.lit(0), k - 1)

    def bound(i: Column) -> Column:
        return F.floor(i * length / k).cast("int")

    if mode == "round":
        out = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * (length - 1) / float(max(n - 1, 1))).cast("int"))
    elif mode == "start":
        out = F.transform(index, lambda i: F.least(bound(i) + offset, bound(i + 1) - 1))
    elif mode == "rand":
        draw = F.lit(None).cast("string") if key is None else key
        out = F.transform(
            index, lambda i: (bound(i) + F.pmod(F.xxhash64(F.lit(seed), draw, i), F.greatest(bound(i + 1) - 1 - bound(i), F.lit(1)))).cast("int")
        )
    elif mode == "middle":
        out = F.transform(index, lambda i: F.floor((bound(i) + bound(i + 1) - 1) / 2).cast("int"))
    else:
        raise ValueError(mode)
    return F.when(k <= 0, F.array().cast("array<int>")).otherwise(out)


def fill_temporal(num_frames: Column, fps: Column, duration: Column) -> Column:
    """struct(num_frames, fps), each derived from the other and the duration where null."""
    n = F.coalesce(num_frames, F.floor(duration * fps).cast("int"))
    return F.struct(n.alias("num_frames"), F.coalesce(fps, F.try_divide(n.cast("double"), duration)).alias("fps"))


def cosine_warmup(step: Column, warmup: int, total: int, base: float = 1.0, floor: float = 0.0, start: float = 0.0) -> Column:
    """Linear ramp over ``warmup`` steps, then half a cosine down to ``floor``."""
    ramp = start + (base - start) * step / max(warmup - 1, 1)
    wave = floor + 0.5 * (base - floor) * (1 + F.cos(math.pi * (step - warmup) / float(max(total - warmup, 1))))
    return F.when(step < warmup, ramp).otherwise(wave)


def byte_ranges(size: Column, threads: int) -> Column:
    """Inclusive (start, end) spans of ceil(size/threads) bytes; spans past the end are left out."""
    part = F.greatest(F.ceil(size / F.lit(float(threads))), F.lit(1)).cast("long")
    spans = F.transform(
        F.sequence(F.lit(0), F.lit(threads - 1)),
        lambda i: F.struct((i * part).alias("s"), F.least((i + 1) * part - 1, size - 1).alias("e")),
    )
    return F.filter(spans, lambda x: x["s"] <= x["e"])
