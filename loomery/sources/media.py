"""Media adapters. Geometry is plain expressions; decoding needs an optional library and fails clearly without it.

None of the decoding libraries is part of the standard installation, so those adapters are import-guarded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resized(height: Column, width: Column, size: int) -> Column:
    """struct(h, w): the short side becomes ``size``, the other is truncated."""
    short_w = width < height
    h = F.when(short_w, F.floor(size * height / width)).otherwise(F.lit(size)).cast("int")
    w = F.when(short_w, F.lit(size)).otherwise(F.floor(size * width / height)).cast("int")
    return F.struct(h.alias("h"), w.alias("w"))


def center_crop(height: Column, width: Column, h: int, w: int) -> Column:
    """struct(top, left) of a centred window, rounded half to even."""
    return F.struct(F.rint((height - h) / 2.0).cast("int").alias("top"), F.rint((width - w) / 2.0).cast("int").alias("left"))


def normalize(pixels: Column, mean: float, std: float, scale: float = 255.0) -> Column:
    """Pixels to (x / scale - mean) / std."""
    return F.transform(pixels, lambda x: (x.cast("double") / scale - mean) / std)


def flip_rows(rows: Column) -> Column:
    """Horizontal flip of an array of pixel rows."""
    return F.transform(rows, F.reverse)


def grayscale(r: Column, g: Column, b: Column) -> Column:
    """Luma of three channel arrays."""
    # fixed values: ITU-R 601 weights
    rg = F.zip_with(r, g, lambda x, y: 0.299 * x + 0.587 * y)
    return F.zip_with(rg, b, lambda x, y: x + 0.114 * y)


def channels_first(frames: Column) -> Column:
    """Frames of channels to channels of frames (T, C -> C, T)."""
    return F.transform(F.sequence(F.lit(0), F.size(frames[0]) - 1), lambda c: F.transform(frames, lambda f: F.get(f, c)))


def clip_plan(clips: DataFrame, fps: str = "fps") -> DataFrame:
    """Clip borders in seconds (frame numbers divided by the rate, seconds as they are)."""
    secs = lambda c: F.when(F.col("unit") == "frame", F.try_divide(F.col(c), F.col(fps))).otherwise(F.col(c))
    return clips.withColumns({"start": secs("start"), "end": secs("end")})


def probe(files: DataFrame) -> DataFrame:
    """(path, width, height, fps, duration, frames) of video files; needs PyAV."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import av  # optional

        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                with av.open(io.BytesIO(content)) as c:
                    s = c.streams.video[0]
                    rows.append((path, s.width, s.height, float(s.average_rate or 0), float((s.duration or 0) * s.time_base), s.frames))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "fps", "duration", "frames"])

    return files.select("path", "content").mapInPandas(run, "path string, width int, height int, fps double, duration double, frames long")


def frames(files: DataFrame, indexes: str) -> DataFrame:
    """(path, frame_idx, height, width, pixels) of the frames listed per file; needs PyAV."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import av  # optional

        for b in batches:
            for path, content, wanted in zip(b["path"], b["content"], b[indexes], strict=True):
                want, rows = set(int(i) for i in wanted), []
                with av.open(io.BytesIO(content)) as c:
                    for k, f in enumerate(c.decode(video=0)):
                        if k in want:
                            a = f.to_ndarray(format="rgb24")
                            rows.append((path, k, a.shape[0], a.shape[1], a.tobytes()))
                yield pd.DataFrame(rows, columns=["path", "frame_idx", "height", "width", "pixels"])

    return files.select("path", "content", indexes).mapInPandas(run, "path string, frame_idx int, height int, width int, pixels binary")
