"""Box and interval algebra. A box is a struct of x0, y0, x1, y1 (``xyxy``, inclusive) or x0, y0, w, h (``xywh``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xyxy(x0, y0, x1, y1) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def xywh(x0, y0, w, h) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), w.alias("w"), h.alias("h"))


def to_xywh(b: Column) -> Column:
    """Widths count both end pixels."""
    return xywh(b["x0"], b["y0"], b["x1"] - b["x0"] + 1, b["y1"] - b["y0"] + 1)


def to_xyxy(b: Column) -> Column:
    """The inverse; a width below 1 counts as 1."""
    zero = F.lit(0.0)
    return xyxy(b["x0"], b["y0"], b["x0"] + F.greatest(b["w"] - 1, zero), b["y0"] + F.greatest(b["h"] - 1, zero))


def resize(b: Column, w: Column, h: Column, new_w: Column, new_h: Column) -> Column:
    """B04 for xyxy boxes: corners scale with the image."""
    rx, ry = new_w.cast("double") / w, new_h.cast("double") / h
    return xyxy(b["x0"] * rx, b["y0"] * ry, b["x1"] * rx, b["y1"] * ry)


def resize_xywh(b: Column, w: Column, h: Column, new_w: Column, new_h: Column) -> Column:
    """B04 for xywh boxes: one ratio scales all four numbers; two ratios scale the corners."""
    rx, ry = new_w.cast("double") / w, new_h.cast("double") / h
    corners = to_xywh(resize(to_xyxy(b), w, h, new_w, new_h))
    return F.when(rx == ry, xywh(b["x0"] * rx, b["y0"] * rx, b["w"] * rx, b["h"] * rx)).otherwise(corners)


def flip_left_right(b: Column, width: Column) -> Column:
    """Pixel-exact, so 1 less than the width."""
    return xyxy(width - b["x1"] - 1, b["y0"], width - b["x0"] - 1, b["y1"])


def flip_top_bottom(b: Column, height: Column) -> Column:
    """Without the 1, as its counterpart always was."""
    return xyxy(b["x0"], height - b["y1"], b["x1"], height - b["y0"])


def _clamp(x: Column, hi: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), hi)


def crop(b: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Shifted to the window and clamped to it; empty boxes stay."""
    w, h = right - left, bottom - top
    return xyxy(_clamp(b["x0"] - left, w), _clamp(b["y0"] - top, h), _clamp(b["x1"] - left, w), _clamp(b["y1"] - top, h))


def clip(b: Column, w: Column, h: Column) -> Column:
    """Clamped to the image's last pixels."""
    return xyxy(_clamp(b["x0"], w - 1), _clamp(b["y0"], h - 1), _clamp(b["x1"], w - 1), _clamp(b["y1"], h - 1))


def not_empty(b: Column) -> Column:
    """The filter for boxes left after clipping."""
    return (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])


def extend(b: Column, sx: float, sy: float, w: Column, h: Column) -> Column:
    """Padded by the scale times half the size, clamped to the image, never dropped."""
    px, py = (b["x1"] - b["x0"] + 1) * sx / 2, (b["y1"] - b["y0"] + 1) * sy / 2
    return clip(xyxy(b["x0"] - px, b["y0"] - py, b["x1"] + px, b["y1"] + py), w, h)


def jitter(b: Column, u: list[Column], out: float, inside: float, w: Column, h: Column) -> Column:
    """Each side moved by a uniform share of the size (four uniforms), clamped, at least a pixel left."""
    bw, bh = b["x1"] - b["x0"] + 1, b["y1"] - b["y0"] + 1
    low = [x * (inside + out) - out for x in u[:2]]
    high = [x * (inside + out) - inside for x in u[2:]]
    x0, y0 = _clamp(b["x0"] + bw * low[0], w - 2), _clamp(b["y0"] + bh * low[1], h - 2)
    x1 = F.greatest(F.least(b["x1"] + bw * high[0], w - 1), x0 + 1)
    y1 = F.greatest(F.least(b["y1"] + bh * high[1], h - 1), y0 + 1)
    return clip(xyxy(x0, y0, x1, y1), w, h)


def area(b: Column) -> Column:
    """B10 for xyxy boxes."""
    return (b["x1"] - b["x0"] + 1) * (b["y1"] - b["y0"] + 1)


def area_xywh(b: Column) -> Column:
    """B10 for xywh boxes."""
    return b["w"] * b["h"]


def span_iou(s0: Column, e0: Column, s1: Column, e1: Column) -> Column:
    """Intersection over union of two spans; null for an empty union."""
    inter = F.greatest(F.least(e0, e1) - F.greatest(s0, s1), F.lit(0.0))
    return F.try_divide(inter, (e0 - s0) + (e1 - s1) - inter)


def span_giou(s0: Column, e0: Column, s1: Column, e1: Column) -> Column:
    """Half of IoU plus union over the enclosing span."""
    inter = F.greatest(F.least(e0, e1) - F.greatest(s0, s1), F.lit(0.0))
    union = (e0 - s0) + (e1 - s1) - inter
    hull = F.greatest(e0, e1) - F.least(s0, s1)
    return 0.5 * (F.try_divide(inter, union) + F.try_divide(union, hull))


def span_resize(st: Column, ed: Column, old: Column, new: Column) -> Column:
    """A span on a timeline of another duration."""
    return F.struct((st * new / old).alias("st"), (ed * new / old).alias("ed"))


def intersect_span(lo: Column, hi: Column, a: Column, b: Column) -> Column:
    """Half-open overlap as struct(lo, hi); null when empty."""
    s, e = F.greatest(lo, a), F.least(hi, b)
    return F.when(s < e, F.struct(s.alias("lo"), e.alias("hi")))
