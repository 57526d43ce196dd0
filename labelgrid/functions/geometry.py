"""Scalar geometry over rectangle columns ``x1, y1, x2, y2``; a null coordinate means that there is no box."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V

Rect = tuple  # four columns


def rect(prefix: str = "") -> Rect:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def of_struct(name: str) -> Rect:
    return tuple(F.col(f"{name}.{c}") for c in ("x1", "y1", "x2", "y2"))


def poly_to_rect(polygon: str) -> list[Column]:
    """Bounding rectangle of an array of points."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return [F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")]


def width(a: Rect) -> Column:
    return a[2] - a[0]


def height(a: Rect) -> Column:
    return a[3] - a[1]


def center_x(a: Rect) -> Column:
    return (a[0] + a[2]) / 2.0


def center_y(a: Rect) -> Column:
    return (a[1] + a[3]) / 2.0


def _gap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.greatest(b1 - a2, a1 - b2, F.lit(0.0))


def vertical_distance(a: Rect, b: Rect) -> Column:
    return _gap(a[1], a[3], b[1], b[3])


def horizontal_distance(a: Rect, b: Rect) -> Column:
    return _gap(a[0], a[2], b[0], b[2])


def overlap_ratio(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Overlap of two intervals by the length of the shorter; 0 if that is not positive."""
    shorter = F.least(a2 - a1, b2 - b1)
    return F.when(shorter <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(a2, b2) - F.greatest(a1, b1)) / F.when(shorter > 0, shorter))


def vertical_overlap_ratio(a: Rect, b: Rect) -> Column:
    return overlap_ratio(a[1], a[3], b[1], b[3])


def horizontal_overlap_ratio(a: Rect, b: Rect) -> Column:
    return overlap_ratio(a[0], a[2], b[0], b[2])


def center_distance(a: Rect, b: Rect) -> Column:
    return F.hypot(center_x(a) - center_x(b), center_y(a) - center_y(b))


def area(a: Rect) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), width(a)) * F.greatest(F.lit(0.0), height(a)), F.lit(0.0))


def intersection_area(a: Rect, b: Rect) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    some = a[0].isNotNull() & b[0].isNotNull() & (w > 0) & (h > 0)
    return F.when(some, w * h).otherwise(0.0)


def iou(a: Rect, b: Rect) -> Column:
    """Intersection over union; 0 where a box is missing or nothing is shared."""
    both = intersection_area(a, b)
    union = area(a) + area(b) - both
    return F.when((both > 0) & (union > 0), both / F.when(union > 0, union)).otherwise(0.0)


def evaluation_iou(a: Rect, b: Rect) -> Column:
    """As ``iou``, but two missing boxes agree."""
    return F.when(a[0].isNull() & b[0].isNull(), 1.0).otherwise(iou(a, b))


def clip(a: Rect, w: Column, h: Column) -> Rect:
    """The rectangle inside an image, at least one pixel wide and high."""
    x1 = F.greatest(F.lit(0.0), F.least(a[0], w - 1.0))
    y1 = F.greatest(F.lit(0.0), F.least(a[1], h - 1.0))
    x2 = F.greatest(F.lit(0.0), F.least(a[2], w.cast("double")))
    y2 = F.greatest(F.lit(0.0), F.least(a[3], h.cast("double")))
    return x1, y1, F.when(x2 <= x1, F.least(w.cast("double"), x1 + 1.0)).otherwise(x2), F.when(y2 <= y1, F.least(h.cast("double"), y1 + 1.0)).otherwise(y2)


def clip_rounded(a: Rect, w: Column, h: Column) -> Rect:
    """As ``clip``, on coordinates rounded half to even."""
    return clip(tuple(F.bround(c) for c in a), w, h)


def valid(a: Rect, w: Column, h: Column, least: float = 8) -> list[Column]:
    """The clipped rectangle, or nulls if it is narrower or lower than ``least``."""
    c = clip(a, w, h)
    good = (width(c) >= least) & (height(c) >= least)
    return [F.when(good, x).alias(n) for x, n in zip(c, ("x1", "y1", "x2", "y2"), strict=True)]


def _padded(a: Rect, w: Column, h: Column, ratio_x: float, ratio_y: float) -> Rect:
    px, py = F.bround(w * F.lit(ratio_x)), F.bround(h * F.lit(ratio_y))
    return a[0] - px, a[1] - py, a[2] + px, a[3] + py


def add_margin(a: Rect, w: Column, h: Column, ratio_x: float = V.PADDING, ratio_y: float = V.PADDING) -> Rect:
    """The rectangle with a margin in proportion to the image (whole pixels), clipped."""
    return clip(_padded(a, w, h, ratio_x, ratio_y), w, h)


def pad(a: Rect, w: Column, h: Column, ratio_x: float = V.PADDING, ratio_y: float = V.PADDING) -> Rect:
    """As ``add_margin``, on rounded coordinates."""
    return clip_rounded(_padded(a, w, h, ratio_x, ratio_y), w, h)


def crop(a: Rect, w: Column, h: Column) -> list[Column]:
    """Where to cut an image: the clipped box in whole pixels, or nulls if a side is below two."""
    c = clip_rounded(a, w, h)
    some = (width(c) >= 2) & (height(c) >= 2)
    return [F.when(some, x).cast("int").alias(n) for x, n in zip(c, ("x1", "y1", "x2", "y2"), strict=True)]


def center_inside(a: Rect, box: Rect) -> Column:
    """Whether the centre lies in the closed box; false without a box."""
    return F.coalesce((center_x(a) >= box[0]) & (center_x(a) <= box[2]) & (center_y(a) >= box[1]) & (center_y(a) <= box[3]), F.lit(False))
