"""Box algebra as column expressions: no UDFs, so Catalyst sees through every box.

Corner boxes are four columns x1, y1, x2, y2; size boxes x, y, w, h; label boxes the centre and size as shares of the image.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Corners(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


class Rect(NamedTuple):
    x: Column
    y: Column
    w: Column
    h: Column


class Label(NamedTuple):
    xc: Column
    yc: Column
    w: Column
    h: Column


def corners(prefix: str = "") -> Corners:
    return Corners(*(F.col(prefix + c) for c in Corners._fields))


def rect(prefix: str = "") -> Rect:
    return Rect(*(F.col(prefix + c) for c in Rect._fields))


def label(prefix: str = "") -> Label:
    return Label(*(F.col(prefix + c) for c in Label._fields))


def corners_from_label(b: Label, width: Column, height: Column) -> Corners:
    """Not clipped, not rounded."""
    return Corners((b.xc - b.w / 2) * width, (b.yc - b.h / 2) * height, (b.xc + b.w / 2) * width, (b.yc + b.h / 2) * height)


def rect_from_label(b: Label, width: Column, height: Column) -> Rect:
    """Whole numbers, cut towards zero; the corner is computed from the size that was cut already."""
    w, h = (b.w * width).cast("int"), (b.h * height).cast("int")
    return Rect((b.xc * width - w / 2).cast("int"), (b.yc * height - h / 2).cast("int"), w, h)


def label_from_corners(b: Corners, width: Column, height: Column) -> Label:
    return Label((b.x1 + b.x2) / 2 / width, (b.y1 + b.y2) / 2 / height, (b.x2 - b.x1) / width, (b.y2 - b.y1) / height)


def corners_from_rect(b: Rect) -> Corners:
    return Corners(b.x, b.y, b.x + b.w, b.y + b.h)


def rect_from_corners(b: Corners) -> Rect:
    return Rect(b.x1, b.y1, b.x2 - b.x1, b.y2 - b.y1)


def shifted(b: Corners, dx: Column, dy: Column) -> Corners:
    """Into the coordinates of a window with origin (dx, dy); with negative numbers back out of it."""
    return Corners(b.x1 - dx, b.y1 - dy, b.x2 - dx, b.y2 - dy)


def outside(b: Corners, width: Column, height: Column) -> Column:
    """Whether nothing of the box, not even an edge's inner side, is in (0, 0, width, height)."""
    return (b.x2 <= 0) | (b.y2 <= 0) | (b.x1 >= width) | (b.y1 >= height)


def clipped(b: Corners, width: Column, height: Column) -> Corners:
    zero = F.lit(0)
    return Corners(F.greatest(b.x1, zero), F.greatest(b.y1, zero), F.least(b.x2, width), F.least(b.y2, height))


def clipped_rect(b: Rect, width: Column, height: Column) -> Rect:
    """Moves the corner inside and then cuts the size: what hung over left or top stays part of the size."""
    x, y = F.greatest(b.x, F.lit(0)), F.greatest(b.y, F.lit(0))
    return Rect(x, y, F.least(b.w, width - x), F.least(b.h, height - y))


def scaled_rect(b: Rect, factor: float) -> Rect:
    """About the centre; all four numbers cut towards zero, the size first."""
    w, h = (b.w * F.lit(factor)).cast("int"), (b.h * F.lit(factor)).cast("int")
    return Rect((b.x + b.w / 2 - w / 2).cast("int"), (b.y + b.h / 2 - h / 2).cast("int"), w, h)


def rotated_half_turn(b: Label) -> Label:
    return Label(1 - b.xc, 1 - b.yc, b.w, b.h)


def crop_window(b: Corners, width: Column, height: Column) -> Corners:
    """The smallest whole-numbered window around the box, inside the image."""
    zero = F.lit(0).cast("long")
    return Corners(F.greatest(zero, F.floor(b.x1)), F.greatest(zero, F.floor(b.y1)), F.least(width, F.ceil(b.x2)), F.least(height, F.ceil(b.y2)))


def area(b: Corners) -> Column:
    return (b.x2 - b.x1) * (b.y2 - b.y1)


def intersection(a: Corners, b: Corners) -> Column:
    zero = F.lit(0)
    return F.greatest(zero, F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * F.greatest(zero, F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))


def ratio(part: Column, whole: Column) -> Column:
    """A share as double, 0 where the whole is 0 or missing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def iou(a: Corners, b: Corners) -> Column:
    both = intersection(a, b)
    return F.when(both == 0, F.lit(0.0)).otherwise(ratio(both, area(a) + area(b) - both))


def containment(a: Corners, b: Corners) -> Column:
    """The share of a's area that is inside b."""
    return ratio(intersection(a, b), area(a))


def squareness(b: Rect) -> Column:
    """The longer side over the shorter one."""
    return F.try_divide(F.greatest(b.w, b.h).cast("double"), F.least(b.w, b.h).cast("double"))


def padded_to_multiple(size: Column, tile: int) -> Column:
    return F.ceil(size / F.lit(tile)).cast("long") * tile


def padded_to_stride(size: Column, tile: int, stride: int) -> Column:
    """The smallest size that windows of `tile` every `stride` cover to the end."""
    steps = F.greatest(F.ceil((size - tile) / F.lit(stride)), F.lit(0))
    return (steps.cast("long") * stride + tile).cast("long")


def line_length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def line_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.degrees(F.atan2(y2 - y1, x2 - x1))


def line_middle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The height of a line's midpoint."""
    return (y1 + y2) / F.lit(2.0)
