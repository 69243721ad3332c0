"""Small pixel functions for pictures as raw bytes (height x width x 3, blue-green-red), vectorised per picture.

They cover what the box pipeline needs of pixels; contours and lines need an image library and are inputs here.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hsv(image: np.ndarray) -> np.ndarray:
    """Hue 0 to 179, saturation and value 0 to 255, of an unsigned byte picture. Worked out plane by plane, in small whole numbers as far as they go."""
    b, g, r = (np.ascontiguousarray(image[..., k]).astype(np.int16) for k in range(3))
    v = np.maximum(np.maximum(b, g), r)
    span = v - np.minimum(np.minimum(b, g), r)
    safe = np.maximum(span, 1).astype(np.float64)
    red, green = v == r, v == g
    hue = np.where(red, g - b, np.where(green, b - r, r - g)) / safe
    hue += np.where(red, 0, np.where(green, 2, 4))
    hue *= 60
    hue %= 360
    hue /= 2
    hue[span == 0] = 0
    out = np.empty(image.shape, np.uint8)
    out[..., 0] = np.rint(hue) % 180
    out[..., 1] = np.rint(255.0 * span / np.maximum(v, 1))
    out[..., 2] = v
    return out


def in_range(image: np.ndarray, low: tuple[int, int, int], high: tuple[int, int, int]) -> np.ndarray:
    """Whether each pixel's three values are between low and high, both included."""
    out = np.ones(image.shape[:-1], bool)
    for k, (a, b) in enumerate(zip(low, high, strict=True)):
        plane = image[..., k]
        out &= (plane >= a) & (plane <= b)
    return out


def upright(values: np.ndarray, inside: np.ndarray, dark: int = 50) -> bool | None:
    """Whether the upper half has more dark pixels inside the outline than the lower one; None if as many."""
    found = (values < dark) & inside
    half = len(found) // 2
    upper, lower = int(found[:half].sum()), int(found[half:].sum())
    return None if upper == lower else upper > lower


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 map that takes four points to four points."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0).reshape(3, 3)


def ordered_corners(points: np.ndarray) -> np.ndarray:
    """Four points as top left, top right, bottom right, bottom left: by smallest and largest sum and difference."""
    total, difference = points.sum(axis=1), points[:, 1] - points[:, 0]
    return points[[total.argmin(), difference.argmin(), total.argmax(), difference.argmax()]]


@F.pandas_udf(T.DoubleType())
def yellow_share(content: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """The share of yellow pixels of a picture."""
    def share(data: bytes, h: int, w: int) -> float:
        image = np.frombuffer(data, np.uint8).reshape(h, w, 3)
        return float(in_range(hsv(image), (20, 100, 100), (30, 255, 255)).mean())

    return pd.Series([None if d is None else share(d, h, w) for d, h, w in zip(content, height, width, strict=True)], dtype="float64")


@F.pandas_udf(T.BinaryType())
def crop(content: pd.Series, height: pd.Series, width: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
    """The pixels of a window; parts of it outside the picture are cut off."""
    def cut(d: bytes, h: int, w: int, a: int, b: int, c: int, e: int) -> bytes:
        return np.frombuffer(d, np.uint8).reshape(h, w, 3)[max(b, 0) : max(e, 0), max(a, 0) : max(c, 0)].tobytes()

    return pd.Series([cut(*row) for row in zip(content, height, width, x1, y1, x2, y2, strict=True)])


@F.pandas_udf(T.BooleanType())
def is_upright(grey: pd.Series, outline: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """upright() as a column, from grey levels and an outline's mask (0 outside it), a byte for each pixel."""
    def one(g: bytes, o: bytes, h: int, w: int) -> bool | None:
        values, inside = (np.frombuffer(x, np.uint8).reshape(h, w) for x in (g, o))
        return upright(values, inside > 0)

    return pd.Series([None if g is None or o is None else one(g, o, h, w) for g, o, h, w in zip(grey, outline, height, width, strict=True)], dtype="object")
