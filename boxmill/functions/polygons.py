"""Polygons as arrays of points (x, y): area, perimeter and the order of four corners, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _after(points: Column) -> Column:
    """The points, each in the place of the one before it."""
    return F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))


def polygon_perimeter(points: Column) -> Column:
    """The length of the closed outline."""
    sides = F.zip_with(points, _after(points), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(sides, F.lit(0.0), lambda s, c: s + c)


def polygon_area(points: Column) -> Column:
    """Half the absolute sum of cross products along the outline; 0 for less than three points."""
    cross = F.zip_with(points, _after(points), lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]).cast("double"))
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, c: s + c)) / 2


def corner_order(points: Column) -> Column:
    """Top left, top right, bottom right, bottom left: the points of smallest x + y and y - x, then of largest; of equal ones the first."""
    def first(key, sign: int) -> Column:
        ranked = F.transform(points, lambda p, i: F.struct((key(p) * sign).alias("k"), i.alias("i"), p.alias("p")))
        return F.array_min(ranked)["p"]

    total, difference = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.array(first(total, 1), first(difference, 1), first(total, -1), first(difference, -1))
