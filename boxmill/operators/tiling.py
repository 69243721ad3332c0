"""Cutting images into overlapping tiles, and dealing boxes to the tiles they lie in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill.functions.boxes import Corners, clipped, containment, corners, intersection, label_from_corners, padded_to_multiple, padded_to_stride, rect_from_corners, shifted

TILE, STRIDE = 640, 440


def windows(images: DataFrame, tile: int = TILE, stride: int = 420) -> DataFrame:
    """Origins of all full windows: (image_id, tile_id, tile_x, tile_y). An image smaller than a window has none, and a strip at the
    end that no full window reaches is not covered."""
    n = lambda size: F.when(F.col(size) >= tile, F.floor((F.col(size) - tile) / stride) + 1).otherwise(0).cast("int")
    axis = lambda size: F.when(n(size) > 0, F.sequence(F.lit(0), n(size) - 1)).otherwise(F.array().cast("array<int>"))
    rows = images.select("image_id", F.explode(axis("height")).alias("row"), n("width").alias("columns"), axis("width").alias("cols"))
    rows = rows.select("image_id", "row", "columns", F.explode("cols").alias("col"))
    return rows.select("image_id", (F.col("row") * F.col("columns") + F.col("col")).cast("long").alias("tile_id"), (F.col("col") * stride).cast("long").alias("tile_x"), (F.col("row") * stride).cast("long").alias("tile_y"))


def padded_to_tiles(images: DataFrame, tile: int = TILE) -> DataFrame:
    """Width and height up to whole tiles."""
    return images.withColumns({"width": padded_to_multiple(F.col("width"), tile), "height": padded_to_multiple(F.col("height"), tile)})


def padded_to_strides(images: DataFrame, tile: int = TILE, stride: int = STRIDE) -> DataFrame:
    """Width and height up to where windows every stride cover everything."""
    return images.withColumns({"width": padded_to_stride(F.col("width"), tile, stride), "height": padded_to_stride(F.col("height"), tile, stride)})


def boxes_in_tiles(boxes: DataFrame, width: int, height: int, tile: int = TILE, stride: int = STRIDE, least: float = 0.8) -> DataFrame:
    """One row for each box and tile with at least `least` of the box's area inside the tile.

    The tiles that a box can touch follow from its corners, so they are written out for each box: no join, no shuffle,
    and the work is in proportion to the pairs. Adds tile_id, tile_x, tile_y.
    """
    columns, rows = ((size - tile) // stride + 1 if size >= tile else 0 for size in (width, height))

    def touched(low: str, high: str, n: int):
        first = F.greatest(F.lit(0), F.floor((F.col(low) - tile) / stride) + 1)
        last = F.least(F.lit(n - 1), F.ceil(F.col(high) / stride) - 1)
        return F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))

    out = boxes.withColumn("tile_row", F.explode(touched("y1", "y2", rows))).withColumn("tile_col", F.explode(touched("x1", "x2", columns)))
    out = out.withColumns({"tile_id": F.col("tile_row") * columns + F.col("tile_col"), "tile_x": F.col("tile_col") * stride, "tile_y": F.col("tile_row") * stride})
    own = Corners(*map(F.col, ("x1", "y1", "x2", "y2")))
    inside = Corners(F.col("tile_x"), F.col("tile_y"), F.col("tile_x") + tile, F.col("tile_y") + tile)
    return out.where(containment(own, inside) >= least).drop("tile_row", "tile_col")


def tile_labels(boxes: DataFrame, tile: int = TILE) -> DataFrame:
    """Clips the boxes of boxes_in_tiles() to their tile and makes them labels of the tile: adds xc, yc, w, h."""
    own = shifted(Corners(*map(F.col, ("x1", "y1", "x2", "y2"))), F.col("tile_x"), F.col("tile_y"))
    edge = F.lit(tile).cast("long")
    b = label_from_corners(clipped(own, edge, edge), F.lit(float(tile)), F.lit(float(tile)))
    return boxes.withColumns({"xc": b.xc, "yc": b.yc, "w": b.w, "h": b.h})


def tile_rectangles(boxes: DataFrame, tile: int = TILE) -> DataFrame:
    """Clips the boxes of boxes_in_tiles() to their tile as rectangles of whole pixels in its coordinates: adds x, y, w, h. Those without area go."""
    own = shifted(Corners(*map(F.col, ("x1", "y1", "x2", "y2"))), F.col("tile_x"), F.col("tile_y"))
    edge = F.lit(tile).cast("long")
    r = rect_from_corners(clipped(own, edge, edge))
    return boxes.withColumns(r._asdict()).where("w > 0 AND h > 0")


def meeting_pairs(a: DataFrame, b: DataFrame, keys: list[str], cell: int = 256, tasks: int | None = None) -> DataFrame:
    """Columns of `a` and `b` under these aliases, for all pairs with equal keys whose boxes (x1, y1, x2, y2) have area in common.

    Boxes are written out once for each cell of a grid that they touch and joined on keys and cell, so what meets on one join key are the boxes around one
    place, not all of an image. A pair is counted in the first cell that both touch, the one of the larger x1 and y1. With `tasks` the join has so many, and as many as the
    session's settings say without.
    """
    def dealt(rows: DataFrame) -> DataFrame:
        first, last = (lambda c: F.floor(F.col(c) / cell)), (lambda c: F.ceil(F.col(c) / cell) - 1)
        touched = lambda low, high: F.when(F.col(low) < F.col(high), F.sequence(first(low), last(high)))
        rows = rows.withColumn("cell_y", F.explode(touched("y1", "y2"))).withColumn("cell_x", F.explode(touched("x1", "x2")))
        return rows.repartition(tasks, *place) if tasks else rows

    place = [*keys, "cell_x", "cell_y"]
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in place]
    pairs = dealt(a).alias("a").join(dealt(b).alias("b"), same)
    ax, bx = corners("a."), corners("b.")
    counted = (F.floor(F.greatest(ax.x1, bx.x1) / cell) == F.col("a.cell_x")) & (F.floor(F.greatest(ax.y1, bx.y1) / cell) == F.col("a.cell_y"))
    return pairs.where(counted & (intersection(ax, bx) > 0))
