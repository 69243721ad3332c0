"""Tile-wise prediction with any model, and the table of a model's predictions as the simplest one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a scorer gets: a tile's bytes; and gives: rows (x1, y1, x2, y2, cls, score) in the tile's coordinates.
Scorer = Callable[[bytes], list[tuple[float, float, float, float, int, float]]]


def predict_tiles(tiles: DataFrame, load: Callable[[], Scorer], threshold: float) -> DataFrame:
    """(image_id, box_idx, cls, x1, y1, x2, y2, score) of tiles (image_id, tile_id, tile_x, tile_y, content).

    `load` is called once for each task and gives the scorer. Boxes at or under the threshold are dropped where they are
    made; the rest are moved to the image's coordinates. box_idx is a number within the image: the tile's in its upper half, the
    order within the tile in its lower one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for pdf in batches:
            rows = []
            for image, tile, dx, dy, content in zip(pdf.image_id, pdf.tile_id, pdf.tile_x, pdf.tile_y, pdf.content, strict=True):
                for k, (x1, y1, x2, y2, cls, score) in enumerate(scorer(content)):
                    if score > threshold:
                        rows.append((image, tile, k, cls, x1 + dx, y1 + dy, x2 + dx, y2 + dy, score))
            yield pd.DataFrame(rows, columns=["image_id", "tile_id", "k", "cls", "x1", "y1", "x2", "y2", "score"])

    made = tiles.select("image_id", "tile_id", "tile_x", "tile_y", "content").mapInPandas(run, "image_id long, tile_id long, k long, cls long, x1 double, y1 double, x2 double, y2 double, score double")
    return made.withColumn("box_idx", F.call_function("shiftleft", F.col("tile_id"), F.lit(32)) + F.col("k") + 1).select("image_id", "box_idx", "cls", "x1", "y1", "x2", "y2", "score")
