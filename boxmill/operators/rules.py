"""Boxes by colour rules: thresholds for each species, applied to contours as a join and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill.functions.boxes import rect, scaled_rect, squareness

#: Species code, contour area from and to, longest to shortest side, largest box, least mean brightness.
SPECIES = [
    ("TRIAVA", 100, 1000, 2.0, None, 97),
    ("LIRIBO", 1000, 10000, 1.76, 28530, None),
    ("BRAIIM", 2000, 10000, 1.73, 42970, None),
]
SCALE = 1.5


def species(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPECIES, "prefix string, least int, most int, max_ratio double, max_box long, min_bright int")


def judged(contours: DataFrame, params: DataFrame, scale: float = SCALE) -> DataFrame:
    """All contours (prefix, x, y, w, h, brightness, contour_area and any other columns), scaled about their centres, with `passes`: whether they keep to their species' rules.

    Those of species without rules don't. params has a few rows, one for each species, so the contours stay where they are.
    """
    rows = contours.join(F.broadcast(params), "prefix", "left")
    bright = F.coalesce(F.col("min_bright") == 0, F.lit(True)) | (F.col("brightness") >= F.col("min_bright"))
    fits = (F.col("w") > 0) & (F.col("h") > 0) & (squareness(rect()) <= F.col("max_ratio")) & (F.col("max_box").isNull() | (F.col("w") * F.col("h") <= F.col("max_box")))
    rows = rows.withColumns(scaled_rect(rect(), scale)._asdict())
    passes = F.coalesce(bright & F.col("contour_area").between(F.col("least"), F.col("most")) & fits, F.lit(False))
    return rows.withColumn("passes", passes).drop(*[c for c in params.columns if c != "prefix"])


def filtered(contours: DataFrame, params: DataFrame, scale: float = SCALE) -> DataFrame:
    """(image_id, box_idx, prefix, x, y, w, h): the scaled boxes of contours that pass judged()."""
    return judged(contours, params, scale).where("passes").select("image_id", "box_idx", "prefix", "x", "y", "w", "h")


def dark_rejects(contours: DataFrame, params: DataFrame) -> DataFrame:
    """(prefix, n_dark): contours that the brightness rule alone rejects."""
    dark = (F.col("min_bright") > 0) & (F.col("brightness") < F.col("min_bright"))
    return contours.join(F.broadcast(params), "prefix").groupBy("prefix").agg(F.count_if(dark).alias("n_dark"))
