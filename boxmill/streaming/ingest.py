"""Label files as they arrive, as a stream of boxes, and counts of classes over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from boxmill.sources.readers import stem


def label_stream(spark: SparkSession, path: str) -> DataFrame:
    """(stem, arrived, line_no, cls, xc, yc, w, h): each new label file's lines once; other lines are left out.
    Empty files give no rows here; boxmill.sources.readers.manifest() tells them from missing ones."""
    text = spark.readStream.text(path, wholetext=True)
    rows = text.select(stem(F.col("_metadata.file_path")).alias("stem"), F.col("_metadata.file_modification_time").alias("arrived"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    rows = rows.withColumn("t", F.split(F.trim("line"), r"\s+")).where(F.size("t") == 5)
    numbers = [F.get("t", F.lit(i)).try_cast("int" if i == 0 else "double").alias(n) for i, n in enumerate(("cls", "xc", "yc", "w", "h"))]
    return rows.select("stem", "arrived", (F.col("line_no") + 1).alias("line_no"), *numbers).dropna()


def class_counts(labels: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Boxes of each class by time of arrival; windows close when the watermark has passed them, so state stays bounded."""
    return labels.withWatermark("arrived", late).groupBy(F.window("arrived", window), "cls").agg(F.count("*").alias("n")).select("window.start", "cls", "n")


def to_table(labels: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there to a Parquet table and ends; started again it goes on where it was."""
    return labels.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
