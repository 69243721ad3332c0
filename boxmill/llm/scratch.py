"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a new temporary one where the setting is absent and all runs on one machine (tests).

    Other masters need the setting: their executors don't see each other's local folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="boxmill-")
        spark.sparkContext.setCheckpointDir(root)
    return root


class Scratch:
    """Writes tables that cut lineage, so that a lost executor costs one table at most and never a whole loop."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.saved: list[DataFrame] = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{len(self.saved) + 1:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.saved.append(out)
        return out

    def renamed(self, table: DataFrame, *names: str) -> DataFrame:
        """A table of :meth:`save` with other names for its columns."""
        out = table.toDF(*names)
        out._scratch_path = table._scratch_path
        return out

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables of :meth:`save` but these, which what is returned reads."""
        kept = {x._scratch_path for x in tables}
        self.drop(*[x for x in self.saved if x._scratch_path not in kept])

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables of :meth:`save` that nothing lazy reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            if (path := getattr(table, "_scratch_path", None)) is not None:
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(conf).delete(target, True)
