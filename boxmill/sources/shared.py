"""Tables in the folder that all machines of a cluster share: what cuts the lineage of a loop."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a new temporary folder where that is unset and everything runs on this machine.

    Other masters need the setting, as their executors don't see each other's local folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="boxmill-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again: a lost executor costs the tasks after it and no more. It stays there until the folder is cleaned."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def tasks_for(rows: DataFrame, most: int) -> int:
    """How many tasks `most` rows each make; at least one for each core. Rows are counted, which takes the files' footers where a table is read as it is."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))


def discarded(*tables: DataFrame) -> None:
    """Deletes what written() wrote, where nothing that is still to be computed reads it."""
    for table in tables:
        target = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._written_path)
        target.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
