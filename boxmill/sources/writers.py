"""Writers of label lines, dumps, metrics and copies."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_line(cls: Column, xc: Column, yc: Column, w: Column, h: Column) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", cls.cast("int"), xc, yc, w, h)


def tuple_line(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.format_string("(%d, %d, %d, %d)", x, y, w, h)


def label_files(labels: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, content): the text of each image's label file, empty for an image without labels."""
    line = label_line(*(F.col(c) for c in ("cls", "xc", "yc", "w", "h")))
    texts = labels.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("box_idx", line.alias("line")))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: F.concat(x["line"], F.lit("\n"))), "")
    return images.select("image_id").join(texts, "image_id", "left").select("image_id", F.coalesce(text, F.lit("")).alias("content"))


def _opened(uri: str):
    """The file system that a path names, and the path there."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_files(files: DataFrame, root: str, extension: str = ".txt") -> None:
    """One file for each row (image_id, content), text or bytes, by the executors, through the file system that root names. A task that runs twice writes the
    same files."""
    def put(rows) -> None:
        system, base = _opened(root)
        system.create_dir(base)
        for row in rows:
            with system.open_output_stream(f"{base}/{row.image_id}{extension}") as f:
                f.write(row.content.encode() if isinstance(row.content, str) else bytes(row.content))

    files.select("image_id", "content").foreachPartition(put)


def without_lines(labels: DataFrame, images: DataFrame, deleted: DataFrame) -> DataFrame:
    """(image_id, content): a new version of the label files, without the lines (image_id, box_idx) of `deleted`. write_files() puts it in a folder
    of its own; the old version stays as it is."""
    return label_files(labels.join(deleted, ["image_id", "box_idx"], "left_anti"), images)


def array_files(arrays: DataFrame) -> DataFrame:
    """(image_id, content): the bytes of a file for each row (image_id, shape, data), as readers.arrays() reads them."""
    @F.pandas_udf("binary")
    def dump(shape: pd.Series, data: pd.Series) -> pd.Series:
        def one(s, d) -> bytes:
            out = io.BytesIO()
            np.save(out, np.asarray(d, "float64").reshape(tuple(s)))
            return out.getvalue()

        return pd.Series([one(s, d) for s, d in zip(shape, data, strict=True)])

    return arrays.select("image_id", dump("shape", "data").alias("content"))


def rectangle_dump(rects: DataFrame) -> DataFrame:
    """(image_id, rects): a JSON list of [x, y, w, h] for each image, with the image's name kept."""
    lists = rects.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("box_idx", F.array("x", "y", "w", "h").alias("r")))).alias("l"))
    return lists.select("image_id", F.to_json(F.transform("l", lambda x: x["r"])).alias("rects"))


def metrics_json(counted: DataFrame, total: int = -1) -> DataFrame:
    """One row with the JSON of metrics files from scored counts per class, the total under its number. A row for each class, so
    gathering them is bounded."""
    row = F.struct(F.col("tp").alias("TP"), F.col("fp").alias("FP"), F.col("fn").alias("FN"), "precision", "recall")
    entries = F.array_sort(F.collect_list(F.when(F.col("cls") != total, F.struct(F.col("cls").cast("string").alias("key"), row.alias("value")))))
    made = counted.agg(F.first(F.when(F.col("cls") == total, row), ignorenulls=True).alias("summary"), F.map_from_entries(entries).alias("per_class"))
    return made.select(F.to_json(F.struct("summary", "per_class")).alias("value"))


def results_json(outcomes: DataFrame, name: Column | None = None) -> DataFrame:
    """(value): a line of JSON for each image of folds.outcomes(), with its boxes and classes by outcome, the false positives' scores too."""
    box = F.struct("place", F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]).alias("box"), F.col("cls").cast("int").alias("cls"), "score")
    kinds = {"TP": "true_positives", "FP": "false_positives", "FN": "false_negatives"}
    gathered = [F.array_sort(F.collect_list(F.when(F.col("outcome") == k, box))).alias(k) for k in kinds]
    each = lambda k, field: F.transform(k, lambda b: b[field])

    def part(kind: str) -> Column:
        scores = [each(kind, "score").alias("scores")] if kind == "FP" else []
        return F.struct(each(kind, "box").alias("boxes"), each(kind, "cls").alias("classes"), *scores).alias(kinds[kind])

    filename = F.concat(F.col("image_id").cast("string"), F.lit(".jpg")) if name is None else name
    rows = outcomes.groupBy("image_id").agg(*gathered)
    return rows.select(F.to_json(F.struct(filename.alias("filename"), *map(part, kinds))).alias("value"))


def split_json(files: DataFrame) -> DataFrame:
    """(value): one row with the JSON of a split template from rows (cls, stem, n_lines), a map of maps; unlabelled files have null. A template names its files in
    one document, so it is as large as their list."""
    per_class = files.groupBy("cls").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stem", "n_lines")))).alias("files"))
    by_class = lambda a, b: F.when(a["cls"] < b["cls"], -1).when(a["cls"] > b["cls"], 1).otherwise(0)
    whole = F.map_from_entries(F.array_sort(F.collect_list(F.struct("cls", "files")), by_class))
    return per_class.agg(F.to_json(whole, {"ignoreNullFields": "false"}).alias("value"))


def write_sets(files: DataFrame, path: str, per_file: int = 100_000) -> None:
    """Files (split, cls, stem, path) of sets as a table with a folder for each split and class, in place of what is there.

    A class is dealt out to as many files as it has `per_file` rows, so a large class is the work of many tasks and a small one is one file.
    """
    sizes = files.groupBy("split", "cls").agg(F.ceil(F.count("*") / per_file).alias("n_"))
    same = F.col("a.split").eqNullSafe(F.col("b.split")) & F.col("a.cls").eqNullSafe(F.col("b.cls"))
    rows = files.select("split", "cls", "stem", "path").alias("a").join(sizes.alias("b"), same).select("a.*", F.pmod(F.xxhash64("stem", "path"), F.col("n_")).alias("deal_"))
    dealt = rows.repartition("split", "cls", "deal_").drop("deal_")
    # Only the partitions that are written are replaced in Spark's dynamic mode; here all are.
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("split", "cls").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """In place of what is there, with a header."""
    rows.write.mode("overwrite").option("header", "true").csv(path)


def append_csv(rows: DataFrame, path: str) -> None:
    """Appends without a header."""
    rows.write.mode("append").option("header", "false").csv(path)


def copy_files(plan: DataFrame) -> DataFrame:
    """Carries out a plan (src, dst) on the executors, through the file systems that the paths name, and returns (src, dst, copied). Copying again gives the same
    files, so a task that is run twice does no harm."""

    def copy(batches):
        for pdf in batches:
            done = []
            for src, dst in zip(pdf.src, pdf.dst, strict=True):
                (from_, a), (to, b) = _opened(src), _opened(dst)
                if there := from_.get_file_info(a).type == fs.FileType.File:
                    to.create_dir(b.rpartition("/")[0], recursive=True)
                    fs.copy_files(a, b, source_filesystem=from_, destination_filesystem=to)
                done.append(there)
            yield pd.DataFrame({"src": pdf.src, "dst": pdf.dst, "copied": done})

    return plan.select("src", "dst").mapInPandas(copy, "src string, dst string, copied boolean")
