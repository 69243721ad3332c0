"""Readers of label files, dumps, results and runs. All give rows with a line number where order counts."""

from __future__ import annotations

import io
import itertools
import os
import struct
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill.operators.ordering import placed
from boxmill.sources import schemas
from boxmill.sources.shared import written


def stem(path: Column) -> Column:
    """A file's name without folders and without what follows the last dot."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def folder(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


_FOUND = "path string, length long"


#: Names that a listing holds at once, and folders that a task lists at least, so that many small ones are few tasks.
NAMES, MOST_TASKS = 10_000, 1000
_ENTRY = "path string, length long, is_folder boolean"


def _entries(folder_: str) -> Iterator[tuple[str, int, bool]]:
    """What is directly in a folder, as the file system gives it. Local folders are read name by name; links to folders are left out."""
    if folder_.startswith("file:"):
        with os.scandir("/" + folder_[5:].lstrip("/")) as found:
            for x in found:
                if x.is_dir(follow_symlinks=False):
                    yield "file:" + x.path, 0, True
                elif x.is_file():
                    yield "file:" + x.path, x.stat().st_size, False
        return
    system, base = pafs.FileSystem.from_uri(folder_)
    uri = folder_[: len(folder_) - len(base)]
    for x in system.get_file_info(pafs.FileSelector(base)):
        yield uri + x.path, x.size or 0, x.type == pafs.FileType.Directory


def _pieces(entries: Iterator[tuple[str, int, bool]]) -> Iterator[pa.RecordBatch]:
    while piece := list(itertools.islice(entries, NAMES)):
        path, length, is_folder = zip(*piece)
        yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(length, pa.int64()), pa.array(is_folder, pa.bool_())], ["path", "length", "is_folder"])


def _below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder_ in batch.column(0).to_pylist():
            yield from _pieces(_entries(folder_))


def _walked(spark: SparkSession, fs, top, recursive: bool) -> DataFrame:
    """(path, length) by the driver, for file systems that only Spark can read; names are written in pieces."""
    found, out = (fs.listFiles(top, True) if recursive else fs.listStatusIterator(top)), None

    def names() -> Iterator[tuple[str, int, bool]]:
        while found.hasNext():
            x = found.next()
            yield x.getPath().toString(), x.getLen(), x.isDirectory()

    for piece in _pieces(names()):
        piece = written(spark.createDataFrame(pa.Table.from_batches([piece])), "listing").where("NOT is_folder").drop("is_folder")
        out = piece if out is None else out.union(piece)
    return spark.createDataFrame([], _FOUND) if out is None else out


def _listed(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    """(path, length) of the files below root, or of those directly in it.

    Folders are listed by tasks, level by level: what a level's folders hold is written in pieces, and its folders are the next level. So neither the driver nor a task
    holds the names, whatever a folder has. Where the tasks can't read the file system, the driver lists it, in pieces too, and a warning says so.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.resolvePath(top) if fs.exists(top) else top
    start = top.toString()
    if not start.startswith("file:"):
        try:
            pafs.FileSystem.from_uri(start)
        except (pa.ArrowException, OSError, ValueError):
            warnings.warn(f"tasks can't list {start}: the driver does, which takes time for many files", stacklevel=3)
            return _walked(spark, fs, top, recursive)
    level, files = spark.createDataFrame([(start,)], "folder string"), None
    while True:
        found = written(level.mapInArrow(_below, _ENTRY), "listing")
        here = found.where("NOT is_folder").drop("is_folder")
        files = here if files is None else files.union(here)
        folders = found.where("is_folder").select(F.col("path").alias("folder"))
        n = folders.count() if recursive else 0
        if not n:
            return files
        # By a hash of the name, so that a parent's folders are dealt out evenly.
        level = folders.repartition(min(n, MOST_TASKS), F.xxhash64("folder"))


def manifest(spark: SparkSession, root: str, count_lines: bool = False, recursive: bool = True) -> DataFrame:
    """(folder, stem, extension, path, length, n_lines) of all files in root and, unless `recursive` is false, in the folders below it.

    Names and lengths come from the file system's own listing, since Spark's readers leave out empty files, and an empty
    label file (a picture without objects) is not a missing one. Lines are counted by Spark, 0 in empty files.
    """
    files = _listed(spark, root, recursive)
    files = files.select(folder(F.col("path")).alias("folder"), stem(F.col("path")).alias("stem"), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("extension"), "path", "length")
    if not count_lines:
        return files.withColumn("n_lines", F.lit(None).cast("long"))
    lines = lines_of(spark, root, recursive=True).groupBy("path").agg(F.count("*").alias("n_lines"))
    return files.join(lines, "path", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0))).select(*files.columns, "n_lines")


def flat_listing(spark: SparkSession, root: str) -> DataFrame:
    """The files directly in root, in order of their names."""
    return manifest(spark, root, recursive=False).orderBy("stem", "extension")


def lines_by_prefix(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    """(n_files, n_lines): the files directly in root whose names begin with prefix, and their lines, empty files included."""
    files = manifest(spark, root, count_lines=True, recursive=False).where(F.col("stem").startswith(prefix))
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_lines"))


def set_files(spark: SparkSession, path: str, split: str | None = None, cls: str | None = None) -> DataFrame:
    """The files of sets written by writers.write_sets(), of one split or class alone if it is named: then only its folders are read, and no others listed."""
    files = spark.read.schema("stem string, path string, split string, cls string").parquet(path)
    for name, value in (("split", split), ("cls", cls)):
        files = files if value is None else files.where(F.col(name) == value)
    return files


def images_in(files: DataFrame, extensions: tuple[str, ...] = ("jpg", "jpeg", "png")) -> DataFrame:
    return files.where(F.col("extension").isin(*extensions))


def lines_of(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, line_no, line): whole files, so that numbers are right; the end of the last line makes no further one."""
    text = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True)
    lines = F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n", -1)
    return text.select(F.col("_metadata.file_path").alias("path"), F.posexplode(lines).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of large files, which Spark reads in pieces: lines are numbered within a piece, after the lines of the pieces before it."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("piece"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    return placed(text, ["path"], F.col("piece"), "at").select("path", F.col("place").alias("line_no"), "line")


def label_lines(spark: SparkSession, path: str, strict: bool = True, recursive: bool = False) -> DataFrame:
    """(path, stem, line_no, cls, xc, yc, w, h) of label files; strict fails on lines that aren't five numbers, else they are left out."""
    rows = lines_of(spark, path, recursive).withColumn("t", F.split(F.trim("line"), r"\s+"))
    numbers = [F.get("t", F.lit(i)).try_cast("int" if i == 0 else "double").alias(n) for i, n in enumerate(("cls", "xc", "yc", "w", "h"))]
    rows = rows.select("path", stem(F.col("path")).alias("stem"), "line_no", F.size("t").alias("n"), *numbers)
    good = (F.col("n") == 5) & F.col("cls").isNotNull() & F.col("xc").isNotNull() & F.col("yc").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    if strict:
        problem = F.raise_error(F.concat(F.lit("not a label: line "), F.col("line_no"), F.lit(" of "), F.col("path")))
        return rows.withColumn("cls", F.when(good, F.col("cls")).otherwise(problem)).drop("n")
    return rows.where(good).drop("n")


def tuple_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, line_no, x, y, w, h) of lines like (1, 2, 3, 4)."""
    rows = lines_of(spark, path).withColumn("t", F.transform(F.split(F.regexp_replace("line", r"[()\s]", ""), ","), lambda c: c.cast("int")))
    return rows.where("line <> ''").select("path", stem(F.col("path")).alias("stem"), "line_no", *[F.col("t")[i].alias(n) for i, n in enumerate("xywh")])


def rectangle_dump(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, rect_idx, x, y, w, h): a list of rectangles for each line, a line for each picture."""
    rows = numbered_lines(spark, path).select("line_no", F.posexplode(F.from_json("line", "array<array<int>>")).alias("rect_idx", "r"))
    return rows.select("line_no", "rect_idx", *[F.col("r")[i].alias(n) for i, n in enumerate("xywh")])


def value_dump(spark: SparkSession, path: str) -> DataFrame:
    return numbered_lines(spark, path).select("line_no", F.explode(F.from_json("line", "array<double>")).alias("value"))


def metrics_files(spark: SparkSession, path: str) -> DataFrame:
    """(train, eval, cls, tp, fp, fn, precision, recall) of files trainXevalY.json; class null is the summary."""
    rows = spark.read.schema(schemas.METRICS).option("multiLine", "true").json(path).withColumn("path", F.col("_metadata.file_path"))
    name = r"[A-Za-z]+(\d+)[A-Za-z]+(\d+)\.[A-Za-z]+$"
    run = [F.regexp_extract("path", name, 1).cast("int").alias("train"), F.regexp_extract("path", name, 2).cast("int").alias("eval")]
    entries = F.concat(F.map_entries(F.coalesce("per_class", F.create_map().cast(f"map<string,{schemas.COUNTS}>"))), F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("summary").alias("value"))))
    rows = rows.select(*run, F.explode(entries).alias("e"))
    nan = lambda c: F.when(F.isnan(c), None).otherwise(c)
    return rows.select("train", "eval", F.col("e.key").cast("int").alias("cls"), F.col("e.value.TP").alias("tp"), F.col("e.value.FP").alias("fp"), F.col("e.value.FN").alias("fn"), nan(F.col("e.value.precision")).alias("precision"), nan(F.col("e.value.recall")).alias("recall"))


def false_positives(spark: SparkSession, path: str) -> DataFrame:
    """(filename, box_index, cls, score, x1, y1, x2, y2) of results files."""
    rows = spark.read.schema(schemas.RESULTS).option("multiLine", "true").json(path)
    fp = F.arrays_zip("false_positives.boxes", "false_positives.classes", "false_positives.scores")
    rows = rows.select("filename", F.posexplode(fp).alias("box_index", "f"))
    return rows.select("filename", "box_index", F.col("f.classes").alias("cls"), F.col("f.scores").alias("score"), *[F.col("f.boxes")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def templates(spark: SparkSession, path: str) -> DataFrame:
    """(path, cls, stem, n_lines) of split templates, JSON of a map of maps."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schemas.TEMPLATE).alias("m"))
    return rows.select("path", F.explode("m").alias("cls", "files")).select("path", "cls", F.explode("files").alias("stem", "n_lines"))


def curves(spark: SparkSession, path: str) -> DataFrame:
    """Training curves, a row for each epoch, with the run's folder; names without slashes and brackets."""
    raw = spark.read.option("header", "true").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)
    kind = lambda n: "int" if n == "epoch" else "double"
    return raw.select(folder(F.col("_metadata.file_path")).alias("run"), *[F.col(f"`{a}`").cast(kind(a)).alias(b) for a, b in schemas.CURVE.items()])


def _table(spark: SparkSession, path: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns of CSV files by the names in their header, as (name, type); lines without any value are left out."""
    raw = spark.read.option("header", "true").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)
    own = [F.col(f"`{c}`").cast(kind).alias(name) for c, (name, kind) in columns.items()]
    return raw.select(*own).dropna("all")


def final_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, tp, fp, fn, precision, recall) of final metrics."""
    counts = {c: (c.lower(), "int") for c in ("TP", "FP", "FN")}
    return _table(spark, path, {"prefix": ("prefix", "string"), **counts, "precision": ("precision", "double"), "recall": ("recall", "double")})


def filter_ablation(spark: SparkSession, path: str, species: tuple[str, ...] = schemas.SPECIES) -> DataFrame:
    """(variant, species, p, fp, tp) of a table of filter variants; a species for which a variant reports nothing is left out."""
    kinds = {"p": "double", "FP": "int", "TP": "int"}
    wide = _table(spark, path, {"_c0": ("variant", "string"), **{f"{s}_{k}": (f"{s}_{k}", kind) for s in species for k, kind in kinds.items()}})
    each = [F.struct(F.lit(s).alias("species"), *[F.col(f"{s}_{k}").alias(k.lower()) for k in ("p", "FP", "TP")]) for s in species]
    rows = wide.select("variant", F.explode(F.array(*each)).alias("r")).select("variant", "r.*")
    return rows.where(F.coalesce("p", F.col("fp").cast("double"), F.col("tp").cast("double")).isNotNull())


def mask_ablation(spark: SparkSession, path: str, species: tuple[str, ...] = schemas.SPECIES) -> DataFrame:
    """(mask, alignment, shift, species, fp, tp) of a table of masks; a mask's name can occur in several rows."""
    own = {c: (c, "string") for c in ("mask", "alignment", "shift")}
    wide = _table(spark, path, {**own, **{f"{k} {s}": (f"{s}_{k}", "int") for s in species for k in ("FP", "TP")}})
    each = [F.struct(F.lit(s).alias("species"), F.col(f"{s}_FP").alias("fp"), F.col(f"{s}_TP").alias("tp")) for s in species]
    return wide.select(*own, F.explode(F.array(*each)).alias("r")).select(*own, "r.*")


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, shape, data) of files of one array each, their numbers as doubles, row by row."""

    @F.pandas_udf("shape array<int>, data array<double>")
    def load(content: pd.Series) -> pd.DataFrame:
        found = [np.load(io.BytesIO(c), allow_pickle=False) for c in content]
        return pd.DataFrame({"shape": [list(a.shape) for a in found], "data": [a.astype("float64").ravel() for a in found]})

    return spark.read.format("binaryFile").load(path).select("path", load("content").alias("a")).select("path", "a.*")


def pictures(spark: SparkSession, path: str, grey: bool = False) -> DataFrame:
    """(path, height, width, content) of pictures that Spark can decode: blue, green and red bytes row by row, or grey ones. Files that are none are left out."""
    rows = spark.read.format("image").option("dropInvalid", "true").load(path)
    rows = rows.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))

    @F.pandas_udf("binary")
    def levels(data: pd.Series, channels: pd.Series) -> pd.Series:
        def one(d: bytes, n: int) -> bytes:
            x = np.frombuffer(d, np.uint8).reshape(-1, n)
            if n == 1 and not grey:
                return np.repeat(x, 3, axis=1).tobytes()
            if n > 1 and grey:
                return np.round(x[:, :3] @ np.array(schemas.GREY)).astype(np.uint8).tobytes()
            return x[:, :3].tobytes()

        return pd.Series([one(d, n) for d, n in zip(data, channels, strict=True)])

    return rows.select("path", "height", "width", levels("data", "channels").alias("content"))


def flat_yaml(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value) of files with a key and a value on each line."""
    rows = lines_of(spark, path).where("line RLIKE '^[^#\\\\s][^:]*:'")
    return rows.select("path", F.trim(F.substring_index("line", ":", 1)).alias("key"), F.trim(F.regexp_replace("line", r"^[^:]*:", "")).alias("value"))


def _exif_time(data: bytes | None) -> str | None:
    """DateTimeOriginal of a JPEG's EXIF segment; None if there is none or the file is broken."""
    try:
        at = data.index(b"Exif\0\0") + 6
        tiff = data[at : at + 65536]
        order = {b"II": "<", b"MM": ">"}[tiff[:2]]

        def entries(offset: int) -> Iterator[tuple[int, int, int]]:
            (n,) = struct.unpack_from(order + "H", tiff, offset)
            for i in range(n):
                tag, _, count, value = struct.unpack_from(order + "HHII", tiff, offset + 2 + 12 * i)
                yield tag, count, value

        main = {tag: value for tag, _, value in entries(struct.unpack_from(order + "I", tiff, 4)[0])}
        own = {tag: (count, value) for tag, count, value in entries(main[0x8769])}
        count, value = own[0x9003]
        return tiff[value : value + count].split(b"\0")[0].decode("ascii")
    except (AttributeError, KeyError, ValueError, struct.error):
        return None


def exif_times(files: DataFrame) -> DataFrame:
    """Adds taken, a timestamp, to rows of Spark's binaryFile source; null where a file has no readable time."""

    @F.pandas_udf("string")
    def times(content: pd.Series) -> pd.Series:
        return content.map(_exif_time)

    return files.withColumn("taken", F.try_to_timestamp(times("content"), F.lit("yyyy:MM:dd HH:mm:ss")))
