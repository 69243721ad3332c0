"""Counts of outcomes, the ratios made of them, and choosing the best run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxmill.functions.boxes import ratio
from boxmill.operators.ordering import placed
from boxmill.sources.shared import tasks_for, written

#: Boxes that a task puts on pages, so that what it holds doesn't grow with the table.
ROWS = 1 << 18


def counts(outcomes: DataFrame, *keys: str, total: int | None = None) -> DataFrame:
    """tp, fp and fn for each key, or over everything; with `total` also over all keys, under that number."""
    grouped = outcomes.groupBy(*keys) if total is None else outcomes.rollup(*keys)
    out = grouped.agg(*[F.count_if(F.col("outcome") == k.upper()).alias(k) for k in ("tp", "fp", "fn")])
    return out if total is None else out.withColumns({k: F.coalesce(k, F.lit(total).cast("long")) for k in keys})


def scored(counted: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, fp, fn; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.withColumns({"precision": F.round(ratio(tp, tp + fp), 9), "recall": F.round(ratio(tp, tp + fn), 9), "f1": F.round(ratio(tp * 2, tp * 2 + fp + fn), 9)})


def surplus(counted: DataFrame, target: float) -> DataFrame:
    """False positives above what the target precision allows."""
    return counted.withColumn("surplus", F.col("fp") - F.col("tp") * F.lit(round(1 - target, 12)) / F.lit(target))


def best(rows: DataFrame, keys: list[str], value: Column, ties: list[str]) -> DataFrame:
    """For each key the row of the largest value; of equal ones the first by `ties`. NaN counts as missing."""
    value = F.when(F.isnan(value), None).otherwise(value)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(value.desc_nulls_last(), *ties))
    return rows.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def canvas_pages(boxes: DataFrame, per_page: int = 100, per_row: int = 10) -> DataFrame:
    """Places crops of each class on pages in rows, best score first: the cell, its row's height, its column's width and where
    the row begins. Input: (image_id, fp_idx, cls, score, w, h), scores from 0 to 1; what is ordered in one task is a class's thousandth of them.
    The boxes, which folds may have made, are worked out once and written."""
    boxes = written(boxes, "placed")
    n = tasks_for(boxes, ROWS)
    by_score = placed(boxes, ["cls"], F.floor(F.col("score") * -1000), F.col("score").desc(), "image_id", "fp_idx", tasks=n)
    rows = by_score.withColumn("place", F.col("place") - 1).drop("in_group")
    rows = rows.withColumns({"page": F.floor(F.col("place") / per_page), "prow": F.floor(F.col("place") % per_page / per_row), "pcol": F.col("place") % per_row})
    # A page is a row of at most per_page cells.
    pages = rows.repartition(n, "cls", "page").groupBy("cls", "page").agg(F.collect_list(F.struct("prow", "pcol", "image_id", "fp_idx", "h", "w")).alias("cells"))
    largest = lambda n, line, side: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_max(F.transform(F.filter("cells", lambda c: c[line] == i), lambda c: c[side])))
    pages = pages.withColumns({"tall": largest(per_page // per_row, "prow", "h"), "wide": largest(per_row, "pcol", "w")})
    cells = pages.select("cls", "page", "tall", "wide", F.explode("cells").alias("c")).select("cls", "page", "c.prow", "c.pcol", "c.image_id", "c.fp_idx", "tall", "wide")
    above = F.aggregate(F.slice("tall", F.lit(1), F.col("prow").cast("int")), F.lit(0).cast("long"), lambda y, h: y + h)
    return cells.select("cls", "page", "prow", "pcol", "image_id", "fp_idx", F.get("tall", F.col("prow").cast("int")).alias("row_height"), F.get("wide", F.col("pcol").cast("int")).alias("col_width"), above.alias("y"))
