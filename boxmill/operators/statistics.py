"""Distributions: exact percentiles, closed histograms, box plots, means with deviations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, one column for each name.

    A group's distinct values and their counts meet in one task, whatever the number of rows: right for whole numbers such as
    areas in pixels; for values that rarely repeat there is boxmill.operators.ranks.
    """
    found = rows.groupBy(*keys).agg(F.percentile(value, list(shares.values())).alias("q_"), F.min(value).alias("min"), F.max(value).alias("max"))
    return found.select(*keys, *[F.col("q_")[i].alias(name) for i, name in enumerate(shares)], "min", "max")


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin of equal widths; the last one holds its upper end too."""
    return F.least(F.width_bucket(value.cast("double"), low.cast("double"), high.cast("double"), F.lit(bins)), F.lit(bins)).cast("long") - 1


def histogram(rows: DataFrame, key: str, value: str, bins: int) -> DataFrame:
    """(key, bin, n) between the key's smallest and largest value; empty bins give no row. The ends are aggregated before
    they are joined back, so a hot key is not gathered in one task."""
    ends = rows.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high")).where("low < high")
    placed = rows.join(ends, key).withColumn("bin", bin_of(F.col(value), F.col("low"), F.col("high"), bins))
    return placed.groupBy(key, "bin").agg(F.count("*").alias("n"))


def mean_and_deviation(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean and sample deviation, rounded to even hundredths; the deviation of one value is 0."""
    n = F.count(value)
    std = F.when(n == 1, F.lit(0.0)).otherwise(F.stddev_samp(value))
    return rows.groupBy(key).agg(n.alias("n"), F.bround(F.avg(value), 2).alias("mean"), F.bround(std, 2).alias("std"))


def best_epoch(curves: DataFrame, run: str, epoch: str, metric: str) -> DataFrame:
    """The row of each run with its best metric, the earliest of equal ones; NaN counts as missing."""
    value = F.when(F.isnan(metric), None).otherwise(F.col(metric))
    rank = F.row_number().over(W.partitionBy(run).orderBy(value.desc_nulls_last(), epoch))
    return curves.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def elapsed(curves: DataFrame, run: str, epoch: str, clock: str) -> DataFrame:
    """Adds total: the clock's sum over launches of a run, the clock starting anew with each launch."""
    w = W.partitionBy(run).orderBy(epoch)
    before = F.lag(clock).over(w)
    step = F.when(before.isNull() | (F.col(clock) < before), F.col(clock)).otherwise(F.col(clock) - before)
    return curves.withColumn("step_", step).withColumn("total", F.sum("step_").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("step_")


def dataset_report(pictures: DataFrame, labelled: DataFrame, group: str, n: str) -> DataFrame:
    """For each group: its pictures, its labelled ones and their share in percent, instances, their mean for a labelled picture, and how many all pictures would
    have at that mean. `labelled` has a row with n instances for each labelled picture; a group without one has zeros and no mean."""
    files = pictures.groupBy(group).agg(F.count("*").alias("image_files"))
    found = labelled.groupBy(group).agg(F.count("*").alias("label_files"), F.sum(n).alias("instances"))
    mean = F.try_divide(F.col("instances").cast("double"), F.col("label_files"))
    rows = files.join(found, group, "left").fillna(0, ["label_files", "instances"])
    return rows.select(
        group, "image_files", "label_files", F.round(F.lit(100.0) * F.col("label_files") / F.col("image_files"), 6).alias("percent_labelled"), "instances",
        F.round(mean, 6).alias("mean_instances"), F.round(mean * F.col("image_files"), 6).alias("estimated_instances"),
    )


def dataset_totals(report: DataFrame) -> DataFrame:
    """One row: the sums of a dataset_report()'s pictures, labelled ones and instances."""
    return report.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("image_files", "label_files", "instances")])


def side_by_side(sets: dict[str, DataFrame], group: str) -> DataFrame:
    """Counts of the rows of each set by group, a column for each set; null where a set lacks the group."""
    counted = [rows.groupBy(group).agg(F.count("*").alias(name)) for name, rows in sets.items()]
    out = counted[0]
    for more in counted[1:]:
        out = out.join(more, group, "full_outer")
    return out
