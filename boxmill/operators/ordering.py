"""Places of rows in the order of their group, without a group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def placed(rows: DataFrame, group: list[str], bucket: Column, *order: Column | str, tasks: int | None = None) -> DataFrame:
    """rows with `place`, counted from 1 in each group by `order`, and `in_group`, the group's number of rows.

    `bucket` is a coarse part of the order: rows of a smaller bucket come before those of a larger one. Rows are counted by group and bucket first, sums
    over those counts say where a bucket begins, and only a bucket's rows are ordered together; so the tasks are as many as there are buckets, however few the
    groups are. Nulls are a group, and a bucket that comes first. The rows are read twice, so those that are dear to make should be written first. With `tasks` they are ordered in so many, and
    in as many as the session's settings say without.
    """
    rows = rows.withColumn("bucket_", bucket)
    keys = [*group, "bucket_"]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("held_"))
    before = W.partitionBy(*group).orderBy("bucket_").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(k).alias(f"{k}_of") for k in keys],
        F.coalesce(F.sum("held_").over(before), F.lit(0)).alias("before_"),
        F.sum("held_").over(W.partitionBy(*group)).alias("in_group"),
    )
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys])
    own = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    dealt = rows.repartition(tasks, *keys) if tasks else rows
    out = dealt.withColumn("own_", own).join(starts, same).withColumn("place", F.col("before_") + F.col("own_"))
    return out.drop("own_", "bucket_", "before_", *[f"{k}_of" for k in keys])
