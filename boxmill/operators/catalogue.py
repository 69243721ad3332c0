"""File-catalogue algebra: pairing, exclusion, duplicates, renumbering and splits of named things."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxmill.operators.ordering import placed


def pair_check(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: (key, missing), missing being the side without it."""
    a, b = left.select(key).distinct().withColumn("in_left", F.lit(True)), right.select(key).distinct().withColumn("in_right", F.lit(True))
    both = a.join(b, key, "full_outer").where("in_left IS NULL OR in_right IS NULL")
    return both.select(key, F.when(F.col("in_left").isNull(), "left").otherwise("right").alias("missing"))


def duplicates(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """Groups of equal contents by SHA-256: (digest, n, first_key). Aggregates before the shuffle, so that a content of any number
    of copies is one row for each task."""
    hashed = rows.select(F.col(key), F.sha2(content, 256).alias("digest"))
    return hashed.groupBy("digest").agg(F.count("*").alias("n"), F.min(key).alias("first_key")).where("n > 1")


def renumber(rows: DataFrame, group: str, time: str, tie: str) -> DataFrame:
    """Numbers each group's rows from 1 in order of time: adds number and new_name. Rows without a time are left out. What is
    ordered in one task is a group's rows of an hour, or of a day where the time has no more."""
    numbered = placed(rows.where(F.col(time).isNotNull()), [group], F.date_trunc("hour", time), time, tie)
    numbered = numbered.withColumn("number", F.col("place").cast("int")).drop("place", "in_group")
    return numbered.withColumn("new_name", F.format_string("%s_%04d", F.col(group), F.col("number")))


def draw(key: Column, seed: int = 43) -> Column:
    """What rows are sampled by: a digest of seed and key, the same in every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sampled(rows: DataFrame, group: str, key: str, seed: int = 43) -> DataFrame:
    """rows with place and in_group: each row's place in its group's sampling order. The digest's first three digits are the
    bucket, so a group is dealt to 4,096 tasks whatever its size."""
    by = draw(F.col(key), seed)
    return placed(rows.withColumn("drawn_", by), [group], F.substring("drawn_", 1, 3), "drawn_", key).drop("drawn_")


def cap_per_group(rows: DataFrame, group: str, key: str, n: int, seed: int = 43) -> DataFrame:
    """At most n sampled rows of each group; Spark keeps n rows of each task and group before it shuffles."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(draw(F.col(key), seed), key))
    return rows.withColumn("rank_", rank).where(F.col("rank_") <= n).drop("rank_")


def split(rows: DataFrame, group: str, key: str, share: float, least: int = 0, seed: int = 43) -> DataFrame:
    """Adds in_first: whether a row is among the first int(share * n) sampled ones, or `least`, of the n of its group."""
    quota = F.greatest(F.lit(least), F.floor(F.col("in_group") * F.lit(share)))
    return sampled(rows, group, key, seed).withColumn("in_first", F.col("place") <= quota).drop("place", "in_group")


def quota_sample(rows: DataFrame, group: str, key: str, quotas: dict[str, int], seed: int = 43) -> DataFrame:
    """As many sampled rows of each group as its quota has; groups without one give none."""
    limit = F.coalesce(*[F.when(F.col(group) == g, F.lit(n)) for g, n in quotas.items()], F.lit(0))
    return sampled(rows.where(limit > 0), group, key, seed).where(F.col("place") <= limit).drop("place", "in_group")


def thinned(rows: DataFrame, thin: Column, key: str, share: float, seed: int = 43) -> DataFrame:
    """All rows that aren't `thin`, and of the thin ones as many sampled ones as `share` of all rows, thin or not, are."""
    marked = rows.withColumns({"thin_": thin, "all_": F.lit(0)})
    total = marked.groupBy("all_").agg(F.count("*").alias("total_"))
    kept = sampled(marked.join(F.broadcast(total), "all_"), "thin_", key, seed)  # one row
    return kept.where(~F.col("thin_") | (F.col("place") <= F.floor(F.col("total_") * F.lit(share)))).drop("thin_", "all_", "total_", "place", "in_group")


def cycled(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """n rows (slot 0 to n - 1) of each group: its first n by key, from the start again where it has fewer."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(key))
    firsts = rows.withColumn("rank_", rank).where(F.col("rank_") <= n)  # Spark keeps n rows of each task and group before it shuffles
    held = F.count("*").over(W.partitionBy(group))
    slots = F.sequence(F.col("rank_") - 1, F.lit(n - 1), F.col("held_").cast("int"))
    return firsts.withColumn("held_", held).withColumn("slot", F.explode(slots)).drop("rank_", "held_")


def crop_entries(crops: DataFrame, results: DataFrame, names: dict[int, str]) -> DataFrame:
    """(filename, stem, box_index, class_name, x1, y1, x2, y2) of crops named stem_index.jpg, from results (stem, entries) by the index, counted
    from 0. Files of other names are left out, and so are crops without an entry."""
    name = r"^(.*)_(\d+)\.jpg$"
    parsed = crops.where(F.col("filename").rlike(name)).select("filename", F.regexp_extract("filename", name, 1).alias("stem"), F.regexp_extract("filename", name, 2).cast("int").alias("box_index"))
    found = parsed.join(results, "stem").select("filename", "stem", "box_index", F.get("entries", F.col("box_index")).alias("e")).where("e IS NOT NULL")
    class_name = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("e.cls").cast("int")], F.format_string("Unknown(%d)", F.col("e.cls")))
    return found.select("filename", "stem", "box_index", class_name.alias("class_name"), *[f"e.{c}" for c in ("x1", "y1", "x2", "y2")])


def reviewed_key(name: Column) -> Column:
    """What a reviewed crop's name begins with: the picture's class and number; null for other names."""
    found = F.regexp_extract(name, r"^([^_]+_\d+)", 1)
    return F.when(found != "", found)


def without_reviewed(pictures: DataFrame, reviewed: DataFrame) -> DataFrame:
    """The pictures (stem, ...) that no reviewed crop (name) was cut from."""
    keys = reviewed.select(reviewed_key(F.col("name")).alias("stem")).where("stem IS NOT NULL").distinct()
    return pictures.join(keys, "stem", "left_anti")


def aligned(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows of sibling sets side by side, by their key and not by their places: the key, and each set's other columns under the set's name as a struct. A set
    without the key has null; a key that a set has twice gives two rows."""
    out = None
    for name, rows in sets.items():
        own = rows.select(key, F.struct(*[F.col(c) for c in rows.columns if c != key]).alias(name))
        out = own if out is None else out.join(own, key, "full_outer")
    return out
