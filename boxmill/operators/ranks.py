"""Exact percentiles of any values, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxmill.sources.shared import written

#: Into how many ranges a group is cut at a time, and from how few values on they are sorted together.
CUTS, FEW = 64, 4096


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles with linear interpolation, one column for each name, and `min` and `max`, as doubles: what F.percentile() gives.

    The ranks next to each share are looked for. A sketch of bounded size cuts a group's values in some ranges, the values at the cuts being ranges of their own; the ranges are counted exactly,
    and the one that a wanted rank falls in is cut again, until it is one value or has few. The sketch only decides how even the ranges are. So tasks hold ranges' counts, a
    few values at the end, and never a group, nor its distinct values; each round leaves about one in CUTS rows of the last.
    Nulls don't count and groups without values give no rows; NaN is the largest value. Null keys are a group.
    """
    same = lambda of: [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in of]
    left = rows.select(*keys, F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    totals = written(left.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max")), "ranks-totals")
    places = [(F.col("n") - 1) * F.lit(float(p)) for p in shares.values()]
    both = F.array(*[f(p).cast("long") for p in places for f in (F.floor, F.ceil)])
    wanted, group, found = totals.select(*keys, F.posexplode(both).alias("k", "rank")), keys, None
    while True:
        cuts = F.percentile_approx("v", [k / CUTS for k in range(CUTS + 1)], CUTS * 16)
        ends = F.array_sort(F.array_distinct(F.concat(F.array(F.min("v"), F.max("v")), cuts)))
        cut = left.groupBy(*group).agg(ends.alias("cuts")).alias("b")
        # Even numbers are the values at the cuts, odd ones what lies between them.
        under = F.size(F.filter("cuts", lambda c: c < F.col("v")))
        ranged = left.alias("a").join(cut, same(group)).select("a.*", (2 * under - F.when(F.array_contains("cuts", F.col("v")), 0).otherwise(1)).alias("range"))
        ranged = written(ranged, "ranks-ranged")
        sizes = ranged.groupBy(*group, "range").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(W.partitionBy(*group).orderBy("range"))
        sizes = sizes.withColumn("before", upto - F.col("n")).alias("b")
        hit = (F.col("before") <= F.col("a.rank")) & (F.col("a.rank") < F.col("before") + F.col("n"))
        chosen = wanted.alias("a").join(sizes, [*same(group), hit]).select("a.*", "range", "n", "low", "high", "before")
        chosen = written(chosen.withColumn("rank", F.col("rank") - F.col("before")).drop("before"), "ranks-chosen")
        single = chosen.where("low <=> high").select(*keys, "k", F.col("low").alias("v"))
        rest = chosen.where("NOT (low <=> high)")
        of = [*group, "range"]
        held = ranged.alias("a").join(rest.alias("b"), same(of)).select(*[f"a.{k}" for k in keys], "b.k", "a.v", "b.rank", "b.n")
        few = held.where(F.col("n") <= FEW).groupBy(*keys, "k", "rank").agg(F.array_sort(F.collect_list("v")).alias("vs")).select(*keys, "k", F.element_at("vs", (F.col("rank") + 1).cast("int")).alias("v"))
        now = single.union(few)
        found = now if found is None else found.union(now)
        rest = rest.where(F.col("n") > FEW)
        if rest.isEmpty():
            break
        left = written(held.where(F.col("n") > FEW).drop("rank", "n"), "ranks-left")
        wanted, group = rest.select(*keys, "k", "rank"), [*keys, "k"]
    values = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("vs"))

    def between(i: int, place: Column) -> Column:
        low, high = (F.element_at("vs", F.lit(2 * i + side)) for side in (0, 1))
        return F.when(F.floor(place) == F.ceil(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    out = totals.alias("a").join(values.alias("b"), same(keys)).select("a.*", "vs")
    return out.select(*keys, *[between(i, p).alias(name) for i, (name, p) in enumerate(zip(shares, places))], "min", "max")
