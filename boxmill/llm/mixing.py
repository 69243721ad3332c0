"""Mixing sources to target weights by pivotal rounding in a reduction tree. JVM-side throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxmill.llm.scratch import Scratch
from boxmill.llm.tables import table, uniform, words_in

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, and the most that a source gives as a multiple of its own.
TOTAL, MOST = 1.5, 2.0
#: Documents rounded together; the leftovers of as many blocks meet in the next level of the tree.
BLOCK = 256
#: Bits of the map of repeated rows, and rows that meet under one key when their copies are dealt.
SIEVE_BITS, CHUNK = 1 << 23, 8192


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, n_rows, target) from rows (source, size).

    A target is the smaller of `most` times the source's size and a common level times its weight. The level at which
    all targets sum to `total` is where handing the excess of full sources to the others ends. Sources
    fill up in the order of capacity to weight, so running sums over the sources give the level. Weights go by the place of a source
    among all, so these windows run over all sources in one task: a row of some 60 bytes for each, pre-aggregated,
    and never over documents. Ten million sources are 0.6 GB, which the window spills.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("room", F.col("source_size") * F.lit(most))
    every = W.partitionBy()
    order = W.orderBy(F.col("room") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    goal = F.sum("source_size").over(every) * F.lit(total)
    full = F.coalesce(F.sum("room").over(before), F.lit(0.0))
    used = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (goal - full) / (F.sum("weight").over(every) - used)
    # The first source that the level leaves room in sets it for itself and all after it.
    s = s.withColumn("level", F.when(level * F.col("weight") <= F.col("room"), level))
    s = s.withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), F.col("room")).otherwise(F.least("room", F.col("level") * F.col("weight")))
    return s.select("source", "source_size", "n_rows", target.alias("target"))


def _settle(items: Column, seed: int, level: Column | int) -> Column:
    """Pivotal rounding along a list of (size, doc_id, row_key, base, part): the list with every part but one 0 or 1.

    The item in hand meets the next one. Words move between the two, so that the sum of size * part stays, until one
    part is 0 or 1; which way is drawn with odds that keep both expectations. The unsettled one stays in hand.
    """
    def meet(acc: Column, b: Column) -> Column:
        a = acc["hand"]
        zero, one = F.lit(0.0), F.lit(1.0)
        up = F.least((one - a["part"]) * a["size"], b["part"] * b["size"])
        down = F.least(a["part"] * a["size"], (one - b["part"]) * b["size"])
        rise = uniform(seed, a["doc_id"], a["row_key"], b["doc_id"], b["row_key"]) * (up + down) < down
        move = F.when(rise, up).otherwise(-down)
        snap = lambda x: F.when(x < 1e-9, zero).when(x > 1 - 1e-9, one).otherwise(x)
        a2 = a.withField("part", snap(a["part"] + move / a["size"]))
        b2 = b.withField("part", snap(b["part"] - move / b["size"]))
        settled = a2["part"].isin(0.0, 1.0)
        done = F.when(settled, a2).otherwise(b2)
        hand = F.when(settled, b2).otherwise(a2)
        return F.struct(hand.alias("hand"), F.concat(acc["done"], F.array(done)).alias("done"))

    start = F.struct(F.element_at(items, 1).alias("hand"), F.slice(items, 1, 0).alias("done"))
    end = F.aggregate(F.slice(items, 2, F.greatest(F.size(items), F.lit(1))), start, meet)
    return end


def _shares(groups: DataFrame, targets: DataFrame, scratch: Scratch, seed: int, block: int) -> DataFrame:
    """(source, doc_id, row_key, in_all): how often the rows of each group of equal ones are taken, all together."""
    rows = groups.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "source_size", "n_rows", "target")
    share = F.when(F.col("size") > 0, F.col("n") * F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("base", F.floor(share + 1e-9).cast("long")).withColumn("part", F.greatest(share - F.col("base"), F.lit(0.0)))
    rows = scratch.save(rows.withColumn("part", F.when(F.col("part") > 1e-9, F.col("part")).otherwise(0.0)), "rows")
    settled = [rows.where("part = 0").select("source", "doc_id", "row_key", "base", F.lit(0.0).alias("part"))]
    item = F.struct("size", "doc_id", "row_key", "base", "part")
    todo, level = rows.where("part > 0").select("source", F.col("n_rows").alias("n_items"), item.alias("item")), 0
    while True:
        n = F.ceil(F.col("n_items") / F.lit(block))
        place = F.when(n > 1, F.pmod(F.xxhash64(F.lit(seed + level), "item.doc_id", "item.row_key"), n)).otherwise(F.lit(0).cast("long"))
        largest_first = F.reverse(F.array_sort(F.collect_list("item")))
        ends = todo.withColumn("place", place).groupBy("source", "place", "n_items").agg(largest_first.alias("items"))
        ends = ends.select("source", "n_items", _settle(F.col("items"), seed, level).alias("end"))
        ends = scratch.save(ends, f"level-{level}")
        settled.append(ends.select("source", F.explode("end.done").alias("x")).select("source", "x.doc_id", "x.row_key", "x.base", "x.part"))
        last = F.col("n_items") <= block
        hand = F.col("end.hand")
        drawn = F.when(uniform(seed + 1, hand["doc_id"], hand["row_key"]) < hand["part"], 1.0).otherwise(0.0)
        settled.append(ends.where(last | hand["part"].isin(0.0, 1.0)).select("source", hand["doc_id"], hand["row_key"], hand["base"], F.when(hand["part"].isin(0.0, 1.0), hand["part"]).otherwise(drawn)))
        todo = ends.where(~last & ~hand["part"].isin(0.0, 1.0)).select("source", F.ceil(F.col("n_items") / F.lit(block)).alias("n_items"), hand.alias("item"))
        level += 1
        if todo.isEmpty():
            break
    return reduce(DataFrame.union, settled).select("source", "doc_id", "row_key", (F.col("base") + F.col("part").cast("long")).alias("in_all"))


def _dealt(rows: DataFrame, taken: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with the columns of their group in `taken`, and `copies`: the group's in_all copies dealt to its n rows as evenly as they go.

    Equal rows are the same for all purposes, so any numbering of them serves. A bitmap of bounded size, of the hashed keys of groups of several rows, tells which rows can be of
    such a group; these are numbered as they are written, and cut into chunks of CHUNK rows by their numbers. A group meets its
    numbers of copies by chunk, where each chunk gets the last row number that takes one more; rows then meet their chunk. So
    no key that rows are dealt out by has more than CHUNK of them, however often a row is repeated, and rows that aren't are not written.
    """
    keys = lambda more=(): reduce(Column.__and__, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*_KEYS, *more]])
    of_group = ["n", "source_size", "target", "in_all"]
    left_over, each = F.col("in_all") % F.col("n"), F.floor(F.col("in_all") / F.col("n")).cast("long")
    place = F.pmod(F.xxhash64(*_KEYS), F.lit(SIEVE_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    sieve = scratch.save(taken.where("n > 1").groupBy(F.floor(place / 64).alias("word_")).agg(F.bit_or(bit).alias("bits_")), "sieve")
    if sieve.isEmpty():
        return rows.alias("a").join(taken.alias("b"), keys()).select("a.*", *of_group).withColumn("copies", each)
    found = rows.join(F.broadcast(sieve), F.floor(place / 64) == F.col("word_"), "left")
    found = found.withColumn("may_", F.coalesce(F.col("bits_").bitwiseAND(bit) != 0, F.lit(False))).drop("word_", "bits_")
    once = found.where("NOT may_").drop("may_").alias("a").join(taken.alias("b"), keys()).select("a.*", *of_group).withColumn("copies", each)
    held = scratch.save(found.where("may_").drop("may_").withColumn("at", F.monotonically_increasing_id()), "repeated").withColumn("chunk", F.floor(F.col("at") / CHUNK))
    chunks = held.groupBy(*_KEYS, "chunk").agg(F.count("*").alias("held"), F.array_sort(F.collect_list("at")).alias("ats"))
    before = F.coalesce(F.sum("held").over(W.partitionBy(*_KEYS).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    chunks = chunks.withColumn("before", before).alias("a").join(taken.alias("b"), keys()).select("a.*", *of_group)
    more = F.least(F.greatest(left_over - F.col("before"), F.lit(0)), F.col("held")).cast("int")
    chunks = chunks.select(*_KEYS, "chunk", *of_group, F.when(more > 0, F.element_at("ats", F.greatest(more, F.lit(1)))).otherwise(-1).alias("upto"))
    several = held.alias("a").join(scratch.save(chunks, "chunks").alias("b"), keys(["chunk"])).select("a.*", *of_group, "upto")
    return once.unionByName(several.withColumn("copies", each + (F.col("at") <= F.col("upto")).cast("long")).drop("at", "chunk", "upto"))


def _keyed(id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row_key"), F.col(source_col).alias("source")]


_KEYS = ["doc_id", "row_key", "source"]


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], total: float, most: float, seed: int, block: int) -> tuple[Scratch, DataFrame, DataFrame]:
    """The scratch folder, rows (doc_id, row_key, source, size) of docs, and (doc_id, row_key, source, n, source_size, target, in_all) of each group of
    equal ones."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = scratch.save(docs.select(*_keyed(id_col, text_col, source_col), words_in(F.col(text_col)).alias("size")), "sizes")
    targets = scratch.save(source_targets(sizes, weights, total, most), "targets")
    groups = scratch.save(sizes.groupBy(*_KEYS, "size").agg(F.count("*").alias("n")), "groups")
    taken = _shares(groups, targets, scratch, seed, block)
    keys = reduce(Column.__and__, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in _KEYS])
    found = taken.alias("a").join(groups.alias("b"), keys).select(*[f"a.{k}" for k in _KEYS], "n", "in_all")
    found = found.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "source_size", "target")
    found = scratch.save(found, "taken")
    scratch.keep(sizes, found)
    return scratch, sizes, found


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """(doc_id, row_key, source, size, source_size, target, copies) for each row of docs.

    Each document of a source should be taken target / source_size times. The whole part is taken as it is; the
    fractions are rounded by pivotal sampling, so every document's expectation holds and a source's
    taken words miss its target by less than one document. A source's documents are dealt into blocks of about `block` by a
    hash and folded there, largest first, so that what is left tends to be small; the one leftover of each block goes on
    to the next level, until one is left, which is drawn by its part. Rows that are equal in id, text and source are one item there, whose copies
    are then dealt to them. So no group is ever larger than a few times
    `block`, however large its source is and however often a row is repeated. Draws depend on seed and documents alone: reruns agree.

    Documents without words (null, empty) have size 0 and are taken 0 times. A null source is a source, null ids are an id. Repeated rows
    are documents of their own. Other columns don't matter. An empty table gives no rows.
    """
    scratch, sizes, taken = _planned(docs, id_col, text_col, source_col, weights, total, most, seed, block)
    return _dealt(sizes, taken, scratch).select(*_KEYS, "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """The rows of docs, all columns, each as many times as copies() takes it; of rows equal in id, text and source any may be the one
    that is taken once more.

    The joined table has a row for each document without its text; Spark broadcasts it only while its measured size is
    under the session's limit. The columns of docs may have any names.
    """
    scratch, _, taken = _planned(docs, id_col, text_col, source_col, weights, total, most, seed, block)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(*_keyed(f"`{id_col}`", f"`{text_col}`", f"`{source_col}`"), row.alias("row"))
    dealt = _dealt(rows, taken.where("in_all > 0"), scratch).where("copies > 0")
    return dealt.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all sources takes of every document."""
    taken = copies(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
