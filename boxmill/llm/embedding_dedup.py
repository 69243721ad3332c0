"""Near-duplicate embeddings by a forest of random-projection trees with spill overlap."""

from __future__ import annotations

import math
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill.llm.arrow_text import mix, stream
from boxmill.llm.components import components
from boxmill.llm.scratch import Scratch
from boxmill.llm.tables import table

#: Pairs of at least this cosine are links.
THRESHOLD = 0.93
#: Vectors that a leaf needn't split further, and levels at most.
LEAF, LEVELS = 2048, 32
#: A node of at most so many vectors is split to its leaves within one task, by as many levels as SHORT at most.
FINISH, SHORT = 1 << 16, 16
#: Further trees of a vector at once, at most.
MORE = 8
#: Vectors this many standard deviations around a split's threshold go to both sides.
SPILL = 0.1
#: A vector goes into further trees until a pair at the threshold that it is in has shared a leaf with this probability.
RECALL = 0.999
#: Places, as shares of a node's vectors, where it may be split, and the distance of two of them.
CUTS, STEP = [round(0.3 + 0.05 * k, 2) for k in range(9)], 0.05
#: Where more of a node's vectors than this share lie in a stretch of length 1 at the best cut, splits part near vectors
#: more than they save; the node is a leaf then, whatever its size.
DENSEST = 1.2
#: Vectors of a leaf that one task compares with each other, or with as many others of the leaf.
BLOCK = 4096


@cache
def _directions(dim: int, tree: int) -> np.ndarray:
    """LEVELS random normal directions of a tree, the same for all nodes of a level."""
    n = (LEVELS * dim + 1) // 2
    a, b = (stream(seed + dim + (tree << 20), n).astype(np.float64) / 2.0**64 for seed in (41, 43))
    radius = np.sqrt(-2 * np.log(np.maximum(a, 1e-300)))
    return np.concatenate([radius * np.cos(2 * np.pi * b), radius * np.sin(2 * np.pi * b)])[: LEVELS * dim].reshape(dim, -1)


def _unit(vectors: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(vectors.flatten(), np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_ROW = "rep long, label string, dim int, tree int, p array<float>"


def _projected(vectors: DataFrame, first: int, levels: int) -> DataFrame:
    """(rep, label, dim, tree, p) for each of the vector's `trees` trees from the first on, with its projections p for so many levels."""

    def run(batches):
        for batch in batches:
            dims, trees = batch.column("dim").to_numpy(), batch.column("trees").to_numpy()
            for dim in np.unique(dims):
                for tree in range(trees[dims == dim].max()):
                    part = batch.filter(pa.array((dims == dim) & (trees > tree)))
                    for lo in range(0, part.num_rows, 4096):
                        own = part.slice(lo, 4096)
                        p = (_unit(own.column("x"), int(dim)) @ _directions(int(dim), first + tree)[:, :levels]).astype(np.float32)
                        number = pa.array(np.full(own.num_rows, first + tree, np.int32))
                        columns = [own.column("rep"), own.column("label"), own.column("dim"), number, pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), levels).cast(pa.list_(pa.float32()))]
                        yield pa.RecordBatch.from_arrays(columns, ["rep", "label", "dim", "tree", "p"])

    rows = vectors.select("rep", "label", "dim", "x", "trees").mapInArrow(run, _ROW)
    return rows.withColumn("node", F.lit(1).cast("long")).withColumn("alive", F.lit(1.0))


#: Shares of a node's vectors whose projections are needed to choose a cut, and what a cut at each place is worth.
_SHARES = [round(CUTS[0] - STEP, 2), *CUTS, round(CUTS[-1] + STEP, 2)]
_WORTH = [-q * math.log(q) - (1 - q) * math.log(1 - q) for q in CUTS]


def _cut(quantiles: Column) -> Column:
    """(cut, density) of the best place to split: few vectors near it for the size of the smaller side."""
    density = lambda i: F.lit(2 * STEP) / F.greatest(quantiles[i + 1] - quantiles[i - 1], F.lit(1e-9))
    places = [F.struct((density(i) / F.lit(w)).alias("price"), quantiles[i].alias("cut"), density(i).alias("density")) for i, w in enumerate(_WORTH, 1)]
    return F.array_min(F.array(*places))


def _together(distance: Column) -> Column:
    """The probability that a vector's partner at the threshold isn't parted from it by a split whose margin on the other side is
    so far from it: their projections differ by a normal variable, the chord of the threshold being its deviation."""
    z = distance / math.sqrt(2 - 2 * THRESHOLD)
    return 1 / (1 + F.exp(-(0.07056 * z * z * z + 1.5976 * z)))


def _split_to_leaves(group: pa.Table) -> pa.Table:
    """The leaves below one node: _cut() and _together() over all its vectors, level by level."""
    p = np.asarray(group["p"].combine_chunks().flatten(), np.float64).reshape(group.num_rows, -1)
    root = np.uint64(group["root"][0].as_py() & (1 << 64) - 1)
    todo, done = [(np.arange(group.num_rows), group["alive"].to_numpy(), 0, 1)], []
    while todo:
        own, alive, level, node = todo.pop()
        leaf = len(own) <= LEAF or level == p.shape[1]
        if not leaf:
            at = p[own, level]
            q = np.quantile(at, _SHARES)
            density = 2 * STEP / np.maximum(q[2:] - q[:-2], 1e-9)
            best = int((density / _WORTH).argmin())
            cut, margin = q[best + 1], SPILL * at.std()
            left, right = at <= cut + margin, at > cut - margin
            leaf = density[best] > DENSEST or left.all() or right.all()
        if leaf:
            name = mix(np.array([root ^ mix(np.array([node], np.uint64))[0]])).view(np.int64)[0]
            done.append((own, alive, np.full(len(own), name), np.full(len(own), len(own))))
            continue
        z = (np.abs(at - cut) + margin) / math.sqrt(2 - 2 * THRESHOLD)
        alive = alive * np.where(left & right, 0.5, 1 / (1 + np.exp(-(0.07056 * z**3 + 1.5976 * z))))
        todo += [(own[side], alive[side], level + 1, 2 * node + k) for k, side in enumerate((left, right))]
    own, alive, leaf, size = (np.concatenate(x) for x in zip(*done, strict=True))
    rows = pa.array(own)
    return pa.table({"rep": group["rep"].take(rows), "tree": group["tree"].take(rows), "leaf": leaf, "size": size, "alive": alive})


_NODE = ["label", "dim", "tree", "node"]


def _finished(rows: DataFrame) -> DataFrame:
    """(rep, tree, leaf, size, alive) of nodes of at most FINISH vectors."""
    return rows.withColumn("root", F.xxhash64(*_NODE)).groupBy(*_NODE).applyInArrow(_split_to_leaves, "rep long, tree int, leaf long, size long, alive double")


def leaves(vectors: DataFrame, scratch: Scratch, first: int) -> DataFrame:
    """(rep, tree, leaf, size, alive): the leaves that each vector is in, with their numbers of vectors and the probability
    that a partner at the threshold is there.

    Nodes are split near the middle where their vectors' projections are thinnest. Those of more than FINISH vectors are split a level at a time, all
    at once, by quantiles that Spark gathers from sketches of all of their vectors; smaller ones within tasks. Nodes of at most LEAF vectors are leaves, and so are
    larger ones that are dense wherever they are cut, as a group of near-copies is. Labels and dimensions have trees of their own.
    """
    large = vectors.groupBy("label", "dim").agg(F.count("*").alias("size")).where(F.col("size") > FINISH).select("label", "dim")
    large = scratch.save(large, "large")  # few: a label for FINISH vectors at most
    if large.isEmpty():
        return _finished(_projected(vectors, first, SHORT))
    done = [_finished(_projected(vectors.join(large, ["label", "dim"], "left_anti"), first, SHORT))]
    rows = scratch.save(_projected(vectors.join(large, ["label", "dim"], "left_semi"), first, LEVELS), "roots")
    for level in range(LEVELS):
        p = F.col("p")[0]
        stats = rows.groupBy(*_NODE).agg(F.count("*").alias("size"), F.percentile_approx(p, _SHARES, 1000).alias("q"), (F.stddev_pop(p) * SPILL).alias("margin"))
        stats = scratch.save(stats.withColumn("best", _cut(F.col("q").cast("array<double>"))).select(*_NODE, "size", "margin", "best.cut", "best.density"), "stats")
        left, right = p <= F.col("cut") + F.col("margin"), p > F.col("cut") - F.col("margin")
        state = F.when(F.col("size") <= FINISH, "small").when((F.col("density") > DENSEST) | F.lit(level == LEVELS - 1), "leaf").otherwise("split")
        sides = F.when(F.col("state") == "split", F.array_compact(F.array(F.when(left, F.col("node") * 2), F.when(right, F.col("node") * 2 + 1)))).otherwise(F.array("node"))
        alive = F.when(F.col("state") != "split", 1.0).when(left & right, 0.5).otherwise(_together(F.abs(p - F.col("cut")) + F.col("margin")))
        rest = F.when(F.col("state") == "split", F.slice("p", 2, LEVELS)).otherwise(F.col("p"))
        split = rows.join(stats, _NODE).withColumn("state", state)
        split = split.select("rep", "label", "dim", "tree", rest.alias("p"), F.explode(sides).alias("node"), (F.col("alive") * alive).alias("alive"), "size", "state")
        before, split = rows, scratch.save(split, "split")
        scratch.drop(before)
        done.append(_finished(split.where("state = 'small'").drop("size", "state")))
        done.append(split.where("state = 'leaf'").select("rep", "tree", F.xxhash64(*_NODE, F.lit("leaf")).alias("leaf"), "size", "alive"))
        rows = split.where("state = 'split'").drop("size", "state")
        if rows.isEmpty():
            break
    return reduce(DataFrame.union, done)


def forest(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, leaf, size): the leaves of as many trees as each vector needs.

    Labels and dimensions of at most LEAF vectors are a leaf as they are, without a projection.     What a vector's path through a tree says about a partner at the threshold is multiplied over its splits; vectors whose
    partners may still be missed with more than 1 - RECALL go into as many further trees as it takes at that rate, until it is so.
    """
    sizes = scratch.save(vectors.groupBy("label", "dim").agg(F.count("*").alias("size")), "sizes")
    small = vectors.join(sizes.where(F.col("size") <= LEAF), ["label", "dim"]).select("rep", F.xxhash64("label", "dim", F.lit("whole")).alias("leaf"), "size")
    many = sizes.where(F.col("size") > LEAF).select("label", "dim")
    if many.isEmpty():
        return small
    vectors = vectors.join(many, ["label", "dim"], "left_semi")
    open_, found, first = vectors.withColumns({"missed": F.lit(1.0), "trees": F.lit(1)}), [small], 0
    while True:
        held = scratch.save(leaves(open_, scratch, first), "held")
        found.append(held.select("rep", "leaf", "size"))
        there = held.groupBy("rep", "tree").agg(F.sum("alive").alias("there")).groupBy("rep").agg(F.product(1 - F.least("there", F.lit(1.0))).alias("by"), F.count("*").alias("seen"))
        rest = there.join(open_.select("rep", "missed").distinct(), "rep").withColumn("missed", F.col("missed") * F.col("by")).where(F.col("missed") > 1 - RECALL)
        more = F.ceil(F.log(F.lit(1 - RECALL) / F.col("missed")) / F.log(F.least("by", F.lit(0.99))) * F.col("seen"))
        rest = scratch.save(rest.select("rep", "missed", F.least(F.greatest(more, F.lit(1)), F.lit(MORE)).cast("int").alias("trees")), "open")
        first += MORE
        if rest.isEmpty():
            return reduce(DataFrame.union, found)
        open_ = vectors.join(rest, "rep")


def _blocks(index: DataFrame) -> DataFrame:
    """Rows of leaves dealt to blocks of about BLOCK vectors, once for every block (lo, hi) that theirs is compared with."""
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("long")
    rows = index.withColumn("block", F.pmod(F.xxhash64("rep"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("size", "other")


def _compare(group: pa.Table) -> pa.Table:
    """Links within a block of a leaf, or across two. A pair that also shares a leaf of smaller number is counted there and only
    there; every vector gets an edge to the smallest one that it reaches here."""
    group = group.sort_by("rep")
    n = group.num_rows
    dim, leaf = group["dim"][0].as_py(), group["leaf"][0].as_py()
    copies, block = group["copies"].to_numpy(), group["block"].to_numpy()
    across = group["lo"][0].as_py() != group["hi"][0].as_py()
    kind = np.unique(np.char.add(np.char.add(np.array(group["label"].to_pylist(), dtype=str), "/"), group["dim"].to_numpy().astype(str)), return_inverse=True)[1]
    lists = group["leaves"].combine_chunks()
    width = np.diff(lists.offsets.to_numpy())
    # The earlier leaves of each vector that another one here is in too, numbered.
    owner, held = np.repeat(np.arange(n), width), lists.flatten().to_numpy()
    owner, held = owner[held < leaf], held[held < leaf]
    ids, at, often = np.unique(held, return_inverse=True, return_counts=True)
    at, owner = (np.cumsum(often > 1) - 1)[at[often[at] > 1]], owner[often[at] > 1]
    same = np.ones(n, bool) if (group["dim"].to_numpy() == dim).all() else group["dim"].to_numpy() == dim
    x = np.zeros((n, dim))
    x[same] = _unit(group["x"].combine_chunks().filter(pa.array(same)), dim)
    # Single precision tells all but what is within its error of the threshold; that is computed anew.
    rough, error = x.astype(np.float32), dim * 2.0**-22
    links, root = np.zeros(n, np.int64), np.arange(n)
    begin = np.searchsorted(owner, np.arange(n + 1))
    members = np.argsort(at, kind="stable")
    member_of = np.searchsorted(at[members], np.arange(int((often > 1).sum()) + 1))
    for lo in range(0, n, 256):
        hi = min(lo + 256, n)
        cosine = rough[lo:hi] @ rough.T
        near = cosine >= THRESHOLD
        close = np.argwhere(np.abs(cosine - THRESHOLD) <= error)
        for some in np.array_split(close, len(close) // 65536 + 1):
            near[some[:, 0], some[:, 1]] = np.einsum("ij,ij->i", x[lo + some[:, 0]], x[some[:, 1]]) >= THRESHOLD
        near &= kind[lo:hi, None] == kind
        if across:
            near &= block[lo:hi, None] != block
        near[np.arange(hi - lo), np.arange(lo, hi)] = False
        for i in np.flatnonzero(near.any(axis=1)):
            j = np.flatnonzero(near[i])
            if (root[j] != root[lo + i]).any():
                met = np.unique(np.append(root[j], root[lo + i]))
                root[np.isin(root, met)] = met[0]  # rows are in order of rep
            for k in at[begin[lo + i] : begin[lo + i + 1]]:
                near[i, owner[members[member_of[k] : member_of[k + 1]]]] = False
        links[lo:hi] = near @ copies
    return pa.table({"rep": group["rep"], "links": links, "root": group["rep"].to_numpy()[root]}).filter(pa.array((links > 0) | (root != np.arange(n))))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    Equal vectors of a label count as one with copies, so they cost nothing however many they are. Every vector is indexed in
    as many trees as it takes to find a pair at the threshold with probability RECALL, and compared in double precision with all of its leaves' vectors, block by block where a leaf is large; links
    are summed where they are found, not emitted as pairs.

    Rows without an id link with nothing, have no component and are kept.
    Null labels, and vectors that are null, zero or hold null or non-finite components, link with nothing; vectors of different
    lengths don't link either. A repeated vec_id is one vector for n_links; with several vectors it has the links of
    all of them. Other columns don't matter; an empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "embedding-dedup")
    kind = dict(vectors.dtypes)[vector_col]
    x = F.col(vector_col).cast("array<float>" if kind == "array<float>" else "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), x.alias("x"))
    finite = F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    good = F.col("label").isNotNull() & F.coalesce(finite & F.exists("x", lambda v: v != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    # Two hashes stand for a vector wherever it needn't be there itself.
    same = ["label", "h1", "h2"]
    hashed = rows.withColumns({"h1": F.when(good, F.xxhash64("x")), "h2": F.when(good, F.xxhash64(F.lit(1), "x"))})
    members = scratch.save(hashed.select("vec_id", *same), "vectors")
    groups = scratch.save(members.where("h1 is not null").groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies")), "groups")
    members = members.join(groups, same, "left").select("vec_id", F.coalesce("rep", "vec_id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    members = scratch.save(members, "members")
    firsts = groups.join(hashed.where("h1 is not null").withColumnRenamed("vec_id", "rep"), [*same, "rep"]).dropDuplicates([*same, "rep"])
    groups = scratch.save(firsts.select("rep", "label", F.size("x").alias("dim"), "x", "copies"), "firsts")
    held = scratch.save(forest(groups, scratch).groupBy("rep").agg(F.collect_set(F.struct("leaf", "size")).alias("in")), "leaves")
    index = groups.join(held, "rep").select("rep", "label", "dim", "x", "copies", F.array_sort("in.leaf").alias("leaves"), F.explode("in").alias("at"))
    index = _blocks(index.select("rep", "label", "dim", "x", "copies", "leaves", "at.leaf", "at.size"))
    found = scratch.save(index.groupBy("leaf", "lo", "hi").applyInArrow(_compare, "rep long, links long, root long"), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    scratch.keep(members, found, comps)
    out = members.join(links, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
