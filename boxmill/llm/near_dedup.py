"""Near-duplicate documents by one-permutation MinHash, banded buckets and star-shaped candidate edges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxmill.llm.arrow_text import U, mix, shingle_sets, slices, stream
from boxmill.llm.components import components
from boxmill.llm.scratch import Scratch
from boxmill.llm.tables import table

#: 24 bands of 8 bins find a pair of similarity 0.85 with probability 1 - (1 - 0.85**8)**24, above 0.999; for 0.8, bands of 6 do.
BANDS, ROWS = 24, 8
#: Words in a shingle; links need 100 * intersection >= SHARE * union, unless a caller asks for another share.
WIDTH, SHARE = 5, 85
#: Rounds of stars before what is left in the buckets is compared in blocks.
STAR_ROUNDS = 2
#: Members of a bucket that are compared at once, and hashes of a set that are there for that; smaller sets are there in full.
BLOCK, LOWEST = 256, 512
#: Bits of the bitmap that keeps texts without candidates from being shuffled: 1 MB.
SIEVE_BITS = 1 << 23
#: A pair is tested on full sets unless its signature's estimate is this many standard deviations short, which a pair at the threshold is
#: with a probability of some millionths.
SLACK = 4.5


@cache
def _probes(bins: int) -> np.ndarray:
    """For each bin the order, the same for all documents, in which it looks for a bin with a value."""
    return np.argsort(stream(11, bins * bins).reshape(bins, bins), axis=1).astype(np.int32)


def signatures(sets: np.ndarray, bounds: np.ndarray, n_bins: int) -> np.ndarray:
    """One-permutation hashing: the smallest hash in each of n_bins ranges, empty bins filled by optimal densification.

    An empty bin takes the value of the first bin with one in its own random order. Rows of empty sets hold zeros.
    """
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    bins = ((sets >> U(32)) * U(n_bins)) >> U(32)
    cell = owner * n_bins + bins.astype(np.int64)
    first = np.flatnonzero(np.diff(cell, prepend=-1))  # sets are sorted, so a bin's first hash is its smallest
    out = np.zeros(n * n_bins, U)
    out[cell[first]] = mix(sets[first])
    filled = np.zeros(n * n_bins, bool)
    filled[cell[first]] = True
    some = np.repeat(np.diff(bounds) > 0, n_bins)
    empty = np.flatnonzero(~filled & some)
    for step in range(n_bins):
        if not len(empty):
            break
        source = empty - empty % n_bins + _probes(n_bins)[empty % n_bins, step]
        hit = filled[source]
        out[empty[hit]] = out[source[hit]]
        empty = empty[~hit]
    return out.reshape(n, n_bins)


def _least(smaller: np.ndarray, bins: int, percent: int) -> np.ndarray:
    """The share of equal bins under which a pair is no link, from the size of the smaller set.

    Of n hashes in so many bins some meet in one, and empty bins repeat others; what counts is how many independent
    values, and how evenly repeated, a signature has.
    """
    filled = bins * -np.expm1(-np.maximum(smaller, 1) / bins)
    repeats = bins / filled
    independent = filled * repeats / (repeats + 1 - 1 / repeats)
    share = percent / 100
    return share - SLACK * np.sqrt(share * (1 - share) / independent)


def _bands(sig: np.ndarray, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.broadcast_to(stream(13, BANDS), (len(sig), BANDS)).copy()
        for k in range(rows):
            h = mix(h ^ sig[:, k::rows])
        return h.view(np.int64)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands) of each row; set_a and set_b identify the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                sets, bounds = shingle_sets(part.column("t"), WIDTH)
                bands = _bands(signatures(sets, bounds, BANDS * rows), rows)
                with np.errstate(over="ignore"):
                    sums = [np.concatenate([np.zeros(1, U), np.cumsum(x, dtype=U)]) for x in (mix(sets), mix(sets ^ U(0x5851F42D4C957F2D)))]
                    a, b = ((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(bounds)),
                        pa.array(a),
                        pa.array(b),
                        pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return texts.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def _alike(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes allow a link and whose signatures don't rule it out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            smaller = np.minimum(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
            keep = (x == y).mean(axis=1) >= _least(smaller, x.shape[1], percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    of_a = sigs.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    of_b = sigs.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    near = pairs.join(of_a, "a").join(of_b, "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return near.mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs with enough of their full shingle sets in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a", 1 << 19):
                x, bx = shingle_sets(part.column("text_a"), WIDTH)
                y, by = shingle_sets(part.column("text_b"), WIDTH)
                keep = np.zeros(part.num_rows, bool)
                for i in range(part.num_rows):
                    p, q = x[bx[i] : bx[i + 1]], y[by[i] : by[i + 1]]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep[i] = both > 0 and 100 * both >= percent * (len(p) + len(q) - both)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    of_a = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    of_b = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(of_a, "a").join(of_b, "b").mapInArrow(run, "a long, b long")


def _sketches(texts: DataFrame, bins: int) -> DataFrame:
    """(rep, n, sig, lowest): the signature and the smallest hashes of the set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, bounds = shingle_sets(part.column("text"), WIDTH)
                low = (signatures(sets, bounds, bins) & U(0xFFFF)).astype("<u2")
                first = [sets[a : min(b, a + LOWEST)].astype("<u8").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(np.diff(bounds)), pa.array([x.tobytes() for x in low], pa.binary()), pa.array(first, pa.binary())], ["rep", "n", "sig", "lowest"])

    return texts.select("rep", "text").mapInArrow(run, "rep long, n long, sig binary, lowest binary")


def _cross_pairs(group: pa.Table, percent: int) -> pa.Table:
    """Pairs of a block, or across two blocks of a bucket, that may link two of its components.

    Sets that are there in full are compared exactly, and a link found so makes its components one at once; of larger sets
    the pairs whose smallest hashes don't rule a link out are returned for confirmation.
    """
    m = group.num_rows
    rep, comp, n, block = (group[c].to_numpy().copy() for c in ("rep", "component", "n", "block"))
    across = block.min() != block.max() or group["other"][0].as_py() != block[0]
    sig = np.frombuffer(b"".join(group["sig"].to_pylist()), "<u2").reshape(m, -1)
    lowest = [np.frombuffer(x, "<u8") for x in group["lowest"].to_pylist()]
    share, found = percent / 100, []
    for i in range(m - 1):
        may = (comp[i + 1 :] != comp[i]) & (np.minimum(n[i + 1 :], n[i]) * 100 >= np.maximum(n[i + 1 :], n[i]) * percent)
        if across:
            may &= block[i + 1 :] != block[i]
        j = i + 1 + np.flatnonzero(may)
        if len(j):
            j = j[(sig[j] == sig[i]).mean(axis=1) >= _least(np.minimum(n[j], n[i]), sig.shape[1], percent)]
        for k in j:
            if comp[k] == comp[i]:
                continue
            p, q = lowest[i], lowest[k]
            both = np.intersect1d(p, q, assume_unique=True)
            if n[i] <= LOWEST and n[k] <= LOWEST:
                if 100 * len(both) >= percent * (len(p) + len(q) - len(both)):
                    found.append((rep[i], rep[k]))
                    comp[comp == comp[k]] = comp[i]
                continue
            size = min(len(p), len(q))
            last = np.union1d(p, q)[size - 1]
            if np.searchsorted(both, last, "right") / size >= share - SLACK * np.sqrt(share * (1 - share) / size):
                found.append((rep[i], rep[k]))
    ends = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": ends.min(axis=1), "b": ends.max(axis=1)})


def _labels(links: list[DataFrame]) -> DataFrame:
    """(rep, label): a label for each end of the links; ends with the same label are connected.

    Two steps to the smallest neighbour gather most of a star-shaped component under one label, without the rounds
    that whole components take.
    """
    both = reduce(DataFrame.union, [x for e in links for x in (e.select("a", "b"), e.select("b", "a"))]).toDF("rep", "other")
    near = both.groupBy("rep").agg(F.min("other").alias("other")).select("rep", F.least("rep", "other").alias("label"))
    return near.join(near.select(F.col("rep").alias("label"), F.col("label").alias("next")), "label", "left").select("rep", F.coalesce("next", "label").alias("label"))


def _rare_groups(members: DataFrame, texts: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(key, rep, component): the members (rep, component) by shingles that are among the rarest of two of them.

    In an order of all shingles by rarity, two sets that are links share one of the first n - ceil(n * percent / 100) + 1 of either: the others
    are too few for a link. So texts that have a template in common but not enough for a link don't meet, however many they are, and no link is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, bounds = shingle_sets(part.column("text"), WIDTH)
                sizes = np.diff(bounds)
                first = sizes - (sizes * percent + 99) // 100 + 1
                owner = pa.array(np.repeat(np.arange(part.num_rows), sizes))
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(owner) for c in ("rep", "component", "own")], pa.array(first).take(owner), pa.array(sets.view(np.int64))], ["rep", "component", "own", "first", "s"])

    # A repeated id with different texts has a set for each of them.
    shingles = texts.join(members, "rep").withColumn("own", F.xxhash64("text")).mapInArrow(run, "rep long, component long, own long, first long, s long")
    # Both are written: texts are hashed once, and a join of two tables can split a shingle that all members of a template have.
    shingles = scratch.save(shingles, "shingles")
    often = scratch.save(shingles.groupBy("s").agg(F.count("*").alias("often")).where("often > 1"), "often")
    place = F.row_number().over(W.partitionBy("rep", "own").orderBy(F.coalesce("often", F.lit(1)), "s"))
    rare = shingles.join(often, "s", "left").withColumn("place", place).where("place <= first and often > 1").select(F.col("s").alias("key"), "rep", "component").distinct()
    rare = scratch.save(rare, "rare")
    scratch.drop(shingles, often)
    more = rare.groupBy("key").agg((F.min("component") != F.max("component")).alias("more")).where("more")
    more = scratch.save(more.select("key"), "shared-rare")  # so that a shingle of very many can be split in the join
    return rare.join(more, "key", "left_semi")


def _left_over(open_: DataFrame, sketches: DataFrame, texts: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs to confirm from all buckets (key, rep, component) that still hold several components.

    The members of buckets of more than BLOCK meet anew by their rarest shingles. Buckets of the same members count once. One that
    is still larger than BLOCK is cut into blocks, and every two of them are compared on their own, so nothing is compared with more than two blocks.
    """
    sizes = open_.groupBy("key").agg(F.count("*").alias("size"))
    large = scratch.save(open_.join(sizes.where(F.col("size") > BLOCK), "key", "left_semi").select("rep", "component").distinct(), "large")
    if not large.isEmpty():
        rare = scratch.save(_rare_groups(large, texts, scratch, percent), "open-rare")
        open_ = open_.join(sizes.where(F.col("size") <= BLOCK), "key", "left_semi").unionByName(rare, allowMissingColumns=True)
    alike = [F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"), F.count("*").alias("size")]
    once = open_.groupBy("key").agg(*alike).groupBy("x", "y", "size").agg(F.min("key").alias("key")).select("key", "size")
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("long")
    rows = open_.join(once, "key").withColumn("block", F.pmod(F.xxhash64("rep"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.join(sketches, "rep")
    return rows.groupBy("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).applyInArrow(lambda group: _cross_pairs(group, percent), "a long, b long").distinct()


def _texts_of(docs: DataFrame, buckets: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, text) of the rows of docs whose id is a rep of the buckets.

    Most documents are in no bucket with others. A bitmap of SIEVE_BITS hashed ids, of bounded size whatever the
    number of ids, drops most of them where they are read; the join that follows is exact. It is an inner join, since Catalyst would
    move a semi join below the bitmap and shuffle all texts for it.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place("rep") % 64).cast("int"))
    sieve = buckets.groupBy(F.floor(place("rep") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))
    sieve = F.broadcast(scratch.save(sieve, "sieve"))
    passed = docs.join(sieve, F.floor(place("doc_id") / 64) == F.col("word")).where(F.call_function("shiftrightunsigned", F.col("bits"), (place("doc_id") % 64).cast("int")).bitwiseAND(1) == 1)
    return passed.select(F.col("doc_id").alias("rep"), "text").join(buckets.select("rep").distinct(), "rep").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = SHARE, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Links need `percent` of the shingles of both in common; bands have `rows` bins, fewer for smaller percentages.

    Documents with equal shingle sets count as one, the smallest id, from the start. The others meet in banded
    buckets. In each bucket one member, the hub, is paired with all members outside its component: a star.
    Pairs that pass the signature test are confirmed on full sets and linked. A hub has then been
    compared with everything it could add, and leaves its bucket; the second round takes hubs that are linked already, which
    gathers copies around their original. Between rounds, texts known to be connected share a label. So a group of copies costs about one pair for each copy. Members
    of different components that are left in a bucket are compared within tasks, large buckets after they have been parted by rare shingles, and only pairs that
    may be links leave them. A link is lost if the texts meet in no bucket (under one in a thousand at the threshold, far fewer above it), or if
    their signatures are so unlike by chance as SLACK allows (some in a million there).

    Null or empty texts, and texts of white space, have no shingles and link with nothing; rows without an id neither, they have no component and are
    kept. Repeated rows of a doc_id are members of its set; a repeated doc_id with different texts links both. Other columns don't matter;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    feats = scratch.save(features(docs, rows=rows), "features")
    sets = ["set_a", "set_b", "n_shingles"]
    some = "n_shingles > 0 and doc_id is not null"
    groups = scratch.save(feats.where(some).groupBy(*sets).agg(F.min("doc_id").alias("rep")), "groups")
    members = scratch.save(feats.select("doc_id", *sets).join(groups, sets, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "members")
    # Copies of a set have the same buckets, where their smallest id stands for them.
    keys = feats.where(some).select(F.explode("bands").alias("key"), "set_a", "doc_id")
    shared = keys.groupBy("key").agg((F.min("set_a") != F.max("set_a")).alias("more")).where("more").select("key")
    shared = scratch.save(shared, "shared")  # so that a key of very many copies can be split in the join
    buckets = keys.join(shared, "key", "left_semi").groupBy("key", "set_a").agg(F.min("doc_id").alias("rep")).select("key", "rep")
    buckets = scratch.save(buckets, "buckets")
    texts = scratch.save(_texts_of(docs, buckets, scratch), "texts")
    sketches = scratch.save(_sketches(texts, BANDS * rows), "sketches")
    scratch.drop(feats)

    # A repeated doc_id with different texts links them.
    twice = members.groupBy("doc_id").agg((F.min("rep") != F.max("rep")).alias("two")).where("two").select(F.col("doc_id").alias("a"))
    links = [members.where("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).join(twice, "a", "left_semi")]
    at = buckets.withColumn("component", F.col("rep")).withColumn("alone", F.lit(True))
    for number in range(STAR_ROUNDS + 1):
        hub = F.min(F.struct("alone", "rep", "component")).alias("hub")
        hubs = at.groupBy("key").agg(hub, (F.min("component") != F.max("component")).alias("more")).where("more")
        hubs = scratch.save(hubs.select("key", F.col("hub.rep").alias("hub"), F.col("hub.component").alias("of_hub")), "hubs")
        if hubs.isEmpty():
            break
        if number == STAR_ROUNDS:
            pairs = scratch.save(_left_over(scratch.save(at.join(hubs, "key", "left_semi"), "open"), sketches, texts, scratch, percent), "pairs")
            links.append(scratch.save(_confirmed(pairs, texts, percent), "links"))
            break
        pairs = at.join(hubs, "key").where(F.col("component") != F.col("of_hub")).select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
        links.append(scratch.save(_confirmed(_alike(pairs, sketches, percent), texts, percent), "links"))
        label = scratch.save(_labels(links[1:]), "labels")
        rest = at.join(hubs, "key").where(F.col("rep") != F.col("hub")).select("key", "rep")
        at = rest.join(label, "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("component"), F.col("label").isNull().alias("alone"))
        at = scratch.save(at, "at")
    comps = components(reduce(DataFrame.union, links), scratch)
    scratch.keep(members, comps)
    out = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-copies among all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
