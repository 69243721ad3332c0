import random
from collections import defaultdict

from pyspark.sql import functions as F

from boxmill.llm import mixing
from boxmill.llm.mixing import copies, mixed, source_targets


def plain_targets(sizes, weights=(5, 2, 1), total=1.5, most=2.0):
    """Hands the excess of full sources to the others by weight until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), total * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return target


def test_targets_against_a_loop(spark):
    rnd = random.Random(7)
    for _ in range(4):
        sizes = {f"s{i}": rnd.choice([0, 1, 10, 100, 5000]) for i in range(rnd.randint(1, 12))} | {None: 50, "Ä": 3, "a": 9}
        got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        want = plain_targets(sizes)
        assert {r.source for r in got} == set(want)
        assert all(abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source]) for r in got)


def test_sources_meet_their_targets_and_reruns_agree(spark):
    rnd = random.Random(8)
    rows = [(i, "w " * rnd.choice([1, 3, 20, 20, 60, 200]), f"s{rnd.choice([0, 0, 0, 1, 2, 3])}", "x") for i in range(4000)]
    rows += [(5000, None, "s1", "x"), (5001, "", None, "x"), (5002, "only one here", "tiny", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, part string")
    first, again = (sorted((r.doc_id, r.size, r.copies, r.target) for r in copies(d).collect()) for d in (docs, docs.repartition(3, "doc_id")))
    assert first == again and len(first) == len(rows)
    source = {r[0]: r[2] for r in rows}
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for i, size, n, goal in first:
        assert 0 <= n <= 2 and (size or not n)
        taken[source[i]] += size * n
        target[source[i]] = goal
        largest[source[i]] = max(largest[source[i]], size)
    assert all(abs(taken[s] - target[s]) < largest[s] or not largest[s] for s in target)
    out = mixed(docs)
    assert out.columns == docs.columns
    assert out.groupBy("doc_id").count().agg(F.sum("count")).first()[0] == sum(n for _, _, n, _ in first)


def test_expectations_hold(spark):
    """Over many seeds a document is taken as often as its source's share says."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(60)], "doc_id long, text string, source string")
    total, share = defaultdict(int), {}
    runs = 12
    for seed in range(runs):
        for r in copies(docs, seed=seed * 100, block=8).collect():
            total[r.source] += r.copies
            share[r.source] = r.target / r.source_size
    assert all(abs(total[s] / runs / 20 - share[s]) < 0.15 for s in share)


def test_odd_tables(spark):
    schema = "doc_id long, text string, source string"
    assert copies(spark.createDataFrame([], schema)).count() == 0
    assert [(r.size, r.copies) for r in copies(spark.createDataFrame([(1, None, None), (2, "", None)], schema)).collect()] == [(0, 0), (0, 0)]
    got = copies(spark.createDataFrame([(1, "a b", "x")] * 3 + [(None, "c", "x")], schema)).collect()
    assert len(got) == 4 and all(r.copies <= 2 for r in got)


def words_of(rows):
    return sum(len((r.text or "").split()) for r in rows)


def test_repeated_rows_share_what_is_taken(spark):
    """Forty equal rows, and others: the mix has as many words as copies() says, near the target."""
    rows = [(1, "a b c d", "x", 0, "p")] * 40 + [(i, "w " * (i % 9), "y", 0, "q") for i in range(2, 60)] + [(None, "n o", "y", 0, "r")] * 7
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id int, _copies string").repartition(6)
    got = copies(docs).collect()
    assert len(got) == len(rows)
    for source in "xy":
        own = [r for r in got if r.source == source]
        assert all(r.copies <= 2 for r in own)
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) < max(r.size for r in own)
    out = mixed(docs)
    assert out.columns == docs.columns
    assert words_of(out.collect()) == sum(r.size * r.copies for r in got)
    assert {r._copies for r in out.collect()} == {"p", "q", "r"}


def test_names_that_clash_and_a_very_long_text(spark):
    columns = ["row", "n", "in_all", "chunk", "before", "size", "copies", "row_key", "target", "source_", "_copy", "col", "a.b"]
    rows = [(i, "w " * (200_000 if i == 3 else 5), "s", *[7] * len(columns)) for i in range(12)] * 3
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *columns])
    out = mixed(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.size, r.copies) for r in copies(docs).collect())[-1][1] == 5
    total = sum(len(r[1].split()) for r in rows)
    assert abs(words_of(out.collect()) - 1.5 * total) <= 200_000


def test_a_row_repeated_in_large_numbers_is_many_tasks(spark):
    """200,000 equal rows among others, with joins by shuffle alone: no task of the result has much more than the others."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        hot = spark.range(200_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("x").alias("source"))
        rest = spark.range(1000).select((F.col("id") + 100).alias("doc_id"), F.lit("a b").alias("text"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("source"))
        got = copies(hot.union(rest).repartition(16)).select("doc_id", "copies", "size", "source", "target", F.spark_partition_id().alias("task")).where("doc_id = 7")
        by_task = sorted(r["count"] for r in got.groupBy("task").count().collect())
        assert sum(by_task) == 200_000 and len(by_task) > 8 and by_task[-1] <= 4 * mixing.CHUNK
        taken = {r.copies: r["count"] for r in got.groupBy("copies").count().collect()}
        assert len(taken) <= 2 and max(taken) - min(taken) <= 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
