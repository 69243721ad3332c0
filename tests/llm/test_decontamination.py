import random
import re

import numpy as np
import pyarrow as pa

from boxmill.llm import decontamination
from boxmill.llm.decontamination import ItemIndex, allowed, find_leaks, normal_words, shared_run, without_leaks


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def distance(item, text):
    """Edits to the nearest part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def plain(docs, items):
    out = []
    for i, t in docs.items():
        for k, u in items.items():
            own = words(u)
            if own and (d := distance(own, words(t))) <= allowed(len(own), 0.2):
                out.append((i, k, d))
    return sorted(out)


def test_runs_survive_all_edits():
    """However edits are spread, one run of adjacent words is at least as long as shared_run() says."""
    for n in range(1, 80):
        k = allowed(n, 0.2)
        even = [(n - k) // (k + 1) + (i < (n - k) % (k + 1)) for i in range(k + 1)]
        assert max(even) == shared_run(n, k)


def test_against_brute_force(spark):
    rnd = random.Random(12)
    pool = [f"wo{i}" for i in range(400)]
    items = {k: " ".join(rnd.choices(pool, k=n)) for k, n in enumerate([3, 5, 8, 14, 14, 20, 25, 30, 37, 45, 59])}
    docs = {}
    for i in range(260):
        body = rnd.choices(pool, k=rnd.choice([0, 20, 120]))
        if rnd.random() < 0.7:
            own = words(rnd.choice(list(items.values())))
            for _ in range(rnd.randint(0, allowed(len(own), 0.2) + 1)):
                at, kind = rnd.randrange(len(own)), rnd.choice("idr")
                own[at : at + (kind != "i")] = [] if kind == "d" else [rnd.choice(pool)]
            own = [w.upper() if rnd.random() < 0.1 else w + rnd.choice(["", "", ",", ".", "\n"]) for w in own]
            cut = rnd.randint(0, len(body))
            body[cut:cut] = own
        docs[i] = " ".join(body)
    want = plain(docs, items)
    found = find_leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3), spark.createDataFrame(list(items.items()), "item_id long, text string"), block_words=100)
    got = sorted((r.doc_id, r.item_id, r.edits) for r in found.collect())
    assert len(want) > 120 and set(got) <= set(want) and len(got) >= 0.995 * len(want)
    assert {p for p in want if p[2] == 0} <= set(got)


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, " .,! "), (None, "x y"), (4, "Solo")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "One, two «three» four: FIVE… six?", 0), (3, "One, two «three» four: FIVE… six?", 0), (4, "solo", 0), (5, "nothing here", 0), (6, "x " * 100_000 + "one two three four five six", 0)], "doc_id long, text string, item_id int")
    assert sorted((r.doc_id, r.item_id, r.edits) for r in find_leaks(docs, items).collect()) == [(3, 1, 0), (3, 1, 0), (4, 4, 0), (6, 1, 0)]
    assert sorted(r.doc_id for r in without_leaks(docs, items).collect()) == [1, 2, 5]
    named = docs.selectExpr("doc_id", "text", "1 AS leaked", "2 AS leaked_", "3 AS _leaked", "4 AS t", "5 AS item_id").union(spark.sql("SELECT NULL, 'solo', 1, 2, 3, 4, 5"))
    assert sorted(r.doc_id or 0 for r in without_leaks(named, items).collect()) == [0, 1, 2, 5]
    assert find_leaks(docs, items.limit(0)).count() == 0 and find_leaks(docs.limit(0), items).count() == 0


def found_of_planted(lengths, copies, seed):
    """The share of copies with all edits that are allowed, each in a text of its own, that are found."""
    rnd = random.Random(seed)
    pool = [f"wo{i}" for i in range(5000)]
    items, texts = [rnd.choices(pool, k=n) for n in lengths], []
    for own in items:
        for _ in range(copies):
            own_words, edits = list(own), allowed(len(own), 0.2)
            for at in sorted(rnd.sample(range(len(own)), edits), reverse=True):
                kind = rnd.choice("idr")
                own_words[at : at + (kind != "i")] = [] if kind == "d" else [rnd.choice(pool)]
            texts.append(" ".join(rnd.choices(pool, k=50) + own_words + rnd.choices(pool, k=50)))
    index = ItemIndex(list(range(len(items))), [normal_words(pa.array([" ".join(x)]))[0] for x in items], 0.2)
    hits = {(text, item) for text, item, _, _ in index.hits(*normal_words(pa.array(texts)))}
    return np.mean([(k, k // copies) in hits for k in range(len(texts))])


def test_long_items_with_all_edits():
    assert found_of_planted([100, 250, 500, 1000], 20, 1) >= 0.995


def test_items_of_one_and_two_words():
    assert found_of_planted([1] * 300, 1, 2) == 1 and found_of_planted([2] * 100, 1, 2) == 1


def test_an_index_is_bounded_by_its_parts_and_made_in_slices(monkeypatch):
    rnd = random.Random(30)
    texts = [" ".join(f"w{rnd.randrange(9000)}" for _ in range(rnd.choice([5, 9, 40, 130]))) for _ in range(600)]
    whole = decontamination.index_of(list(range(600)), texts)
    keys = sum(k.nbytes + o.nbytes for k, o in whole.tables.values())
    assert keys == len(whole.parts) * decontamination.WALKS * decontamination.SAMPLES * 12
    monkeypatch.setattr(decontamination, "TABLE_SLICE", 7)
    sliced = decontamination.index_of(list(range(600)), texts)
    for c, (known, owner) in whole.tables.items():
        assert (sliced.tables[c][0] == known).all() and (sliced.tables[c][1] == owner).all()


def test_blocks_by_words_and_by_parts(spark):
    items = spark.createDataFrame([(k, "a b c d e f") for k in range(10)] + [(10, "w " * 500)], "item_id long, t string").orderBy("item_id")
    sizes = lambda **most: [len(ids) for ids, _ in decontamination._blocks(items, **most)]
    assert sizes(block_words=10**6, block_parts=4) == [4, 4, 3] and sizes(block_words=12, block_parts=10**6) == [2, 2, 2, 2, 2, 1]
    docs = spark.createDataFrame([(1, "x a b c d e f y"), (2, "none of it")], "doc_id long, text string")
    found = find_leaks(docs, items.withColumnRenamed("t", "text"), block_parts=3).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, k) for k in range(10)]
