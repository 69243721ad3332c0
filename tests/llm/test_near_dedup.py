import random

from boxmill.llm import near_dedup
from boxmill.llm.components import components
from boxmill.llm.scratch import Scratch
from tests.llm import plain


def result(spark, rows, schema="doc_id long, text string"):
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found)


def expected(docs):
    return sorted((i, n, c, i == c) for i, (n, c) in plain.near_duplicates(docs).items())


def test_groups_around_lost_originals(spark):
    """Copies with edits of every strength, so that most pairs of a group share buckets and are no links."""
    rnd = random.Random(3)
    docs = {}
    for group, (size, words) in enumerate([(90, 150), (40, 700), (25, 60)]):
        base = [f"w{group}x{rnd.randrange(10**6)}" for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5, 8]) * words // 150 + rnd.randint(0, 1)):
                own[rnd.randrange(words)] = f"n{rnd.randrange(10**9)}"
            docs[rnd.randrange(10**9)] = " ".join(own)
    for i in range(40):
        docs[i] = " ".join(f"z{rnd.randrange(10**6)}" for _ in range(rnd.randint(1, 300)))
    want = expected(docs)
    assert result(spark, list(docs.items())) == want
    assert len({c for _, _, c, _ in want}) > 50


def test_blocks_give_the_same_pairs(spark, monkeypatch):
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    docs = {}
    for i in range(60):
        own = list(base)
        for _ in range(rnd.randint(1, 6)):
            own[rnd.randrange(120)] = f"n{rnd.randrange(10**9)}"
        docs[i] = " ".join(own)
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 0)
    monkeypatch.setattr(near_dedup, "BLOCK", 10)
    assert result(spark, list(docs.items())) == expected(docs)


def templated(rnd, n, shared, own):
    """Texts with a template in common that is not enough for a link; each tenth has a near-copy."""
    template = [f"t{i}" for i in range(shared)]
    docs = {}
    for i in range(n):
        docs[2 * i] = " ".join(template + [f"n{rnd.randrange(10**9)}" for _ in range(own)])
        if i % 10 == 0:
            docs[2 * i + 1] = docs[2 * i] + " end"
    return docs


def test_large_buckets_of_templated_texts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 20)
    docs = templated(random.Random(6), 300, 100, 30)
    want = expected(docs)
    assert result(spark, list(docs.items())) == want and sum(not kept for *_, kept in want) == 30


def test_templated_texts_do_not_meet_by_rare_shingles(spark):
    """Five thousand texts, three quarters of each the same: what meets is in proportion to the near-copies, not to the square."""
    docs = templated(random.Random(7), 5000, 90, 30)
    texts = spark.createDataFrame([(i, t) for i, t in docs.items()], "rep long, text string").repartition(8)
    groups = near_dedup._rare_groups(texts.selectExpr("rep", "rep AS component"), texts, Scratch(spark, "test"), 85).groupBy("key").count().toPandas()
    assert groups["count"].max() == 2 and len(groups) <= 500 * 20
    assert len(result(spark, list(docs.items()))) == 5500


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(30000))
    docs = {1: None, 2: "", 3: " \t\n", 4: "a b", 5: "A B", 6: "a b c", 7: "É b", 8: "é b", 9: long, 10: long + " end", 11: long.upper()}
    want = expected(docs)
    assert (5, 1, 4, False) in want and (10, 29997, 9, False) in want and (8, 1, 8, True) in want
    assert result(spark, list(docs.items())) == want
    rows = [(1, "a b", "x"), (1, "a b", "y"), (2, "A  b", "z")]
    assert result(spark, [(i, t, s, 0) for i, t, s in rows], "doc_id long, text string, component_id string, rep int") == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    assert result(spark, []) == []
    unnamed = near_dedup.near_duplicates(spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b"), (4, "c")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in unnamed) == [(0, 0, True), (0, 0, True), (3, 3, True), (4, 4, True)]


def test_long_words_of_few_letters(spark):
    """A Thue-Morse word and its inverse agree in every polynomial hash modulo a power of two."""
    rows = []
    for n in (64, 1024, 2048, 4096):
        word = "a"
        while len(word) < n:
            word += word.translate({97: 98, 98: 97})
        rows += [(len(rows), word), (len(rows) + 1, word.translate({97: 98, 98: 97}))]
    assert all(c == i for i, _, c, _ in result(spark, rows))


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(5)
    chain = list(range(200))
    rnd.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(500, i) for i in range(600, 700)] + [(900, 900), (901, 902), (902, 901)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert got == plain.smallest_reachable(nodes, [e for e in edges if e[0] != e[1]])
