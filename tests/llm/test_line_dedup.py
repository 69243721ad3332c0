import hashlib
import random
from collections import defaultdict

from boxmill.llm import line_dedup
from boxmill.llm.line_dedup import dedup_lines
from tests.llm.plain import LOWER

SPACES = " \t\n\x0b\x0c\r"


def plain(docs):
    key = lambda line: line.strip(SPACES).translate(LOWER)
    lines = {i: (t or "").split("\n") for i, t in docs.items()}
    holders = defaultdict(set)
    for i, ls in lines.items():
        for line in ls:
            holders[key(line)].add(i)
    out = []
    for i, ls in lines.items():
        kept = [x for x in ls if len(key(x)) < 10 or min(holders[key(x)]) == i]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_against_a_loop(spark):
    rnd = random.Random(6)
    pool = [f"line number {i} of the pool" for i in range(30)] + ["short", "", "  ", "ÄÖÜ äöü line", "äöü äöü line", "\x0b LINE Number 3 of the pool\r", "a" * 9, "b" * 10, "\xa0line number 1 of the pool"]
    docs = {rnd.randrange(10**6): "\n".join(rnd.choice(pool) for _ in range(rnd.choice([1, 2, 10, 200]))) for _ in range(60)}
    docs |= {-5: None, -4: "", -3: "\n\n", -2: "own text here only\n" * 3, -1: "common boilerplate line\nx"} | {10**7 + i: "Common Boilerplate Line" for i in range(300)}
    got = dedup_lines(spark.createDataFrame([(i, t, "first") for i, t in docs.items()], "doc_id long, text string, first string"))
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == plain(docs)


def test_repeated_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, pos int, line int"
    rows = [(1, "the same line here", 0, 0)] * 2 + [(1, "the same line here\nother", 0, 0), (2, "the same line here", 0, 0)]
    got = sorted((r.doc_id, r.n_dropped, r.text) for r in dedup_lines(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 0, "the same line here"), (1, 0, "the same line here"), (1, 0, "the same line here\nother"), (2, 1, "")]
    assert dedup_lines(spark.createDataFrame([], schema)).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_null_ids(spark):
    rows = [(None, "a line of everyone")] * 2 + [(i, "a line of everyone") for i in range(40)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_dropped) for r in got) == [(-1, 0), (-1, 0), (0, 0)] + [(i, 1) for i in range(1, 40)]


def test_salts_and_a_very_long_text(spark, monkeypatch):
    """A line of every document over many salts, and a text of 100,000 lines."""
    monkeypatch.setattr(line_dedup, "SPREAD", 1)
    docs = {i: f"the line of every document\nown line of number {i}" for i in range(300)}
    docs[299] = "\n".join(["the line of every document", "twice here, only here"] * 50_000)
    docs[7] = "own line of number 3\n" * 40 + "the line of every document"
    got = dedup_lines(spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id long, text string").repartition(7))
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == plain(docs)
