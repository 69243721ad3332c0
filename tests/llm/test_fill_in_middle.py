import random
import re
from hashlib import sha256

import numpy as np
import pytest

from boxmill.llm import fill_in_middle as module
from boxmill.llm.arrow_text import buffers
from boxmill.llm.fill_in_middle import PSM, fill_in_middle, restore_texts, restored

PIECES = ["\n", "\n\n", "a", "line of text", "é", "中文", "🙂", "<", ">", "<P", "P>", "S>", "<M", " ", "\r\n", "\x85", " "]


def plain(doc_id, text, fim=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= fim:
        return doc_id, n, "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def made(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.choice([0, 1, 3, 12, 60]))) for _ in range(n)]


@pytest.mark.parametrize("fim, spm", [(100, 50), (60, 10)])
def test_against_a_loop_and_round_trip(spark, fim, spm):
    texts = [*made(800, fim), None, "", "\n", "no newline", "<P>", "x<M>y\n", "<", ">\n<"]
    # A text that ends in the beginning of a mark before one that starts with its end: not a mark.
    texts += ["ends <", "P> starts\nx", "ends <S", ">starts\ny"]
    rows = [(i * 37 - 500, t, "output") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string").coalesce(3)
    got = restore_texts(fill_in_middle(df, fim=fim, spm=spm)).collect()
    assert sorted(map(tuple, (r[:6] for r in got))) == sorted(plain(i, t, fim, spm) for i, t, _ in rows)
    own = {i: t or "" for i, t, _ in rows}
    assert all(r.restored == own[r.doc_id] for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_odd_rows(spark):
    schema = "doc_id long, text string, n int, form int, h0 int"
    rows = [(None, "a\nb\nc", 0, 0, 0), (None, "a\nb\nc", 0, 0, 0), (3, None, 0, 0, 0), (3, "x\n" * 500_000, 0, 0, 0), (4, "é" * 1_000_001, 0, 0, 0)]
    got = restore_texts(fill_in_middle(spark.createDataFrame(rows, schema))).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, len(x[5]))
    assert sorted((tuple(r[:6]) for r in got), key=key) == sorted((plain(r[0], r[1]) for r in rows), key=key)
    assert sorted(len(r.restored) for r in got) == sorted(len(r[1] or "") for r in rows)
    empty = spark.createDataFrame([], schema)
    assert restore_texts(fill_in_middle(empty)).count() == 0


def test_blocks_that_cut_segments_and_characters(monkeypatch):
    import pyarrow as pa

    texts = made(60, 3) + ["", "x"]
    data, offsets = buffers(pa.array(texts))
    draws = np.array([[int(h, 16) for h in re.findall("." * 8, sha256(f"7:{i}".encode()).hexdigest())[:4]] for i in range(len(texts))])
    for block in (1, 7, 64):
        monkeypatch.setattr(module, "BLOCK", block)
        lines, forms, cuts, out, ends = module.rearranged(data, offsets, draws)
        want = [plain(i, t) for i, t in enumerate(texts)]
        assert [bytes(out[a:b]).decode() for a, b in zip(ends, ends[1:])] == [w[5] for w in want]
        back, at = restored(out, ends, forms)
        assert bytes(back) == bytes(data) and list(at) == list(offsets)


def test_outputs_without_their_marks_are_refused():
    import pyarrow as pa

    with pytest.raises(ValueError):
        restored(*buffers(pa.array(["<P>a<S>b"])), np.array([PSM]))
