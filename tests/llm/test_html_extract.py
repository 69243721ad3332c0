import itertools
import random
import time

import numpy as np
import pytest

from boxmill.llm import html_extract
from boxmill.llm.html_blocks import Block, Parser
from boxmill.llm.html_extract import Extractor, Field, coded_page, default_field, extract, fit, path_features, text_features
from boxmill.llm.html_training import labelled_pages
from tests.llm.labelled_pages import PAGES


@pytest.fixture(scope="module")
def extractor():
    return Extractor(default_field())


def test_held_out_pages(extractor):
    right = blocks = 0
    for page in labelled_pages(150, 99):
        labels = coded_page(page)[1]
        got = extractor.decode(list(extractor.parser.blocks("".join(x for x, _ in page))))
        right += sum(a == bool(b) for a, b in zip(got, labels, strict=True))
        blocks += len(labels)
    assert right / blocks > 0.995


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><!-- ad 0 --><div class="ad">Buy this thing now.</div>
<article><h1>A title &amp; more&nbsp;words</h1><p><b>First  paragraph,
with\ttwo lines.<br>And a third one.<p>Second &lt;one&gt; here, of several words.<div class="newsletter"><form><label>Mail</label><input></form></div>
<p>Be.</p></article><section class="comments"><h2>Comments</h2><p>I think this is a very good article, is it not? Yes, it is.</p></section>
<footer>&copy; example &middot; All rights.</footer></body></html>"""

TEXT = "A title & more words\n\nFirst paragraph, with two lines. And a third one.\n\nSecond <one> here, of several words.\n\nBe."


def test_a_page(extractor):
    assert extractor.text(PAGE) == TEXT


def test_broken_markup_ends_with_the_page():
    texts = lambda page: [b.text for b in Parser().blocks(page)]
    assert texts("a < b and c") == ["a < b and c"]
    assert texts("<p>x<script>y") == ["x"]
    assert texts("<p>x<!-- y <p>z") == ["x"]
    assert texts("x<p title='a>b'>y</p attr>z<di") == ["x", "y", "z"]
    assert texts("<p class=\"a>x</p>y") == ["x", "y"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert texts("") == [] and texts(" \n ") == []
    rnd = random.Random(1)
    for _ in range(2000):
        texts("".join(rnd.choice(["<", ">", "</", "p", "b>", "<p>", "</p>", "&amp", ";", '"', "'", " x", "<!--", "-->", "<script>", "</script>", "<a ", "="]) for _ in range(25)))


def test_odd_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", PAGE, "x"), (3, "u", PAGE, "x"), (None, "u", "<article><p>" + "One more word here. " * 20000, "x")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.url or "", len(r.text)) for r in got) == [(0, "u", 399999), (1, "u", 0), (2, "", 0), (3, "u", len(TEXT)), (3, "u", len(TEXT))]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_self_closing_svg_and_math():
    texts = lambda page: [(b.text, b.path.tags) for b in Parser().blocks(page)]
    for tag in ['<svg/>', '<svg class="x" />', "<svg a='b'/>", '<svg a=b />', "<math/>"]:
        assert texts(f"<p>one</p>{tag}<p>two</p>") == [("one", ("p",)), ("two", ("p",))]
    assert texts("<p>one</p><svg a=b/><text>in</text></svg><p>two</p>") == [("one", ("p",)), ("two", ("p",))]


def test_path_scores_are_sums_of_features(extractor):
    """What is added up along a path is what the path's own list of features gives."""
    for page in labelled_pages(20, 3):
        for block in Parser().blocks("".join(x for x, _ in page)):
            assert abs(extractor.path_score(block.path) - extractor.model.score(path_features(block.path))) < 1e-9


def test_viterbi_against_all_labellings():
    rnd = random.Random(4)
    for n in (1, 2, 5, 9):
        for _ in range(6):
            blocks = [Block(Parser().child(Parser().root, "p", f'class="k{rnd.randrange(4)}"'), "x" * rnd.randint(1, 5), 0) for _ in range(n)]
            model = Field({f"word k{i}": rnd.gauss(0, 2) for i in range(4)} | {"bias": rnd.gauss(0, 1)}, np.array([[rnd.gauss(0, 2) for _ in "ab"] for _ in "ab"]))
            here = [model.score(path_features(b.path) + text_features(b)) for b in blocks]
            worth = lambda y: sum(h * a for h, a in zip(here, y, strict=True)) + sum(model.moves[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
            best = max(itertools.product([0, 1], repeat=n), key=worth)
            assert abs(worth([int(x) for x in Extractor(model).decode(blocks)]) - worth(best)) < 1e-9


def test_first_step_follows_the_gradient_over_all_labellings():
    """AdaGrad's first step is rate * grad / sqrt(grad**2 + 1e-6): its size tells the gradient, which summing over all labellings gives too."""
    rnd = random.Random(5)
    blocks, labels = [[f"f{rnd.randrange(6)}" for _ in range(3)] for _ in range(6)], [rnd.randrange(2) for _ in range(6)]
    blocks = [sorted(set(b)) for b in blocks]
    names = sorted({f for b in blocks for f in b})
    grad, grad_m = dict.fromkeys(names, 0.0), np.zeros((2, 2))
    every = list(itertools.product([0, 1], repeat=6))  # all weights are 0 at first, so all are as likely
    for y in every:
        for b, a in zip(blocks, y, strict=True):
            for f in b:
                grad[f] += a / len(every)
        for a, b in zip(y, y[1:]):
            grad_m[a, b] += 1 / len(every)
    for b, a in zip(blocks, labels, strict=True):
        for f in b:
            grad[f] -= a
    for a, b in zip(labels, labels[1:]):
        grad_m[a, b] -= 1
    model = fit([(blocks, labels)], epochs=1, rate=0.1, decay=0.0)
    assert all(abs(model.weights[f] + 0.1 * g / np.sqrt(1e-6 + g * g)) < 1e-9 for f, g in grad.items())
    assert np.allclose(model.moves, -0.1 * grad_m / np.sqrt(1e-6 + grad_m**2))


@pytest.mark.parametrize("piece", ["<div>x", "<div class=k{0}>x", "<b>x", "<b>x<p>y</p>", "<i><div>x", "<ul><li>x", "</q>x<q>", "<a href=x>y<div>z"])
def test_deep_markup_takes_time_in_proportion(extractor, piece):
    page = "".join(piece.replace("{0}", str(i)) for i in range(50_000))
    began = time.process_time()
    assert extractor.text("<article>" + page) is not None
    assert time.process_time() - began < 15


def test_deep_markup_where_paths_are_let_go(monkeypatch):
    monkeypatch.setattr(html_extract, "MOST_PATHS", 100)
    own = Extractor(default_field())
    assert own.text("<article>" + "<div><p>Some words here.</p>" * 1000) == "\n\n".join(["Some words here."] * 1000)


def test_pages_labelled_by_hand(extractor):
    """Blocks of twenty and one layouts that no rule made."""
    wrong, blocks = [], 0
    for name, page in PAGES.items():
        labels = coded_page(page)[1]
        found = list(Parser().blocks("".join(x for x, _ in page)))
        wrong += [(name, b.text) for b, a, got in zip(found, labels, extractor.decode(found), strict=True) if bool(a) != got]
        blocks += len(labels)
    assert blocks > 120 and len(wrong) <= 0.04 * blocks, wrong
