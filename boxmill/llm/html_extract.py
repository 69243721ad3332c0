"""Main text of web pages: a linear-chain conditional random field over leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill.llm.html_blocks import MOST_PATHS, Block, Parser, Path
from boxmill.llm.html_training import labelled_pages
from boxmill.llm.tables import table

#: Labelled pages that the model is fitted on, passes over them, and the penalty on weights.
TRAINING_PAGES, EPOCHS, RATE, DECAY = 600, 10, 0.3, 1e-4
SEED = 5
#: Parts of class, id and role words that are features of their own, so that unseen compounds of them count too.
STEMS = "article content story entry post body main text comment repl discuss cookie consent gdpr notice alert popup modal sidebar widget related recommend footer header masthead banner advert sponsor promo newsletter subscri signup login search menu navi breadcrumb pagin share social copyright legal".split()
_CONTAINERS = frozenset("article main nav header footer aside form section div ul ol table body head".split())


def _stems(word: str) -> set[str]:
    found = {s for s in STEMS if s in word}
    return found | {"ads"} if word == "ad" or word.startswith("ads") else found


def _around(path: Path) -> set[str]:
    """Features that an element gives to all blocks inside it."""
    return {f"in {path.tag}"} | {f"word {w}" for w in path.words} | {f"stem {s}" for w in path.words for s in _stems(w)}


def _innermost(tag: str, words: tuple[str, ...], container: str) -> set[str]:
    """Features of a block's own element, the words nearest to it and the container nearest to it."""
    own = {f"own {tag}"} if tag else set()
    return own | {f"nearest {container}"} | {f"nearest word {w}" for w in words} | {f"nearest stem {s}" for w in words for s in _stems(w)}


def path_features(path: Path) -> list[str]:
    """Of the elements around a block: all names and attribute words, and the innermost of either."""
    around = list(path.outwards())
    words = next((p.words for p in around if p.words), ())
    container = next((p.tag for p in around if p.tag in _CONTAINERS), "none")
    return sorted(set().union(_innermost(path.tag, words, container), *map(_around, around)))


def text_features(block: Block) -> list[str]:
    text = block.text
    n = text.count(" ") + 1
    size = "1" if n == 1 else "3" if n < 4 else "9" if n < 10 else "24" if n < 25 else "more"
    linked = 2 * block.link_chars > len(text)
    found = ["bias", f"words {size}", "ends" if text[-1] in ".!?…:;\"”»" else "open", "linked" if linked else "plain"]
    if "©" in text[:40]:
        found.append("copyright")
    return found


@dataclass
class Field:
    """Weights of features for main text against the rest, and of neighbours with equal and different labels."""

    weights: dict[str, float] = field(default_factory=dict)
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def score(self, features: list[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in features)


def fit(pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> Field:
    """Maximum likelihood by AdaGrad over pages of (features of each block, labels), with marginals by forward-backward."""
    names = sorted({f for blocks, _ in pages for fs in blocks for f in fs})
    number = {f: i for i, f in enumerate(names)}
    coded = [([np.array([number[f] for f in fs]) for fs in blocks], np.array(labels)) for blocks, labels in pages if blocks]
    w, moves = np.zeros(len(names)), np.zeros((2, 2))
    seen_w, seen_m = np.full(len(names), 1e-6), np.full((2, 2), 1e-6)
    for _ in range(epochs):
        for blocks, labels in coded:
            n = len(blocks)
            emit = np.zeros((n, 2))
            emit[:, 1] = [w[b].sum() for b in blocks]
            ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0] = emit[0]
            for t in range(1, n):
                ahead[t] = emit[t] + np.logaddexp(ahead[t - 1, 0] + moves[0], ahead[t - 1, 1] + moves[1])
            for t in range(n - 2, -1, -1):
                x = emit[t + 1] + back[t + 1]
                back[t] = np.logaddexp(moves[:, 0] + x[0], moves[:, 1] + x[1])
            total = np.logaddexp(*ahead[-1])
            miss = np.exp(ahead[:, 1] + back[:, 1] - total) - labels
            grad = decay * w
            for b, g in zip(blocks, miss, strict=True):
                grad[b] += g
            grad_m = decay * moves
            for t in range(1, n):
                grad_m += np.exp(ahead[t - 1][:, None] + moves + (emit[t] + back[t])[None, :] - total)
                grad_m[labels[t - 1], labels[t]] -= 1
            seen_w += grad**2
            seen_m += grad_m**2
            w -= rate * grad / np.sqrt(seen_w)
            moves -= rate * grad_m / np.sqrt(seen_m)
    return Field(dict(zip(names, w.tolist(), strict=True)), moves)


def coded_page(pieces: list[tuple[str, bool]]) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a labelled page's blocks. Pieces begin with a tag, so no block crosses them; a mark that
    can't occur in text tells where a piece's blocks are."""
    page = "".join(f"{piece}<hr><x-mark>\x00{int(main)}</x-mark>" for piece, main in pieces)
    features, labels, waiting = [], [], 0
    for block in Parser().blocks(page):
        if block.text.startswith("\x00"):
            labels += [int(block.text[1])] * waiting
            waiting = 0
        else:
            features.append(path_features(block.path) + text_features(block))
            waiting += 1
    return features, labels


@cache
def default_field() -> Field:
    """Every second page is learned without whole class words, so that their parts carry weight too."""
    pages = [coded_page(p) for p in labelled_pages(TRAINING_PAGES, SEED)]
    return fit([([[f for f in fs if k % 2 or "word " not in f] for fs in blocks], labels) for k, (blocks, labels) in enumerate(pages)])


class Nested(NamedTuple):
    """What the elements of a path add up to: the features of theirs that the model knows, the sum of their weights, the nearest words and the nearest
    container; and the path's whole score."""

    path: Path
    known: frozenset[str]
    total: float
    words: tuple[str, ...]
    container: str
    score: float


class Extractor:
    """A worker's parser and model, with the scores of paths it has met.

    A path's sum is that of the path around it and what its own element adds, so the cost of a page doesn't depend on how deep it is. A set of
    known features is shared by all paths that add none, and is never larger than the model.
    """

    def __init__(self, model: Field):
        self.model, self.parser = model, Parser()
        self.of_path: dict[int, Nested] = {}

    def nested(self, path: Path) -> Nested:
        todo = [path]
        while (found := self.of_path.get(id(todo[-1]))) is None and todo[-1].around is not None:
            todo.append(todo[-1].around)
        if found is None:
            found = self._keep(Nested(todo[-1], frozenset(), 0.0, (), "none", self.model.score(["nearest none"])))
        for own in reversed(todo):
            if own is found.path:
                continue
            new = {f for f in _around(own) if f in self.model.weights} - found.known
            words, container = own.words or found.words, own.tag if own.tag in _CONTAINERS else found.container
            total = found.total + self.model.score(sorted(new))
            score = total + self.model.score(sorted(_innermost(own.tag, words, container)))
            found = self._keep(Nested(own, found.known | new if new else found.known, total, words, container, score))
        return found

    def _keep(self, found: Nested) -> Nested:
        if len(self.of_path) >= MOST_PATHS:
            self.of_path.clear()
        self.of_path[id(found.path)] = found
        return found

    def path_score(self, path: Path) -> float:
        return self.nested(path).score

    def decode(self, blocks: list[Block]) -> list[bool]:
        (m00, m01), (m10, m11) = self.model.moves.tolist()
        rest, main, came = 0.0, -math.inf, []
        for t, block in enumerate(blocks):
            here = self.path_score(block.path) + self.model.score(text_features(block))
            if not t:
                rest, main = 0.0, here
                came.append((0, 1))
                continue
            a, b, c, d = rest + m00, main + m10, rest + m01, main + m11
            came.append((int(b > a), int(d >= c)))
            rest, main = max(a, b), max(c, d) + here
        labels, now = [False] * len(blocks), int(main > rest)
        for t in range(len(blocks) - 1, -1, -1):
            labels[t] = bool(now)
            now = came[t][now]
        return labels

    def text(self, page: str) -> str:
        blocks = list(self.parser.blocks(page))
        return "\n\n".join(b.text for b, main in zip(blocks, self.decode(blocks), strict=True) if main)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Field | None = None) -> DataFrame:
    """(page_id, url, text) for each row of pages; a narrow map without shuffle.

    The model is fitted on labelled pages on the driver, a bounded set that grows with nothing, unless one is given.
    text is the main blocks in page order, two newlines between, each with its references decoded and white space as
    single spaces. Null and empty pages, and pages without main text, have the empty text. Unclosed elements, comments and
    scripts end with the page. Repeated rows are extracted each, null ids and urls stay null; other columns don't matter, whatever their names. An empty table
    gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(shared.value)
        for batch in batches:
            texts = pa.array([extractor.text(x) if (x := s.as_py()) else "" for s in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("h"))
    return rows.mapInArrow(run, "page_id long, url string, text string")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
