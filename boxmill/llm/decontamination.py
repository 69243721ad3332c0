"""Benchmark passages in documents: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill.llm.arrow_text import U, buffers, hashes, mix, slices, stream, words
from boxmill.llm.scratch import Scratch
from boxmill.llm.tables import table, unused

#: Words that may be inserted, deleted or replaced, as a share of the item's words.
MAX_EDITS = 0.2
#: Random walks of the embedding, bit samples of each, and symbols in a sample.
WALKS, SAMPLES, SAMPLE_SIZE = 8, 10, 3
#: Items whose window lengths differ by no more than this factor sample the same steps.
CLASS_RATIO = 1.25
#: Longer items are embedded in parts of up to so many words. If edits are no more than a share of the item's words, they are no
#: more than that share in one of its parts.
PART_WORDS = 40
#: Words of items, and parts of them, that are looked for in one pass over the documents. Both bound the index, which the driver makes and every worker holds: 80 keys
#: of 12 bytes for each part.
BLOCK_WORDS, BLOCK_PARTS = 2_000_000, 50_000
#: Parts that are embedded at once when the index is made.
TABLE_SLICE = 4096

#: Bytes between words: ASCII but letters and digits, and the lead bytes of Latin-1 signs. _PUNCTUATION adds the rest.
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False
_FILTER_BITS = 22


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of (lower-cased) texts, and for each text the index of its first word.

    Words are runs of ASCII letters and digits and of other letters; code points U+0080 to U+00BF and
    U+2000 to U+207F are signs between words.
    """
    data, offsets = buffers(texts)
    data = data.copy()
    sign = np.flatnonzero(data == 0xC2)
    if len(sign):
        data[sign], data[sign + 1] = 0x20, 0x20
    lead = np.flatnonzero(data == 0xE2)
    lead = lead[(data[lead + 1] == 0x80) | (data[lead + 1] == 0x81)] if len(lead) else lead
    if len(lead):
        data[lead], data[lead + 1], data[lead + 2] = 0x20, 0x20, 0x20
    starts, ends, first = words(data, offsets, _BETWEEN)
    return hashes(data, starts, ends), first


def allowed(n: int, max_edits: float) -> int:
    return int(max_edits * n + 1e-9)


def shared_run(n: int, edits: int) -> int:
    """So many adjacent words of an item with n words stay together whatever `edits` edits do: they leave n - edits words in
    edits + 1 runs at most."""
    return math.ceil((n - edits) / (edits + 1))


def grams(word: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q words from each place on; the last q - 1 places have none of their own."""
    n = max(0, len(word) - q + 1)
    with np.errstate(over="ignore"):
        out = np.zeros(n, U)
        for k in range(q):
            out += word[k : k + n] * U(pow(0x9FB21C651E98DF25, k + 1, 1 << 64))
    return mix(out)


class Walks:
    """The CGK embedding: in each step it writes the symbol at hand and, by a random bit of step and symbol, moves on.

    Strings that differ by few edits fall into step again after each, so they agree in most steps.
    """

    def __init__(self, steps: int, seed: int = 29):
        self.seeds = stream(seed, WALKS * steps).reshape(WALKS, steps)

    def embed(self, word: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int) -> np.ndarray:
        """Embeddings (steps x walks x starts) of the words from each start on; 0 from its end on."""
        at, out = np.tile(starts, (WALKS, 1)), np.zeros((steps, WALKS, len(starts)), U)
        for t in range(steps):
            symbol = np.where(at < ends, word[np.minimum(at, len(word) - 1)], U(0))
            out[t] = symbol
            at += (mix(symbol ^ self.seeds[:, t, None]) & U(1)).astype(np.int64)
        return out


class ItemIndex:
    """The items of one block, those with edits in parts: their seeds and, by class of lengths, the keys of their samples.

    Items too short for an edit are looked up by a hash of all their words.
    """

    def __init__(self, ids: list[int], word_lists: list[np.ndarray], max_edits: float):
        self.ids, self.words = np.array(ids, np.int64), word_lists
        self.edits = [allowed(len(w), max_edits) for w in word_lists]
        whole: dict[int, list[int]] = defaultdict(list)
        #: Item and place in it of each part, and its words.
        self.part_of: list[tuple[int, int]] = []
        self.parts: list[np.ndarray] = []
        for i, (w, k) in enumerate(zip(word_lists, self.edits, strict=True)):
            if not k:
                whole[len(w)].append(i)
                continue
            count = math.ceil(len(w) / PART_WORDS)
            for part in range(count):
                lo, hi = len(w) * part // count, len(w) * (part + 1) // count
                self.part_of.append((i, lo))
                self.parts.append(w[lo:hi])
        self.exact: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, members in whole.items():
            found = np.concatenate([grams(word_lists[i], n) for i in members])
            order = np.argsort(found, kind="stable")
            self.exact[n] = found[order], np.array(members)[order]
        self.seed_filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        seeds: dict[int, list[np.ndarray]] = defaultdict(list)
        reach: dict[int, int] = defaultdict(int)
        for w in self.parts:
            k = allowed(len(w), max_edits)
            q = shared_run(len(w), k)
            seeds[q].append(grams(w, q))
            reach[q] = max(reach[q], len(w) + k)
        for q, found in seeds.items():
            known = np.unique(np.concatenate(found))
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[known >> U(64 - _FILTER_BITS)] = True
            self.seed_filters[q] = bits, known
        self.reach = dict(reach)
        self.classes: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(self.parts):
            self.classes[self._class(len(w))].append(i)
        self.steps = {c: max(SAMPLE_SIZE, int(2 * c)) for c in self.classes}
        self.walks = Walks(max(self.steps.values(), default=1))
        self.samples = {c: self._picks(c, n) for c, n in self.steps.items()}
        self.tables = {c: self._table(c, members) for c, members in self.classes.items()}

    @staticmethod
    def _class(n: int) -> int:
        """The smallest length of the class that n is in."""
        low = 1
        while max(low + 1, int(low * CLASS_RATIO) + 1) <= n:
            low = max(low + 1, int(low * CLASS_RATIO) + 1)
        return low

    @staticmethod
    def _picks(c: int, steps: int) -> np.ndarray:
        """WALKS x SAMPLES sets of SAMPLE_SIZE different steps."""
        order = np.argsort(stream(31 + c, WALKS * SAMPLES * steps).reshape(WALKS, SAMPLES, steps), axis=2)
        return order[:, :, :SAMPLE_SIZE]

    def keys(self, word: np.ndarray, starts: np.ndarray, ends: np.ndarray, classes: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """For each class the keys (samples x starts) of the windows at all starts. Walks don't depend on the class: the longest
        have the others' steps in them."""
        embedded = self.walks.embed(word, starts, ends, max(self.steps[c] for c in classes))
        walk = np.arange(WALKS)[:, None]
        for c in classes:
            key = np.broadcast_to(np.arange(1, WALKS * SAMPLES + 1, dtype=U).reshape(WALKS, SAMPLES, 1), (WALKS, SAMPLES, len(starts)))
            for k in range(SAMPLE_SIZE):
                key = mix(key ^ embedded[self.samples[c][:, :, k], walk])
            yield c, key.reshape(WALKS * SAMPLES, -1)

    def _table(self, c: int, members: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of the class's parts, and the parts."""
        some = []
        for at in range(0, len(members), TABLE_SLICE):
            own = members[at : at + TABLE_SLICE]
            joined = np.concatenate([self.parts[i] for i in own])
            ends = np.cumsum([len(self.parts[i]) for i in own])
            starts = ends - [len(self.parts[i]) for i in own]
            some += [keys for _, keys in self.keys(joined, starts, ends, [c])]
        keys = np.concatenate(some, axis=1)
        owner = np.tile(np.array(members, np.int32), len(keys))
        keys = keys.ravel()
        order = np.argsort(keys, kind="stable")
        return keys[order], owner[order]

    def starts_near_seeds(self, word: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The starts of all windows that can be within their part's edits of it: those with a run of q words of some part.

        Nothing is lost here, as every such window keeps a run of shared_run() words; windows without one cost nothing.
        """
        marks = np.zeros(len(word) + 1, np.int64)
        for q, (bits, known) in self.seed_filters.items():
            g = grams(word, q)
            hit = np.flatnonzero(bits[g >> U(64 - _FILTER_BITS)])
            at = np.searchsorted(known, g[hit])
            hit = hit[known[np.minimum(at, len(known) - 1)] == g[hit]]
            text = np.searchsorted(first, hit, "right") - 1
            inside = hit + q <= first[text + 1]
            hit, text = hit[inside], text[inside]
            np.add.at(marks, np.maximum(first[text], hit - self.reach[q]), 1)
            np.add.at(marks, hit + 1, -1)
        return np.flatnonzero(np.cumsum(marks[:-1]) > 0)

    def candidates(self, word: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """(text, item) and the starts that the item has if a window that shares a sample's key with a part of it is that part,
        which may lie before the text's."""
        found: dict[tuple[int, int], set[int]] = defaultdict(set)
        for n, (known, owner) in self.exact.items():
            g = grams(word, n)
            at = np.searchsorted(known, g)
            hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == g)
            text = np.searchsorted(first, hit, "right") - 1
            for j, t in zip(hit, text, strict=True):
                if j + n <= first[t + 1]:
                    for item in owner[at[j] : np.searchsorted(known, g[j], "right")]:
                        found[int(t), int(item)].add(int(j))
        starts = self.starts_near_seeds(word, first)
        for lo in range(0, len(starts), 1 << 12):
            part = starts[lo : lo + (1 << 12)]
            text = np.searchsorted(first, part, "right") - 1
            for c, keys in self.keys(word, part, first[text + 1], self.tables.keys()):
                known, owner = self.tables[c]
                at = np.searchsorted(known, keys)
                for sample, j in zip(*np.nonzero(known[np.minimum(at, len(known) - 1)] == keys), strict=True):
                    for own in owner[at[sample, j] : np.searchsorted(known, keys[sample, j], "right")]:
                        item, offset = self.part_of[own]
                        found[int(text[j]), item].add(int(part[j]) - offset)
        return {k: sorted(v) for k, v in found.items()}

    def hits(self, word: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, edits, end) of the verified pairs; end is the word after the best match, in the text."""
        for (text, item), starts in self.candidates(word, first).items():
            pattern, k = self.words[item], self.edits[item]
            best = (k + 1, 0)
            at = 0
            while at < len(starts):
                to = at
                while to + 1 < len(starts) and starts[to + 1] - starts[to] <= len(pattern) + 2 * k:
                    to += 1
                lo = max(first[text], starts[at] - k)
                hi = min(first[text + 1], starts[to] + len(pattern) + 2 * k)
                best = min(best, nearest(pattern, word[lo:hi], int(lo - first[text])))
                at = to + 1
            if best[0] <= k:
                yield text, item, *best


def nearest(pattern: np.ndarray, region: np.ndarray, at: int) -> tuple[int, int]:
    """(edits, end) of the part of the region nearest to the pattern in edit distance; of equal ones the first to end."""
    places = np.arange(len(region) + 1)
    cost = np.zeros(len(region) + 1, np.int64)
    for symbol in pattern:
        up = cost + 1
        up[1:] = np.minimum(up[1:], cost[:-1] + (region != symbol))
        cost = np.minimum.accumulate(up - places) + places
    end = int(cost.argmin())
    return int(cost[end]), at + end


def _blocks(items: DataFrame, block_words: int, block_parts: int) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of items, so many at a time as have block_words words or block_parts parts, one item at least. Signs may part words too, so characters that are none
    of a word's count as ends of words."""
    ids, texts, held, parts = [], [], 0, 0
    for row in items.toLocalIterator():
        n = 1 + sum(not c.isalnum() for c in row.t)
        ids.append(row.item_id)
        texts.append(row.t)
        held, parts = held + n, parts + math.ceil(n / PART_WORDS)
        if held >= block_words or parts >= block_parts:
            yield ids, texts
            ids, texts, held, parts = [], [], 0, 0
    if ids:
        yield ids, texts


def index_of(ids: list[int], texts: list[str], max_edits: float = MAX_EDITS) -> ItemIndex:
    """The index of a block of (lower-cased) items; those without words are in nothing."""
    own, first = normal_words(pa.array(texts, pa.string()))
    some = np.flatnonzero(np.diff(first))
    return ItemIndex([ids[i] for i in some], [own[first[i] : first[i + 1]] for i in some], max_edits)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", max_edits: float = MAX_EDITS, block_words: int = BLOCK_WORDS, block_parts: int = BLOCK_PARTS) -> DataFrame:
    """(doc_id, item_id, edits, item_words, end_word): the documents that hold an item within max_edits * its words.

    Words are compared without case and signs. Items are a query set, looked for in all documents block by block: the index of a block of about
    block_words words and block_parts parts at most is made once, broadcast, whatever the number of items, and let go when its leaks are written. In a document only windows that
    share a run of words with a part of an item, which every window near enough does, are embedded; where windows and parts
    agree in one of WALKS * SAMPLES samples, the item is a candidate, and its least edit distance is computed in full.
    A narrow map without shuffle, so a passage of every document is no hot key.

    Null ids or texts of items and items without words are left out; null, empty and short texts hold nothing.
    Repeated rows of documents are found each, repeated items once, a null doc_id gives a null one. Other columns don't matter. Empty tables give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col)).alias("t"))
    known = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.lower(F.col(item_text_col)).alias("t"))
    known = known.where("item_id is not null and t is not null").distinct().orderBy("item_id", "t")
    schema = "doc_id long, item_id long, edits long, item_words long, end_word long"
    found = []
    for ids, texts in _blocks(known, block_words, block_parts):
        shared = spark.sparkContext.broadcast(index_of(ids, texts, max_edits))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "t"):
                    ix, doc_ids = shared.value, part.column("doc_id")
                    hits = list(ix.hits(*normal_words(part.column("t"))))
                    if hits:
                        text, item, edits, end = map(np.array, zip(*hits, strict=True))
                        n = np.array([len(ix.words[i]) for i in item])
                        yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(text)), pa.array(ix.ids[item]), pa.array(edits), pa.array(n), pa.array(end)], ["doc_id", "item_id", "edits", "item_words", "end_word"])

        found.append(scratch.save(rows.mapInArrow(run, schema), "block"))
        shared.destroy()
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, all columns, whose id holds no item. Rows without an id stay: they can't be told apart by it."""
    (leaked,) = unused(docs, "leaked")
    leaks = Scratch(docs.sparkSession, "decontamination").save(find_leaks(docs, items, id_col, **options).select(F.col("doc_id").alias(leaked)).distinct(), "leaks")
    return docs.join(leaks, docs[id_col].cast("long") == leaks[leaked], "left_anti")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it holds."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
