"""Secrets in texts: three fixed patterns, and values beside words of credentials that are hard to guess.

How hard is the least cost, in bits, of cutting a value into words, dates, repeats, keyboard walks and spans of brute force: dynamic programming over its places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from math import comb, log2
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill.llm.arrow_text import slices
from boxmill.llm.scratch import Scratch
from boxmill.llm.tables import table

# Fixed patterns and lengths of the base kinds, in the order in which kinds at the same place are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
#: Runs as long as they go, so that those which are too short needn't be found first.
HEX = re.compile(rf"[0-9a-f]{{{HEX_CHARS},}}")
KINDS = ("assign", "access", "hex", "value")

#: A value beside a word of credentials: quoted, or up to a space or a bracket. Written so that Java's and Python's patterns mean the same by it.
CONTEXT = (
    r"""(?:pass(?:word|wd|phrase|code)|(?<![a-z])pass|pwd|secret|token|credential|(?<![a-z])auth(?:orization)?|(?:api|access|private|auth|account)[_\x20-]?key)s?"""
    r"""(?:[0-9_-][a-z0-9_-]{0,16})?["'`]?[\x20\t]{0,16}(?:[:=]>?|\bis\b)[\x20\t]{0,16}(?:(?:bearer|basic)[\x20\t]{1,16})?"""
    r"""(?:"([^"\n]{1,})"|'([^'\n]{1,})'|`([^`\n]{1,})`|([^\s"'`,;<>(){}\[\]]{1,}))"""
)
_CONTEXT = re.compile(CONTEXT, re.I | re.A)
#: One of these is in every match of ASSIGN and of CONTEXT, whatever its case: most texts have none and needn't be searched for them.
HINTS = ("pass", "pwd", "secret", "token", "credential", "auth", "key")

#: Values of at least so many bits are secrets. Dictionary words, years, keyboard rows and examples with a digit behind them stay well below.
GUESS_BITS = 38.0
#: The dictionary holds the corpus's most frequent words of so many letters, of which at most WORDS go to the tasks (some 2 MB).
WORDS, SHORTEST_WORD, LONGEST_WORD = 1 << 16, 3, 24
#: Frequencies that differ by less than 2 ** (1 / STEPS) are one rank.
STEPS = 8

# What usual passwords and placeholders consist of. They rank before the corpus's words.
COMMON = (
    "password passwd secret token admin administrator root user login welcome letmein changeme default example sample test testing demo guest master dragon monkey "
    "shadow sunshine princess football baseball superman batman iloveyou trustno hunter access public private key api your here value string none null true false "
    "undefined redacted hidden placeholder insert replace enter required optional xxx abc foo bar baz"
).split()
# Characters that stand for letters, and keyboard rows, unshifted and shifted, each half a key to the right of the one above.
LEET = {"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"}
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = ("!@#$%^&*()_+", "QWERTYUIOP{}", 'ASDFGHJKL:"', "ZXCVBNM<>?")

#: What it costs to begin one more segment, to say which key a walk starts on and how long it is, to turn, and to repeat.
SEGMENT, WALK, TURN, REPEAT = 1.0, log2(47) + 3, log2(5), 4.0
YEAR, DAY, SEPARATED = log2(150), log2(366 * 150), 2.0
LONGEST_UNIT = 16
#: What usually stands between words.
SEPARATORS = "-_. /"
_CLASSES = ((str.isdigit, 10), (str.islower, 26), (str.isupper, 26))

_KEYS = {c: (row, place) for rows in (ROWS, SHIFTED) for row, keys in enumerate(rows) for place, c in enumerate(keys)}
_Y, _D, _M = r"(?:19\d\d|20[0-4]\d)", r"(?:0?[1-9]|[12]\d|3[01])", r"(?:0?[1-9]|1[0-2])"
_D2, _M2, _Y2 = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"\d\d"
#: Each kind of date: its form, its lengths and its cost.
_DATES = [
    (re.compile(_Y), (4,), YEAR),
    (re.compile("|".join((_Y + _M2 + _D2, _D2 + _M2 + _Y, _M2 + _D2 + _Y, _D2 + _M2 + _Y2, _M2 + _D2 + _Y2, _Y2 + _M2 + _D2))), (6, 8), DAY),
    (re.compile("|".join(rf"{x}(?P<s{k}>[-/._\x20]){y}(?P=s{k}){z}" for k, (x, y, z) in enumerate([(_Y, _M, _D), (_D, _M, _Y), (_M, _D, _Y), (_D, _M, _Y2), (_M, _D, _Y2)]))), (6, 7, 8, 9, 10), DAY + SEPARATED),
]


def _low(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    return "".join(x if len(x := c.lower()) == 1 else c for c in text)


def char_bits(c: str) -> float:
    """Brute force: one of the characters of its kind."""
    if c in SEPARATORS:
        return 2.0
    if c.isascii():
        return log2(next((n for is_one, n in _CLASSES if is_one(c)), 33))
    return log2(100)


def case_bits(word: str) -> float:
    """One bit for a capital or capitals throughout, else the choice of which letters are capitals."""
    upper, letters = sum(c.isupper() for c in word), sum(c.isalpha() for c in word)
    if not upper:
        return 0.0
    if upper == letters or upper == 1 and word[0].isupper():
        return 1.0
    return log2(sum(comb(letters, k) for k in range(1, min(upper, letters - upper) + 1)) + 1)


def key_step(a: str, b: str) -> tuple[int, int] | None:
    """The direction from one key to a neighbour, or None."""
    if a not in _KEYS or b not in _KEYS:
        return None
    (y, x), (v, u) = _KEYS[a], _KEYS[b]
    step = (v - y, u - x)
    return step if step in ((0, 1), (0, -1), (-1, 0), (-1, 1), (1, 0), (1, -1)) else None


class GuessCosts:
    """Costs of values with a dictionary of words and their bits."""

    def __init__(self, words: dict[str, float]):
        common = {w: log2(len(COMMON)) for w in COMMON}
        self.words = {**words, **{w: min(b, words.get(w, b)) for w, b in common.items()}}
        self.bits = lru_cache(1 << 12)(self._bits)

    def word_bits(self, text: str, low: str) -> float | None:
        """The cost of a word in any case, with characters that stand for letters at one bit for each kind of them."""
        if (rank := self.words.get(low)) is not None:
            return rank + case_bits(text)
        plain = "".join(LEET.get(c, c) for c in low)
        if plain != low and (rank := self.words.get(plain)) is not None:
            return rank + case_bits(text) + len({c for c in low if c in LEET})
        return None

    def cost(self, value: str) -> float:
        """Bits; each unit of a repeat is shorter than its value, so the recursion ends."""
        return self.bits(value) if len(value) <= 256 else self._bits(value)

    def _bits(self, value: str) -> float:
        n, low, never = len(value), _low(value), float("inf")
        # Costs of the first i characters: in all, with a span of brute force or a walk still open, and with a repeat of units of p characters open.
        best, brute, walk = [0.0] + [never] * n, [never] * (n + 1), [never] * (n + 1)
        repeat = [[never] * (LONGEST_UNIT + 1)] * (n + 1)
        same = [0] * (LONGEST_UNIT + 1)
        steps: list[tuple[int, int] | None] = [None]
        for i in range(1, n + 1):
            brute[i] = min(brute[i - 1], best[i - 1] + SEGMENT) + char_bits(value[i - 1])
            least = brute[i]
            for j in range(max(0, i - LONGEST_WORD), i - SHORTEST_WORD + 1):
                if (bits := self.word_bits(value[j:i], low[j:i])) is not None:
                    least = min(least, best[j] + SEGMENT + bits)
            if value[i - 1].isdigit():
                for form, lengths, bits in _DATES:
                    for j in (i - k for k in lengths):
                        if j >= 0 and best[j] + SEGMENT + bits < least and form.fullmatch(value, j, i):
                            least = best[j] + SEGMENT + bits
            steps.append(key_step(value[i - 2], value[i - 1]) if i > 1 else None)
            if i > 2 and steps[i] and steps[i - 1]:
                walk[i] = min(walk[i - 1], best[i - 3] + SEGMENT + WALK) + TURN * (steps[i] != steps[i - 1])
                least = min(least, walk[i])
            own = None
            for p in range(1, min(LONGEST_UNIT, i - 1) + 1):
                same[p] = same[p] + 1 if value[i - 1] == value[i - 1 - p] else 0
                if same[p] >= p:
                    own = own or [never] * (LONGEST_UNIT + 1)
                    own[p] = min(repeat[i - p][p], best[i - 2 * p] + SEGMENT + self.cost(value[i - 2 * p : i - p]) + REPEAT)
                    least = min(least, own[p])
            if own:
                repeat[i] = own
            best[i] = least
        return best[n]


def _hinted(text: str) -> bool:
    low = text.lower()
    return any(h in low for h in HINTS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns, sorted. A match that is too short is dropped, what it covers is not searched again."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS] if _hinted(text) else []
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def context_values(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each value beside a word of credentials; without stops and colons after it, unless it is quoted."""
    for m in _CONTEXT.finditer(text) if _hinted(text) else ():
        start, end = m.span(m.lastindex)
        if m.lastindex == 4:
            while end > start and text[end - 1] in ".:":
                end -= 1
        if end > start:
            yield start, end


def secret_spans(text: str, costs: GuessCosts, guess_bits: float = GUESS_BITS) -> list[tuple[int, int, int, float | None]]:
    """(start, kind's number, end, bits) of the base spans and of the hard values that no base span covers, sorted; bits of the latter alone."""
    found: list[tuple[int, int, int, float | None]] = [(*s, None) for s in base_spans(text)]
    base, at, reach = list(found), 0, -1
    for start, end in context_values(text):
        # Both lists are sorted by start; reach is the farthest end of the base spans that start no later.
        while at < len(base) and base[at][0] <= start:
            reach, at = max(reach, base[at][2]), at + 1
        if reach < end and (bits := costs.cost(text[start:end])) >= guess_bits:
            found.append((start, 3, end, bits))
    return sorted(found, key=lambda s: s[:3])


def _word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n): the words of all texts, without the values beside words of credentials, so that a secret that many copies hold is no word."""
    text = F.lower(F.col(text_col))
    hinted = reduce(or_, [F.contains(text, F.lit(h)) for h in HINTS])
    text = F.when(hinted, F.regexp_replace(text, F.lit(CONTEXT), F.lit(" "))).otherwise(text)
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return words.where(F.length("word").between(SHORTEST_WORD, LONGEST_WORD)).groupBy("word").agg(F.count("*").alias("n"))


def dictionary(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> dict[str, float]:
    """The most frequent words of all texts and the bits of their ranks; at most `words` of them.

    Frequencies are put in steps, and the words of as many steps from the top are taken as stay within `words`; a word's rank is the number of words down to its step. So
    no task sorts the words, and what the driver gets is bounded: some hundreds of steps, and those words. The counts are written once, to the shared folder, and deleted.
    """
    step = F.floor(F.log2(F.col("n")) * STEPS).cast("int")
    scratch = Scratch(docs.sparkSession, "secret-words")
    counts = scratch.save(_word_counts(docs, text_col).select("word", step.alias("step")), "steps")
    ranks, total = {}, 0
    for row in sorted(counts.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        total += row["count"]
        if total > words:
            break
        ranks[row["step"]] = log2(total + len(COMMON))
    taken = counts.where(F.col("step") >= min(ranks, default=1 << 30)).toArrow()
    scratch.drop(counts)
    return {w: ranks[s] for w, s in zip(taken.column("word").to_pylist(), taken.column("step").to_pylist())}


def scan_secrets(docs: DataFrame, words: dict[str, float], id_col: str = "doc_id", text_col: str = "text", guess_bits: float = GUESS_BITS) -> DataFrame:
    """(doc_id, spans) for each row of docs; spans is an array of (kind, start, end, bits), by start and then by kind.

    Places are code points, ends exclusive. The kinds assign, access and hex are the fixed patterns; value is what stands beside a word of credentials,
    isn't covered by one of those and costs guess_bits or more to guess; bits is null for the others.
    Null and empty texts have no spans. Repeated rows are scanned each, a null id gives a null one; other columns don't matter; an empty table gives no rows.
    A narrow map. Patterns take time by a text's length, costs by a value's: a long value, too, is read as a whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = GuessCosts(shared.value)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())]))
        for batch in batches:
            for part in slices(batch, "text"):
                spans = [[{"kind": KINDS[k], "start": a, "end": b, "bits": bits} for a, k, b, bits in secret_spans(t or "", costs, guess_bits)] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: int, end: int, bits: double>>")


def without_secrets(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with a mark in the place of each span; spans that overlap share one."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(state: Column, s: Column) -> Column:
        apart = F.concat(state["done"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark))
        return F.struct(F.when(s["start"] < state["at"], state["done"]).otherwise(apart).alias("done"), F.greatest(state["at"], s["end"]).alias("at"))

    return F.aggregate(spans, start, step, lambda s: F.concat(s["done"], F.substr(text, s["at"] + 1)))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document: numbers and a digest of the base kinds, and all spans."""
    docs = table(spark, sf_dir, "documents")
    found = scan_secrets(docs, dictionary(docs))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "value")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
