"""Token counts by byte-pair merging over a heap and a linked list, without token ids."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill.llm.tables import table

#: The GPT-2 pattern that cuts a text before merging, with \s spelled out as Unicode's White_Space.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
)
#: Bytes of the distinct pieces, with what a piece costs besides, whose counts a worker keeps; when full, it starts anew. Longer pieces than
#: LONG are counted each time.
CACHE_BYTES, PIECE_BYTES, LONG = 128 << 20, 150, 256


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes stand for themselves."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class PieceCounter(dict):
    """Tokens of a piece of text, computed at first use: initial symbols less merges."""

    def __init__(self, model: dict, limit: int = CACHE_BYTES):
        super().__init__()
        self.limit, self.held = limit, 0
        self.ids = {token: i for i, token in enumerate(model["vocab"])}
        self.letters = [self.ids[x] for x in byte_letters()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[a], self.ids[b]] = rank, self.ids[a + b]

    def __missing__(self, piece: str) -> int:
        data = piece.encode("utf-8")
        n = self.count(data)
        if len(data) <= LONG:
            self.held += len(data) + PIECE_BYTES
            if self.held > self.limit:
                self.clear()
                self.held = len(data) + PIECE_BYTES
            self[piece] = n
        return n

    def count(self, data: bytes) -> int:
        """Pops the lowest-ranked adjacent pair (leftmost among equals) until none is left."""
        symbol, merges = [self.letters[b] for b in data], self.merges
        n = left_over = len(symbol)
        if n < 2:
            return n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # An entry is the pair's rank and its left symbol's place in one number.
        heap = [m[0] << 32 | i for i in range(n - 1) if (m := merges.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or (m := merges.get((symbol[i], symbol[j]))) is None or m[0] != entry >> 32:
                continue  # one of the two was merged meanwhile
            symbol[i], symbol[j] = m[1], -1
            after[i] = k = after[j]
            left_over -= 1
            if k < n:
                before[k] = i
                if m := merges.get((symbol[i], symbol[k])):
                    heapq.heappush(heap, m[0] << 32 | i)
            if (k := before[i]) >= 0 and (m := merges.get((symbol[k], symbol[i]))):
                heapq.heappush(heap, m[0] << 32 | k)
        return left_over


def _unsupported(spec: dict) -> list[str]:
    """What a file asks for that counting here does not do."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    found = [k for k in ("normalizer", "truncation", "padding", "post_processor") if spec.get(k)]
    found += [f"pre_tokenizer {before.get('type')}"] * (before.get("type") != "ByteLevel" or before.get("add_prefix_space", True) or not before.get("use_regex", True))
    found += [f"model {model.get('type', 'BPE')}"] * (model.get("type", "BPE") != "BPE")
    found += [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    return found + [f"added token {t['content']}" for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or not t["content"]]


class TokenCounter:
    """Counts of whole texts for a byte-level BPE file of the tokenizers library. Files that ask for more than that are refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if more := _unsupported(spec):
            raise ValueError(f"{path} needs {', '.join(more)}")
        self.pieces = PieceCounter(spec["model"])
        self.split = regex.compile(PATTERN).findall
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.marks = special

    def count(self, text: str) -> int:
        """Special strings in a text are one token each, as the library has it by default."""
        if self.marks and any(m in text for m in self.marks):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(self.count_plain(p) for p in parts)
        return self.count_plain(text)

    def count_plain(self, text: str) -> int:
        return sum(map(self.pieces.__getitem__, self.split(text)))


_counters: dict[str, TokenCounter] = {}


def counter(tokenizer: str) -> TokenCounter:
    """The worker's counter for a vocabulary file, by its name or path; kept from task to task."""
    if tokenizer not in _counters:
        import os

        import public_tokenizers

        _counters[tokenizer] = TokenCounter(tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer))
    return _counters[tokenizer]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """(id, n_bytes, n_tokens) for each row of docs.

    A narrow map without shuffle. Null and empty texts have 0 of both; repeated rows are counted each, a null id gives a null one;
    other columns don't matter; an empty table gives no rows. The heap of one piece is bounded by the piece's length, a piece by its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for batch in batches:
            texts = batch.column(2)
            n = [count(x) if x else 0 for x in map(lambda s: s.as_py(), texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of documents; over_limit marks those of more than 512."""
    counts = count_tokens(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)
