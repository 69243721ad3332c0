"""Token ids packed into rows of equal length: best-fit-decreasing with a segment tree over capacities."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill.llm.tables import table

#: Tokens in a packed row. With BLOCK_ROWS it bounds what a task holds.
SEQ_LEN = 2048
#: Rows' worth of tokens that are packed together.
BLOCK_ROWS = 512
TOKENIZER = "byte_bpe_50k.tiktoken"
#: The id after a document's last token, free in the vocabulary; also fills the ends of rows.
END_ID = 50256


@cache
def _encoder(tokenizer: str):
    import base64

    import public_tokenizers
    import tiktoken

    path = tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class CapacityTree:
    """The open rows by free places: a segment tree that tells the smallest capacity, of at least some size, that a row has."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.counts = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def push(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        at = capacity + self.size
        while at:
            self.counts[at] += 1
            at >>= 1

    def pop(self, capacity: int) -> int:
        at = capacity + self.size
        while at:
            self.counts[at] -= 1
            at >>= 1
        return self.rows[capacity].pop()

    def smallest(self, least: int) -> int | None:
        """Climb from the leaf until a right sibling holds a row, then go down its left side."""
        at = least + self.size
        if self.counts[at]:
            return least
        while at > 1:
            if not at & 1 and self.counts[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.counts[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indices into lengths (each 1 to capacity): longest first, each into the fullest row that takes it.

    Equal lengths go in their order; of equally full rows the latest is taken.
    """
    rows: list[list[int]] = []
    tree = CapacityTree(capacity)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[i]
        if (free := tree.smallest(n)) is None:
            row, free = len(rows), capacity
            rows.append([])
        else:
            row = tree.pop(free)
        rows[row].append(i)
        if free > n:
            tree.push(free - n, row)
    return rows


FIELDS = [
    ("n_tokens", pa.int32(), "int"),
    ("input_ids", pa.binary(), "binary"),
    ("position_ids", pa.binary(), "binary"),
    ("cu_seqlens", pa.list_(pa.int32()), "array<int>"),
    ("doc_ids", pa.list_(pa.int64()), "array<long>"),
    ("doc_offsets", pa.list_(pa.int64()), "array<long>"),
]
SCHEMA = ", ".join(f"{name} {kind}" for name, _, kind in FIELDS)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, block_rows: int = BLOCK_ROWS, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """One row for each packed sequence of seq_len ids; a narrow map without shuffle.

    - n_tokens: places in use, from the left; the rest holds end_id.
    - input_ids, position_ids: seq_len little-endian uint16 (uint32 if the vocabulary, end_id or seq_len need it); stacked, the rows
      are the id matrix. Positions start anew at 0 with each segment and after the last one.
    - cu_seqlens: 0 and the end of each segment.
    - doc_ids, doc_offsets: for each segment its document and the place of its first token among the document's.

    A document's tokens are those of its whole text, special strings being ordinary text, and then end_id; null
    and empty texts are end_id alone. A document longer than seq_len is split into pieces of seq_len and a rest. Segments
    of a document put together by their offsets give its tokens back: nothing is lost, cut or repeated. Tasks pack blocks of
    block_rows * seq_len tokens on their own, so which segments share a row depends on how the files are split,
    while the segments don't. A task's last block is packed with what it has; so half a row on average stays empty for each task besides what a full block
    loses: 0.3 % of a task of 128 MB of text, more for smaller files. Repeated rows are packed each, a null id gives a null one; other columns
    don't matter. An empty table gives no rows.
    """
    ids_type = np.dtype("<u2" if max(end_id, seq_len, _encoder(tokenizer).max_token_value) < 1 << 16 else "<u4")
    out_type = pa.schema([(name, kind) for name, kind, _ in FIELDS])

    def packed(segments: list[tuple[int | None, int, np.ndarray]]) -> pa.RecordBatch:
        rows = best_fit_decreasing([len(x[2]) for x in segments], seq_len)
        ids = np.full((len(rows), seq_len), end_id, ids_type)
        positions = np.zeros((len(rows), seq_len), ids_type)
        counting = np.arange(seq_len, dtype=ids_type)
        used, ends = [], []
        for r, row in enumerate(rows):
            at, cuts = 0, [0]
            for i in row:
                tokens = segments[i][2]
                ids[r, at : at + len(tokens)] = tokens
                positions[r, at : at + len(tokens)] = counting[: len(tokens)]
                at += len(tokens)
                cuts.append(at)
            positions[r, at:] = counting[: seq_len - at]
            used.append(at)
            ends.append(cuts)
        columns = [used, [x.tobytes() for x in ids], [x.tobytes() for x in positions], ends, [[segments[i][0] for i in row] for row in rows], [[segments[i][1] for i in row] for row in rows]]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind, _) in zip(columns, FIELDS, strict=True)], schema=out_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(tokenizer).encode_ordinary, np.array([end_id], ids_type)
        segments, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.append(np.array(encode(text.as_py() or ""), ids_type), end)
                for start in range(0, len(tokens), seq_len):
                    segments.append((doc_id, start, piece := tokens[start : start + seq_len]))
                    held += len(piece)
                    if held >= block_rows * seq_len:
                        yield packed(segments)
                        segments, held = [], 0
        if segments:
            yield packed(segments)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """The binary output: Parquet files whose row groups are id matrices with their segment lengths and positions."""
    packed.write.mode("overwrite").parquet(path)


def op1_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed rows of token ids."""
    return pack(table(spark, sf_dir, "documents"))
