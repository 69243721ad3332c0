"""Fill-in-middle texts by displacement scatter: a scan for the cuts, a difference array of shifts, one scatter for all bytes of a slice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from boxmill.llm.arrow_text import buffers, slices
from boxmill.llm.tables import table

#: The marks before prefix, suffix and middle. A text that holds one of them stays plain, so a mark in an output is always one that was put there.
MARKS = (b"<P>", b"<S>", b"<M>")
#: Of 100 documents so many are rearranged, and of these so many with the suffix first.
FIM_PERCENT, SPM_PERCENT = 100, 50
SEED = 7
#: Forms as numbers inside the kernels. A rearranged output holds its segments in these orders (0 prefix, 1 suffix, 2 middle).
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ["plain", "psm", "spm"]
_ORDER = np.array([[0, 1, 2], [0, 1, 2], [1, 0, 2]])
#: The numbers of the segments in a text: prefix, middle, suffix.
_IN_TEXT = (0, 2, 1)
#: Bytes whose targets are worked out at once.
BLOCK = 1 << 18
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _mark_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where marks start, and which of them each is."""
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">"))) if len(data) > 2 else np.zeros(0, np.int64)
    letter = data[at + 1]
    kind = np.full(len(at), -1)
    for k, mark in enumerate(MARKS):
        kind[letter == mark[1]] = k
    return at[kind >= 0], kind[kind >= 0]


def _owners(offsets: np.ndarray, at: np.ndarray, width: int = 1) -> np.ndarray:
    """The texts of the places `at`, and -1 where the `width` bytes from there are not of one text."""
    own = np.searchsorted(offsets, at, "right") - 1
    return np.where(at + width <= offsets[np.minimum(own + 1, len(offsets) - 1)], own, -1)


def _shifts(starts: np.ndarray, to: np.ndarray, n: int) -> Iterator[tuple[slice, np.ndarray]]:
    """The target of each of n bytes, if those from starts[k] on go to to[k] and after; starts are sorted and begin with 0.

    Given in blocks of bytes, so that the numbers of a very long text are never all there. In each block the changes of the shift
    are scattered into a difference array (empty segments start at the same place and add up), whose running sum is every byte's shift.
    """
    changes, carry = np.diff(to - starts, prepend=0), 0
    for low in range(0, n, BLOCK):
        high = min(n, low + BLOCK)
        first, last = np.searchsorted(starts, (low, high))
        steps = np.zeros(high - low, np.int64)
        np.add.at(steps, starts[first:last] - low, changes[first:last])
        steps[0] += carry
        shift = np.cumsum(steps, out=steps)
        carry = shift[-1]
        yield slice(low, high), np.arange(low, high) + shift


def _chars(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points of the UTF-8 between each start and end."""
    begins = (data & 0xC0) != 0x80
    return np.array([np.count_nonzero(begins[a:b]) for a, b in zip(starts, ends)], np.int64)


def rearranged(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT):
    """(lines, forms, cuts, bytes, offsets) of the outputs of texts; draws: four numbers for each text.

    cuts are the places in `data` where middle and suffix start.
    """
    docs, n = len(offsets) - 1, len(data)
    starts, ends = offsets[:-1], offsets[1:]
    # A line ends after its newline, the last one at the text's end.
    closing = data == ord("\n")
    last = ends[ends > starts] - 1
    closing[last] = True
    closes = np.flatnonzero(closing) + 1
    first = np.searchsorted(closes, starts, "right")
    lines = np.searchsorted(closes, ends, "right") - first
    a, b = draws[:, 0] % (lines + 1), draws[:, 1] % (lines + 1)
    # closes[first + k - 1] is the end of line k; k = 0 is the text's start.
    padded = np.concatenate([closes, [n]])
    cut = lambda k: np.where(k > 0, padded[np.maximum(first + k - 1, 0)], starts)
    cuts = np.stack([cut(np.minimum(a, b)), cut(np.maximum(a, b))], 1)
    forms = np.where(draws[:, 3] % 100 < spm, SPM, PSM)
    own = _owners(offsets, _mark_places(data)[0], 3)
    forms[own[own >= 0]] = PLAIN
    forms[(lines == 0) | (draws[:, 2] % 100 >= fim)] = PLAIN

    out_offsets = offsets + np.concatenate([[0], np.cumsum(9 * (forms != PLAIN))])
    size = np.stack([cuts[:, 0] - starts, ends - cuts[:, 1], cuts[:, 1] - cuts[:, 0]], 1)
    order = _ORDER[forms]
    in_order = np.take_along_axis(size, order, 1)
    # The places of the segments in the output, in its order, each behind its mark; then by segment.
    place = out_offsets[:-1, None] + 3 * np.arange(1, 4) + np.cumsum(in_order, 1) - in_order
    by_segment = np.empty_like(place)
    np.put_along_axis(by_segment, order, place, 1)
    to = by_segment[:, _IN_TEXT]
    plain = forms == PLAIN
    to[plain] = (out_offsets[:-1, None] + np.concatenate([starts[:, None], cuts], 1) - starts[:, None])[plain]
    out = np.empty(out_offsets[-1], np.uint8)
    for block, targets in _shifts(np.concatenate([starts[:, None], cuts], 1).ravel(), to.ravel(), n):
        out[targets] = data[block]
    for segment, mark in enumerate(MARKS):
        for k, byte in enumerate(mark):
            out[by_segment[~plain, segment] - 3 + k] = byte
    return lines, forms, cuts, out, out_offsets


def restored(out: np.ndarray, out_offsets: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of the texts that rearranged() made outputs of, from these and their forms alone.

    The marks are found anew; the segments between them give the shifts, and the texts gather their bytes from where the shifts put them.
    """
    moved = forms != PLAIN
    at, kind = _mark_places(out)
    own = _owners(out_offsets, at, 3)
    own[~moved[own]] = -1
    at, kind, own = at[own >= 0], kind[own >= 0], own[own >= 0]
    if len(at) != 3 * moved.sum():
        raise ValueError("an output that isn't plain has to hold each mark once")
    offsets = out_offsets - np.concatenate([[0], np.cumsum(9 * moved)])
    # From the start of a segment to the next mark or the text's end, in the output's order.
    begins = (at + 3).reshape(-1, 3)
    ends = np.concatenate([at.reshape(-1, 3)[:, 1:], out_offsets[1:][moved][:, None]], 1)
    by_segment, size = np.empty((2, *begins.shape), np.int64)
    np.put_along_axis(by_segment, kind.reshape(-1, 3), begins, 1)
    np.put_along_axis(size, kind.reshape(-1, 3), ends - begins, 1)
    starts = np.repeat(offsets[:-1, None], 3, 1)
    come_from = np.repeat(out_offsets[:-1, None], 3, 1)
    come_from[moved] = by_segment[:, _IN_TEXT]
    in_text = size[:, _IN_TEXT]
    starts[moved] += np.cumsum(in_text, 1) - in_text
    texts = np.empty(offsets[-1], np.uint8)
    for block, places in _shifts(starts.ravel(), come_from.ravel(), offsets[-1]):
        texts[block] = out[places]
    return texts, offsets


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fim: int = FIM_PERCENT, spm: int = SPM_PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of docs.

    A text of n lines is cut after two numbers of lines that a SHA-256 of seed and id draws, so every run and order of rows gives the same cuts. `fim` of 100 documents
    are rearranged, of which `spm` of 100 start with the suffix (spm), the rest with the prefix (psm).
    Null and empty texts, texts that hold a mark, and those not drawn are plain: their output is the text, their counts of
    characters are null. Null ids draw as an empty id would. Repeated rows give repeated rows; other columns don't matter; an empty table gives no rows.
    A narrow map: rows are handled in slices of 256 KB of text, a longer text alone,
    at a few bytes of memory for each of its bytes and eight for each line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = buffers(part.column("text"))
                draws = np.stack([part.column(f"h{k}").to_numpy() for k in range(4)], 1)
                lines, forms, cuts, out, out_offsets = rearranged(data, offsets, draws, fim, spm)
                plain = forms == PLAIN
                columns = [part.column("doc_id"), pa.array(lines), pa.DictionaryArray.from_arrays(forms.astype(np.int8), FORMS).cast(pa.string())]
                columns += [pa.array(_chars(data, x, y), mask=plain) for x, y in ((offsets[:-1], cuts[:, 0]), (cuts[:, 0], cuts[:, 1]))]
                yield pa.RecordBatch.from_arrays([*columns, _strings(out, out_offsets)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    groups = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    return rows.select("doc_id", "text", *groups).mapInArrow(run, _SCHEMA)


def restore_texts(outputs: DataFrame, form_col: str = "form", output_col: str = "output", text_col: str = "restored") -> DataFrame:
    """`outputs` with one more column: the text that each output was made of, worked out from its form and output alone.

    All columns stay; null outputs count as plain empty ones. An empty table gives no rows.
    """
    names, schema = outputs.columns, StructType([*outputs.schema.fields, StructField(text_col, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, output_col):
                forms = np.array([FORMS.index(x or "plain") for x in part.column(form_col).to_pylist()])
                text = _strings(*restored(*buffers(part.column(output_col)), forms))
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*names, text_col])

    return outputs.mapInArrow(run, schema)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut in three and rearranged, and read back, as digests."""
    done = restore_texts(fill_in_middle(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), numbers AS (
  SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM drawn
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), parts AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
