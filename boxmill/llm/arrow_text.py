"""Numpy kernels over the buffers of Arrow string columns: words, word hashes and shingles of many texts at once.

All hashes are 64 bit and depend on the bytes alone, so every task and every rerun agrees.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
#: Text bytes handled at once (a longer text is handled alone); bounds a task's memory.
SLICE_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (splitmix64's finalizer)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers of a seed."""
    with np.errstate(over="ignore"):
        return mix(U(seed) + U(_BASE) * np.arange(1, n + 1, dtype=U))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words of more bytes are digested one by one.
_LONG = 64
#: What is left of eight bytes of which only the first so many are the word's.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and len+1 offsets; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `size` bytes of text each, and one row at least."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (len+1 numbers)."""
    n = len(data)
    inside = ~space[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = np.unique(offsets[(offsets > 0) & (offsets < n)])
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word; A-Z count as a-z.

    Eight bytes at a time are mixed into what the bytes before them gave, so words that differ anywhere have unrelated hashes.
    """
    low, n = _LOWER[data], ends - starts
    # Eight bytes from each place on, as one number.
    eight = np.ndarray(len(low) + 1, "<u8", np.append(low, np.zeros(8, np.uint8)), strides=1)
    out = mix(n.astype(U) ^ U(0xD6E8FEB86659FD93))
    todo = np.flatnonzero(n <= _LONG)
    for at in range(0, _LONG, 8):
        todo = todo[n[todo] > at]
        if not len(todo):
            break
        out[todo] = mix(out[todo] ^ mix((eight[starts[todo] + at] & _FIRST[np.minimum(n[todo] - at, 8)]) + U(_BASE)))
    for i in np.flatnonzero(n > _LONG):
        out[i] = int.from_bytes(blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles of `width` words, and len+1 offsets into them.

    A text with fewer words has one shingle, the whole sequence; one without words has none.
    """
    data, offsets = buffers(texts)
    starts, ends, first = words(data, offsets)
    own = hashes(data, starts, ends)
    n, counts = len(own), np.diff(first)
    with np.errstate(over="ignore"):
        rolled = np.zeros(n, U)
        for k in range(width):
            rolled[: max(0, n - k)] += own[k:] * U(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64))
        rolled = mix(rolled + U(width))
    keep = np.arange(n) + width <= np.repeat(first[1:], counts)
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        a, b = first[d], first[d + 1]
        whole = U(b - a)
        for x in own[a:b]:
            whole = mix(np.array([whole ^ x]))[0]
        rolled[a], keep[a] = whole, True
    sets, sizes = [], np.zeros(len(counts) + 1, np.int64)
    for d in range(len(counts)):
        a, b = first[d], first[d + 1]
        if b > a:
            s = rolled[a : max(a + 1, b - width + 1)]
            s = np.unique(s[keep[a : a + len(s)]])
            sets.append(s)
            sizes[d + 1] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, U)), np.cumsum(sizes)
