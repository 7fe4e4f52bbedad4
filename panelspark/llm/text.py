"""Vectorised helpers over UTF-8 bytes: words, hashes, batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: The bytes that separate words, 0x20 and 0x09 to 0x0D.
SPACES = (32, 9, 10, 11, 12, 13)
SPACE = np.zeros(256, bool)
SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Odd multipliers of the mixing steps.
_ODD = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_KEY = b"word hash"


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that changes about half of the bits when one changes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The place of each span among the distinct ones, and these; spans in order, without overlap. Bytes are compared."""
    lengths = ends - starts
    if len(starts) and (starts[1:] == ends[:-1]).all():
        flat = buf[starts[0] : ends[-1]]
    else:
        flat = gather(buf, starts, lengths)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])
    found = column.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def join_hashes(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    """A hash of the ordered pairs (a, b)."""
    return mix(a * np.uint64(_ODD[lane]) + mix(b ^ np.uint64(_ODD[1 - lane])))


#: Bytes of a span that are hashed as two numbers; longer spans go through a library hash.
SHORT = 16
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def first_bytes(buf: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 8 bytes of each span and the next 8 as numbers, with zeros after its end."""
    padded = np.concatenate([buf, np.zeros(SHORT, np.uint8)])
    at = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    return at[starts] & _MASKS[np.minimum(size, 8)], at[np.minimum(starts + 8, len(at) - 1)] & _MASKS[np.clip(size - 8, 0, 8)]


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lanes: int = 1) -> np.ndarray:
    """64 bits of hash for each span (lanes=2: two rows of 64); spans in order, without overlap.

    Up to SHORT bytes the two numbers and the length that are mixed are the span itself; of a longer
    span they are its keyed BLAKE2 hash.
    """
    size = (ends - starts).astype(np.int64)
    low, high = first_bytes(buf, starts, size)
    long = np.flatnonzero(size > SHORT)
    if len(long):
        codes, found = distinct_spans(buf, starts[long], ends[long])
        raw = b"".join([blake2b(x, digest_size=16, key=_KEY).digest() for x in found.to_pylist()])
        low[long], high[long] = np.frombuffer(raw, "<u8").reshape(-1, 2)[codes].T
    size = size.astype(np.uint64)
    first = join_hashes(join_hashes(low, high), size)
    return first if lanes == 1 else np.stack([first, join_hashes(join_hashes(low, high, 1), size, 1)])


def window_hash(values: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive hashes: runs of 1, 2, 4, ... values are joined in pairs, the last two may overlap."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    width, runs = 1, values
    while 2 * width <= k:
        runs = join_hashes(runs[:-width], runs[width:], lane)
        width *= 2
    if width < k:
        runs = join_hashes(runs[: len(runs) - (k - width)], runs[k - width :], lane)
    return runs


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    else:
        column = column.cast(pa.large_binary())
    column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of a column; one row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = column_bytes(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), start + 4096, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of flat[start:start+length] for each pair."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lengths)
    at = np.arange(total, dtype=np.int64)
    at += np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)
    return flat[at]


def doc_words(buf: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each document (and in all); `apart` tells the bytes between words."""
    word = ~apart[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | edge[1:-1]
    end[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def sorted_set(values: np.ndarray) -> np.ndarray:
    """The distinct values in order."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]
