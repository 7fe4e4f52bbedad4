"""Splits texts by the public byte-level pattern and maps each distinct piece to ids once.

The pattern is ``public_tokenizers.PATTERN``. For texts of the plain alphabet (below) its matches
are found by vectorised rules; any other text goes through the `regex` module.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import regex

from panelspark.llm.text import SHORT, distinct_spans, first_bytes, gather, join_hashes

#: Code points whose class no Unicode version disputes.
_PLAIN_TOP = 0x0530
_LETTER, _NUMBER, _OTHER, _SPACE = range(4)
#: The contractions of the pattern, by length.
_ONE, _TWO = "stmd", ("re", "ve", "ll")


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(_PLAIN_TOP, _OTHER, np.uint8)
    chars = "".join(map(chr, range(_PLAIN_TOP)))
    for found, k in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _SPACE)):
        kind[[ord(c) for c in regex.findall(found, chars)]] = k
    plain = np.ones(_PLAIN_TOP, bool)
    plain[:32] = plain[127:161] = False
    plain[[9, 10, 13]] = True
    return kind, plain


_KIND, _IS_PLAIN = _classes()


def plain(points: np.ndarray) -> bool:
    return not len(points) or bool(points.max() < _PLAIN_TOP and _IS_PLAIN[points].all())


def starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pattern's matches start, in code points. first: the first code point of each text."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _KIND[points]
    text_start = np.zeros(n + 1, bool)
    text_start[first] = True
    text_start[n] = True
    run = text_start[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    at = np.zeros(n, bool)
    begin = np.flatnonzero(run)
    end = np.append(begin[1:], n)
    space = kind[begin] == _SPACE
    last_blank = points[end - 1] == 32
    closed = text_start[end]  # nothing follows in this text
    at[begin[space & (closed | (end - begin > 1))]] = True
    alone = space & ~closed & ~last_blank
    at[end[alone] - 1] = True
    # a run of another kind takes one blank before it
    takes = np.zeros(len(begin), bool)
    takes[1:] = space[:-1] & last_blank[:-1] & ~text_start[begin[1:]]
    own = ~space
    at[begin[own & takes] - 1] = True
    at[begin[own & ~takes]] = True
    # contractions
    quotes = begin[own & ~takes & (points[begin] == 39) & (end - begin == 1)]
    quotes = quotes[(quotes + 1 < n) & ~text_start[np.minimum(quotes + 1, n)]]
    for q in quotes[kind[quotes + 1] == _LETTER] if len(quotes) else ():
        if chr(points[q + 1]) in _ONE:
            k = 1
        elif q + 2 < n and not text_start[q + 2] and chr(points[q + 1]) + chr(points[q + 2]) in _TWO:
            k = 2
        else:
            continue
        at[q + 1] = False
        if q + 1 + k < n and kind[q + 1 + k] == _LETTER:
            at[q + 1 + k] = True
    return np.flatnonzero(at)


def _roomy(values: np.ndarray, n: int) -> np.ndarray:
    """The same values with room for n, so that many additions copy them seldom."""
    if n <= len(values):
        return values
    out = np.empty(max(n, 2 * len(values)), values.dtype)
    out[: len(values)] = values
    return out


class Memo:
    """Ids of pieces seen so far, found by the pieces' bytes; memory is bounded by `most` pieces and by `most` times 8 bytes of long ones.

    A piece of up to SHORT - 1 bytes is the two numbers that hold its bytes and its length; a table
    with open addresses tells where its ids are, for all pieces of a text at once. Longer pieces are
    looked up one by one.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], pattern: str, most: int = 1_600_000):
        self.encode, self.pattern, self.most = encode, regex.compile(pattern), most
        self.specials: tuple[str, ...] = ()
        self.clear()

    def clear(self) -> None:
        self.long: dict[bytes, int] = {}
        self.held = self.n = self.n_ids = 0
        self.slots = np.full(1 << 12, -1, np.int32)
        self.low, self.high = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (join_hashes(low, high) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each short piece, -1 if it is new."""
        out = np.full(len(low), -1, np.int64)
        left, slot = np.arange(len(low)), self._slot(low, high)
        while len(left):
            got = self.slots[slot]
            used = np.flatnonzero(got >= 0)
            left, slot, low, high, got = left[used], slot[used], low[used], high[used], got[used]
            same = (self.low[got] == low) & (self.high[got] == high)
            out[left[same]] = got[same]
            on = np.flatnonzero(~same)
            left, slot, low, high = left[on], (slot[on] + 1) & (len(self.slots) - 1), low[on], high[on]
        return out

    def _place(self, numbers: np.ndarray) -> None:
        """Enters short pieces, no two of them equal, that the table doesn't have."""
        slot = self._slot(self.low[numbers], self.high[numbers])
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            on = np.flatnonzero(self.slots[slot] != numbers)
            numbers, slot = numbers[on], (slot[on] + 1) & (len(self.slots) - 1)

    def _learn(self, pieces: list[bytes], low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The numbers of new pieces, no two of them equal, after they were encoded."""
        got = self.encode(pieces)
        size = np.fromiter(map(len, got), np.int64, len(got))
        numbers = self.n + np.arange(len(got))
        n, n_ids = self.n + len(got), self.n_ids + int(size.sum())
        self.low, self.high, self.at, self.size = (_roomy(x, n) for x in (self.low, self.high, self.at, self.size))
        self.ids = _roomy(self.ids, n_ids)
        self.low[numbers], self.high[numbers], self.size[numbers] = low, high, size
        self.at[numbers] = self.n_ids + np.cumsum(size) - size
        self.ids[self.n_ids : n_ids] = np.fromiter(chain.from_iterable(got), np.uint32, n_ids - self.n_ids)
        self.n, self.n_ids = n, n_ids
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for i in np.flatnonzero(length >= SHORT).tolist():
            self.long[pieces[i]] = int(numbers[i])
            self.held += len(pieces[i])
        short = numbers[length < SHORT]
        if 2 * n > len(self.slots):
            self.slots = np.full(1 << (2 * n).bit_length(), -1, np.int32)
            short = np.flatnonzero(self.high[:n] >> np.uint64(56) < SHORT)
        self._place(short)
        return numbers

    def lookup(self, buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces buf[lo:hi] in order, and how many each has."""
        if not len(lo):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.n > self.most or self.held > 8 * self.most:
            self.clear()
        size = hi - lo
        low, high = first_bytes(buf, lo, size)
        # the length above the last bytes; no entry has that of a long piece
        high = np.where(size < SHORT, high, np.uint64(0)) | (np.minimum(size, SHORT).astype(np.uint64) << np.uint64(56))
        where = self._find(low, high)
        rest = np.flatnonzero(where < 0)
        if len(rest):
            codes, found = distinct_spans(buf, lo[rest], hi[rest])
            found = found.to_pylist()
            first = np.empty(len(found), np.int64)
            first[codes] = rest
            known = np.fromiter((self.long.get(x, -1) for x in found), np.int64, len(found))
            new = np.flatnonzero(known < 0)
            if len(new):
                known[new] = self._learn([found[i] for i in new.tolist()], low[first[new]], high[first[new]])
            where[rest] = known[codes]
        size = self.size[where]
        return gather(self.ids, self.at[where], size), size

    def fast(self, text: str, points: np.ndarray) -> bool:
        return plain(points) and not any(s in text for s in self.specials)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the count of each text."""
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        chars = np.fromiter(map(len, texts), np.int64, len(texts))
        if self.fast(whole, points):
            buf = np.frombuffer(whole.encode(), np.uint8)
            end = np.cumsum(chars)
            first = (end - chars)[chars > 0]
            at = starts(points, first)
            width = np.zeros(len(points) + 1, np.int64)
            np.cumsum(1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF), out=width[1:])
            lo = width[at]
            hi = np.append(lo[1:], len(buf)) if len(lo) else lo
            ids, size = self.lookup(buf, lo, hi)
            total = np.zeros(len(at) + 1, np.int64)
            np.cumsum(size, out=total[1:])
            edge = total[np.searchsorted(at, np.append(end - chars, len(points)))]
            return ids, np.diff(edge)
        if len(texts) > 1:  # keep the plain ones on the fast way
            odd = [not self.fast(t, np.frombuffer(t.encode("utf-32-le"), np.uint32)) for t in texts]
            out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
            even = [i for i, o in enumerate(odd) if not o]
            ids, n = self.texts([texts[i] for i in even])
            for i, part in zip(even, np.split(ids, np.cumsum(n)[:-1]) if even else []):
                out[i] = part
            for i, o in enumerate(odd):
                if o:
                    out[i] = self.odd(texts[i])
            return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))
        ids = self.odd(texts[0])
        return ids, np.array([len(ids)])

    def in_parts(self, texts: list[str], limit: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
        """texts(), with very long ones taken in parts."""
        if all(len(t) <= limit for t in texts):
            return self.texts(texts)
        got = [[self.texts([x])[0] for x in long_parts(t, limit)] for t in texts]
        return np.concatenate([x for g in got for x in g]), np.array([sum(map(len, g)) for g in got], np.int64)

    def odd(self, text: str) -> np.ndarray:
        found = [m.encode() for m in self.pattern.findall(text)]
        buf = np.frombuffer(b"".join(found), np.uint8)
        size = np.fromiter(map(len, found), np.int64, len(found))
        hi = np.cumsum(size)
        return self.lookup(buf, hi - size, hi)[0]


def long_parts(text: str, limit: int = 1 << 21) -> list[str]:
    """A very long text cut before blanks where a match must start, so that memory stays bounded."""
    out, at = [], 0
    cut = regex.compile(r"(?<=[A-Za-z,.])(?= [A-Za-z])")
    while len(text) - at > limit:
        m = cut.search(text, at + limit)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]
