"""Substring dedup by fixed-block anchors.

A window of WINDOW words holds a whole block of (WINDOW + 1) // 2 words that starts at a multiple of
that length in its document. Such non-overlapping blocks are the reference index; every rolling
window of the same length probes it. Where a probe meets a block that also stands elsewhere, the
windows of WINDOW words around it are compared with each other, and all words that repeated
windows cover go: these are the maximal exact repeats.

How it runs: documents are dealt over chunks by a hash of doc_id, once; all passes over texts read
that exchange. A chunk sends each distinct hash once, packed, to the part that its first bits name,
and gets back a bitmap; so a passage in a third of all documents costs a part one entry a chunk.
Anchors are compared by the part and 32 bits more, which only adds candidates; windows are equal if
96 bits of hash are.

Edge cases: a null or empty text has no words; documents of fewer than WINDOW words lose none;
repeated rows are copies of each other and lose all windows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.text import column_bytes, doc_words, gather, span_hash, window_hash

WINDOW = 35
#: Bytes of text of a chunk; larger in large tables, so that a chunk still sends each part enough at once.
CHUNK_BYTES, LARGEST_CHUNK = 4 << 20, 64 << 20
MOST_PARTS = 1 << 17

_SENT = "part int, chunk int, n int, first binary, second binary, many binary, anchor binary"
_BACK = "chunk int, kind int, part int, n int, bits binary"


class _Chunk:
    """The words of a chunk with their hashes."""

    def __init__(self, table: pa.Table, column: str, window: int):
        self.buf, self.offsets = column_bytes(table.column(column))
        self.starts, self.ends, self.docs = doc_words(self.buf, self.offsets)
        self.window, self.block = window, (window + 1) // 2
        n = np.diff(self.docs)
        self.doc_start, self.doc_end = np.repeat(self.docs[:-1], n), np.repeat(self.docs[1:], n)
        self.words = span_hash(self.buf, self.starts, self.ends)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where probes start; distinct hashes; each probe's hash among them; which come more than once here; which are blocks."""
        k = self.block
        hashes = window_hash(self.words, k)
        at = np.flatnonzero(np.arange(len(hashes)) + k <= self.doc_end[: len(hashes)])
        found, which, count = np.unique(hashes[at], return_inverse=True, return_counts=True)
        anchor = np.zeros(len(found), bool)
        anchor[which[(at - self.doc_start[at]) % k == 0]] = True
        return at, found, which, count > 1, anchor

    def candidates(self, at: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows that hold a hit: their starts; distinct hashes (two columns); each window's hash among them; which come more than once."""
        w = self.window
        n = max(len(self.words) - w + 1, 0)
        hits = np.zeros(len(self.words) + 1, np.int64)
        hits[at[hit] + 1] = 1
        np.cumsum(hits, out=hits)
        p = np.arange(n)
        p = p[(p + w <= self.doc_end[:n]) & (hits[p + w - self.block + 1] > hits[p])]
        first = window_hash(self.words, w)[p] if len(p) else np.zeros(0, np.uint64)
        if len(p):
            other = span_hash(self.buf, self.starts, self.ends, 1)
            second = (window_hash(other, w, 1)[p] >> np.uint64(32)).astype(np.uint32)
        else:
            second = np.zeros(0, np.uint32)
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        group = np.cumsum(new) - 1
        which = np.empty(len(a), np.int64)
        which[order] = group
        return p, a[new], b[new], which, np.bincount(group, minlength=int(new.sum())) > 1


def _slices(sorted_hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part = (sorted_hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(sorted_hashes), np.int64)
    parts, begin = np.unique(part, return_index=True)
    return parts, begin, np.append(begin[1:], len(part))


def _rows(columns: dict[str, list], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table([pa.array(columns[name], kind) for name, kind in schema], names=[name for name, _ in schema])


_SENT_KINDS = [("part", pa.int32()), ("chunk", pa.int32()), ("n", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("many", pa.binary()), ("anchor", pa.binary())]
_BACK_KINDS = [("chunk", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("bits", pa.binary())]


def _send(chunk: int, found: np.ndarray, bits: int, first: np.ndarray, second: np.ndarray | None, many: np.ndarray, anchor: np.ndarray | None) -> pa.Table:
    out: dict[str, list] = {name: [] for name, _ in _SENT_KINDS}
    for part, a, b in zip(*(x.tolist() for x in _slices(found, bits))):
        row = (part, chunk, b - a, first[a:b].tobytes(), None if second is None else second[a:b].tobytes(), np.packbits(many[a:b]).tobytes(), None if anchor is None else np.packbits(anchor[a:b]).tobytes())
        for name, value in zip(out, row):
            out[name].append(value)
    return _rows(out, _SENT_KINDS)


def _bits(rows: list, counts: list[int]) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(r, np.uint8), count=n) for r, n in zip(rows, counts)]).astype(bool)


def _answer(table: pa.Table, kind: int) -> pa.Table:
    """For each entry of a part: whether its hash stands more than once in all (and, of anchors, is a block somewhere)."""
    got = table.to_pydict()
    counts = got["n"]
    many = _bits(got["many"], counts)
    if kind == 0:
        keys = np.frombuffer(b"".join(got["first"]), np.uint32)
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
    else:
        a, b = np.frombuffer(b"".join(got["first"]), np.uint64), np.frombuffer(b"".join(got["second"]), np.uint32)
        order = np.lexsort((b, a))
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=1 + many[order])
    fine = total > 1
    if kind == 0:
        fine &= np.bincount(group, weights=_bits(got["anchor"], counts)[order]) > 0
    hit = np.empty(len(order), bool)
    hit[order] = fine[group]
    edge = np.cumsum([0, *counts]).tolist()
    rows = [(c, kind, p, n, np.packbits(hit[x:y]).tobytes()) for c, p, n, x, y in zip(got["chunk"], got["part"], counts, edge, edge[1:]) if hit[x:y].any()]
    return _rows({name: [r[i] for r in rows] for i, (name, _) in enumerate(_BACK_KINDS)}, _BACK_KINDS)


def _received(back: pa.Table, kind: int, found: np.ndarray, bits: int) -> np.ndarray:
    """The answers for the distinct hashes of a chunk."""
    hit = np.zeros(len(found), bool)
    rows = back.to_pydict()
    answers = {p: (n, b) for k, p, n, b in zip(rows["kind"], rows["part"], rows["n"], rows["bits"]) if k == kind}
    if answers:
        for part, a, b in zip(*(x.tolist() for x in _slices(found, bits))):
            if part in answers:
                n, raw = answers[part]
                hit[a:b] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)
    return hit


def substring_dedup(docs: DataFrame, column: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words that stay, joined by one blank."""
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    size = min(max(CHUNK_BYTES, total // 2000), LARGEST_CHUNK)
    chunks = max(total // size, 1)
    bits = min(max(total // CHUNK_BYTES, 16), MOST_PARTS).bit_length()
    texts = docs.select("doc_id", F.col(column).alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk"))

    def probe(key: tuple, table: pa.Table) -> pa.Table:
        _, found, _, many, anchor = _Chunk(table, "text", window).anchors()
        short = (found << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
        return _send(key[0].as_py(), found, bits, short, None, many, anchor)

    def extend(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        chunk = _Chunk(table, "text", window)
        at, found, which, _, _ = chunk.anchors()
        _, first, second, _, many = chunk.candidates(at, _received(back, 0, found, bits)[which])
        return _send(key[0].as_py(), first, bits, first, second, many, None)

    def cut(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        chunk = _Chunk(table, "text", window)
        at, found, which, _, _ = chunk.anchors()
        p, first, _, whose, _ = chunk.candidates(at, _received(back, 0, found, bits)[which])
        p = p[_received(back, 1, first, bits)[whose]]
        depth = np.bincount(p, minlength=len(chunk.words) + 1) - np.bincount(p + window, minlength=len(chunk.words) + 1)[: len(chunk.words) + 1] if len(p) else np.zeros(len(chunk.words) + 1, np.int64)
        stays = np.cumsum(depth)[: len(chunk.words)] == 0
        kept_before = np.concatenate([[0], np.cumsum(stays)])[chunk.docs]
        lengths = (chunk.ends - chunk.starts)[stays]
        out = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
        stop = np.cumsum(lengths + 1)
        out[gather(np.arange(len(out)), stop - lengths - 1, lengths)] = gather(chunk.buf, chunk.starts[stays], lengths)
        edge = np.concatenate([[0], stop])[kept_before].tolist()
        raw = out.tobytes()
        kept = [raw[a : max(a, b - 1)].decode() for a, b in zip(edge, edge[1:])]
        n = np.diff(chunk.docs)
        return pa.table([table.column("doc_id").combine_chunks(), pa.array(n, pa.int64()), pa.array(n - np.diff(kept_before), pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    by_chunk = texts.groupBy("chunk")
    anchors = by_chunk.applyInArrow(probe, _SENT).groupBy("part").applyInArrow(lambda t: _answer(t, 0), _BACK)
    windows = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(_skip_absent(extend, _SENT_KINDS), _SENT).groupBy("part").applyInArrow(lambda t: _answer(t, 1), _BACK)
    kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]
    return by_chunk.cogroup(anchors.unionByName(windows).groupBy("chunk")).applyInArrow(_skip_absent(cut, kinds), "doc_id long, n_words long, n_removed long, kept string")


def _skip_absent(f, kinds: list[tuple[str, pa.DataType]]):
    def run(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        return f(key, table, back) if table.num_rows else _rows({name: [] for name, _ in kinds}, kinds)

    return run
