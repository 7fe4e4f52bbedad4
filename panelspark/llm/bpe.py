"""Byte-level BPE: merges compiled into a lazily determinised transducer, and a streaming decoder.

Encoding. A sequence of vocabulary entries is what merging by rank yields exactly if each two
neighbours stay apart when merged on their own. So encoding is a nondeterministic transducer:
a configuration is (place in the trie of the entry being read, last entry written, output not yet
agreed on). Sets of configurations become states of a deterministic machine, built on first use;
a transition writes the output that all configurations share. An entry has at most as many bytes as
the longest one, so a token leaves after bounded lookahead.

Decoding. The bytes of a document's tokens go through an incremental UTF-8 machine, PORTION at a time,
whatever the document's length; digests are of the text that it gives, not of the bytes.

Edge cases: null and empty texts have no ids. Very long texts are encoded whole, a piece at a time;
repeated rows are encoded each; an empty table gives an empty result. Other columns pass through unchanged;
one with the name of a result is refused.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.pretokens import Memo
from panelspark.llm.text import gather, pieces

#: Bytes that the UTF-8 machine is fed at once.
PORTION = 1 << 14


class Transducer:
    """Maps bytes to ids by ranks. States are built when first reached, at most `most` of them are kept."""

    def __init__(self, ranks: dict[bytes, int], most: int = 50_000):
        self.ranks, self.most = ranks, most
        self.entry = {i: t for t, i in ranks.items()}
        self.next: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for text, rank in ranks.items():
            node = 0
            for byte in text:
                child = self.next[node].get(byte)
                if child is None:
                    child = self.next[node][byte] = len(self.next)
                    self.next.append({})
                    self.token.append(-1)
                node = child
            self.token[node] = rank
        self.apart: dict[tuple[int, int], bool] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [((0, -1, ()),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def merged(self, text: bytes) -> list[int]:
        """Merging by rank, for a short text: the definition that the machine is compiled from."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int]:
        """The two entries whose merge gives this one."""
        known = self.split.get(token)
        if known is None:
            text = self.entry[token]
            parts = [text[i : i + 1] for i in range(len(text))]
            while len(parts) > 2:
                _, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = self.split[token] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return known

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether a then b is what merging yields for their bytes: go back in time, undoing the later
        merge of the two at the boundary, and see if the neighbours there would have merged first."""
        known = self.apart.get((a, b))
        if known is not None:
            return known
        entry, ranks = self.entry, self.ranks
        x, y, x_until, y_until = a, b, 1 << 60, 1 << 60
        known = True
        while True:
            rank = ranks.get(entry[x] + entry[y])
            if rank is not None and rank < x_until and rank <= y_until:
                known = False
                break
            x_whole, y_whole = len(entry[x]) > 1, len(entry[y]) > 1
            if x_whole and (not y_whole or x > y):
                x_until, x = x, self.halves(x)[1]
            elif y_whole:
                y_until, y = y, self.halves(y)[0]
            else:
                break
        self.apart[a, b] = known
        return known

    def move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        found, done = [], None
        follow, tokens, apart = self.next, self.token, self.apart
        for node, last, rest in self.states[state]:
            child = follow[node].get(byte)
            if child is None:
                continue
            if done is None and (token := tokens[child]) >= 0:  # one configuration at most ends here
                known = last < 0 or apart.get((last, token))
                if known is None:
                    known = self.stay_apart(last, token)
                if known:
                    done = (0, token, (*rest, token))
            if follow[child]:
                found.append((child, last, rest))
        if done is not None:
            found.append(done)
        if not found:
            raise ValueError(f"no entry of the vocabulary covers byte {byte}")
        first = found[0][2]
        shared = len(first)
        for _, _, rest in found[1:]:
            if rest[:shared] != first[:shared]:
                shared = next((i for i, (x, y) in enumerate(zip(first, rest)) if x != y), min(shared, len(rest)))
        key = tuple(found) if not shared else tuple([(n, last, rest[shared:]) for n, last, rest in found])
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        out = self.moves[state << 8 | byte] = (to, first[:shared])
        return out

    def encode(self, text: bytes) -> list[int]:
        if len(self.states) > self.most:
            self.reset()
        if len(self.apart) > 6 * self.most:
            self.apart.clear()
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in text:
            step = moves.get(state << 8 | byte)
            if step is None:
                step = self.move(state, byte)
            state = step[0]
            if step[1]:
                out += step[1]
        for node, _, rest in self.states[state]:
            if node == 0:
                out += rest
                break
        return out

    def encode_pieces(self, texts: list[bytes]) -> list[list[int]]:
        return [self.encode(t) for t in texts]


class Utf8:
    """An incremental UTF-8 state machine: feed bytes in any portions, get text as soon as it is complete.

    State: continuation bytes still due and the allowed range of the next one. Bytes that can't
    go on give U+FFFD, as in "replace" decoding of maximal subparts.
    """

    def __init__(self) -> None:
        self.due, self.low, self.high, self.held = 0, 0x80, 0xBF, b""

    def feed(self, data: bytes) -> str:
        """The text of what is complete. Between characters, whole ones are taken at once; the rest goes byte by byte."""
        out: list[str] = []
        at = 0
        while at < len(data):
            if not self.due:
                try:
                    return "".join(out) + data[at:].decode()
                except UnicodeDecodeError as e:
                    out.append(data[at : at + e.start].decode())
                    at += e.start
            out.append(self._step(data[at]))
            at += 1
            while self.due and at < len(data):
                out.append(self._step(data[at]))
                at += 1
        return "".join(out)

    def _step(self, byte: int) -> str:
        lost = ""
        if self.due:
            if self.low <= byte <= self.high:
                self.held += bytes((byte,))
                self.due -= 1
                self.low, self.high = 0x80, 0xBF
                whole, self.held = (self.held.decode(), b"") if not self.due else ("", self.held)
                return whole
            lost = "�"
            self.due, self.low, self.high, self.held = 0, 0x80, 0xBF, b""
        if byte < 0x80:
            return lost + chr(byte)
        if not 0xC2 <= byte <= 0xF4:
            return lost + "�"
        self.due = 1 + (byte >= 0xE0) + (byte >= 0xF0)
        self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
        self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
        self.held = bytes((byte,))
        return lost

    def end(self) -> str:
        out = "�" if self.due else ""
        self.__init__()
        return out


def streamed(data: bytes | memoryview) -> Iterator[str]:
    """The text of some bytes through the machine, PORTION bytes at a time."""
    machine = Utf8()
    for at in range(0, len(data), PORTION):
        yield machine.feed(bytes(data[at : at + PORTION]))
    yield machine.end()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def _memo(path: str, pattern: str) -> Memo:
    return Memo(Transducer(read_ranks(path)).encode_pieces, pattern)


@lru_cache(maxsize=2)
def _entries(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ranks = read_ranks(path)
    top = max(ranks.values()) + 1
    by = [b""] * top
    for t, i in ranks.items():
        by[i] = t
    size = np.fromiter(map(len, by), np.int64, top)
    return np.frombuffer(b"".join(by), np.uint8), np.cumsum(size) - size, size


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str, column: str, out: str) -> Iterator[pa.RecordBatch]:
    memo = _memo(path, pattern)
    for batch in pieces(batches, column):
        texts = [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
        ids, n = memo.in_parts(texts)
        edge = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(ids.view(np.int32)))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])


def decode_batches(batches: Iterator[pa.RecordBatch], path: str, column: str, out: str, raw: str | None = None) -> Iterator[pa.RecordBatch]:
    flat, at, size = _entries(path)
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index(column))
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        n = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        if len(ids) and not (0 <= ids.min() and ids.max() < len(size)):
            raise ValueError("an id is outside the vocabulary")
        data = gather(flat, at[ids], size[ids]).tobytes()
        edge = np.concatenate([[0], np.cumsum(size[ids])])[np.concatenate([[0], np.cumsum(n)])].tolist()
        whole = [data[a:b] for a, b in zip(edge, edge[1:])]
        arrays, names = list(batch.columns), list(batch.schema.names)
        if raw:
            arrays, names = [*arrays, pa.array(whole, pa.binary())], [*names, raw]
        if out:
            arrays, names = [*arrays, pa.array(["".join(streamed(w)) for w in whole], pa.string())], [*names, out]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of each text. A row with a column named `out` already is refused."""
    if out in docs.columns:
        raise ValueError(f"{out} is a column already")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(lambda it: encode_batches(it, path, pattern, column, out), schema)


def decode(docs: DataFrame, path: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of each list of ids; a null list gives an empty text, invalid UTF-8 gives U+FFFD."""
    if out in docs.columns:
        raise ValueError(f"{out} is a column already")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())])
    return docs.mapInArrow(lambda it: decode_batches(it, path, column, out), schema)


def round_trip(docs: DataFrame, path: str, pattern: str, column: str = "text", out: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encode() and decode() in one pass through one Python worker: adds the ids and the text decoded from them."""
    if {out, decoded} & set(docs.columns):
        raise ValueError(f"{out} or {decoded} is a column already")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    return docs.mapInArrow(lambda it: decode_batches(encode_batches(it, path, pattern, column, out), path, out, decoded), schema)


def _digest(texts: Iterator[str]) -> str:
    h = hashlib.sha256()
    for t in texts:
        h.update(t.encode())
    return h.hexdigest()


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: count and SHA-256 of its ids, SHA-256 (in UTF-8) of the text that the machine gives from their bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = encode_batches(it, path, pattern, "text", "ids")
        for b in decode_batches(encoded, path, "ids", "", raw="raw"):
            lists = b.column(b.schema.get_field_index("ids"))
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            edge = (np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()).astype(np.int64))]) * 4).tolist()
            raw = b.column(b.schema.get_field_index("raw"))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(b.schema.get_field_index("doc_id")),
                    pa.array(np.diff(edge) // 4, pa.int64()),
                    pa.array([hashlib.sha256(ids[x:y]).hexdigest() for x, y in zip(edge, edge[1:])], pa.string()),
                    pa.array([_digest(streamed(memoryview(x.as_buffer()))) for x in raw], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
