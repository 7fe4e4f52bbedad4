"""Token-id shards compressed by Re-Pair grammars, with random access to each document.

Documents are range-partitioned by doc_id and sorted; a partition is a shard, written in blocks of
bounded size, which bounds the memory of a task whatever the shard's. In a block, frequent pairs of
neighbouring symbols are replaced by nonterminals, round after round, until no pair is frequent; a
pair never spans two documents. A block stores its rules with the length that each expands to, the
symbols, where each document starts among them, and the number of ids of each document, so that one
document, or a span of it, is decoded alone. Blocks are rows of a Parquet table: Spark commits them
whole or not at all.

Edge cases: a null or empty text has the end id alone; of rows with one doc_id the text breaks the
tie; repeated rows are written each; an empty table gives an empty file set. Texts that hold the
vocabulary's special strings are encoded as the library does by default; a very long text is encoded in
parts. A null doc_id comes first. Columns other than doc_id and text aren't read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm.pretokens import Memo
from panelspark.llm.text import gather, pieces

#: Ids of a block, about.
BLOCK_IDS = 1 << 20
#: Uses from which a pair is replaced.
LEAST_USES = 8
FILE_SCHEMA = "shard int, block int, docs array<long>, lengths binary, starts binary, rules binary, sizes binary, symbols binary, terminals int, n_ids long"


class _LibraryMemo(Memo):
    def __init__(self, path: str, pattern: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        batch = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        super().__init__(lambda found: [e.ids for e in batch([f.decode() for f in found], add_special_tokens=False)], pattern)
        self.specials = tuple(t.content for t in self.library.get_added_tokens_decoder().values())

    def odd(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def _memo(path: str, pattern: str) -> _LibraryMemo:
    return _LibraryMemo(path, pattern)


def compress(ids: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray | int]:
    """A Re-Pair grammar of ids; lengths: ids of each document.

    A round replaces every pair with at least LEAST_USES uses, the more frequent ones first where two
    overlap, until no such pair is left. After the first round only pairs with a new symbol, or
    frequent before, can be frequent, so only their places are visited; symbols stay where they are,
    linked to their neighbours, until the last round.
    """
    n = len(ids)
    symbols = ids.astype(np.int64)
    terminals = int(symbols.max()) + 1 if n else 0
    ends = np.zeros(n, bool)
    ends[np.cumsum(lengths)[lengths > 0] - 1] = True
    following, preceding = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    alive, visit = np.ones(n, bool), np.zeros(n, bool)
    rules: list[np.ndarray] = []
    top = terminals
    at = np.flatnonzero(~ends)
    while len(at):
        pair = (symbols[at] << 32) | symbols[following[at]]
        found = np.sort(pair)
        edge = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        uses = np.diff(np.append(edge, len(found)))
        found, uses = found[edge[uses >= LEAST_USES]], uses[uses >= LEAST_USES]
        if not len(found):
            break
        none = len(found)
        rank = np.empty(none, np.int32)
        rank[np.lexsort((found, -uses))] = np.arange(none)
        place = pd.Index(found).get_indexer(pair)
        match = np.flatnonzero(place >= 0)
        at, mine = at[match], rank[place[match]]
        joined = at[1:] == following[at[:-1]]
        before, after = np.full((2, len(at)), none, np.int32)
        np.copyto(before[1:], mine[:-1], where=joined)
        np.copyto(after[:-1], mine[1:], where=joined)
        # of a run of one pair (a a a a) every second place
        number = np.arange(len(at), dtype=np.int32)
        inside = number - np.maximum.accumulate(np.where(mine != before, number, 0))
        win = (inside % 2 == 0) & ((inside > 0) | (mine < before)) & (mine <= after)
        win = np.flatnonzero(win)
        wins, name = at[win], mine[win]
        real = np.bincount(name, minlength=none)
        kept = np.flatnonzero(real >= 2)
        order = np.full(none, -1, np.int32)
        order[kept] = np.arange(len(kept))
        name = order[name]
        if len(kept) < none:
            win = np.flatnonzero(name >= 0)
            wins, name = wins[win], name[win]
        if not len(wins):
            break
        gone = following[wins]
        symbols[wins] = top + name
        ends[wins] = ends[gone]
        alive[gone] = False
        following[wins] = following[gone]
        preceding[following[wins]] = wins
        by_rank = np.empty(none, np.int64)
        by_rank[rank] = found
        rules.append(np.stack([by_rank[kept] >> 32, by_rank[kept] & 0xFFFFFFFF], 1))
        top += len(kept)
        left = preceding[wins]
        visit[at] = visit[wins] = visit[left[left >= 0]] = True
        visit[gone] = False
        at = np.flatnonzero(visit)
        visit[at] = False
        at = at[~ends[at]]
    symbols, ends = symbols[alive], ends[alive]
    stops = np.flatnonzero(ends) + 1
    starts = np.zeros(len(lengths) + 1, np.int64)
    starts[1:][lengths > 0] = stops
    starts = np.maximum.accumulate(starts)
    rules_ = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return {"terminals": terminals, "rules": rules_, "sizes": expansions(terminals, rules_)[2][terminals:], "symbols": symbols, "starts": starts}


def expansions(terminals: int, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of every symbol, end to end, with each one's place and length."""
    size = np.ones(terminals + len(rules), np.int64)
    at = np.arange(terminals + len(rules), dtype=np.int64)
    flat = [np.arange(terminals, dtype=np.uint32)]
    done, used = terminals, terminals
    while done < len(size):
        # rules whose sides are known already: those of one round
        todo = rules[done - terminals :]
        known = (todo < done).all(1)
        n = len(todo) if known.all() else int(np.argmin(known))
        table = np.concatenate(flat)
        flat = [table]
        side = todo[:n].ravel()
        lengths = size[side]
        flat.append(gather(table, at[side], lengths))
        own = lengths.reshape(-1, 2).sum(1)
        size[done : done + n] = own
        at[done : done + n] = used + np.cumsum(own) - own
        used += int(own.sum())
        done += n
    return np.concatenate(flat), at, size


def expand(terminals: int, rules: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    flat, at, size = expansions(terminals, rules)
    return gather(flat, at[symbols], size[symbols])


def _blocks(batches: Iterator[pa.RecordBatch], path: str, pattern: str, end_id: int, column: str) -> Iterator[pa.RecordBatch]:
    memo, shard, block = _memo(path, pattern), TaskContext.get().partitionId(), 0
    docs: list = []
    ids: list[np.ndarray] = []
    lengths: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        n, whole = np.concatenate(lengths), np.concatenate(ids)
        g = compress(whole, n)
        row = {
            "shard": [shard],
            "block": [block],
            "docs": [docs],
            "lengths": [n.astype("<i4").tobytes()],
            "starts": [g["starts"].astype("<i4").tobytes()],
            "rules": [g["rules"].astype("<i4").tobytes()],
            "sizes": [g["sizes"].astype("<i4").tobytes()],
            "symbols": [g["symbols"].astype("<i4").tobytes()],
            "terminals": [g["terminals"]],
            "n_ids": [len(whole)],
        }
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 5, pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds)], names=list(row))

    for batch in pieces(batches, column):
        got, n = memo.in_parts([t or "" for t in batch.column(1).to_pylist()])
        ends = np.cumsum(n)
        ids.append(np.insert(got, ends, end_id))
        lengths.append(n + 1)
        docs += batch.column(0).to_pylist()
        if sum(map(len, ids)) >= BLOCK_IDS:
            yield flush()
            block += 1
            docs, ids, lengths = [], [], []
    if docs:
        yield flush()


def write(docs: DataFrame, target: str, path: str, pattern: str, end_id: int, column: str = "text") -> None:
    """Writes the ids of all texts, each followed by end_id, in order of doc_id, to the folder `target`."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", column).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", column)
    ordered.mapInArrow(lambda it: _blocks(it, path, pattern, end_id, column), FILE_SCHEMA).write.parquet(target)


def read(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, decoded from the files."""
    files = spark.read.schema(FILE_SCHEMA).parquet(target)
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("all_ids"))  # a row a shard
    bases = shards.select("shard", F.coalesce(F.sum("all_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    places = files.select("shard", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("before"))
    places = places.join(bases, "shard").select("shard", "block", (F.col("base") + F.col("before")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row).astype("<u4")
                n = np.frombuffer(row["lengths"], "<i4").astype(np.int64)
                edge = np.concatenate([[0], np.cumsum(n)])
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge.tolist(), edge[1:].tolist())]
                k = len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, row["shard"]), pa.int32()), pa.array(np.full(k, row["block"]), pa.int32()), pa.array(row["docs"], pa.int64()), pa.array(edge[:-1], pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    names=["shard", "block", "doc_id", "offset", "n_tokens", "ids_crc32"],
                )

    rows = files.mapInArrow(run, "shard int, block int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return rows.join(places, ["shard", "block"]).select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def decode_block(row: dict, doc: int | None = None, begin: int = 0, end: int | None = None) -> np.ndarray:
    """The ids of a block, or the ids begin..end of its doc-th document alone.

    For a document only the symbols that the stored expansion lengths place in the span are expanded, by
    the rules that they need.
    """
    rules = np.frombuffer(row["rules"], "<i4").reshape(-1, 2).astype(np.int64)
    symbols = np.frombuffer(row["symbols"], "<i4").astype(np.int64)
    terminals = row["terminals"]
    if doc is None:
        return expand(terminals, rules, symbols)
    starts = np.frombuffer(row["starts"], "<i4")
    symbols = symbols[starts[doc] : starts[doc + 1]]
    sizes = np.concatenate([np.ones(terminals, np.int64), np.frombuffer(row["sizes"], "<i4")])
    upto = np.cumsum(sizes[symbols])
    end = int(upto[-1]) if end is None and len(upto) else min(end or 0, int(upto[-1]) if len(upto) else 0)
    if begin >= end:
        return np.zeros(0, np.uint32)
    a, b = int(np.searchsorted(upto, begin, "right")), int(np.searchsorted(upto, end, "left")) + 1
    skipped = int(upto[a] - sizes[symbols[a]])
    symbols = symbols[a:b]
    while (high := symbols >= terminals).any():
        sides = np.repeat(symbols, 1 + high)
        at = np.cumsum(1 + high)[high]
        sides[at - 2], sides[at - 1] = rules[symbols[high] - terminals].T
        symbols = sides
    return symbols[begin - skipped : end - skipped].astype(np.uint32)
