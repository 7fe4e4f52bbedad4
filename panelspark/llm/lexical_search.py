"""Ranked lexical search: best-first intervals of documents over range-maximum tables of posting lists.

Documents are indexed in segments of about SEGMENT bytes of text, each in the task that reads it. A
segment holds, for the terms asked for, the posting lists (document, frequency) in order of documents. A
search computes the impact of every posting and a sparse table a list: the place of the largest impact of
any range in two look-ups. An interval of documents is bounded by the sum, over the item's terms, of the
range maxima. The best intervals are taken first; the document of the largest impact of one is scored
exactly and splits it in two, whose bounds are computed in turn. An interval whose bound can't beat the
k-th best document found so far is dropped, so the answer is exact. The k-th best score is carried from
segment to segment of a task.

Per step the best intervals of an item are taken together, at first STEP, twice as many each time: more
than strictly needed, never fewer, so that numpy handles many at once.

Items are answered in blocks of BLOCK_TERMS terms, all documents read once a block; a block's terms are
what tasks are sent. No posting is shuffled: segments are rows of a written table, tasks send k rows an
item, and those meet in two rounds. The weights need two passes, one to count and one to search.

Edge cases: a null or empty text has no terms and isn't counted or found; items without terms, or whose
terms no document holds, have no rows; an item row is answered once, so repeated items repeat; repeated
documents are documents each; equal scores by doc_id, null last (2^63 - 1 counts as null); very long texts
are segments of their own; no documents or items give an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelspark.llm.storage import Scratch
from panelspark.llm.text import LOWER, column_bytes, distinct_spans, doc_words, pieces

#: Bytes of text in a segment of the index.
SEGMENT = 8 << 20
#: Terms of the items that are answered in one pass.
BLOCK_TERMS = 1 << 17
#: Items searched at once in a segment, and the intervals of each that are taken first.
TOGETHER, STEP = 32, 2
#: Length normalisation in hundredths: a document's m is 100 - B + B * n / mean.
B = 75
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_NONE = (1 << 63) - 1


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(_LOW))


INDEX = "n_docs long, n_terms long, docs array<long>, sizes array<long>, terms array<int>, counts array<long>, places array<int>, tfs array<long>"


def index(docs: DataFrame, terms: list[str]) -> DataFrame:
    """A row a segment: its documents in order of doc_id with their numbers of terms, and the posting lists of `terms`."""
    known = sorted(set(terms))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array([t.encode() for t in known], pa.large_binary())
        for b in pieces(it, "text", SEGMENT):
            ids = b.column(0).fill_null(_NONE).to_numpy()
            order = np.argsort(ids, kind="stable")
            buf, offsets = column_bytes(b.column(1).take(pa.array(order)))
            buf = LOWER[buf]
            starts, ends, before = doc_words(buf, offsets, _APART)
            codes, found = distinct_spans(buf, starts, ends)
            at = pc.index_in(found, value_set=wanted).fill_null(-1).to_numpy()
            term = at[codes] if len(codes) else np.zeros(0, np.int32)
            sizes = np.diff(before)
            doc = np.repeat(np.arange(b.num_rows), sizes)[term >= 0]
            keys, tf = np.unique(term[term >= 0].astype(np.int64) * b.num_rows + doc, return_counts=True)
            own, counts = np.unique(keys // b.num_rows, return_counts=True)
            columns = [pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())])]
            columns += [_list(x, kind) for x, kind in ((ids[order], pa.int64()), (sizes, pa.int64()), (own, pa.int32()), (counts, pa.int64()), (keys % b.num_rows, pa.int32()), (tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in INDEX.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, INDEX)


def _list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


class Segment:
    """The impacts of a segment's postings, and their range-maximum tables."""

    def __init__(self, docs: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, places: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.docs, self.size, self.local = docs, len(docs), np.full(len(weights), -1, np.int64)
        self.local[terms] = np.arange(len(terms))
        self.keys = np.repeat(np.arange(len(terms)), counts) * self.size + places
        if len(sizes) and B * int(sizes.max()) * n_docs >= 1 << 63:
            m = np.array([100 - B + B * int(n) * n_docs // n_terms for n in sizes], np.int64)
        else:
            m = 100 - B + B * sizes * n_docs // n_terms
        self.places = places
        self.impact = np.repeat(weights[terms], counts) * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[places]))
        # table[j][i]: the place of the largest of impact[i : i + 2**j]; ranges asked for lie within one list
        self.table = [np.arange(len(self.keys))]
        while 2 << (len(self.table) - 1) <= (int(counts.max()) if len(counts) else 0):
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            a, b = last[:-half], last[half:]
            self.table.append(np.where(self.impact[a] >= self.impact[b], a, b))
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in self.table])])
        self.flat = np.concatenate(self.table)

    def largest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of the largest impact in [a, b), for ranges that aren't empty."""
        level = np.frexp(b - a)[1] - 1  # floor of the logarithm
        x = self.flat[self.starts[level] + a]
        y = self.flat[self.starts[level] + b - (1 << level)]
        return np.where(self.impact[x] >= self.impact[y], x, y)


class Items:
    """Some items' terms within a segment: for item i, term[at[i] : at[i + 1]] with the times it's repeated."""

    def __init__(self, segment: Segment, items: list[dict[int, int]]):
        own = [[(segment.local[t], n) for t, n in i.items() if segment.local[t] >= 0] for i in items]
        self.segment, self.at = segment, np.concatenate([[0], np.cumsum([len(o) for o in own])])
        self.term = np.array([t for o in own for t, _ in o], np.int64)
        self.times = np.array([n for o in own for _, n in o], np.int64)

    def _pairs(self, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For intervals of items: of each pair (interval, term) the interval and the place of the term; the first pair of each interval."""
        n = self.at[item + 1] - self.at[item]
        first = np.cumsum(n) - n
        of = np.repeat(np.arange(len(item)), n)
        return of, np.arange(len(of)) - first[of] + self.at[item][of], first

    def bounds(self, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum of range maxima of each interval [low, high) of documents, and the document of the largest."""
        s = self.segment
        if not len(item):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        of, pair, first = self._pairs(item)
        base = self.term[pair] * s.size
        a, b = np.searchsorted(s.keys, base + low[of]), np.searchsorted(s.keys, base + high[of])
        some = np.flatnonzero(b > a)
        top = s.largest(a[some], b[some])
        value = np.zeros(len(of), np.int64)
        value[some] = s.impact[top] * self.times[pair[some]]
        most = np.maximum.reduceat(value, first)
        is_most = np.flatnonzero(value[some] == most[of[some]])
        split = low.copy()
        split[of[some][is_most]] = s.places[top[is_most]]
        return np.add.reduceat(value, first), split

    def scores(self, item: np.ndarray, doc: np.ndarray) -> np.ndarray:
        s = self.segment
        of, pair, first = self._pairs(item)
        key = self.term[pair] * s.size + doc[of]
        at = np.minimum(np.searchsorted(s.keys, key), len(s.keys) - 1)
        return np.add.reduceat(np.where(s.keys[at] == key, s.impact[at] * self.times[pair], 0), first)


class Best:
    """The k best documents of each of some items so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.least, self.last = np.ones(n, np.int64), np.full(n, _NONE)  # the score to reach; with that score, the doc_id not to exceed

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        good = score > 0
        item, score, doc = (np.concatenate([x, y[good]]) for x, y in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kept = rank < self.k
        self.item, self.score, self.doc = item[kept], score[kept], doc[kept]
        full = np.flatnonzero(rank == self.k - 1)
        self.least[item[full]], self.last[item[full]] = score[full], doc[full]


def search_segment(segment: Segment, items: list[dict[int, int]], begin: int, best: Best) -> int:
    """Adds what a segment has for items begin, begin + 1, ... to the best; how many documents were scored."""
    own = Items(segment, items)
    item = np.flatnonzero(np.diff(own.at))
    low, high = np.zeros(len(item), np.int64), np.full(len(item), segment.size)
    bound, split = own.bounds(item, low, high)
    step, scored = STEP, 0
    while len(item):
        ask = item + begin
        alive = (bound > best.least[ask]) | ((bound == best.least[ask]) & (segment.docs[low] <= best.last[ask]))
        item, low, high, bound, split = (x[alive] for x in (item, low, high, bound, split))
        order = np.lexsort((-bound, item))
        first = np.searchsorted(item[order], item[order])
        taken = np.arange(len(order)) - first < step
        now, later = order[taken], order[~taken]
        if len(now):
            best.add(item[now] + begin, own.scores(item[now], split[now]), segment.docs[split[now]])
            scored += len(now)
        parts = [(item[now], low[now], split[now]), (item[now], split[now] + 1, high[now])]
        i, lo, hi = (np.concatenate([p[j] for p in parts]) for j in range(3))
        i, lo, hi = (x[lo < hi] for x in (i, lo, hi))
        b, s = own.bounds(i, lo, hi)
        item, low, high, bound, split = (np.concatenate([x[later], y]) for x, y in ((item, i), (low, lo), (high, hi), (bound, b), (split, s)))
        step *= 2
    return scored


def _blocks(items: DataFrame) -> Iterator[tuple[list, list[dict[str, int]]]]:
    """Ids and terms of items, in blocks of bounded size; the driver holds one."""
    ids: list = []
    terms: list[dict[str, int]] = []
    held = 0
    for r in items.select("item_id", "text").toLocalIterator():
        ids.append(r["item_id"])
        terms.append(Counter(terms_of(r["text"])))
        held += len(terms[-1]) + 1
        if held >= BLOCK_TERMS:
            yield ids, terms
            ids, terms, held = [], [], 0
    if ids:
        yield ids, terms


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, with a score above 0."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    id_type = items.schema["item_id"].dataType
    kind = id_type.simpleString()
    hits = spark.createDataFrame([], f"block int, item int, item_id {kind}, doc_id long, score long, part int")
    for number, (ids, asked) in enumerate(_blocks(items)):
        known = sorted({t for a in asked for t in a})
        code = {t: i for i, t in enumerate(known)}
        own = scratch.keep(index(docs, known), "segments")
        n_docs, n_terms = (int(x or 0) for x in own.agg(F.sum("n_docs"), F.sum("n_terms")).first())
        weights = np.zeros(len(known), np.int64)
        for r in own.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df")).collect():  # a row a term of the block
            weights[r["terms"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
        coded = [{code[t]: n for t, n in a.items()} for a in asked]

        def run(it: Iterator[pa.RecordBatch], ids=ids, coded=coded, weights=weights, n_docs=n_docs, n_terms=n_terms) -> Iterator[pa.RecordBatch]:
            best = Best(len(coded), k)
            for b in it:
                for i in range(b.num_rows):
                    row = [b.column(j)[i].values.to_numpy(zero_copy_only=False) for j in range(6)]
                    if not len(row[2]):
                        continue
                    segment = Segment(*row, weights, n_docs, n_terms)
                    for begin in range(0, len(coded), TOGETHER):
                        search_segment(segment, coded[begin : begin + TOGETHER], begin, best)
            doc = pa.array(best.doc, pa.int64(), mask=best.doc == _NONE)
            yield pa.RecordBatch.from_arrays([pa.array(best.item, pa.int32()), pa.array([ids[i] for i in best.item], to_arrow_type(id_type)), doc, pa.array(best.score, pa.int64())], names=["item", "item_id", "doc_id", "score"])

        found = own.select("docs", "sizes", "terms", "counts", "places", "tfs").mapInArrow(run, f"item int, item_id {kind}, doc_id long, score long")
        found = found.select(F.lit(number).alias("block"), "*", F.pmod(F.spark_partition_id(), F.lit(256)).alias("part"))
        hits = hits.unionByName(scratch.keep(found, "hits"))
        scratch.drop("segments")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # many tasks have k rows an item each: first the best of 256 parts, then of these
    best = hits.withColumn("n", F.row_number().over(Window.partitionBy("block", "item", "part").orderBy(*order))).where(F.col("n") <= k)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("block", "item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
