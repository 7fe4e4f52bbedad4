"""Language identification by mixture inference: the proportions of languages in each document.

A model holds, for each language, how often a byte follows two others within words (ASCII letters in
lower case and bytes of other characters, with an edge mark on both sides), counted over every
labelled document. A word's likelihood in a language is the product over its trigrams, hashed to BUCKETS
places. A document is a mixture of languages whose words are drawn independently: expectation
maximisation finds the proportions that make its words likeliest. Languages are taken into a document's
set one by one, in order of their proportions in the mixture of all, while the likelihood, less PENALTY
* ln(words) for each language, goes up; proportions are estimated again for each set. The prediction is
the set's largest language, its proportion the score.

Counting is one pass with sums by language and bucket, which are what the driver collects: at most
MAX_LANGUAGES (those with the most words) x 2 * BUCKETS numbers. Predicting is one narrow pass; documents
are worked on in batches, by their distinct words.

Edge cases: a null text, or one without a letter, is `und` with score 0; documents with a null lang or a
null text teach nothing; with nothing to learn from, every prediction is `und`; equal proportions go to
the language that is first by code point; a text whose words are all alike likely in each language has a
set of one; repeated rows teach and are predicted each; very long texts are whole; other columns pass
through, but those with the names of the results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.storage import Scratch
from panelspark.llm.text import LOWER, column_bytes, distinct_spans, doc_words, mix, pieces

#: Places of trigrams, and of the pairs of bytes they begin with.
BUCKETS = 1 << 16
MAX_LANGUAGES = 128
#: Weight of the uniform distribution over bytes in a trigram's estimate.
SMOOTH = 4.0
STEPS, PENALTY = 30, 1.0
UNKNOWN = "und"
_APART = np.ones(256, bool)
_APART[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_EDGE, _LETTER = 32, "_has_letter"


def held_out(doc_id: Column | None = None) -> Column:
    return F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string").cast("binary")) % 4 == 2


def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all trigrams of some words, edges included: the place of each, the place of its first two bytes; and where each word's begin."""
    flat, offsets = column_bytes(words)
    n = np.diff(offsets)
    at = np.arange(len(flat)) + 2 * np.repeat(np.arange(len(n)), n) + 1
    framed = np.full(len(flat) + 2 * len(n), _EDGE, np.uint64)
    framed[at] = flat
    begin = offsets[:-1] + 2 * np.arange(len(n))
    # the last two places of a word's frame begin no trigram of it
    first = np.ones(len(framed), bool)
    first[begin + n], first[begin + n + 1] = False, False
    i = np.flatnonzero(first)
    pair = framed[i] * np.uint64(256) + framed[i + 1] if len(i) else np.zeros(0, np.uint64)
    triple = pair * np.uint64(256) + framed[i + 2] if len(i) else pair
    return (mix(triple + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64), pair.astype(np.int64), begin - 2 * np.arange(len(n))


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of some documents by their place among the distinct ones, these, and the words before each document."""
    buf = LOWER[buf]
    starts, ends, before = doc_words(buf, offsets, _APART)
    codes, found = distinct_spans(buf, starts, ends)
    return codes.astype(np.int64), found, before


@dataclass
class Model:
    """Languages in order; log counts of trigrams by place and of pairs of bytes, both smoothed, places x languages."""

    languages: list[str]
    triples: np.ndarray
    pairs: np.ndarray

    def word_logs(self, words: pa.Array) -> np.ndarray:
        """Log likelihood of each word in each language."""
        place, pair, begin = grams(words)
        if not len(begin):
            return np.zeros((0, len(self.languages)))
        return np.add.reduceat(self.triples[place] - self.pairs[pair], begin)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts over all rows with a language."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, n in sums.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], names=["lang", "place", "n"])
            sums.clear()

        for b in pieces(it, "text"):
            names = b.column(0).dictionary_encode()
            codes, found, before = _words(*column_bytes(b.column(1)))
            if not len(codes):
                continue
            place, pair, begin = grams(found)
            size = np.diff(np.append(begin, len(place)))
            doc_lang = np.repeat(names.indices.to_numpy(), np.diff(before)).astype(np.int64)
            for i, name in enumerate(names.dictionary.to_pylist()):
                times = np.repeat(np.bincount(codes[doc_lang == i], minlength=len(found)), size)
                n = sums.setdefault(name, np.zeros(BUCKETS + 65536, np.int64))
                n[:BUCKETS] += np.bincount(place, times, BUCKETS).astype(np.int64)
                n[BUCKETS:] += np.bincount(pair, times, 65536).astype(np.int64)
            if len(sums) > 64:
                yield from flush()
        yield from flush()

    known = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    scratch = Scratch(docs.sparkSession)
    counts = scratch.keep(known.mapInArrow(run, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("lang").agg(F.sum(F.when(F.col("place") < BUCKETS, F.col("n"))).alias("n"))
    names = sorted(r["lang"] for r in totals.orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect())
    table = np.zeros((BUCKETS + 65536, len(names)))
    at = {x: i for i, x in enumerate(names)}
    for r in counts.where(F.col("lang").isin(names)).collect():  # bounded by MAX_LANGUAGES
        table[r["place"], at[r["lang"]]] = r["n"]
    scratch.drop("grams")
    return Model(names, np.log(table[:BUCKETS] + SMOOTH / 256).astype(np.float32), np.log(table[BUCKETS:] + SMOOTH).astype(np.float32))


def proportions(p: np.ndarray, times: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation maximisation: each document's proportions of its allowed languages, and its log likelihood.

    p: words x languages, times: how often, first: each document's first word (one at least). A document
    whose proportions don't move any more is set aside, so its result doesn't depend on its neighbours.
    """
    theta = allowed / allowed.sum(1, keepdims=True)
    docs, size = np.arange(len(first)), np.diff(np.append(first, len(p)))
    all_p, all_times, all_size = p, times, size
    for _ in range(STEPS):
        if not len(docs):
            break
        first = np.cumsum(size) - size
        r = p * np.repeat(theta[docs], size, axis=0)
        r *= (times / r.sum(1))[:, None]
        new = np.add.reduceat(r, first)
        new /= new.sum(1, keepdims=True)
        moved = np.abs(new - theta[docs]).max(1) > 1e-6
        theta[docs] = new
        if not moved.all():
            rows = np.repeat(moved, size)
            p, times, docs, size = p[rows], times[rows], docs[moved], size[moved]
    total = (all_p * np.repeat(theta, all_size, axis=0)).sum(1)
    return theta, np.add.reduceat(all_times * np.log(total), np.cumsum(all_size) - all_size)


def language_sets(logs: np.ndarray, times: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Proportions of the languages in each document's set; zero for the others. logs: words x languages."""
    p = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -600))
    n = len(first)
    size = np.diff(np.append(first, len(p)))
    whole, _ = proportions(p, times, first, np.ones((n, p.shape[1])))
    order = np.argsort(-whole, axis=1, kind="stable")
    cost = PENALTY * np.log(np.maximum(np.add.reduceat(times, first), 2))
    allowed = np.zeros((n, p.shape[1]))
    allowed[np.arange(n), order[:, 0]] = 1
    theta = allowed.copy()
    best = np.add.reduceat(times * np.log(p[np.arange(len(p)), np.repeat(order[:, 0], size)]), first)
    active = np.arange(n)
    for k in range(1, p.shape[1]):
        allowed[active, order[active, k]] = 1
        rows = np.isin(np.repeat(np.arange(n), size), active)
        own = size[active]
        new, log = proportions(p[rows], times[rows], np.cumsum(own) - own, allowed[active])
        better = log - cost[active] > best[active]
        best[active[better]] = log[better] - cost[active[better]]
        theta[active[better]] = new[better]
        active = active[better]
        if not len(active):
            break
    return theta


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score, and the languages of each text with their proportions (lang_set, lang_shares)."""
    own = docs.drop("lang_pred", "score", "lang_set", "lang_shares")
    results = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_set", T.ArrayType(T.StringType())), T.StructField("lang_shares", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*own.schema.fields, *results])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(it, text):
            theta = np.zeros((b.num_rows, len(model.languages)))
            codes, found, before = _words(*column_bytes(b.column(b.schema.get_field_index(text))))
            if len(codes) and model.languages:
                keys, times = np.unique(np.repeat(np.arange(b.num_rows), np.diff(before)) * len(found) + codes, return_counts=True)
                doc, word = keys // len(found), keys % len(found)
                own, first = np.unique(doc, return_index=True)
                theta[own] = language_sets(model.word_logs(found)[word], times, first)
            letters = b.column(b.schema.get_field_index(_LETTER)).to_numpy(zero_copy_only=False)
            theta[~letters.astype(bool)] = 0
            rows = [sorted(((-t[i], i) for i in np.flatnonzero(t))) for t in theta]
            names = [[model.languages[i] for _, i in r] for r in rows]
            shares = [[-float(x) for x, _ in r] for r in rows]
            columns = [c for c, f in zip(b.columns, b.schema.names) if f != _LETTER]
            columns += [pa.array([x[0] if x else UNKNOWN for x in names], pa.string()), pa.array([min(x[0], 1.0) if x else 0.0 for x in shares], pa.float64()), pa.array(names, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    # a letter by its Unicode class, which the JVM knows
    return own.withColumn(_LETTER, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, schema)
