"""Quality classifier: gated attention over the passages of a document.

Each passage of PASSAGE words is encoded from its bytes and words alone (shares of byte classes,
word lengths, repetition). The encoder's output h feeds gated attention, a = softmax(w (tanh(V h) *
sigmoid(U h))), learnt from document labels; the score is a logistic function of the weighted sum of
the passages. So a document with a few bad passages can be told by them.

The model is fitted on at most MAX_TRAIN labelled documents, those with the smallest hash of doc_id,
and at most MAX_PASSAGES passages of each, evenly spaced: a bounded sample, whatever the table's size,
and all that is collected. Scores use every passage of every text.

Edge cases: null, empty and blank texts are one passage without words and get a score like others;
labels with a null quality or without a document teach nothing; of several labels of a doc_id the
smaller, of several texts of one the first in order is learnt from; with no usable label every score is
0.5; repeated rows are scored each; an empty table gives an empty result; other columns pass through, but
one with the name of the score's is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.text import column_bytes, doc_words, mix, pieces, span_hash

PASSAGE = 64
MAX_TRAIN, MAX_PASSAGES = 4000, 64
HIDDEN, GATE = 24, 12
EPOCHS, RATE, DECAY = 250, 0.02, 1e-4


def _classes() -> np.ndarray:
    """A class for each byte: lower case, upper case, digits, high bytes, controls; other bytes their own."""
    kind = np.full(256, 4, np.int64)
    kind[128:] = 3
    nxt = 5
    for b in range(32, 127):
        c = chr(b)
        if c.islower():
            kind[b] = 0
        elif c.isupper():
            kind[b] = 1
        elif c.isdigit():
            kind[b] = 2
        else:
            kind[b] = nxt
            nxt += 1
    kind[10] = nxt
    return kind


_KIND = _classes()
_KINDS = int(_KIND.max()) + 1
FEATURES = _KINDS + 8


def passages(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, and the first passage of each document (and their number, last)."""
    starts, ends, docs = doc_words(buf, offsets)
    n_words = np.diff(docs)
    count = np.maximum(-(-n_words // PASSAGE), 1)
    first = np.concatenate([[0], np.cumsum(count)])
    total = int(first[-1])
    doc = np.repeat(np.arange(len(n_words)), n_words)
    nth = np.arange(len(starts)) - docs[:-1][doc]
    passage = first[:-1][doc] + nth // PASSAGE
    # a passage's bytes run from its first word (a document's first passage: from its first byte) to the next passage
    begin = np.zeros(total + 1, np.int64)
    begin[first] = offsets
    inner = (nth % PASSAGE == 0) & (nth > 0)
    begin[passage[inner]] = starts[inner]
    sizes = np.diff(begin)
    shares = np.bincount(np.repeat(np.arange(total), sizes) * _KINDS + _KIND[buf], minlength=total * _KINDS).reshape(total, _KINDS)
    x = np.zeros((total, FEATURES), np.float32)
    x[:, :_KINDS] = np.log1p(100 * shares / np.maximum(sizes, 1)[:, None]) / 3
    words = np.bincount(passage, minlength=total)
    some = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(passage, weights=length, minlength=total) / some
    spread = np.sqrt(np.maximum(np.bincount(passage, weights=length * length, minlength=total) / some - mean * mean, 0))
    hashes = span_hash(buf, starts, ends)
    _, at = np.unique(mix(hashes ^ (passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)
    distinct = np.bincount(passage[at], minlength=total) / some
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    longest = np.zeros(total)
    np.maximum.at(longest, passage, length)
    rest = (np.log1p(mean), np.log1p(spread), distinct, np.bincount(passage[again], minlength=total) / some, np.log1p(words) / 4, np.log1p(longest) / 4, words == 0, np.log1p(n_words)[np.repeat(np.arange(len(count)), count)] / 8)
    for i, v in enumerate(rest):
        x[:, _KINDS + i] = v
    return x, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Attention:
    """Parameters, forward pass and gradients of the gated attention model."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p = {
            "W": r.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)),
            "b": np.zeros(HIDDEN),
            "V": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "U": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "w": r.normal(0, GATE**-0.5, GATE),
            "c": np.zeros(HIDDEN),
            "d": np.zeros(1),
        }
        self.shift, self.scale = np.zeros(FEATURES), np.ones(FEATURES)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, at = self.p, first[:-1]
        x = (x - self.shift) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        n = np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), n))
        a = e / np.repeat(np.add.reduceat(e, at), n)
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["d"])}

    def gradients(self, f: dict[str, np.ndarray], first: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, at, n = self.p, first[:-1], np.diff(first)
        dl = (f["y"] - labels) / len(labels)
        dz = dl[:, None] * p["c"]
        dz_each = np.repeat(dz, n, axis=0)
        da = (dz_each * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, at), n))
        dg = de[:, None] * p["w"]
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        dh = f["a"][:, None] * dz_each + dt @ p["V"].T + ds @ p["U"].T
        du = dh * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ du, "b": du.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ dl, "d": dl.sum(keepdims=True)}

    def fit(self, x: np.ndarray, first: np.ndarray, labels: np.ndarray) -> Attention:
        self.shift, self.scale = x.mean(0), x.std(0) + 1e-3
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, EPOCHS + 1):
            g = self.gradients(self.forward(x, first), first, labels)
            for k, grad in g.items():
                grad = grad + DECAY * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                self.p[k] = self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)["y"]


def held_out(doc_id=None):
    return F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Attention | None:
    """Learns from labelled rows that aren't held out; None if both labels don't occur."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null").where(~held_out())
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # `most` rows at most
    texts = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def some(x: np.ndarray) -> bytes:
        return x[np.unique(np.linspace(0, len(x) - 1, min(len(x), MAX_PASSAGES)).round().astype(int))].astype(np.float32).tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(it, "text"):
            x, first = passages(*column_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([some(x[i:j]) for i, j in zip(first, first[1:])], pa.binary())], names=["doc_id", "quality", "x"])

    rows = sorted(texts.select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, x binary").collect(), key=lambda r: (r["doc_id"], r["quality"], r["x"]))
    y = np.array([r["quality"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return None
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in rows]
    return Attention().fit(np.concatenate(bags).astype(float), np.concatenate([[0], np.cumsum([len(b) for b in bags])]), y)


def score(docs: DataFrame, model: Attention | None, column: str = "text", out: str = "score") -> DataFrame:
    """docs with a column `out`: how likely label 1 is; a column of that name is replaced."""
    texts = docs.drop(out)
    schema = T.StructType([*texts.schema.fields, T.StructField(out, T.DoubleType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(it, column):
            x, first = passages(*column_bytes(b.column(b.schema.get_field_index(column))))
            y = np.full(b.num_rows, 0.5) if model is None else model.scores(x, first)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(y, pa.float64())], names=[*b.schema.names, out])

    return texts.mapInArrow(run, schema)
