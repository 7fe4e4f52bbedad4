"""Centroid clustering of integer vectors with a LAESA pivot table.

The distances of every vector to PIVOTS fixed pivots are computed once and written beside the vector.
In each round, only centroids are compared with the pivots: by the triangle inequality the largest
difference of two stored distances bounds a vector's distance to a centroid from below. The centroid of
the least bound gets its exact distance, and then every centroid whose bound doesn't exceed the best
distance so far; ties go to the smaller number. Bounds are doubles with a margin for their rounding,
distances are exact integers, so no bound decides a result.

Each task sums its vectors by cluster; rounds exchange one row for a cluster, dimension and task, and
the driver gets clusters x dimensions numbers. No vector is shuffled or sorted, so a vector that many
rows share is work like any other. The pivots are chosen greedily, each the farthest from those before,
from the SAMPLE kept vectors that follow the first centroids by hash: they decide the cost, not the rows.

Edge cases: vectors that are null, of another length, or with a null or non-finite component aren't kept
and have no row; fewer kept vectors than clusters give as many clusters; repeated rows count and are
returned each, in the first choice ordered by their components; a null vec_id comes last in the first
choice and is clustered like others; no kept vector gives an empty result; other columns aren't read. A
distance or sum over 2^63 - 1 is given as that; component sums are exact below 10^38, an error above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.storage import Scratch

PIVOTS = 8
#: Vectors that pivots are chosen from: a bound, the choice changes the cost alone.
SAMPLE = 256
#: Components up to this have distances of 64 dimensions within 64 bits; larger ones use Python's integers.
SMALL = 1 << 27
_MOST = (1 << 63) - 1


def kept(vectors: DataFrame, vector: str, dims: int, scale: float) -> DataFrame:
    """Whole vectors of the wanted length as floor(scale * x), as integral doubles in a column `v`."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where((F.size(vector) == dims) & whole).withColumn("v", F.transform(vector, lambda x: _floor(F.lit(float(scale)) * x.cast("double"))))


def _floor(y: Column) -> Column:
    """The largest integer up to y, as a double: y - y % 1 is exact, and has no 64-bit range."""
    return y - y % 1.0 - F.when(y % 1.0 < 0, 1.0).otherwise(0.0)


def _exact(v: np.ndarray) -> np.ndarray:
    """Integral doubles as integers: of 64 bits where squares of differences fit, else Python's."""
    if not v.size or np.abs(v).max() <= SMALL:
        return v.astype(np.int64)
    return np.array([int(x) for x in v.ravel()], object).reshape(v.shape)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    if a.dtype == object or b.dtype == object:
        a, b = a.astype(object), b.astype(object)
    d = a - b
    return (d * d).sum(-1)


def _roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Each the vector with the largest sum of distances to those before; fewer if no vector is away from all."""
    if not len(sample):
        return sample
    total = _roots(squared(sample, sample[:1]))
    chosen: list[int] = []
    while len(chosen) < n and total.max() > 0:
        at = int(total.argmax())
        chosen.append(at)
        total = total + _roots(squared(sample, sample[at]))
        total[chosen] = 0
    return sample[chosen or [0]]


def bounds(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squares of lower bounds of the distance of each row to each centre; both have distances to the same pivots."""
    apart = np.zeros((len(rows), len(centres)))
    for p in range(rows.shape[1]):
        gap = np.abs(rows[:, p, None] - centres[None, :, p]) - 1e-9 * (rows[:, p, None] + centres[None, :, p])
        np.maximum(apart, gap, out=apart)
    return apart * apart * (1 - 1e-9)


def nearest(v: np.ndarray, low: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centre of each row and its squared distance (ties: the smaller number), and how many were computed."""
    first = low.argmin(1)
    best, which, computed = squared(v, centres[first]), first.copy(), len(v)
    for c in range(len(centres)):
        rows = np.flatnonzero((first != c) & (low[:, c] <= best.astype(np.float64)))
        d = squared(v[rows], centres[c])
        better = (d < best[rows]) | ((d == best[rows]) & (c < which[rows]))
        best[rows[better]], which[rows[better]] = d[better], c
        computed += len(rows)
    return which, best, computed


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64, salt: str = "1:", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each kept vector."""
    scratch = Scratch(vectors.sparkSession)
    own = kept(vectors.select(key, vector), vector, dims, scale).select(key, "v")
    order = F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256).asc_nulls_last()
    head = own.select("v").orderBy(order, "v").limit(k + SAMPLE).collect()  # a bounded number of vectors
    start = _exact(np.array([r["v"] for r in head], float).reshape(-1, dims))
    centres = start[:k]
    pivots = choose_pivots(start[k:] if len(start) > k else start, PIVOTS)
    width = len(pivots)

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            v = _exact(_matrix(b.column(1), dims))
            far = np.stack([_roots(squared(v, p)) for p in pivots], 1) if b.num_rows else np.zeros((0, width))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * width), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=[key, "v", "far"])

    id_type = own.schema[key].dataType.simpleString()
    table = scratch.keep(own.mapInArrow(measure, f"{key} {id_type}, v array<double>, far array<double>") if width else own.withColumn("far", F.array().cast("array<double>")), "pivots")

    def found(b: pa.RecordBatch, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = _exact(_matrix(b.column(b.schema.get_field_index("v")), dims))
        away = np.stack([_roots(squared(centres, p)) for p in pivots], 1)
        which, best, _ = nearest(v, bounds(_matrix(b.column(b.schema.get_field_index("far")), width), away), centres)
        return v, which, best

    for _ in range(rounds):

        def sums(it: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(len(centres), np.int64), np.zeros((len(centres), dims), object)
            for b in it:
                if b.num_rows:
                    v, which, _ = found(b, centres)
                    n += np.bincount(which, minlength=len(centres))
                    for c in np.unique(which):
                        total[c] += v[which == c].sum(0).astype(object)
            full = np.flatnonzero(n)
            c, d = np.repeat(full, dims), np.tile(np.arange(dims), len(full))
            amounts = pa.array([int(x) for x in total[full].ravel()], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(np.repeat(n[full], dims)), amounts], names=["cluster", "dim", "n", "total"])

        part = table.mapInArrow(sums, "cluster int, dim int, n long, total decimal(38,0)")
        centres = centres.astype(object)
        for r in part.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # k * dims rows
            centres[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
        centres = _exact(centres.astype(np.float64)) if centres.size and max(abs(int(x)) for x in centres.ravel()) <= SMALL else centres

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                _, which, best = found(b, centres)
                least = pa.array([min(int(x), _MOST) for x in best] if best.dtype == object else best, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(which, pa.int32()), least], names=[key, "cluster", "distance"])

    done = scratch.keep(table.mapInArrow(assign, f"{key} {id_type}, cluster int, distance long"), "assigned")
    scratch.drop("pivots")
    by = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part")).collect()  # k rows
    inertia = min(sum(int(r["part"]) for r in by), _MOST)
    parts = {r["cluster"]: min(int(r["part"]), _MOST) for r in by}
    names = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centres]
    at = lambda values, kind: F.get(F.array(*[F.lit(x).cast(kind) for x in values]) if values else F.array().cast(f"array<{kind}>"), F.col("cluster"))
    return done.select(key, "cluster", "distance", at([parts.get(c) for c in range(len(names))], "long").alias("cluster_inertia"), F.lit(inertia).cast("long").alias("inertia"), at(names, "string").alias("centroid_sha256"))
