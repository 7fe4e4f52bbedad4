"""N-gram Jaccard join: count-vector R-trees over tiles of documents that can be alike.

A document is the set of its word shingles, as 64-bit hashes; equal sets form one class, and only
class representatives are compared. Shingles are hashed into groups, the counts per group are a
point; two points bound the overlap of their sets by the sum of coordinate minima. Points of a tile
are bulk-loaded into an R-tree whose nodes keep the largest count of each coordinate and the range of
sizes: a search descends only where the bound reaches the overlap that the threshold asks for, and
what is left is verified on the sets.

Which documents share a tile. An R-tree over all documents would be one index that every task needs;
two filters that lose no link come first.

1. A set of n shingles of which u stand in no other set overlaps none in more than n - u, so it is linked
   only if n - u >= t n. Shingles of a fixed share of hash space are counted; sets that this rules out go.
2. Among what is left, shingles are put in order of their exact frequency, rarest first. Two linked
   sets share one of their first n - ceil(t n) + 1 shingles; sets that share one are joined in a graph.

Components of that graph are tiles. One that weighs more than TILE is cut into leaves in order of size, as
an R-tree packs its leaves: first each leaf is searched by itself, together with one document of the component.
What links leave outside the component's largest part is then searched against every
leaf whose bounding box (range of sizes, largest count of each group) can hold a partner. A tile
keeps links that span its connected documents, never all pairs.

Edge cases: texts without words have the empty set and are linked with nothing; texts with fewer
words than a shingle have one shingle, the whole sequence; repeated rows are of one class, rows with one
doc_id and different texts are compared by their own texts; a row with a null doc_id gets a size, and
the component of a row with an id and the same set, else null; an empty table gives an empty result; columns
other than doc_id and text aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.components import components
from panelspark.llm.storage import Scratch
from panelspark.llm.text import LOWER, column_bytes, doc_words, mix, pieces, sorted_set, span_hash, window_hash

#: Groups of a bounding box between tiles; trees inside tiles take more for larger sets.
GROUPS = 64
LEAF, FANOUT = 16, 16
#: The weight of a tile; a document weighs 1, and 1 more for each so many shingles.
TILE, HEAVY = 256, 2000
_CLASS = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text, A-Z lower-cased, as hashes."""
    buf, at = column_bytes(column)
    buf = LOWER[buf]
    starts, ends, docs = doc_words(buf, at)
    hashes = span_hash(buf, starts, ends)
    runs = window_hash(hashes, k)
    out = []
    for a, b in zip(docs.tolist(), docs[1:].tolist()):
        if b - a >= k:
            out.append(sorted_set(runs[a : b - k + 1]))
        else:
            out.append(window_hash(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def identity(found: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    return tuple(int(np.add.reduce(mix(found ^ x)).astype(np.int64)) if len(found) else 0 for x in (np.uint64(0), _CLASS))


def _long(values: list[np.ndarray]) -> pa.Array:
    return pa.array((np.concatenate(values) if values else np.zeros(0, np.uint64)).view(np.int64), pa.int64())


def _describe(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The size and identity of each document's set."""
    for batch in pieces(batches, "text"):
        sets = shingle_sets(batch.column(1), k)
        marks = [identity(s) for s in sets]
        arrays = [pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n", "p", "q"])


def counted_share(percent: int) -> float:
    """The share of hash space whose shingles are counted: somewhat more than what a set that is ruled out needs."""
    return min(1.0, 1.3 * (100 - percent) / 100 + 0.03)


def _sample_tokens(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The counted shingles of each class of a batch, with the class's first mark."""
    most = np.uint64(int(counted_share(percent) * ((1 << 32) - 1)))
    for batch in pieces(batches, "text", 4 << 20):
        own = {identity(s)[0]: s for s in shingle_sets(batch.column(0), k) if len(s)}
        # the low half: the high bits choose a shingle's group
        left = [s[(s & np.uint64(0xFFFFFFFF)) <= most] for s in own.values()]
        mark = np.repeat(np.array(list(own), np.int64), [len(s) for s in left])
        yield pa.RecordBatch.from_arrays([_long(left), pa.array(mark, pa.int64())], names=["token", "mark"])


def _same_class(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The rows whose text has the set that their class names: others have the same doc_id only."""
    for batch in pieces(batches, "text"):
        marks = batch.column(batch.schema.get_field_index("p")).to_pylist(), batch.column(batch.schema.get_field_index("q")).to_pylist()
        keep = [identity(s) == (p, q) for s, p, q in zip(shingle_sets(batch.column(batch.schema.get_field_index("text")), k), *marks)]
        yield batch.select(["node", "n", "text"]).filter(pa.array(keep, pa.bool_()))


def _tokens(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each node."""
    for batch in pieces(batches, "text", 4 << 20):
        sets = shingle_sets(batch.column(1), k)
        nodes = np.repeat(batch.column(0).to_numpy(), [len(s) for s in sets])
        yield pa.RecordBatch.from_arrays([_long(sets), pa.array(nodes, pa.int64())], names=["token", "node"])


def group_counts(found: np.ndarray, groups: int) -> np.ndarray:
    """The point of a set: how many of its shingles each group has; groups is a power of two."""
    shift = np.uint64(64 - int(groups).bit_length() + 1)
    return np.bincount((found >> shift).astype(np.int64), minlength=groups).astype(np.int32)


def _points(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        points = [group_counts(s, GROUPS) for s in shingle_sets(batch.column(1), k)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(points, pa.list_(pa.int32()))], names=["node", "point"])


class RTree:
    """Bulk-loaded over count vectors: leaves of LEAF points sorted by size, then by their fullest groups."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.counts, self.sizes = counts, sizes
        slabs = np.argsort(sizes, kind="stable")
        step = LEAF * FANOUT
        order = [s[np.lexsort(counts[s][:, :8].T)] for s in (slabs[i : i + step] for i in range(0, len(slabs), step))]
        self.order = np.concatenate(order) if order else slabs
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        top, low, high, width = counts[self.order], sizes[self.order], sizes[self.order], LEAF
        while len(top) > 1 or not self.levels:
            at = np.arange(0, len(top), width)
            top, low, high = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))
            width = FANOUT
            if len(top) == 1:
                break

    def search(self, count: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Points whose bound allows `percent` of the union."""

        def fits(top: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            bound = np.minimum(top, count).sum(1)
            # overlap >= p / (100 + p) * (a + b), and sizes within the ratio
            return (bound * (100 + percent) >= percent * (size + low)) & (100 * low <= size * 100 * 100 // percent) & (100 * high >= percent * size)

        nodes = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            nodes = nodes[nodes < len(top)]
            nodes = nodes[fits(top[nodes], low[nodes], high[nodes])]
            width = LEAF if depth == 0 else FANOUT
            nodes = (nodes[:, None] * width + np.arange(width)).ravel()
        points = self.order[nodes[nodes < len(self.order)]]
        return points[fits(self.counts[points], self.sizes[points], self.sizes[points])]


def links(sets: list[np.ndarray], percent: int, left: np.ndarray | None = None, parts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all sets which links connect. left: with it, only pairs of a left and another one
    count. parts: sets with the same number are known to be connected."""
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if parts is not None:
        first: dict[int, int] = {}
        for i, part in enumerate(parts.tolist()):
            parent[i] = first.setdefault(part, i)
    sizes = np.array([len(s) for s in sets], np.int64)
    out: list[tuple[int, int]] = []

    def verify(a: int, b: int) -> None:
        x, y = root(a), root(b)
        if x != y:
            both = _overlap(sets[a], sets[b]) if sizes[a] <= sizes[b] else _overlap(sets[b], sets[a])
            if 100 * both >= percent * (sizes[a] + sizes[b] - both):
                parent[max(x, y)] = min(x, y)
                out.append((a, b))

    if len(sets) == 2:
        verify(0, 1)
        return out
    groups = 1 << int(np.clip(int(sizes.mean()) // 4, GROUPS, 1024) - 1).bit_length()
    counts = np.stack([group_counts(s, groups) for s in sets])
    base = np.arange(len(sets)) if left is None else np.flatnonzero(~left)
    if not len(base):
        return out
    tree = RTree(counts[base], sizes[base])
    for a in range(len(sets)) if left is None else np.flatnonzero(left):
        found = base[tree.search(counts[a], int(sizes[a]), percent)]
        for b in found[found < a] if left is None else found:
            verify(int(a), int(b))
    return out


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _clusters(table: pa.Table, k: int) -> Iterator[tuple]:
    """For each cluster of a tile: its rows (one a node) and their sets."""
    sets = shingle_sets(table.column("text"), k)
    for _, own in table.drop_columns(["text"]).to_pandas().groupby("cluster", sort=False):
        own = own.sort_values(["node", "side"]).drop_duplicates("node")
        yield own, [sets[r] for r in own.index]


def _inside(table: pa.Table, k: int, percent: int) -> pa.Table:
    """node, cluster, part: the smallest node that links connect it with inside the tile, or the cluster's leader if that is one."""
    nodes, clusters, parts = [], [], []
    for own, sets in _clusters(table, k):
        ids = own["node"].to_numpy()
        part = np.arange(len(ids))
        for a, b in links(sets, percent):
            x, y = part[a], part[b]
            part[part == max(x, y)] = min(x, y)
        leader = int(own["lead"].iloc[0])
        at = np.flatnonzero(ids == leader)
        name = ids[part]
        if len(at):
            name = np.where(part == part[at[0]], leader, name)
        nodes.append(ids)
        parts.append(name)
        clusters.append(own["cluster"].to_numpy())
    return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in (nodes, clusters, parts)], names=["node", "cluster", "part"])


def _between(table: pa.Table, k: int, percent: int) -> pa.Table:
    """u, v: links between parts. side 2: of all pairs of the tile; else of those of a 0 and a 1."""
    ends: tuple[list, list] = ([], [])
    for own, sets in _clusters(table, k):
        part, side = own["part"].to_numpy(), own["side"].to_numpy()
        for a, b in links(sets, percent, None if side[0] == 2 else side == 0, part):
            ends[0].append(int(part[a]))
            ends[1].append(int(part[b]))
    return pa.table([pa.array(x, pa.int64()) for x in ends], names=["u", "v"])


def survivors(texts: DataFrame, classes: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """node, n, text of the classes that step 1 leaves, one row each."""
    tokens = texts.select("text").mapInArrow(lambda it: _sample_tokens(it, k, percent), "token long, mark long")
    alone = tokens.groupBy("token").agg(F.min("mark").alias("p"), F.max("mark").alias("other")).where("p = other")
    lone = scratch.keep(alone.groupBy("p").agg(F.count(F.lit(1)).alias("u")), "lone")
    left = classes.join(lone, "p", "left").where(F.lit(100) * (F.col("n") - F.coalesce("u", F.lit(0))) >= F.lit(percent) * F.col("n"))
    left = scratch.keep(left.select("node", "n", "p", "q", "doc"), "left")
    rows = texts.join(left.withColumnRenamed("doc", "doc_id"), "doc_id").select("node", "n", "p", "q", "text").mapInArrow(lambda it: _same_class(it, k), "node long, n long, text string")
    return scratch.keep(rows.dropDuplicates(["node"]), "survivors")


def candidates(rows: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Edges u, v of step 2: each node tied to the smallest one with the same early shingle."""
    tokens = rows.select("node", "text").mapInArrow(lambda it: _tokens(it, k), "token long, node long")
    frequent = scratch.keep(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "frequent")
    shared = tokens.join(frequent, "token").join(rows.select("node", "n"), "node")
    # of a node's shingles those without a partner come first, so only the others need a place
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "token"))
    shared = shared.withColumns({"place": place, "lone": F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("node"))})
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / F.lit(100)) + 1
    early = scratch.keep(shared.where(F.col("place") <= prefix - F.col("lone")).select("token", "node"), "early")
    lowest = scratch.keep(early.groupBy("token").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("df")).where("df > 1").select("token", "v"), "lowest-early")
    return scratch.keep(early.join(lowest, "token").where("node <> v").select(F.col("node").alias("u"), "v").distinct(), "candidates")


def leaves(rows: DataFrame) -> DataFrame:
    """rows (node, cluster, n, more) with `leaf`: each cluster in order of size, cut by weight. Its window holds one row a size of each cluster."""
    weight = F.col("n") / HEAVY + 1
    sizes = rows.groupBy("cluster", "n").agg(F.count(F.lit(1)).alias("same")).withColumn("all", F.col("same") * weight)
    before = F.coalesce(F.sum("all").over(Window.partitionBy("cluster").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = rows.join(sizes.withColumn("before", before), ["cluster", "n"])
    inside = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / float(1 << 30)
    return placed.withColumn("leaf", F.floor((F.col("before") + inside * F.col("all")) / TILE)).select(*rows.columns, "leaf")


def _boxes(rows: DataFrame, name: str) -> DataFrame:
    """A bounding box of each leaf (cluster, name): range of sizes, largest count of each group."""
    tops = [F.max(F.col("point")[i]) for i in range(GROUPS)]
    return rows.groupBy("cluster", name).agg(F.min("n").alias(f"low_{name}"), F.max("n").alias(f"high_{name}"), F.array(*tops).alias(f"top_{name}"))


def _can_meet(percent: int) -> Column:
    """Whether boxes a and b can hold a linked pair: sizes within the ratio, enough overlap by coordinate minima."""
    bound = F.aggregate(F.zip_with("top_a", "top_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    sizes = (F.lit(percent) * F.col("low_a") <= 100 * F.col("high_b")) & (F.lit(percent) * F.col("low_b") <= 100 * F.col("high_a"))
    return sizes & (bound * (100 + percent) >= F.lit(percent) * (F.col("low_a") + F.col("low_b")))


def connected(rows: DataFrame, clusters: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """node, component: the nodes that links connect share one. rows: node, n, text; clusters: node, component of candidates."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = scratch.keep(clusters.join(rows.select("node", "n"), "node").withColumnRenamed("component", "cluster"), "sized")
    weights = scratch.keep(sized.groupBy("cluster").agg(F.sum(F.col("n") / HEAVY + 1).alias("weight"), F.min("node").alias("lead")), "weights")
    whole = sized.join(weights, "cluster")
    small = whole.where(F.col("weight") <= TILE)
    light, heavy = weights.agg(F.sum(F.when(F.col("weight") <= TILE, F.col("weight"))), F.max("weight")).first()
    buckets = max(partitions, int((light or 0) // TILE))
    two = F.lit(2).alias("side")
    tiles = small.select("node", "cluster", F.pmod(F.xxhash64("cluster"), F.lit(buckets)).alias("tile"), two, F.lit(-1).cast("long").alias("lead"))
    if (heavy or 0) > TILE:
        large = scratch.keep(leaves(whole.where(F.col("weight") > TILE)), "large")
        own = large.select("node", "cluster", F.xxhash64("cluster", "leaf").alias("tile"), two, "lead")
        # the leader is in each leaf: parts of different leaves meet in it
        led = own.select("cluster", "tile", "lead").distinct().select(F.col("lead").alias("node"), "cluster", "tile", two, "lead")
        tiles = tiles.unionByName(own.where("node <> lead")).unionByName(led)

    def search(tiles: DataFrame, find, schema: str, name: str) -> DataFrame:
        dealt = rows.select("node", "text").join(tiles, "node")
        return scratch.keep(dealt.groupBy("tile").applyInArrow(lambda t: find(t, k, percent), schema), name)

    found = search(tiles, _inside, "node long, cluster long, part long", "inside")
    if (heavy or 0) <= TILE:
        return found.select("node", F.col("part").alias("component"))
    parts = scratch.keep(large.join(found.select("node", "part").distinct(), "node").select("node", "cluster", "n", "leaf", "part"), "parts")
    counted = parts.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("rows"))
    largest = counted.groupBy("cluster").agg(F.max(F.struct("rows", "part")).alias("most")).select("cluster", F.col("most.part").alias("most"))
    outside = scratch.keep(parts.join(largest, "cluster").where("part <> most").select("node", "cluster", "n", "part"), "outside")
    every = found.select("node", F.col("part").alias("component")).distinct()
    if outside.isEmpty():
        return every
    points = rows.select("node", "text").join(large.select("node"), "node", "left_semi").mapInArrow(lambda it: _points(it, k), "node long, point array<int>")
    right = scratch.keep(parts.join(points, "node").withColumnRenamed("leaf", "b"), "right")
    left = scratch.keep(leaves(outside).withColumnRenamed("leaf", "a").join(right.select("node", "point"), "node"), "left-out")
    pairs = scratch.keep(_boxes(left, "a").join(_boxes(right, "b"), "cluster").where(_can_meet(percent)).select("cluster", "a", "b"), "box-pairs")
    both = F.xxhash64("cluster", "a", "b")
    tiles = left.join(pairs, ["cluster", "a"]).select("node", "cluster", both.alias("tile"), F.lit(0).alias("side"), "part")
    tiles = tiles.unionByName(left.select("node", "cluster", F.xxhash64("cluster", "a", F.lit("itself")).alias("tile"), two, "part"))
    tiles = tiles.unionByName(right.join(pairs, ["cluster", "b"]).select("node", "cluster", both.alias("tile"), F.lit(1).alias("side"), "part"))
    across = search(tiles, _between, "u long, v long", "across")
    if across.isEmpty():
        return every
    joined = components(across).withColumnRenamed("node", "part").withColumnRenamed("component", "whole")
    return every.withColumnRenamed("component", "part").join(joined, "part", "left").select("node", F.coalesce("whole", "part").alias("component"))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included; of empty sets, itself)."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    described = scratch.keep(texts.mapInArrow(lambda it: _describe(it, k), "doc_id long, n long, p long, q long"), "described")
    classes = described.where("n > 0").groupBy("n", "p", "q").agg(F.min("doc_id").alias("doc"))
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    named = classes.where("doc IS NOT NULL")  # a class without an id can't be reached by one: it is its own component
    rows = survivors(texts.where("doc_id IS NOT NULL"), named, k, percent, scratch)
    edges = candidates(rows, k, percent, scratch)
    scratch.drop("lone", "left", "frequent", "early", "lowest-early")
    found = scratch.keep(connected(rows, components(edges), k, percent, scratch), "labels")
    scratch.drop(*(x for x in list(scratch.paths) if x not in ("described", "classes", "labels")))
    # written, so that Spark can split the rows of a large component in the join
    ids = scratch.keep(found.join(classes.select("node", "doc"), "node").groupBy("component").agg(F.min("doc").alias("component_id")), "ids")
    labelled = classes.join(found.join(ids, "component").select("node", "component_id"), "node", "left")
    labelled = scratch.keep(labelled.select("n", "p", "q", F.coalesce("component_id", "doc").alias("component_id")), "classes-labelled")
    scratch.drop("classes", "labels", "ids")
    full = described.where("n > 0").join(labelled, ["n", "p", "q"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(described.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
