"""Shards by sampled splitters: size-weighted key samples give quantile boundaries, records are
range-partitioned by them, and overfull ranges are subdivided.

The key is a hash of the text, then doc_id, so equal texts lie side by side. The sampled quantiles are
the shards' boundaries as long as each range between them measures at most OVERFULL of the mean. A range
that measures more is joined with its neighbours until their mean is within it (a key that several
boundaries fall on has its ranges joined from the start), and what is joined is subdivided by measured
sizes. Shards have near equal sizes, in law ``bytes``: within OVERFULL of the mean and one record.
A cut through a group of equal texts leaves its rows in two or more shards.

Edge cases: a null text counts as empty; repeated rows each get a slot of their own; an empty table
gives an empty result. Columns other than doc_id and the text's aren't read, whatever their names; only
those named below are returned. Very long texts count by their bytes and may fill ranges alone. Shards depend on the
rows alone, not on settings of the session, so that reruns agree.

Texts are read once. Keys, ranges and shards are written between the steps (a few numbers a row): joined in one plan, the
search for a row's range is a lambda that Spark may infer as a filter of the join's other side, where its key is missing.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.storage import materialise

RANGES_PER_SHARD = 16
#: Rows of a range on average: what one task sorts, without texts.
ROWS_PER_RANGE = 1_000_000
#: Samples of a shard: the standard deviation of a range is about one in 200 of its size.
SAMPLES_PER_SHARD = 40_000
OVERFULL = 1.02


def splitters(keyed: DataFrame, ranges: int, samples: int, seed: int = 7) -> list[int]:
    """ranges - 1 boundaries of `key`, from about `samples` draws that take rows in proportion to `size`.

    A row is drawn as often as its share says, the fraction by a hash of the row, and the quantiles of the sample
    are exact: the same on any rerun, whatever the order in which tasks end.
    """
    total = keyed.agg(F.sum("size")).first()[0]
    if not total:
        return []
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "key"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    copies = F.floor(F.col("size") * F.lit(samples / total) + draw).cast("long")
    drawn = keyed.select("key", copies.alias("copies")).where("copies > 0").groupBy("key").agg(F.sum("copies").alias("n"))
    # keys of the sample alone, `samples` and a few at most: one task may order them
    upto = F.sum("n").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    ordered = drawn.select("key", "n", upto.alias("upto"), F.sum("n").over(Window.partitionBy()).alias("all"))
    before, last = (F.floor(x * ranges / F.col("all")) for x in (F.col("upto") - F.col("n"), F.col("upto")))
    cut = ordered.select("key", (before + 1).alias("a"), F.least(last, F.lit(ranges - 1)).alias("b")).where("a <= b")
    return [r["key"] for r in cut.select("key", F.explode(F.sequence("a", "b")).alias("i")).orderBy("i").collect()]


def joined_shards(sizes: list[int], shared: list[bool]) -> list[tuple[int, int]]:
    """First shard and number of shards of each stretch that is subdivided as a whole; a stretch of one shard is a sampled range.

    sizes: measured bytes of each shard's range; shared: whether the boundary after it falls on a key that fills ranges on both sides.
    """
    mean = sum(sizes) / len(sizes)
    out: list[list] = []
    for i, size in enumerate(sizes):
        out.append([i, 1, size])
        if i and shared[i - 1]:
            _, n, more = out.pop()
            out[-1][1] += n
            out[-1][2] += more
    while True:
        over = [i for i, (_, n, size) in enumerate(out) if size > OVERFULL * mean * n]
        if not over or len(out) == 1:
            return [(first, n) for first, n, _ in out]
        i = over[0]
        # the lighter neighbour takes the surplus
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(out)]
        j = min(near, key=lambda j: out[j][2] / out[j][1])
        a, b = sorted((i, j))
        out[a] = [out[a][0], out[a][1] + out[b][1], out[a][2] + out[b][2]]
        del out[b]


def shard(docs: DataFrame, shards: int, column: str = "text", samples_per_shard: int = SAMPLES_PER_SHARD) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard)."""
    text = F.coalesce(F.col(column), F.lit(""))
    keyed = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 12).alias("key"),
    )
    keyed = materialise(keyed, "keys")
    rows = keyed.select("doc_id").count()
    per = max(RANGES_PER_SHARD, -(-rows // (shards * ROWS_PER_RANGE)))  # by the table, not by the session
    ranges = shards * per
    bounds = splitters(keyed, ranges, shards * samples_per_shard)
    counted = Counter(bounds)
    top = 1 << len(bounds).bit_length()
    table = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    steps = F.array(*[F.lit(top >> i) for i in range(1, top.bit_length())]) if top > 1 else F.array().cast("array<int>")
    below = F.aggregate(steps, F.lit(0), lambda at, s: at + F.when((at + s <= len(bounds)) & (F.get(table, at + s - 1) < F.col("key")), s).otherwise(0))
    placed = keyed.withColumn("below", below)
    if len(counted) < len(bounds):  # a key on several boundaries is dealt over all its ranges
        spread = F.get(F.array(*[F.lit(counted[b]) for b in bounds]), F.col("below"))
        equal = F.get(table, F.col("below")) == F.col("key")
        placed = placed.withColumn("range", F.when(equal & (spread > 1), F.col("below") + F.pmod(F.xxhash64("doc_id"), spread).cast("int")).otherwise(F.col("below")))
    else:
        placed = placed.withColumnRenamed("below", "range")
    placed = materialise(placed.select("range", "key", "doc_id", "size", "text_crc32"), "ranges")
    # exact sums of the ranges: `ranges` rows at most
    sums = placed.groupBy("range").agg(F.sum("size").alias("range_size"), F.count(F.lit(1)).alias("range_rows"))
    measured = {r["at"]: r["size"] for r in sums.groupBy(F.floor(F.col("range") / per).cast("int").alias("at")).agg(F.sum("range_size").alias("size")).collect()}  # a row a shard
    sizes = [measured.get(i, 0) for i in range(shards)]
    shared = [len(bounds) > 0 and counted[bounds[i * per - 1]] > 1 for i in range(1, shards)]
    stretches = joined_shards(sizes, shared) if any(sizes) else [(i, 1) for i in range(shards)]
    of_shard = [(first, n, sum(sizes[:first]), sum(sizes[first : first + n])) for first, n in stretches for _ in range(n)]
    first, number, begin_of, size_of = (F.get(F.array(*[F.lit(x[i]).cast("long") for x in of_shard]), F.floor(F.col("range") / per).cast("int")) for i in range(4))
    order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range", F.coalesce(F.sum("range_size").over(order), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("range_rows").over(order), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("range").orderBy("key", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    middle = (2 * (F.col("bytes_before") + F.col("upto") - begin_of) - F.col("size")).cast("decimal(38,0)") * number / (2 * size_of)
    out = (
        placed.withColumns({"upto": F.sum("size").over(inside), "nth": F.row_number().over(inside)})
        .join(F.broadcast(sums), "range")  # a row a range: bounded by `ranges`
        .withColumn("shard", F.when(number == 1, first).otherwise(first + F.least(F.floor(middle).cast("long"), number - 1)).cast("int"))
        .withColumn("row", F.col("rows_before") + F.col("nth") - 1)
        .select("doc_id", "size", "text_crc32", "shard", "row")
    )
    out = materialise(out, "shards")
    firsts = out.groupBy("shard").agg(F.min("row").alias("first"))
    return out.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
