"""Mixes sources to target weights, with DataFrame functions alone.

The words of a source, document after document, are packed into blocks of BLOCK words. Each slot of
the output draws its source by weight, so that every output shard of SHARD_SLOTS slots has multinomial
counts. A source's running total of draws over the shards is then scaled by slots wanted / slots drawn
and rounded down: totals meet the target, and a shard keeps the share of each source that it drew.
The slots of a source are numbered through the shards and run through pseudorandom permutations of its
block indexes (a Feistel network with cycle walking), one for each pass over the source, keyed by the
seed; `mixture` is that table, and is joined with blocks by index.

Edge cases: a null or empty text has no words and takes none; a null source is a source of its own,
last in order; repeated rows count each, in an order by doc_id (null first), size and a hash of the
text; a source that wants slots and drew none has them in the first shard; an empty table gives an
empty result. Columns other than doc_id, text and source aren't read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.storage import Scratch

BLOCK = 128
#: Parts of a source whose running totals are taken apart: a fixed number, so that results don't follow session settings.
BUCKETS = 1 << 14
#: Rows whose running totals are taken together.
RUN = 1 << 14
#: Slots of an output shard.
SHARD_SLOTS = 8192
WORD = r"[^\x20\x09-\x0D]+"
#: Steps of a cycle walk: at most 2 * ceil(sqrt(n)) + 2 are needed, and each goes on with probability 2 / sqrt(n).
WALK = 48


def permuted(index: Column, n: Column, key: Column, epoch: Column) -> Column:
    """The image of index under a permutation of 0..n-1 that key and epoch choose."""
    side = F.ceil(F.sqrt(n.cast("double"))).cast("long")

    def turn(x: Column) -> Column:
        pair = F.struct((x / side).cast("long").alias("l"), F.pmod(x, side).alias("r"))
        out = F.aggregate(
            F.array(*[F.lit(i) for i in range(4)]),
            pair,
            lambda p, i: F.struct(p["r"].alias("l"), F.pmod(p["l"] + F.pmod(F.xxhash64(i, p["r"], key, epoch), side), side).alias("r")),
        )
        return F.transform(F.array(out), lambda p: p["l"] * side + p["r"])[0]

    # walk until the image is inside 0..n-1
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(index.alias("x"), F.lit(False).alias("done")), lambda s, i: F.when(s["done"], s).otherwise(_walked(turn, s["x"], n)))
    return F.transform(F.array(walked), lambda s: F.when(s["done"], s["x"]).otherwise(F.raise_error(F.lit("a cycle walk didn't end")).cast("long")))[0]


def _walked(turn, x: Column, n: Column) -> Column:
    return F.transform(F.array(turn(x)), lambda y: F.struct(y.alias("x"), (y < n).alias("done")))[0]


def targets(sources: DataFrame, share: float, weights: tuple[float, ...], most: float) -> DataFrame:
    """source, source_size -> target. Sources by code point, null last, weigh `weights` in turn; together
    they take `share` of all sizes, each `most` times its size at most, the excess reshared by weight.

    Sources fill up in order of size / weight, so running sums in that order give the final level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weighed = sources.withColumn("turn", F.row_number().over(order)).withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("turn") - 1, F.lit(len(weights)))))
    full = Window.orderBy(F.col("cap") / F.col("weight"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    levelled = (
        weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumns({"caps": F.coalesce(F.sum("cap").over(full), F.lit(0.0)), "used": F.coalesce(F.sum("weight").over(full), F.lit(0.0))})
        .withColumns({"all_weight": F.sum("weight").over(everything), "want": F.sum("source_size").over(everything) * F.lit(float(share))})
        .withColumn("level", (F.col("want") - F.col("caps")) / (F.col("all_weight") - F.col("used")))
        .withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    )
    # the first source in that order which doesn't fill up has the final level
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "turn", "level"))).over(everything)["level"]
    return levelled.select("source", "turn", "weight", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def running(rows: DataFrame, key: str, at: str, value: str, out: str) -> DataFrame:
    """rows with `out`: the sum of `value` over the rows of the same key with a smaller `at`. In runs of RUN
    places, then over the runs' sums: no task holds a key's rows."""
    cut = rows.withColumn("_run", F.floor(F.col(at) / RUN))
    inside = Window.partitionBy(key, "_run").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    runs = Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(key, "_run").agg(F.sum(value).alias("_sum")).select(key, "_run", F.coalesce(F.sum("_sum").over(runs), F.lit(0)).alias("_base"))
    part = cut.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return part.join(sums, [key, "_run"]).select(*rows.columns, (F.col("_base") + F.col("_inside")).alias(out))


def draws(spark, plan: DataFrame, seed: int) -> DataFrame:
    """shard, turn, drawn: the multinomial counts of each output shard. plan has a row a source (turn, slots)."""
    shares = plan.select("turn", "slots").where("slots > 0").orderBy("turn").collect()  # a row a source
    total = sum(r["slots"] for r in shares)
    edges, at = [], 0
    for r in shares[:-1]:
        at += r["slots"]
        edges.append(F.lit(at / total))
    table = F.array(*edges) if edges else F.array().cast("array<double>")
    turns = F.array(*[F.lit(r["turn"]) for r in shares]) if shares else F.array().cast("array<int>")
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 50)) / F.lit(float(1 << 50))
    slots = spark.range(total).select((F.col("id") / SHARD_SLOTS).cast("long").alias("shard"), F.get(turns, F.size(F.filter(table, lambda e: e <= draw))).alias("turn"))
    return slots.groupBy("shard", "turn").agg(F.count(F.lit(1)).alias("drawn"))


def allotted(plan: DataFrame, drawn: DataFrame) -> DataFrame:
    """shard, turn, begin, end: the slots of each source that a shard holds; a source's slots run on through the shards."""
    totals = drawn.groupBy("turn").agg(F.sum("drawn").alias("all"))
    some = plan.select("turn", "slots").where("slots > 0").join(totals, "turn", "left")
    upto = running(drawn, "turn", "shard", "drawn", "before").join(some, "turn")
    scaled = lambda x: F.floor(x.cast("decimal(38,0)") * F.col("slots") / F.col("all")).cast("long")
    own = upto.select("shard", "turn", scaled(F.col("before")).alias("begin"), scaled(F.col("before") + F.col("drawn")).alias("end"))
    none = some.where("all IS NULL").select(F.lit(0).cast("long").alias("shard"), "turn", F.lit(0).cast("long").alias("begin"), F.col("slots").alias("end"))
    return own.unionByName(none).where("begin < end")


def mixture(plan: DataFrame, seed: int, draw_seed: int | None = None) -> DataFrame:
    """shard, turn, slot, index: the blocks of each output shard. plan: turn, slots, blocks of each source.

    draw_seed (seed) keys the draws, so which shard holds a slot; seed keys the permutations, so which block it is.
    """
    held = allotted(plan, draws(plan.sparkSession, plan, seed if draw_seed is None else draw_seed)).join(plan.select("turn", "blocks"), "turn")
    slots = held.select("shard", "turn", "blocks", F.explode(F.sequence("begin", F.col("end") - 1)).alias("slot"))
    index = permuted(F.pmod("slot", "blocks"), F.col("blocks"), F.hash("turn", F.lit(seed)), (F.col("slot") / F.col("blocks")).cast("long"))
    return slots.select("shard", "turn", "slot", index.alias("index"))


def packed(docs: DataFrame, share: float, weights: tuple[float, ...], most: float, block: int, seed: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The sizes of all documents, and a row for each source: its turn, size, target, blocks, and slots in the mix."""
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("tie"))
    sized = scratch.keep(sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(BUCKETS)).cast("int")), "sized")
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights, most)
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    per_block = F.col("source_size") / F.when(F.col("source_size") > 0, blocks)
    slots = F.coalesce(F.least(F.round(F.col("target") / per_block).cast("long"), (F.lit(float(most)) * blocks).cast("long")), F.lit(0).cast("long"))
    return sized, scratch.keep(plan.withColumn("blocks", blocks).withColumn("slots", slots), "plan")


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), most: float = 2.0, block: int = BLOCK, seed: int = 11, draw_seed: int | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each document.

    And where it takes them: n_slots, the slots that hold any of its words, and first_shard, the first output
    shard that has one (null: none). Draws decide the shards; how often a block is taken is the same for all.
    """
    scratch = Scratch(docs.sparkSession)
    sized, plan = packed(docs, share, weights, most, block, seed, scratch)
    # running totals: in buckets, these in groups of 128, so that one large source isn't one task
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("_size")).withColumn("group", F.shiftright("bucket", 7))
    below = lambda *key: Window.partitionBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("source", "group").agg(F.sum("_size").alias("_size")).select("source", "group", F.coalesce(F.sum("_size").over(below("source").orderBy("group")), F.lit(0)).alias("base"))
    offsets = (
        sums.withColumn("inside", F.coalesce(F.sum("_size").over(below("source", "group").orderBy("bucket")), F.lit(0)))
        .alias("a")
        .join(groups.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.group") == F.col("b.group")))
        .select("a.source", "bucket", (F.col("base") + F.col("inside")).alias("offset"))
    )
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        sized.withColumn("upto", F.sum("size").over(inside))
        .alias("a")
        .join(offsets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.bucket") == F.col("b.bucket")))
        .select("a.doc_id", "a.source", "a.size", (F.col("offset") + F.col("upto") - F.col("size")).alias("start"), (F.col("offset") + F.col("upto")).alias("stop"))
        .alias("a")
        .join(plan.alias("s"), F.col("a.source").eqNullSafe(F.col("s.source")))
        .select("doc_id", "size", "source_size", "target", "turn", "start", "stop")
    )
    # how often each block is in the mix, and slots of the blocks before it
    hits = mixture(plan, seed, draw_seed).groupBy("turn", "index").agg(F.count(F.lit(1)).alias("n"), F.min("shard").alias("shard"))
    every = plan.where("blocks > 0").select("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / RUN))).alias("_run"), "blocks")
    every = every.select("turn", F.explode(F.sequence(F.col("_run") * RUN, F.least((F.col("_run") + 1) * RUN, "blocks") - 1)).alias("index"))
    table = scratch.keep(running(every.join(hits, ["turn", "index"], "left").select("turn", "index", F.coalesce("n", F.lit(0)).alias("n"), "shard"), "turn", "index", "n", "before"), "blocks")
    # a document's words lie in neighbouring blocks: sums by prefix, so its two ends are enough
    lo, hi = table.alias("lo"), table.alias("hi")
    some = placed.where("size > 0").withColumns({"first": F.floor(F.col("start") / block), "last": F.floor((F.col("stop") - 1) / block)})
    # where its words go: a row for each block that holds some, at most one more a document than there are blocks
    parts = some.select("turn", "start", F.explode(F.sequence("first", "last")).alias("index")).join(table.select("turn", "index", "n", "shard"), ["turn", "index"])
    spread = parts.groupBy("turn", "start").agg(F.sum("n").alias("n_slots"), F.min("shard").alias("first_shard"))
    got = (
        some.join(spread, ["turn", "start"])
        .alias("d")
        .join(lo, (F.col("d.turn") == F.col("lo.turn")) & (F.col("d.first") == F.col("lo.index")))
        .join(hi, (F.col("d.turn") == F.col("hi.turn")) & (F.col("d.last") == F.col("hi.index")))
    )
    # words before x, repeats counted: block * (slots of the blocks before) + those of its own block
    taken = (F.col("hi.before") * block + (F.col("stop") - F.col("last") * block) * F.col("hi.n")) - (F.col("lo.before") * block + (F.col("start") - F.col("first") * block) * F.col("lo.n"))
    full = got.select("d.doc_id", "d.size", "d.source_size", "d.target", taken.cast("long").alias("taken"), "d.n_slots", "d.first_shard")
    return full.unionByName(placed.where("size = 0").select("doc_id", "size", "source_size", "target", *[F.lit(x).cast("long").alias(c) for c, x in (("taken", 0), ("n_slots", 0), ("first_shard", None))]))
