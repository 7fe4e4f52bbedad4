"""Exact dedup by deterministic block naming.

Each normalised text is cut into blocks of BLOCK bytes. Distinct blocks are dealt over partitions
and sorted there; place gives each an integer name. Neighbouring names are then paired, distinct
pairs named in the same way, until each document has one name. Names are compared by content at
every level, so with the length they are an identity without collisions.

Blocks that many rows share (found by counting hashes) are joined apart, by a table whose size is
bounded by MOST_HOT blocks: one hot text doesn't end in one task.

Edge cases: a null text counts as empty, empty texts equal each other; repeated rows are copies of
each other, of rows with the same smallest doc_id one stays; a row with a null doc_id comes after all
rows with one, so it stays only where no copy has an id; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.storage import materialise

BLOCK = 4096
#: The column that tells rows apart.
ROW = "_row"
#: A block is hot if more than 1 in so many rows have it; the hottest so many are joined apart (4 MB of blocks at most).
HOT_SHARE, MOST_HOT = 500, 1000
#: Runs of separators other than a single blank; a single blank is normal already.
RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(column: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), RUN, " ")


def _named(keys: DataFrame, *by: str) -> DataFrame:
    """Each distinct key with an integer name: sorted inside its partition, named by place."""
    return keys.distinct().sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, column: str = "text", block: int = BLOCK) -> DataFrame:
    """row, doc_id, n_bytes, name, text_sha256: rows have equal texts if n_bytes and name are equal.

    docs needs a column ROW, different in each row.
    """
    text = F.encode(normalised(column), "utf-8")
    whole = docs.select(ROW, "doc_id", text.alias("t"))
    n = F.length("t")
    last = F.greatest(F.ceil(n / F.lit(block)).cast("int") - 1, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("t"), i * block + 1, F.lit(block)))
    blocks = whole.select(ROW, "doc_id", n.alias("n_bytes"), F.sha2("t", 256).alias("sha"), F.posexplode(cut).alias("i", "block")).withColumn("sha", F.when(F.col("i") == 0, F.col("sha")))
    lean = whole.select(F.explode(cut).alias("block"))
    counts = lean.groupBy(F.xxhash64("block").alias("h")).count()
    total = docs.count()
    hot = [r["h"] for r in counts.where(F.col("count") > max(total // HOT_SHARE, 64)).orderBy(F.col("count").desc(), "h").limit(MOST_HOT).collect()]
    if hot:
        is_hot = F.xxhash64("block").isin(hot)
        names = _named(lean.where(~is_hot), "block")
        cold = blocks.where(~is_hot).join(names, "block")
        hot_names = materialise(lean.where(is_hot).distinct().coalesce(1).sortWithinPartitions("block").withColumn("name", -1 - F.monotonically_increasing_id()), "hot-names")
        level = cold.unionByName(blocks.where(is_hot).join(F.broadcast(hot_names), "block"))
    else:
        level = blocks.join(_named(lean, "block"), "block")
    base = materialise(level.select(ROW, "doc_id", "n_bytes", "sha", "i", "name"), "block-names")
    top = base.agg(F.max("i")).first()[0] or 0
    names = base.where(F.col("n_bytes") <= block).select(ROW, "name")
    if top:
        current = base.where(F.col("n_bytes") > block).select(ROW, "i", "name")
        while top:
            pairs = current.groupBy(ROW, F.shiftright("i", 1).alias("i")).agg(
                F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("left"), F.max(F.when(F.col("i") % 2 == 1, F.col("name"))).alias("right")
            )
            pairs = materialise(pairs, "pairs")
            table = materialise(_named(pairs.select("left", "right"), "left", "right"), "pair-names")
            joined = pairs.alias("p").join(table.alias("t"), (F.col("p.left") == F.col("t.left")) & F.col("p.right").eqNullSafe(F.col("t.right"))).select(f"p.{ROW}", "p.i", "t.name")
            current = materialise(joined, "level")
            top >>= 1
        names = names.unionByName(current.select(ROW, "name"))
    return base.where("i = 0").select(ROW, "doc_id", "n_bytes", F.col("sha").alias("text_sha256")).join(names, ROW)


def decide(docs: DataFrame, column: str = "text", block: int = BLOCK) -> DataFrame:
    """row, doc_id, keep_id, group_size, kept, text_sha256, one row for each row of docs."""
    rows = materialise(identities(docs, column, block), "identities")
    groups = materialise(rows.groupBy("n_bytes", "name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", ROW)).alias("first"), F.count(F.lit(1)).alias("group_size")), "groups")
    out = rows.join(groups, ["n_bytes", "name"])
    return out.select(ROW, "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col(ROW) == F.col(f"first.{ROW}")).alias("kept"), "text_sha256")


def numbered(docs: DataFrame) -> DataFrame:
    """docs with the column ROW that decide() needs: the same numbers each time the same files are read."""
    return docs.withColumn(ROW, F.monotonically_increasing_id())
