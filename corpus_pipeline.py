"""The corpus pipeline: quality, exact dedup, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents.

A row with a null doc_id is a document of its own: stages 3 and 4 give it an id beyond all others while
they run (in the order of the files) and return it with a null doc_id again.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from panelspark.llm.storage import materialise

#: Tells rows without a doc_id from others while they have one.
NAMELESS = "_nameless"
#: Columns that stages add for a while; columns of documents with these names are set aside meanwhile.
OWN = (NAMELESS, exact_dedup.ROW, "_score", "_number", "_part", "_base", "_taken", "_size", "_copies", "_copy")


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that returns the columns of documents, whatever their names: those in OWN (in any case) are renamed while it works."""

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {c: f"_aside_{i}_of_{len(docs.columns)}" for i, c in enumerate(docs.columns) if c.lower() in OWN}
        out = work(spark, docs.withColumnsRenamed(aside), sf_dir)
        return out.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])

    return run


def with_ids(docs: DataFrame) -> DataFrame:
    """docs with NAMELESS, true where doc_id was null; there doc_id is the largest id plus 1, 2, ...

    The numbered rows are written, so that all reads agree; tables without such rows are not.
    An id beyond the longs is an error.
    """
    named = docs.where("doc_id IS NOT NULL").withColumn(NAMELESS, F.lit(False))
    nameless = docs.where("doc_id IS NULL")
    if nameless.isEmpty():
        return named
    # the number holds its partition in the upper bits: made dense by the counts of the partitions before
    rows = materialise(nameless.withColumn("_number", F.monotonically_increasing_id()), "nameless")
    part = F.shiftright("_number", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(part.alias("_part")).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    last = named.agg(F.coalesce(F.max("doc_id"), F.lit(0)).cast("long")).first()[0]
    dense = F.lit(last) + 1 + F.col("_base") + F.col("_number").bitwiseAND(F.lit((1 << 33) - 1))
    given = rows.withColumn("_part", part).join(F.broadcast(bases), "_part").withColumn("doc_id", dense).withColumn(NAMELESS, F.lit(True))
    return named.unionByName(given.select(*named.columns))


def without_ids(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, with doc_id null again where with_ids() gave one."""
    return docs.withColumn("doc_id", F.when(~F.col(NAMELESS), F.col("doc_id"))).select(*columns)


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose score is at least 0.5.

    Null, empty and blank texts are scored like others; long texts are scored whole; repeated rows have the
    same score and stay or go together; where no label can be learnt from, every score is 0.5 and all rows stay;
    an empty table stays empty; other columns, whatever their names, pass through.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, out="_score").where(F.col("_score") >= 0.5).drop("_score")


@stage
def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: that with the smallest doc_id, null last; of repeated rows any one.

    A null text equals an empty one; long texts are compared whole; an empty table stays empty; other
    columns, whatever their names, pass through. The numbered rows are written: numbers given twice could
    differ after an executor is lost.
    """
    rows = materialise(exact_dedup.numbered(docs), "numbered")
    kept = exact_dedup.decide(rows).where("kept").select(exact_dedup.ROW)
    return rows.join(kept, exact_dedup.ROW, "left_semi")


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of 5-word shingles at a similarity of 0.8 or more.

    Rows with a null doc_id come after all others: one stays where its component has no id and no earlier row.
    Null, empty and blank texts are linked with nothing and stay; long texts are compared whole; rows with
    one doc_id stay or go together; an empty table stays empty; other columns, whatever their names, pass through.
    """
    rows = with_ids(docs)
    found = jaccard_join.jaccard_components(rows, k=5, percent=80)
    return without_ids(rows.join(found.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi"), docs.columns)


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, in whole copies: the rest of the share is drawn by a hash of doc_id.

    A row with a null doc_id is mixed by the id that it has for this stage. Rows with a null, empty or blank
    text have no words, take none and go; long texts are taken whole; rows with one doc_id have the share
    that they take together; a null source is one of its own; an empty table stays empty; other columns,
    whatever their names, pass through.
    """
    rows = with_ids(docs)
    taken = mixing.mix(rows).groupBy("doc_id").agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
    share = F.when(F.col("_size") > 0, F.col("_taken") / F.col("_size")).otherwise(0.0)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("mixture")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = (F.floor(share) + F.when(draw < share - F.floor(share), 1).otherwise(0)).cast("int")
    wanted = taken.select("doc_id", copies.alias("_copies")).where("_copies > 0")
    return without_ids(rows.join(wanted, "doc_id").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents but the text, the ids of each text (token_ids) and the text decoded from them (decoded_text).

    Null and empty texts have no ids and decode to an empty text; long texts are encoded in parts; repeated
    rows are encoded each; an empty table stays empty; columns named like the two new ones are replaced,
    others pass through.
    """
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    new = ("token_ids", "decoded_text")
    return bpe.round_trip(docs.drop(*new), path, public_tokenizers.PATTERN, out=new[0], decoded=new[1]).drop("text")


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE", tokens),
]

#: A fitted model, hash draws and a tokenizer: not in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
