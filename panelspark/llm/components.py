"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.storage import Scratch


def _with_lowest(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (u, v) with m, the smallest v of each u.

    The minima are combined before their shuffle and written; the join that follows has two plain
    exchanges, so Spark deals the rows of a large star's centre over several tasks.
    """
    lowest = scratch.keep(rows.groupBy("u").agg(F.min("v").alias("m")), "lowest")
    return rows.join(lowest, "u")


def _large(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (or to the node)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_lowest(both, scratch).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _with_lowest(down, scratch)
    # a node's own tie comes from each of its rows: distinct after, combined before the shuffle
    return low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node), for the nodes of at least one edge (u, v).

    Rounds grow with the logarithm of the number of nodes; each is written to the shared folder, and
    deleted after the next one. They end when the edges are stars: each node has one centre, which has none.
    """
    edges = edges.where("u <> v").select("u", "v")
    before = None
    while True:
        scratch = Scratch(edges.sparkSession)
        edges = scratch.keep(_small(scratch.keep(_large(edges, scratch), "large"), scratch), "stars")
        scratch.drop("large", "lowest")
        if before:
            before.drop("stars")
        before = scratch
        # a node with two centres has two rows, a centre with a centre has one
        tied = edges.select(F.col("u").alias("x"), F.lit(1).alias("out")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out")).distinct())
        if tied.groupBy("x").agg(F.sum("out").alias("outs"), F.count(F.lit(1)).alias("rows")).where("outs > 1 OR (outs > 0 AND rows > outs)").isEmpty():
            break
    centres = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
