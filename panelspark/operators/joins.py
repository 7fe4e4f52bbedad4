"""Joins of panels: benchmark, date dimensions, as-of, completion, ranges of splits, checks of keys.

The as-of join is one shuffle by key: both sides are united and the last right row is carried
forward, so cost is linear and sorting spills. Dimensions keyed by date hold a row a date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def join_benchmark(panel: DataFrame, benchmark: str, columns: Sequence[str], prefix: str = "bench_") -> DataFrame:
    """The benchmark symbol's columns of the same date beside every row (left join; one row a date)."""
    own = panel.where(F.col("symbol") == benchmark).select("date", *[F.col(c).alias(prefix + c) for c in columns])
    return panel.join(own, "date", "left")


def join_dates(panel: DataFrame, dimension: DataFrame) -> DataFrame:
    return panel.join(dimension, "date", "left")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, tie: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """Each left row with the last right row of its key at or before its time; else nulls.

    Of right rows at one time the last by `tie` counts. by may be empty for small tables.
    """
    payload = [c for c in right.columns if c not in by]
    sides = [
        left.select(*by, F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(F.struct(*payload)).schema[0].dataType).alias("_right"), *[F.lit(None).cast(right.schema[t].dataType).alias(f"_tie{i}") for i, t in enumerate(tie)]),
        right.select(*by, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_left"), F.struct(*payload).alias("_right"), *[F.col(t).alias(f"_tie{i}") for i, t in enumerate(tie)]),
    ]
    order = Window.partitionBy(*by).orderBy("_time", "_side", *[f"_tie{i}" for i in range(len(tie))]).rowsBetween(Window.unboundedPreceding, 0)
    carried = sides[0].unionByName(sides[1]).withColumn("_right", F.last("_right", ignorenulls=True).over(order)).where("_side = 1")
    return carried.select("_left.*", *[F.col(f"_right.{c}").alias(prefix + c) for c in payload])


def complete_panel(prices: DataFrame) -> DataFrame:
    """Every symbol on every date; missing rows have nulls. The cross product is the result asked for."""
    dates = prices.select("date").distinct()
    return prices.select("symbol").distinct().crossJoin(dates).join(prices, ["symbol", "date"], "left")


def join_labels(features: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    return features.join(labels.where(F.col(target).isNotNull()), ["symbol", "date"])


def assign_roles(df: DataFrame, splits: DataFrame) -> DataFrame:
    """A row for each split and role whose dates hold the row. splits: a row a fold.

    Ranges become days, a row a split and day, so that the join is by equal dates and no row meets all ranges.
    """
    days = splits.select("split_id", F.explode(F.array(
        F.struct(F.lit("train").alias("role"), F.col("train_start").alias("start"), F.col("train_end").alias("end")),
        F.struct(F.lit("validation").alias("role"), F.col("validation_start").alias("start"), F.col("validation_end").alias("end")),
    )).alias("r")).where("r.start <= r.end").select("split_id", "r.role", F.explode(F.sequence(F.col("r.start").cast("date"), F.col("r.end").cast("date"))).alias("date"))
    return df.join(days, "date").select(*df.columns, "split_id", "role")


def pair_metrics(metrics: DataFrame, baseline: str, keys: Sequence[str], value: str) -> DataFrame:
    """Each model's metric beside the baseline's of the same slice."""
    base = metrics.where(F.col("model") == baseline).select(*keys, F.col(value).alias("baseline_value"))
    return metrics.where(F.col("model") != baseline).join(base, list(keys)).withColumn("difference", F.col(value) - F.col("baseline_value"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union in which a new row replaces the old one of its key."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_turn").desc()))).where("_n = 1").drop("_turn", "_n")


def last_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    by = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def equal_inputs(preds: DataFrame) -> DataFrame:
    """Per split: whether all models have the same row keys (compared by count and sums of hashes)."""
    h = F.xxhash64("symbol", "date").cast("decimal(38,0)")
    each = preds.groupBy("split_id", "model").agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("h"))
    return each.groupBy("split_id").agg(F.count(F.lit(1)).alias("n_models"), (F.countDistinct("n", "h") == 1).alias("equal_inputs"))
