"""Exact quantiles of many groups at once, whatever a group's size.

``percentile`` keeps every distinct value of a group in one buffer. Here a sketch of bounded size (an
approximate percentile) proposes a range of values for each quantile, a second pass counts exactly how many
values lie below and within each range, and only values within the ranges go on: counted by value, then
narrowed to the bin of the range that holds the rank, then summed up in order. Where a sketch misses the
rank, the counts show it and the range reaches to the group's smallest or largest value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketch, and by how much of all values a proposed range goes beyond a quantile on either side.
ACCURACY = 10_000
SLACK = 2 / ACCURACY
#: Bins that a range of values is cut into.
BINS = 1024


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], out: str = "quantiles") -> DataFrame:
    """keys, n, `out`: an array with the quantile of each probability, interpolated between neighbours as ``percentile`` does.

    Null and NaN values are left out; a group without values has no row. A null key is a key like others.
    The table is read three times; what is shuffled are sketches, counts, and the values in the ranges.
    """
    own = df.select(F.struct(*keys).alias("_k"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    ends = [[min(1.0, max(0.0, p + side)) for p in probabilities] for side in (-SLACK, SLACK)]
    sketch = own.groupBy("_k").agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        *[F.percentile_approx("_v", e, ACCURACY).alias(name) for name, e in zip(("_low", "_high"), ends)],
    )
    counts = own.join(sketch, "_k").groupBy("_k").agg(
        *[F.any_value(c).alias(c) for c in ("_n", "_min", "_max", "_low", "_high")],
        *[F.count_if(F.col("_v") < F.get("_low", F.lit(i))).alias(f"_below{i}") for i in range(len(probabilities))],
        *[F.count_if(F.col("_v") <= F.get("_high", F.lit(i))).alias(f"_upto{i}") for i in range(len(probabilities))],
    )
    ranges = counts.select("_k", "_n", F.array(*[_range(i, p) for i, p in enumerate(probabilities)]).alias("_ranges"))
    within = own.join(ranges, "_k").select("_k", "_n", "_v", F.explode(F.filter("_ranges", lambda r: F.col("_v").between(r["low"], r["high"]))).alias("_r"))
    within = within.groupBy("_k", "_n", "_r", "_v").agg(F.count(F.lit(1)).alias("_c")).withColumn("_bin", _bin(F.col("_v"), F.col("_r.low"), F.col("_r.high")))
    by = Window.partitionBy("_k", "_r.i").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = within.groupBy("_k", "_r", "_bin").agg(F.sum("_c").alias("_b")).withColumn("_before", F.col("_r.below") + F.coalesce(F.sum("_b").over(by), F.lit(0)))
    held = bins.where((F.col("_before") <= F.col("_r.upper")) & (F.col("_before") + F.col("_b") > F.col("_r.lower"))).select("_k", F.col("_r.i").alias("_i"), "_bin", "_before")
    last = within.select("_k", "_n", "_r", F.col("_r.i").alias("_i"), "_v", "_c", "_bin").join(held, ["_k", "_i", "_bin"])
    order = Window.partitionBy("_k", "_i", "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("_upto", F.col("_before") + F.sum("_c").over(order))
    at = lambda rank: F.min(F.when(F.col("_upto") > F.col(rank), F.col("_v")))
    each = last.groupBy("_k", "_n", "_r").agg(at("_r.lower").alias("_a"), at("_r.upper").alias("_b"))
    place = (F.col("_n") - 1) * F.col("_r.p")
    q = F.when(F.col("_r.lower") == F.col("_r.upper"), F.col("_a")).otherwise((F.col("_r.upper") - place) * F.col("_a") + (place - F.col("_r.lower")) * F.col("_b"))
    listed = each.select("_k", "_n", F.struct(F.col("_r.i"), q.alias("q")).alias("_q")).groupBy("_k", "_n").agg(F.array_sort(F.collect_list("_q")).alias("_q"))  # a row a probability
    return listed.select("_k.*", F.col("_n").alias("n"), F.transform("_q", lambda x: x["q"]).alias(out))


def _range(i: int, p: float) -> Column:
    """The values between which the ranks of a quantile lie, by exact counts: those proposed, or the group's ends."""
    place = (F.col("_n") - 1) * F.lit(float(p))
    lower, upper = F.floor(place), F.ceil(place)
    fits, reaches = F.col(f"_below{i}") <= lower, F.col(f"_upto{i}") > upper
    return F.struct(
        F.lit(i).alias("i"), F.lit(float(p)).alias("p"), lower.alias("lower"), upper.alias("upper"),
        F.when(fits, F.get("_low", F.lit(i))).otherwise(F.col("_min")).alias("low"), F.when(fits, F.col(f"_below{i}")).otherwise(F.lit(0)).alias("below"),
        F.when(reaches, F.get("_high", F.lit(i))).otherwise(F.col("_max")).alias("high"),
    )


def _bin(v: Column, low: Column, high: Column) -> Column:
    """Bins in order of values; a single one where the range has no finite width."""
    width = high - low
    return F.when((width > 0) & (width < float("inf")), F.floor((v - low) / width * (BINS - 1))).otherwise(0).cast("int")
