"""Audit of features by walk-forward split: estimates from training dates, evidence from the validation dates after them.

splits: split_id, train_start, train_end, validation_start, validation_end, both ends included. Null, NaN and infinite
values are missing; a table without rows gives results without rows. Correlations need three complete pairs and variance.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.expr import average_rank, finite, safe_corr
from panelspark.operators import audit
from panelspark.operators.joins import assign_roles
from panelspark.operators.metrics import with_value_ranks
from panelspark.sources import tables

PERIOD = ["split_id", "period", "feature"]


def quality(df: DataFrame, features: Sequence[str], splits: DataFrame) -> DataFrame:
    """A row a split and feature: rows, missing and non-finite rates and covered symbols of both roles, training stale rate, revisions, PSI.

    A value is stale if it equals the symbol's value of the row before, both of training. Revisions are the training
    sum of the column <feature>_revision_count; null, with revision_tracking_available false, where there is none.
    """
    counts = {f: F.col(f"{f}_revision_count").cast("double") if f"{f}_revision_count" in df.columns else F.lit(None).cast("double") for f in features}
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), n.alias("revisions")) for f, n in counts.items()])).alias("x")
    long = df.select("symbol", "date", each).select("symbol", "date", "x.*")
    known = F.when(~F.isnan("value"), F.col("value"))
    before = Window.partitionBy("feature", "symbol").orderBy("date")  # before splits are met: a row once, not once a split
    long = long.withColumns({"known": known, "last": F.lag(known).over(before), "last_date": F.lag("date").over(before), "clean": finite("value")})
    rows = assign_roles(long, splits).join(splits.select("split_id", "train_start"), "split_id")
    train, held = F.col("role") == "train", F.col("role") == "validation"
    compared = train & F.col("known").isNotNull() & F.col("last").isNotNull() & (F.col("last_date") >= F.col("train_start"))
    strange = F.col("known").isNotNull() & F.col("clean").isNull()

    def share(of: Column, role: Column) -> Column:
        return F.avg(F.when(role, of.cast("double")))

    tracked = F.col("feature").isin([f for f in features if f"{f}_revision_count" in df.columns])
    out = rows.groupBy("split_id", "feature").agg(
        F.count_if(train).alias("train_rows"), F.count_if(held).alias("validation_rows"),
        share(F.col("clean").isNull(), train).alias("train_missing_rate"), share(F.col("clean").isNull(), held).alias("validation_missing_rate"),
        share(strange, train).alias("train_non_finite_rate"), share(strange, held).alias("validation_non_finite_rate"),
        F.countDistinct(F.when(train & F.col("clean").isNotNull(), F.col("symbol"))).alias("train_symbol_coverage"),
        F.countDistinct(F.when(held & F.col("clean").isNotNull(), F.col("symbol"))).alias("validation_symbol_coverage"),
        F.avg(F.when(compared, (F.col("known") == F.col("last")).cast("double"))).alias("train_stale_rate"),
        F.sum(F.when(train, F.col("revisions"))).alias("train_revision_count"),
    )
    out = out.withColumns({"revision_tracking_available": tracked, "train_revision_count": F.when(tracked, F.coalesce("train_revision_count", F.lit(0.0)))})
    return out.join(audit.psi(rows.select("split_id", "role", "feature", "value")), ["split_id", "feature"], "left")


def predictive(df: DataFrame, features: Sequence[str], ret: str, target: str, splits: DataFrame) -> DataFrame:
    """split_id, period (train, validation), feature: mean daily rank IC, rank association with the class, complete pairs with the return.

    A date's IC is the same in every split, so it is taken once and only rows a date meet the splits. Ranks of the
    association are of counted values, range by range.
    """
    long = audit.long_features(df, features, ["date", ret, target]).select("feature", "date", finite("value").alias("value"), finite(ret).alias("_ret"), finite(target).alias("_class")).where("value IS NOT NULL")
    paired = long.where("_ret IS NOT NULL")
    day = ["feature", "date"]
    ranked = paired.withColumns({"_a": average_rank("value", day), "_b": average_rank("_ret", day)})
    daily = assign_roles(ranked.groupBy(*day).agg(safe_corr("_a", "_b", 3).alias("ic"), F.count(F.lit(1)).alias("n")), splits).withColumnRenamed("role", "period")
    ics = daily.groupBy(*PERIOD).agg(F.avg("ic").alias("rank_ic"), F.sum("n").alias("observations"))
    both = assign_roles(long.where("_class IS NOT NULL"), splits).withColumnRenamed("role", "period").select(*PERIOD, "value", "_class")
    both = with_value_ranks(with_value_ranks(both, "value", "_a", PERIOD), "_class", "_b", PERIOD)
    classes = both.groupBy(*PERIOD).agg(safe_corr("_a", "_b", 3).alias("classification_association"))
    days = assign_roles(df.select("date").distinct(), splits).select("split_id", F.col("role").alias("period")).distinct()
    every = days.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    return every.join(ics, PERIOD, "left").join(classes, PERIOD, "left").na.fill(0, ["observations"])


def stability(pred: DataFrame) -> DataFrame:
    """A row a feature: splits, median ICs of both periods, share of splits whose two ICs have one sign, and whether that is evidence.

    A split without one of its ICs has no common sign. Evidence: two splits, 0.6 of them, a validation median of 0.01.
    The groups have a row a split.
    """
    wide = pred.groupBy("split_id", "feature").pivot("period", ["train", "validation"]).agg(F.first("rank_ic"))
    same = F.coalesce((F.signum("train") == F.signum("validation")).cast("double"), F.lit(0.0))
    out = wide.groupBy("feature").agg(
        F.count(F.lit(1)).alias("folds"), F.percentile("train", 0.5).alias("train_median_ic"), F.percentile("validation", 0.5).alias("validation_median_ic"), F.avg(same).alias("sign_agreement"))
    return out.withColumn("stable_evidence", (F.col("folds") >= 2) & (F.col("sign_agreement") >= 0.6) & F.coalesce(F.abs("validation_median_ic") >= 0.01, F.lit(False)))


def redundancy(df: DataFrame, features: Sequence[str], splits: DataFrame, threshold: float = 0.9) -> DataFrame:
    """split_id, feature_a, feature_b, spearman_correlation of training rows that have both, where it reaches the threshold.

    All pairs and splits are ranked in one pass each for the left and the right values; a row becomes a row a pair.
    """
    pairs = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), finite(a).alias("_x"), finite(b).alias("_y")) for a, b in combinations(features, 2)])
    train = splits.withColumns({"validation_start": F.lit(None).cast("date"), "validation_end": F.lit(None).cast("date")})
    rows = assign_roles(df.select("date", *features), train).select("split_id", F.explode(pairs).alias("p")).select("split_id", "p.*").where("_x IS NOT NULL AND _y IS NOT NULL")
    keys = ["split_id", "feature_a", "feature_b"]
    ranked = with_value_ranks(with_value_ranks(rows, "_x", "_a", keys), "_y", "_b", keys)
    return ranked.groupBy(*keys).agg(safe_corr("_a", "_b").alias("spearman_correlation")).where(F.abs("spearman_correlation") >= threshold)


def decisions(df: DataFrame, families: dict[str, str], ret: str, target: str, splits: DataFrame, groups: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """What to do with each feature (`audit.decisions`), on evidence by split; n_redundant counts a pair once in each split."""
    names = list(families)
    df, splits = tables.written(df, "audited"), tables.written(splits, "splits")  # every part of the audit reads both
    stable = stability(predictive(df, names, ret, target, splits)).withColumnsRenamed({"validation_median_ic": "median_ic", "stable_evidence": "has_evidence"})
    pairs = redundancy(df, names, splits, threshold).withColumnsRenamed({"feature_a": "left", "feature_b": "right"})
    return audit.decisions(quality(df, names, splits), stable, pairs, audit.family_ablation(df, families, ret, splits), audit.exposure(df, names, groups), families)
