"""Audit of features: quality, stability of distribution, predictive power, redundancy, exposure, decisions.

Features are unpivoted once; every measure is a grouped aggregate of the long table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.expr import average_rank, finite, percent_rank, safe_corr
from panelspark.functions.quantiles import quantiles
from panelspark.operators.joins import assign_roles
from panelspark.operators.metrics import with_value_ranks
from panelspark.sources import tables


def long_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("symbol", "date")) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x")
    return df.select(*keep, each).select(*keep, "x.*")


def quality(df: DataFrame, features: Sequence[str], splits: DataFrame) -> DataFrame:
    """Per split and feature: rows, missing and non-finite rates, symbols covered, stale rate, PSI between roles."""
    long = long_features(df, features)
    long = long.withColumn("stale", (F.col("value") == F.lag("value").over(Window.partitionBy("feature", "symbol").orderBy("date"))).cast("double"))
    rows = assign_roles(long, splits)
    clean = finite("value")
    each = rows.groupBy("split_id", "feature").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.col("value").isNull().cast("double")).alias("missing_rate"),
        F.avg((F.col("value").isNotNull() & clean.isNull()).cast("double")).alias("non_finite_rate"),
        (F.countDistinct(F.when(clean.isNotNull(), F.col("symbol"))) / F.countDistinct("symbol")).alias("symbol_coverage"),
        F.avg("stale").alias("stale_rate"),
        F.avg(F.when(F.col("role") == "validation", clean.isNull().cast("double"))).alias("validation_missing_rate"),
    )
    return each.join(psi(rows), ["split_id", "feature"], "left")


def psi(rows: DataFrame) -> DataFrame:
    """Population stability index of validation against train: train deciles, outer ends open, shares at least 1e-6."""
    rows = rows.withColumn("value", finite("value"))
    deciles = quantiles(rows.where("role = 'train'"), ["split_id", "feature"], "value", [i / 10 for i in range(11)])
    edges = deciles.select("split_id", "feature", F.array_distinct("quantiles").alias("edges"))  # three edges are two distinct values
    edges = edges.where(F.size("edges") >= 3).select("split_id", "feature", F.slice("edges", 2, F.size("edges") - 2).alias("inner"), F.sequence(F.lit(0), F.size("edges") - 2).alias("bins"))
    binned = rows.where("value IS NOT NULL").join(edges, ["split_id", "feature"]).withColumn("bin", F.size(F.filter("inner", lambda e: e < F.col("value"))))
    counts = binned.groupBy("split_id", "feature", "bin").agg(F.count_if(F.col("role") == "train").alias("t"), F.count_if(F.col("role") == "validation").alias("v"))
    every = edges.select("split_id", "feature", F.explode("bins").alias("bin")).join(counts, ["split_id", "feature", "bin"], "left").na.fill(0, ["t", "v"])
    group = Window.partitionBy("split_id", "feature")
    every = every.withColumns({"a": F.greatest(F.lit(1e-6), F.try_divide(F.col("v"), F.sum("v").over(group))), "e": F.greatest(F.lit(1e-6), F.try_divide(F.col("t"), F.sum("t").over(group)))})
    return every.groupBy("split_id", "feature").agg(F.sum((F.col("a") - F.col("e")) * F.ln(F.col("a") / F.col("e"))).alias("psi"))


def predictive(df: DataFrame, features: Sequence[str], ret: str, target: str) -> DataFrame:
    """Per feature and year: mean daily rank IC, pooled rank association with the class, complete pairs."""
    long = long_features(df, features, ["symbol", "date", ret, target]).withColumn("period", F.year("date")).where(F.col("value").isNotNull() & F.col(ret).isNotNull())
    daily = long.withColumns({"_a": average_rank("value", ["feature", "date"]), "_b": average_rank(ret, ["feature", "date"])})
    daily = daily.groupBy("feature", "period", "date").agg(safe_corr("_a", "_b", 3).alias("ic"))
    keys = ["feature", "period"]  # a period is a year of the whole panel: ranks of counted values, range by range
    pooled = with_value_ranks(with_value_ranks(long, "value", "_a", keys), target, "_b", keys)
    pooled = pooled.groupBy("feature", "period").agg(safe_corr("_a", "_b", 3).alias("class_association"), F.count(F.lit(1)).alias("n_pairs"))
    return daily.groupBy("feature", "period").agg(F.avg("ic").alias("rank_ic")).join(pooled, ["feature", "period"])


def stability(pred: DataFrame, least_folds: int = 2, agreement: float = 0.6, size: float = 0.01) -> DataFrame:
    """Per feature: folds, median IC, share of folds with the median's sign, and whether that is evidence."""
    median = F.percentile("rank_ic", 0.5).over(Window.partitionBy("feature"))
    rows = pred.where("rank_ic IS NOT NULL").withColumn("_m", median)
    out = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("folds"), F.max("_m").alias("median_ic"), F.avg((F.signum("rank_ic") == F.signum("_m")).cast("double")).alias("sign_agreement"))
    return out.withColumn("has_evidence", (F.col("folds") >= least_folds) & (F.col("sign_agreement") >= agreement) & (F.abs("median_ic") >= size))


def redundancy(df: DataFrame, features: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """Pairs whose Spearman correlation over complete pairs reaches the threshold; ranks are taken pair by pair."""
    from functools import reduce

    out = []
    for i, a in enumerate(features):
        for b in features[i + 1 :]:
            both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
            ranked = with_value_ranks(with_value_ranks(both.select(F.col(a).alias("_x"), F.col(b).alias("_y")), "_x", "_a"), "_y", "_b")
            out.append(ranked.agg(safe_corr("_a", "_b").alias("rank_corr")).select(F.lit(a).alias("left"), F.lit(b).alias("right"), "rank_corr"))
    return reduce(DataFrame.unionByName, out).where(F.abs("rank_corr") >= threshold)


def family_ablation(df: DataFrame, families: dict[str, str], ret: str, splits: DataFrame) -> DataFrame:
    """Per split and family: validation rank IC of the family alone and of all features, what dropping it costs, and a verdict.

    The score of a row is the sum of its features' daily percentile ranks, each times the feature's mean daily rank IC
    in training (features without one are left out). families: feature -> family. Under 0.005 is no measurable value.
    """
    long = assign_roles(long_features(df, list(families), ["symbol", "date", ret]), splits).withColumn("value", finite("value")).where("value IS NOT NULL")
    keys = ["split_id", "feature", "date"]
    train = long.where((F.col("role") == "train") & F.col(ret).isNotNull())
    train = train.withColumns({"_a": average_rank("value", keys), "_b": average_rank(ret, keys)}).groupBy(*keys).agg(safe_corr("_a", "_b", 3).alias("ic"))
    weights = train.groupBy("split_id", "feature").agg(F.round(F.avg("ic"), 9).alias("weight")).where("weight <> 0")  # a row a split and feature
    names = sorted(set(families.values()))
    cases = F.create_map(*[x for f, g in families.items() for x in (F.lit(f), F.array(F.lit("all"), F.lit(f"only_{g}"), *[F.lit(f"without_{o}") for o in names if o != g]))])
    held = long.where("role = 'validation'").withColumn("_r", percent_rank("value", keys)).join(weights, ["split_id", "feature"])
    held = held.withColumn("case", F.explode(F.element_at(cases, F.col("feature"))))
    scored = held.groupBy("split_id", "case", "date", "symbol").agg(F.round(F.sum(F.col("_r") * F.col("weight")), 9).alias("score"), F.first(ret).alias("_ret")).where("_ret IS NOT NULL")
    case = ["split_id", "case", "date"]
    scored = scored.withColumns({"_a": average_rank("score", case), "_b": average_rank("_ret", case)})
    ic = scored.groupBy(*case).agg(safe_corr("_a", "_b", 3).alias("ic")).groupBy("split_id").pivot("case", ["all", *[f"{k}_{g}" for g in names for k in ("only", "without")]]).agg(F.avg("ic"))
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("family"), F.col(f"only_{g}").alias("family_ic"), F.col("all").alias("all_ic"), (F.col("all") - F.col(f"without_{g}")).alias("drop_delta")) for g in names])).alias("x")
    out = ic.select("split_id", each).select("split_id", "x.*")
    small = F.coalesce(F.abs("drop_delta") < 0.005, F.lit(True))
    return out.withColumn("verdict", F.when(small, "no_measurable_value").when(F.col("drop_delta") > 0, "helps").otherwise("hurts"))


def exposure(df: DataFrame, features: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Per feature and grouping: the range over groups of the mean and of the missing rate; rows without a group don't count."""
    long = long_features(df, features, list(groups)).withColumn("value", finite("value"))
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("group")) for g in groups])).alias("x")
    rows = long.select("feature", "value", each).select("feature", "value", "x.*").where("group IS NOT NULL")
    means = rows.groupBy("feature", "grouping", "group").agg(F.avg("value").alias("m"), F.avg(F.col("value").isNull().cast("double")).alias("missing"))
    return means.groupBy("feature", "grouping").agg((F.max("m") - F.min("m")).alias("exposure_range"), (F.max("missing") - F.min("missing")).alias("missing_range"), F.count(F.lit(1)).alias("n_groups"))


def decisions(quality_rows: DataFrame, stable: DataFrame, redundant: DataFrame, ablation: DataFrame, exposed: DataFrame, families: dict[str, str]) -> DataFrame:
    """What to do with each feature, in this order, with the reason and the evidence of all parts of the audit.

    Insufficient coverage (median validation missing rate above 0.5), retain (stable and not redundant), transform
    (stable but redundant), conditional (signs agree in 0.6 of the folds and the median IC is 0.005), remove.
    """
    family = F.element_at(F.create_map(*[F.lit(x) for pair in families.items() for x in pair]), F.col("feature"))
    q = quality_rows.groupBy("feature").agg(F.percentile("validation_missing_rate", 0.5).alias("validation_missing_rate"), F.percentile("psi", 0.5).alias("median_psi"))
    pairs = redundant.select(F.explode(F.array("left", "right")).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n_redundant"))
    delta = ablation.groupBy("family").agg(F.percentile("drop_delta", 0.5).alias("family_delta"))
    reach = exposed.groupBy("feature").agg(F.max("exposure_range").alias("exposure_range"))
    rows = stable.withColumn("family", family).join(q, "feature", "left").join(pairs, "feature", "left").join(delta, "family", "left").join(reach, "feature", "left").na.fill(0, ["n_redundant"])
    sure = F.coalesce("has_evidence", F.lit(False))
    steps = [
        (F.col("validation_missing_rate") > 0.5, "insufficient_coverage", "median validation missing rate above 0.5"),
        (sure & (F.col("n_redundant") == 0), "retain", "stable and not redundant"),
        (sure, "transform", "stable but redundant"),
        ((F.col("sign_agreement") >= 0.6) & (F.abs("median_ic") >= 0.005), "conditional", "weak evidence"),
    ]
    decision = reason = F
    for test, name, why in steps:
        decision, reason = decision.when(test, name), reason.when(test, why)
    return rows.select("feature", "family", decision.otherwise("remove").alias("decision"), reason.otherwise("no stable evidence").alias("reason"), "median_ic", "sign_agreement", "validation_missing_rate", "median_psi", "n_redundant", "family_delta", "exposure_range")


def audit_features(df: DataFrame, families: dict[str, str], ret: str, target: str, splits: DataFrame, groups: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """The whole audit: quality, predictive power, stability, redundancy, ablation, exposure, and a decision for each feature."""
    names = list(families)
    df, splits = tables.written(df, "audited"), tables.written(splits, "splits")  # every part of the audit reads both
    return decisions(quality(df, names, splits), stability(predictive(df, names, ret, target)), redundancy(df, names, threshold), family_ablation(df, families, ret, splits), exposure(df, names, groups), families)


def feature_scores(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per key and feature: abs(correlation) * share of dates with its sign (0.5 if no date has one, or it is 0) * coverage."""
    by = [*keys, "feature"]
    long = long_features(df, features, [*keys, "date", target]).withColumn("value", finite("value"))
    pooled = long.groupBy(*by).agg(F.coalesce(safe_corr("value", target), F.lit(0.0)).alias("c"), F.avg(F.col("value").isNotNull().cast("double")).alias("coverage"))
    daily = long.groupBy(*by, "date").agg(safe_corr("value", target).alias("d"))
    share = daily.where("d IS NOT NULL").join(pooled, by).where("c <> 0").groupBy(*by).agg(F.avg((F.signum("d") == F.signum("c")).cast("double")).alias("same_sign"))
    out = pooled.join(share, by, "left")
    return out.select(*by, (F.abs("c") * F.coalesce("same_sign", F.lit(0.5)) * F.col("coverage")).alias("score"))


def daily_profile(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """abs(median daily correlation) * share of dates with its sign * coverage, and the sign."""
    long = long_features(df, features, ["date", target])
    coverage = long.groupBy("feature").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("coverage"))
    daily = long.groupBy("feature", "date").agg(safe_corr("value", target, 3).alias("d")).where("d IS NOT NULL")
    daily = daily.withColumn("m", F.percentile("d", 0.5).over(Window.partitionBy("feature")))
    out = daily.groupBy("feature").agg(F.max("m").alias("m"), F.avg((F.signum("d") == F.signum("m")).cast("double")).alias("share")).join(coverage, "feature")
    return out.select("feature", (F.abs("m") * F.col("share") * F.col("coverage")).alias("score"), F.signum("m").cast("int").alias("sign"))


def select_features(df: DataFrame, features: Sequence[str], target: str, budget: int, most_corr: float = 0.8) -> list[str]:
    """Greedy: by daily profile, leaving out what correlates with a chosen one. The tables collected have a row a feature or pair."""
    from panelspark.operators.metrics import correlation_matrix

    order = [r["feature"] for r in daily_profile(df, features, target).orderBy(F.col("score").desc(), "feature").collect()]
    near = {frozenset((r["left"], r["right"])): r["abs_corr"] for r in correlation_matrix(df, order).collect()} if len(order) > 1 else {}
    chosen: list[str] = []
    for f in order:
        if len(chosen) < budget and all(near[frozenset((f, g))] < most_corr for g in chosen):
            chosen.append(f)
    return chosen
