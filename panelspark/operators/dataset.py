"""Modeling datasets and prediction tables: canonical features, membership, labels, roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators import contracts, features, joins


def canonical_features(panel: DataFrame, benchmark: str, ranked: Sequence[str], products: dict[str, tuple[str, str]], check_keys: bool = True) -> DataFrame:
    """Normalised keys, no label columns, market signals, interactions and cross-sections; keys checked."""
    out = contracts.refuse_labels(contracts.normalize_panel(panel))
    if check_keys:
        contracts.assert_unique(out, contracts.KEYS, "features")
    out = features.add_market_signals(out, benchmark)
    return features.add_cross_section(features.add_interactions(out, products), ranked)


def apply_membership(rows: DataFrame, members: DataFrame, columns: Sequence[str] = ("sector", "size_bucket")) -> DataFrame:
    """Rows of members on their dates, with sector and size."""
    return rows.join(members.where("is_member").select("symbol", "date", *columns), ["symbol", "date"])


def modeling_dataset(rows: DataFrame, labels: DataFrame, target: str, names: Sequence[str], start: str | None = None, end: str | None = None, most_missing: float = 0.5) -> DataFrame:
    """Features and a target that isn't null, between two dates, with few enough missing features."""
    kept = contracts.filter_missing(contracts.filter_dates(rows, start, end), names, most_missing)
    return joins.join_labels(kept.select("symbol", "date", *names), labels.select("symbol", "date", target), target)


def role_dataset(sample: DataFrame, split: int, prefix: str, target: str) -> DataFrame:
    """One split's rows with the features of a prefix; rows with a null are refused."""
    names = [c for c in sample.columns if c.startswith(prefix)]
    rows = sample.where(F.col("split_id") == split).select("symbol", "date", "role", target, *names)
    if rows.where(" OR ".join(f"`{c}` IS NULL" for c in [target, *names])).limit(1).count():
        raise ValueError("a feature or the target is null")
    return rows


def prediction_table(scored: DataFrame, model: str, score: str, target: str) -> DataFrame:
    """The standard columns; the one column that starts with forward_return is the return."""
    found = [c for c in scored.columns if c.startswith("forward_return")]
    if len(found) != 1:
        raise ValueError(f"one forward-return column is asked for, there are {found}")
    out = scored.select("symbol", "date", F.col(target).cast("double").alias("y_true"), F.col(score).cast("double").alias("y_score"), F.col(found[0]).cast("double").alias("forward_return"), F.lit(model).alias("model"), "split_id")
    return out.where("y_true IS NOT NULL AND y_score IS NOT NULL AND forward_return IS NOT NULL")


def binary_models(preds: DataFrame) -> DataFrame:
    """Predictions of models whose targets are all 0 or 1."""
    fine = preds.groupBy("model").agg(F.bool_and(F.coalesce(F.col("y_true").isin(0, 1), F.lit(False))).alias("ok")).where("ok")
    return preds.join(F.broadcast(fine.select("model")), "model", "left_semi")  # a row a model


def without_models(preds: DataFrame, excluded: Sequence[str]) -> DataFrame:
    return preds.where(~F.col("model").isin(list(excluded)))


def first_splits(splits: DataFrame, n: int, last: bool = False) -> DataFrame:
    return splits.orderBy(F.col("split_id").desc() if last else F.col("split_id")).limit(n)


def eligible_regimes(regimes: DataFrame, column: str, least: int) -> DataFrame:
    """Regimes with enough rows, with their share."""
    out = regimes.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("regime")).agg(F.count(F.lit(1)).alias("n_rows"))
    out = out.where(F.col("n_rows") >= least)
    return out.withColumn("weight", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()))


def select_targets(diagnostics: DataFrame, baselines: dict[str, tuple[str, int]], margin: float = 0.01, least_periods: int = 2) -> DataFrame:
    """The best target of each role (classification, ranking) over validation periods, against the role's baseline.

    diagnostics: rows of labels.target_diagnostics with their role; those of role calibration are not looked at.
    baselines: role -> (target, horizon). The score is |mean rank IC| less its spread and the missing rate, plus a
    tenth of the class balance; ties go to the shorter horizon, then by name. A target is promoted only if it
    beats the baseline by the margin (or there is none) and passes every stability gate; null fails.
    """
    rows = diagnostics.where(F.col("role").isin("inner", "outer")).groupBy("target", "target_family", "label_horizon_days").agg(
        F.countDistinct("period").alias("periods"),
        F.avg("rank_ic").alias("mean_rank_ic"),
        F.stddev_samp("rank_ic").alias("rank_ic_spread"),
        F.avg("magnitude").alias("mean_magnitude"),
        F.avg("missing_rate").alias("mean_missing_rate"),
        (1 - F.abs(F.avg("positive_rate") - 0.5) * 2).alias("class_balance"),
        F.avg((F.col("rank_ic") > 0).cast("double")).alias("positive_share"),
    )
    zero = F.lit(0.0)
    score = F.coalesce(F.abs("mean_rank_ic"), zero) - F.coalesce("rank_ic_spread", zero) - F.col("mean_missing_rate") + F.coalesce("class_balance", zero) * 0.1
    role = F.when(F.col("target_family").isin("binary", "neutral_zone"), "classification").otherwise("ranking")
    rows = rows.withColumns({"selected_role": role, "selection_score": F.round(score, 9)})
    own = F.lit(False)
    for name, (target, horizon) in baselines.items():
        own = own | ((F.col("selected_role") == name) & (F.col("target") == target) & (F.col("label_horizon_days") == horizon))
    by = Window.partitionBy("selected_role")  # a row a target
    place = F.row_number().over(by.orderBy(F.col("selection_score").desc(), "label_horizon_days", "target"))
    best = rows.withColumns({"baseline_score": F.max(F.when(own, F.col("selection_score"))).over(by), "_place": place}).where("_place = 1").drop("_place")
    improves = F.col("baseline_score").isNull() | (F.col("selection_score") >= F.col("baseline_score") + margin)
    balanced = (F.col("selected_role") != "classification") | F.col("class_balance").isNull() | (F.col("class_balance") >= 0.6)
    stable = (F.col("periods") >= least_periods) & (F.col("mean_missing_rate") <= 0.2) & F.coalesce(F.col("positive_share") >= 0.5, F.lit(False)) & balanced
    out = best.withColumns({"improves": improves, "is_stable": stable})
    return out.withColumn("decision", F.when(F.col("improves") & F.col("is_stable"), "promote_candidate").otherwise("retain_baseline"))


def attach_returns(sample: DataFrame, labels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A sample's rows with the returns of their symbol and date; labels that repeat a key are refused, absent ones are null."""
    contracts.require(labels, [*contracts.KEYS, *columns], "labels")
    contracts.assert_unique(labels, contracts.KEYS, "labels")
    return sample.join(labels.select(*contracts.KEYS, *columns), list(contracts.KEYS), "left")


def train_validation(rows: DataFrame, labels: DataFrame, target: str, train: tuple[str, str], validation: tuple[str, str], names: Sequence[str] | None = None, most_missing: float = 1.0) -> DataFrame:
    """Both datasets as one table with a role; the features of both are the train side's (all its numbers, unless named)."""
    start = contracts.filter_dates(rows, *train)
    names = list(names or contracts.feature_columns(start))
    if not names:
        raise ValueError("no feature columns")
    sides = [modeling_dataset(rows, labels, target, names, *ends, most_missing).withColumn("role", F.lit(role)) for role, ends in (("train", train), ("validation", validation))]
    return sides[0].unionByName(sides[1])
