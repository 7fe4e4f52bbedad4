"""Evidence, promotion and comparison tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.expr import finite
from panelspark.operators.joins import pair_metrics
from panelspark.operators.metrics import bootstrap_lower_bound, bootstrap_means, holm, sign_permutation


def composite_rank(summary: DataFrame, metrics: dict[str, bool]) -> DataFrame:
    """Mean of the available ranks over metrics; metrics: name -> larger is better."""
    ranks = {}
    for m, up in metrics.items():
        x = F.col(m)
        order = x.desc() if up else x.asc()
        ranks[f"_r_{m}"] = F.when(x.isNotNull(), F.rank().over(Window.partitionBy(x.isNotNull()).orderBy(order)))
    out = summary.withColumns(ranks)
    total = sum((F.coalesce(F.col(r), F.lit(0)) for r in ranks), F.lit(0))
    n = sum((F.col(r).isNotNull().cast("int") for r in ranks), F.lit(0))
    return out.withColumn("composite_rank", F.try_divide(total, n)).drop(*ranks)


def compare_to_baseline(metrics: DataFrame, baseline: str, value: str, draws: int = 200, seed: int = 42, margin: float = 0.0) -> DataFrame:
    """Per model: mean paired difference, bootstrap interval, permutation p with Holm, and a decision."""
    paired = pair_metrics(metrics.where(F.col(value).isNotNull()), baseline, ["split_id"], value).where("difference IS NOT NULL")
    own = paired.groupBy("model").agg(F.avg("difference").alias("mean_difference"), F.count(F.lit(1)).alias("n_splits"))
    ends = bootstrap_means(paired, ["model"], "difference", "split_id", draws, seed).groupBy("model").agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    p = sign_permutation(paired, ["model"], "difference", "split_id", draws, seed).select("model", "p_value")
    out = holm(own.join(ends, "model").join(p, "model"))
    decision = F.when((F.col("low") > margin) & (F.col("p_holm") < 0.05), "better").when(F.col("high") < -margin, "worse").otherwise("inconclusive")
    return out.withColumn("decision", decision)


def promotion_table(ranking: DataFrame, portfolio: DataFrame, naive: DataFrame, permutation: DataFrame, least_ic: float = 0.02, least_share: float = 0.6, most_p: float = 0.05, most_turnover: float = 0.75, most_drawdown: float = 0.3, least_splits: int = 5) -> DataFrame:
    """Six gates per model, all asked for; a null fails its gate.

    ranking: model, split_id, scope (split or overall), rank_ic. portfolio: model, cumulative_net_excess_return,
    max_drawdown, avg_turnover, plausibility_status, neutralization. naive: model, beats_naive. permutation: model, p_holm.
    """
    overall = ranking.where("scope = 'overall'").select("model", "rank_ic")
    splits = ranking.where("scope = 'split'").groupBy("model").agg(F.avg((F.coalesce("rank_ic", F.lit(0.0)) > 0).cast("double")).alias("positive_share"), F.countDistinct("split_id").alias("n_splits"))
    economics = portfolio.select("model", "cumulative_net_excess_return", "max_drawdown", "avg_turnover", "plausibility_status", "neutralization")
    out = overall.join(splits, "model", "left").join(economics, "model", "left").join(naive.select("model", "beats_naive"), "model", "left").join(permutation.select("model", "p_holm"), "model", "left")
    money = (F.col("cumulative_net_excess_return") > 0) & (F.col("avg_turnover") <= most_turnover) & (F.col("max_drawdown") >= -most_drawdown) & (F.col("plausibility_status") == "passed") & (F.col("neutralization") == "sector_equal_weight")
    gates = {
        "passes_rank_ic": F.col("rank_ic") >= least_ic,
        "passes_stability": F.col("positive_share") >= least_share,
        "passes_split_count": F.col("n_splits") >= least_splits,
        "passes_permutation": F.col("p_holm") <= most_p,
        "passes_naive": F.col("beats_naive"),
        "passes_economics": money,
    }
    out = out.withColumns({g: F.coalesce(x, F.lit(False)) for g, x in gates.items()})
    every = F.lit(True)
    for g in gates:
        every = every & F.col(g)
    return out.withColumn("is_eligible", every).withColumn("decision", F.when(F.col("is_eligible"), "eligible_to_freeze_for_locked_test").otherwise("remain_in_development"))


def regime_leaders(metrics: DataFrame, value: str) -> DataFrame:
    by = Window.partitionBy("regime_type", "regime").orderBy(F.col(value).desc(), "model")
    return metrics.where(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def slice_differences(metrics: DataFrame, model: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One model against every other in the same slice: other, and for each value its own, the other's and own minus other.

    Slices that only one side has give no row; a null on either side gives a null difference.
    """
    own = metrics.where(F.col("model") == model).select(*keys, *[F.col(v).alias(f"{v}_own") for v in values])
    others = metrics.where(F.col("model") != model).select(*keys, F.col("model").alias("other"), *[F.col(v).alias(f"{v}_other") for v in values])
    return own.join(others, list(keys)).withColumns({f"{v}_difference": F.col(f"{v}_own") - F.col(f"{v}_other") for v in values})


def pivot_metrics(long: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return long.groupBy("model").pivot("metric", list(metrics)).agg(F.first("value"))


def stability_promotion(metrics: DataFrame, calibration: DataFrame, configs: DataFrame, tuned: str, fixed: str, value: str, draws: int = 2000, seed: int = 42) -> DataFrame:
    """Whether a tuned model replaces a fixed one: one row of figures, criteria and the decision.

    metrics: model, split_id, value; only splits of both count. calibration: model, split_id, log_loss, brier.
    configs: split_id and the columns of the configuration chosen there. Criteria: a larger mean; positive values in
    two thirds of splits; a bootstrapped lower bound of the gain above 0; log loss at most 0.01 and Brier at most
    0.005 worse; no split with more than 0.6 of the gains; two configurations or more. Null fails.
    """
    gains = pair_metrics(metrics.where(F.col("model").isin(tuned, fixed)), fixed, ["split_id"], value).where("difference IS NOT NULL").withColumn("_one", F.lit(1))
    up = F.greatest(F.col("difference"), F.lit(0.0))
    out = gains.agg(
        F.count(F.lit(1)).alias("n_splits"), F.avg(value).alias("tuned_value"), F.avg("baseline_value").alias("fixed_value"), F.avg((F.col(value) > 0).cast("double")).alias("positive_share"),
        F.coalesce(F.try_divide(F.max(up), F.sum(up)), F.lit(1.0)).alias("largest_share"),
    )
    bound = bootstrap_lower_bound(gains, ["_one"], "difference", "split_id", draws, seed).select("lower_bound")
    at = {m: [F.avg(F.when(F.col("model") == m, F.col(c))) for c in ("log_loss", "brier")] for m in (tuned, fixed)}
    fine = calibration.agg(((at[tuned][0] <= at[fixed][0] + 0.01) & (at[tuned][1] <= at[fixed][1] + 0.005)).alias("is_calibrated"))
    kinds = configs.drop("split_id").distinct().agg(F.count(F.lit(1)).alias("n_configs"))
    out = out.join(bound, how="left").join(fine).join(kinds)  # each has one row
    good = (F.col("tuned_value") > F.col("fixed_value")) & (F.col("positive_share") >= 2 / 3) & (F.col("lower_bound") > 0) & F.col("is_calibrated") & (F.col("largest_share") <= 0.6) & (F.col("n_configs") >= 2)
    return out.withColumn("promoted", F.coalesce(good, F.lit(False)))


def qualify_candidates(metrics: DataFrame, candidates: Sequence[str], controls: Sequence[str], value: str, draws: int = 2000, seed: int = 42) -> DataFrame:
    """Each candidate against the control with the best mean over splits: advantage, its lower bound, and whether it qualifies."""
    base = metrics.where(F.col("model").isin(list(controls)))
    best = base.groupBy("model").agg(F.avg(value).alias("m")).agg(F.min_by("model", F.struct(-F.round("m", 9), "model")).alias("best_control"), F.max("m").alias("control_value"))
    matched = base.join(F.broadcast(best), F.col("model") == F.col("best_control")).select("split_id", F.col(value).alias("_control"))  # best: one row
    rows = metrics.where(F.col("model").isin(list(candidates)))
    paired = rows.join(matched, "split_id").select("model", "split_id", (F.col(value) - F.col("_control")).alias("advantage"))
    own = rows.groupBy("model").agg(F.avg(value).alias("mean_value"), F.avg((F.coalesce(value, F.lit(0.0)) > 0).cast("double")).alias("positive_share"), F.count(F.lit(1)).alias("n_splits"))
    out = own.join(bootstrap_lower_bound(paired, ["model"], "advantage", "split_id", draws, seed), "model", "left").join(F.broadcast(best))
    beats = F.col("mean_value") > F.col("control_value")
    good = (F.col("n_splits") >= 2) & (F.col("mean_value") > 0) & (F.col("positive_share") >= 2 / 3) & beats & (F.col("lower_bound") > 0)
    return out.withColumns({"beats_control": beats, "is_eligible": F.coalesce(good, F.lit(False))})


#: Limits of a training run's figures.
GRADIENT_FLOOR, GRADIENT_CEILING, VOLATILITY_CEILING, NORM_CEILING, GAP_CEILING = 1e-5, 5.0, 0.2, 10.0, 0.05


def run_stability(history: DataFrame, losses: DataFrame) -> DataFrame:
    """Runs ranked by stability, validation loss, spread of loss changes and name, with what went wrong.

    history: run, step, loss, gradient_norm, parameter_norm. losses: run, train_loss, validation_loss. A null or
    infinite figure counts as non-finite.
    """
    by = Window.partitionBy("run").orderBy("step")
    rows = history.withColumn("_c", F.col("loss") - F.lag("loss").over(by))
    bad = [finite(c).isNull() for c in ("loss", "gradient_norm", "parameter_norm")]
    out = rows.groupBy("run").agg(
        F.min_by("loss", "step").alias("initial_loss"), F.max_by("loss", "step").alias("final_loss"), F.coalesce(F.stddev_pop("_c"), F.lit(0.0)).alias("loss_volatility"), F.percentile("gradient_norm", 0.5).alias("median_gradient"),
        F.max("gradient_norm").alias("largest_gradient"), F.max("parameter_norm").alias("largest_norm"), F.bool_or(bad[0] | bad[1] | bad[2]).alias("_bad"),
    )
    out = out.join(losses, "run", "left").withColumn("overfit_gap", F.col("validation_loss") - F.col("train_loss"))
    modes = F.array_compact(F.array(
        F.when(F.col("_bad"), "non_finite"),
        F.when(F.col("median_gradient") < GRADIENT_FLOOR, "vanishing_gradient"),
        F.when(F.col("largest_gradient") > GRADIENT_CEILING, "exploding_gradient"),
        F.when(F.col("loss_volatility") > VOLATILITY_CEILING, "unstable_loss"),
        F.when(F.col("largest_norm") > NORM_CEILING, "parameter_growth"),
        F.when(F.col("overfit_gap") > GAP_CEILING, "overfitting"),
    ))
    out = out.withColumns({"is_stable": F.size(modes) == 0, "failure_modes": F.when(F.size(modes) == 0, "none").otherwise(F.array_join(modes, ","))}).drop("_bad")
    place = F.row_number().over(Window.orderBy(F.col("is_stable").desc(), F.round("validation_loss", 9).asc_nulls_last(), F.round("loss_volatility", 9), "run"))  # a row a run
    return out.withColumn("place", place)


def failure_counts(runs: DataFrame) -> DataFrame:
    """How many runs have each failure mode."""
    return runs.where("failure_modes <> 'none'").select(F.explode(F.split("failure_modes", ",")).alias("failure_mode")).groupBy("failure_mode").agg(F.count(F.lit(1)).alias("n_runs"))


def against_naive(metrics: DataFrame, naive: Sequence[str], value: str, margin: float = 0.0) -> DataFrame:
    """Each model's mean against the best naive model's, with a verdict."""
    means = metrics.groupBy("model").agg(F.avg(value).alias("mean_value"))
    best = means.where(F.col("model").isin(list(naive))).agg(F.max_by("model", F.struct(F.round("mean_value", 9), "model")).alias("best_naive"), F.max("mean_value").alias("naive_value"))
    out = means.where(~F.col("model").isin(list(naive))).crossJoin(F.broadcast(best)).withColumn("margin", F.col("mean_value") - F.col("naive_value"))
    return out.withColumn("verdict", F.when(F.col("margin") > margin, "beats_naive").otherwise("no_evidence"))


def compare_ensembles(overall: DataFrame, splits: DataFrame, outcome: DataFrame, ensembles: dict[str, str | None], value: str) -> DataFrame:
    """Each ensemble against the best single model and its equal-weight partner, with what it earned.

    overall: model, value; splits: model, split_id, value; outcome: model, cumulative_net_excess_return, max_drawdown.
    ensembles: name -> its equal-weight partner. It improves if its value is larger than the best single one, it
    wins 0.6 of the splits and its net excess is above 0; null fails.
    """
    named = list(ensembles)
    single = overall.where(~F.col("model").isin(named)).agg(F.min_by("model", F.struct(-F.round(value, 9), "model")).alias("best_single"), F.max(value).alias("best_single_value"))
    partner = F.coalesce(F.lit(None).cast("string"), *[F.when(F.col("model") == e, F.lit(p)) for e, p in ensembles.items() if p])
    equal = overall.select(F.col("model").alias("_partner"), F.col(value).alias("_equal"))
    rows = overall.where(F.col("model").isin(named)).select("model", F.col(value).alias("_own"), partner.alias("_partner")).join(equal, "_partner", "left").join(F.broadcast(single))  # single: one row
    base = splits.join(F.broadcast(single), F.col("model") == F.col("best_single")).select("split_id", F.col(value).alias("_single"))
    both = splits.where(F.col("model").isin(named)).join(base, "split_id").where(F.col(value).isNotNull() & F.col("_single").isNotNull())
    wins = both.groupBy("model").agg(F.avg((F.col(value) > F.col("_single")).cast("double")).alias("win_share"))
    out = rows.join(wins, "model", "left").join(outcome.select("model", "cumulative_net_excess_return", "max_drawdown"), "model", "left")
    improves = (F.col("_own") > F.col("best_single_value")) & (F.col("win_share") >= 0.6) & (F.col("cumulative_net_excess_return") > 0)
    return out.select("model", F.col("_own").alias(value), "best_single", "best_single_value", (F.col("_own") - F.col("best_single_value")).alias("delta_single"), (F.col("_own") - F.col("_equal")).alias("delta_equal"), "win_share", "cumulative_net_excess_return", "max_drawdown", F.coalesce(improves, F.lit(False)).alias("improves_after_costs"))


def resource_summary(lanes: dict[str, DataFrame]) -> DataFrame:
    """Mean seconds and peak memory of each lane's models. Rows: model, runtime_seconds, peak_memory_mb."""
    from functools import reduce

    rows = [df.select(F.lit(lane).alias("lane"), "model", "runtime_seconds", "peak_memory_mb") for lane, df in lanes.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("lane", "model").agg(F.avg("runtime_seconds").alias("runtime_seconds"), F.avg("peak_memory_mb").alias("peak_memory_mb"))


def lane_leaders(metrics: DataFrame) -> DataFrame:
    """Per lane, the best model and the best one of the reference family, by AUC plus rank IC (null is 0; ties by name).

    metrics: lane, model, is_reference, roc_auc, rank_ic.
    """
    score = F.round(F.coalesce("roc_auc", F.lit(0.0)) + F.coalesce("rank_ic", F.lit(0.0)), 9)
    order = F.struct(-score, F.col("model"))
    return metrics.groupBy("lane").agg(F.min_by("model", order).alias("leader"), F.min_by(F.when(F.col("is_reference"), F.col("model")), F.when(F.col("is_reference"), order)).alias("reference_leader"))


def two_lane_claims(metrics: DataFrame, paired: DataFrame, outcome: DataFrame, lane: str, candidates: Sequence[str], locked: bool, least_gain: float = 0.01) -> DataFrame:
    """Per candidate and baseline: gains in rank IC and net excess of the lane, and whether three gains agree on an opened locked test.

    metrics: lane, model, rank_ic. paired: model, baseline, mean_difference, decision ("material_difference" when
    significant and large). outcome: lane, model, cumulative_net_excess_return. Null fails.
    """
    figures = metrics.where(F.col("lane") == lane).select("model", "rank_ic").join(outcome.where(F.col("lane") == lane).select("model", F.col("cumulative_net_excess_return").alias("net")), "model")
    base = figures.select(F.col("model").alias("baseline"), F.col("rank_ic").alias("_ic"), F.col("net").alias("_net"))
    rows = paired.where(F.col("model").isin(list(candidates))).join(figures, "model").join(base, "baseline")
    rows = rows.withColumns({"rank_gain": F.col("rank_ic") - F.col("_ic"), "net_gain": F.col("net") - F.col("_net")})
    good = F.lit(locked) & (F.col("decision") == "material_difference") & (F.col("mean_difference") > 0) & (F.col("rank_gain") >= least_gain) & (F.col("net_gain") > 0)
    return rows.select("model", "baseline", "mean_difference", "decision", "rank_gain", "net_gain", F.coalesce(good, F.lit(False)).alias("is_defensible"))


def baseline_comparison(summary: DataFrame, expected: Sequence[tuple[str, str]]) -> DataFrame:
    """Expected models with their family and figures; missing ones are marked."""
    table = summary.sparkSession.createDataFrame(list(expected), "model string, family string")
    out = table.join(summary, "model", "left")
    return out.withColumn("is_missing", F.coalesce(*[F.col(c).cast("string") for c in summary.columns if c != "model"]).isNull())
