"""A whole walk-forward run in written stages: predictions, ensembles, metrics, evidence, promotion.

Each stage is a Parquet table under the run's folder, which is named by a hash of its configuration, so
that a run that was stopped goes on after the last stage (and the last model of a split) it wrote, and a
changed configuration starts anew. The training rows of all splits are prepared and written once; every
fit reads its part of that table. Fits don't depend on each other: some run at once, as jobs of one session.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.expr import safe_corr
from panelspark.operators import audit, dataset, ensembles, evidence, labels, metrics, models, portfolio, splits
from panelspark.operators.metrics import with_value_ranks

#: (training rows, validation rows, features, target) -> validation rows with y_score.
Learner = Callable[[DataFrame, DataFrame, Sequence[str], str], DataFrame]

#: The configurations that tuned boosting tries. None is all features.
FEATURE_COUNTS, RATES, LEAVES, L2 = (20, 50, None), (0.03, 0.08), (15, 31), (0.0, 0.1)


def linear_rank(train: DataFrame, test: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """A ridge regression's prediction as the score."""
    return models.predict(models.fit_ridge(train, features, target, alpha=1.0), test)


def sector_neutral_rank(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, sector: str = "sector") -> DataFrame:
    """linear_rank less the mean of the date and sector."""
    return models.sector_neutral(linear_rank(train, test, features, target), sector)


def fitted(fit: Callable[..., PipelineModel], **options) -> Learner:
    """A learner of a fit(train, features, target)."""
    return lambda train, test, features, target: models.predict(fit(train, features, target, **options), test)


def rule(score: Callable[[DataFrame], DataFrame]) -> Learner:
    """A learner that learns nothing."""
    return lambda train, test, features, target: score(test)


def weighted_boosting(train: DataFrame, features: Sequence[str], target: str, rounds: int = 500, depth: int = 4, tail: float = 0.2, seed: int = 42) -> PipelineModel:
    """A boosted classifier in which all dates count alike, stopped early on the last dates of its training rows.

    Spark stops when the holdout's loss no longer falls by its tolerance, not after a number of rounds.
    """
    rows = splits.inner_tail(labels.date_weights(train), tail)
    return models.fit_boosting(rows, features, target, rounds=rounds, depth=depth, weight="weight", holdout="is_tail", seed=seed)


def ranked_features(rows: DataFrame, features: Sequence[str], target: str) -> list[str]:
    """By AU10's score, best first; ties by name. A row a feature comes to the driver."""
    found = audit.feature_scores(rows, features, target).collect()
    return [r["feature"] for r in sorted(found, key=lambda r: (-r["score"], r["feature"]))]


def pooled_rank_correlation(scored: DataFrame, target: str) -> float:
    """Of all rows together; -1 where it isn't defined."""
    rows = with_value_ranks(with_value_ranks(scored.select("y_score", target), "y_score", "_a"), target, "_b")
    return rows.agg(F.coalesce(safe_corr("_a", "_b"), F.lit(-1.0))).first()[0]


def tune_boosting(train: DataFrame, features: Sequence[str], target: str, counts: Sequence[int | None] = FEATURE_COUNTS, rates: Sequence[float] = RATES, leaves: Sequence[int] = LEAVES, l2: Sequence[float] = L2, rounds: int = 300, leaf: int = 20, tail: float = 0.2, parallelism: int = 8, seed: int = 42) -> tuple[PipelineModel, dict, list[dict]]:
    """The configuration whose scores have the best rank correlation on the last dates, fitted on all training rows.

    Features are ranked on the earlier dates; each configuration takes the first of them; ties go to fewer
    features, then to the earlier configuration. Afterwards features are ranked on all rows. Returns model,
    choice, and a row a configuration, best first. Spark's trees have no number of leaves and no l2 penalty:
    leaves become the depth that holds as many, and configurations that differ in l2 alone are one fit.
    """
    rows = splits.inner_tail(train.where(F.col(target).isNotNull()), tail)
    early, late = rows.where(~F.col("is_tail")).drop("is_tail"), rows.where("is_tail").drop("is_tail")
    names = ranked_features(early, features, target)
    size = lambda count: len(names) if count is None else max(1, min(count, len(names)))
    grid = [{"config_id": i, "feature_count": size(c), "learning_rate": r, "max_leaf_nodes": n, "l2_regularization": x} for i, (c, r, n, x) in enumerate(product(counts, rates, leaves, l2))]
    fit = lambda rows, names, rate, leaves: models.fit_boosting(rows, names, target, classify=False, rounds=rounds, leaf=leaf, depth=max(1, math.ceil(math.log2(leaves))), rate=rate, seed=seed)
    key = lambda g: (g["feature_count"], g["learning_rate"], math.ceil(math.log2(g["max_leaf_nodes"])))

    def one(k: tuple) -> float:
        return pooled_rank_correlation(models.predict(fit(early, names[: k[0]], k[1], 1 << k[2]), late), target)

    different = list(dict.fromkeys(map(key, grid)))
    with ThreadPool(parallelism) as pool:
        scores = dict(zip(different, pool.map(inheritable_thread_target(train.sparkSession)(one), different, chunksize=1)))
    tried = sorted(({**g, "inner_rank_ic": scores[key(g)]} for g in grid), key=lambda g: (-g["inner_rank_ic"], g["feature_count"], g["config_id"]))
    best = tried[0]
    chosen = ranked_features(train, features, target)[: best["feature_count"]]
    model = fit(train.where(F.col(target).isNotNull()), chosen, best["learning_rate"], best["max_leaf_nodes"])
    return model, {**best, "selected_features": chosen}, [{"rank": i + 1, **g} for i, g in enumerate(tried)]


class Stages:
    """Written tables of a run: each is made once, whatever stopped the run in between."""

    def __init__(self, spark: SparkSession, folder: str, config: Mapping):
        text = json.dumps(config, sort_keys=True, default=str)
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/run-{hashlib.sha256(text.encode()).hexdigest()[:16]}"
        self.made: list[str] = []

    def _is_whole(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not self._is_whole(path):
            make().write.mode("overwrite").parquet(path)
            self.made.append(name)
        return self.spark.read.parquet(path)


#: The stages in order, after the rows and the predictions of each model and split.
STAGES = ("predictions", "ensembles", "classification", "ranking", "portfolio_returns", "portfolio_risk", "ensemble_evidence", "naive_evidence", "permutation", "promotion")


def run(rows: DataFrame, features: Sequence[str], learners: Mapping[str, tuple[Learner, str]], naive: Sequence[str], folder: str, config: Mapping, fraction: float = 0.1, every: int = 1, per_year: float = 252.0, iterations: int = 200, block: int = 1, parallelism: int = 8) -> dict[str, DataFrame]:
    """The tables of a run by stage. rows: symbol, date, split_id, role, sector, the features, the targets,
    forward_return and forward_excess_return, of all splits (see selection.prepared).

    learners: name -> learner and the target that it learns, which is y_true in its predictions. `config` names the data and the settings: with the other arguments it is the identity of the run. A
    model's predictions are those of validation rows; ensembles of them use earlier splits alone.
    """
    spark = rows.sparkSession
    whole = {**config, "features": list(features), "models": {name: target for name, (_, target) in learners.items()}, "naive": list(naive), "fraction": fraction, "every": every, "per_year": per_year, "iterations": iterations, "block": block}
    stages = Stages(spark, folder, whole)
    table = stages.table("rows", lambda: rows)
    ids = sorted(r["split_id"] for r in table.select("split_id").distinct().collect())  # a row a split

    def one(fold: tuple[int, str]) -> DataFrame:
        s, name = fold
        learner, target = learners[name]

        def make() -> DataFrame:
            own = table.where(F.col("split_id") == s)
            scored = learner(own.where((F.col("role") == "train") & F.col(target).isNotNull()), own.where("role = 'validation'"), features, target)
            return dataset.prediction_table(scored.withColumnRenamed(target, "_y").drop("forward_excess_return"), name, "y_score", "_y").join(own.where("role = 'validation'").select("symbol", "date", "forward_excess_return", "sector"), ["symbol", "date"])

        return stages.table(f"fits/{name}/{s}", make)

    with ThreadPool(parallelism) as pool:
        parts = pool.map(inheritable_thread_target(spark)(one), [(s, name) for s in ids for name in learners], chunksize=1)
    single = stages.table("predictions", lambda: reduce(DataFrame.unionByName, parts))
    # an ensemble row has the sector of its symbol and date
    sectors = single.groupBy("split_id", "symbol", "date").agg(F.min("sector").alias("sector"))
    mixed = stages.table("ensembles", lambda: ensembles.chronological(single).predictions.drop("sector").join(sectors, ["split_id", "symbol", "date"]))
    columns = ["split_id", "symbol", "date", "model", "sector", "y_true", "y_score", "forward_return", "forward_excess_return"]
    preds = single.select(*columns).unionByName(mixed.select(*columns))
    by_date = partial(metrics.ranking_by_date, preds, min(fraction, 0.5))
    out = {"predictions": single, "ensembles": mixed}
    out["classification"] = stages.table("classification", lambda: metrics.with_overall(dataset.binary_models(preds), metrics.classification))
    out["ranking"] = stages.table("ranking", lambda: metrics.ranking_summary(by_date()))
    out["portfolio_returns"] = stages.table("portfolio_returns", lambda: portfolio.backtest(preds, fraction=fraction, every=every, sector="sector"))
    out["portfolio_risk"] = stages.table("portfolio_risk", lambda: portfolio.risk(out["portfolio_returns"], per_year, split=False).withColumn("neutralization", F.lit("sector_equal_weight")))
    overall, by_split = (out["ranking"].where(F.col("scope") == scope) for scope in ("overall", "split"))
    partners = {f"{task}_{m}_ensemble": None if m == "simple_average" else f"{task}_simple_average_ensemble" for task in ("classification", "ranking") for m in ("simple_average", "rank_average", "constrained_stack")}
    out["ensemble_evidence"] = stages.table("ensemble_evidence", lambda: evidence.compare_ensembles(overall.select("model", "rank_ic"), by_split.select("model", "split_id", "rank_ic"), out["portfolio_risk"], partners, "rank_ic"))
    out["naive_evidence"] = stages.table("naive_evidence", lambda: evidence.against_naive(by_split.select("model", "rank_ic"), naive, "rank_ic").withColumn("beats_naive", F.col("verdict") == "beats_naive"))
    out["permutation"] = stages.table("permutation", lambda: metrics.holm(metrics.sign_permutation(by_date().where("rank_ic IS NOT NULL"), ["model"], "rank_ic", "date", iterations, 42, block, two_sided=False)))
    out["promotion"] = stages.table("promotion", lambda: evidence.promotion_table(out["ranking"], out["portfolio_risk"], out["naive_evidence"], out["permutation"]))
    return out
