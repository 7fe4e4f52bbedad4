"""Rankers and learners on Spark ML, with the penalties that scikit-learn's parameters mean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.expr import average_rank, safe_corr


def momentum_rank(df: DataFrame, horizons: Sequence[int] = (20, 10, 5, 1)) -> DataFrame:
    """The longest return there is as the score."""
    column = next(f"return_{h}d" for h in horizons if f"return_{h}d" in df.columns)
    return df.withColumn("y_score", F.col(column))


def sign_rank(df: DataFrame, column: str = "return_1d") -> DataFrame:
    return df.withColumn("y_score", F.signum(column))


def random_rank(df: DataFrame) -> DataFrame:
    """The first 12 hex digits of a SHA-256 of symbol|date|split, over 16**12."""
    text = F.concat_ws("|", "symbol", F.col("date").cast("string"), F.col("split_id").cast("string"))
    return df.withColumn("y_score", F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") / float(16**12))


def sector_neutral(df: DataFrame, sector: str = "sector") -> DataFrame:
    group = Window.partitionBy("date", F.coalesce(sector, F.lit("unknown")))
    return df.withColumn("y_score", F.col("y_score") - F.avg("y_score").over(group))


def score_latest(model: PipelineModel | str, rows: DataFrame, features: Sequence[str], benchmark: str, name: str = "model", score: str = "probability") -> DataFrame:
    """The rows of the last date, scored by a fitted model (or the folder of a saved one) and ranked from 1, ties by symbol.

    Missing features, an absent benchmark and a missing score are refused. A classifier's score is the probability
    of 1; else score="prediction".
    """
    lost = [c for c in features if c not in rows.columns]
    if lost:
        raise ValueError(f"features are missing: {', '.join(lost)}")
    fitted = PipelineModel.load(model) if isinstance(model, str) else model
    last = rows.agg(F.max("date").alias("_last"))
    latest = rows.join(F.broadcast(last), F.col("date") == F.col("_last")).drop("_last")  # last: one row
    if not latest.where(F.col("symbol") == benchmark).limit(1).count():
        raise ValueError(f"{benchmark} has no row on the last date")
    out = fitted.transform(latest)
    value = vector_to_array("probability")[1] if score == "probability" else F.col(score)
    out = out.select("date", "symbol", value.cast("double").alias("score"), (F.col("symbol") == benchmark).alias("is_benchmark"), F.lit(name).alias("model"))
    if out.where("score IS NULL OR isnan(score)").limit(1).count():
        raise ValueError("a row has no score")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy(F.col("score").desc(), "symbol")))


def _assemble(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def _moments(train: DataFrame, target: str) -> tuple[int, float]:
    n, sd = train.agg(F.count(F.lit(1)), F.stddev_samp(target)).first()
    return n, sd or 1.0


def fit_logistic(train: DataFrame, features: Sequence[str], target: str, c: float = 1.0) -> PipelineModel:
    n, _ = _moments(train, target)
    return Pipeline(stages=[_assemble(features), LogisticRegression(labelCol=target, regParam=1 / (n * c), standardization=False)]).fit(train)


def fit_ridge(train: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0) -> PipelineModel:
    """Spark divides the L2 penalty by the target's sd; so it is multiplied in here."""
    n, sd = _moments(train, target)
    return Pipeline(stages=[_assemble(features), LinearRegression(labelCol=target, regParam=alpha * sd / n, elasticNetParam=0.0, standardization=False)]).fit(train)


def fit_elastic_net(train: DataFrame, features: Sequence[str], target: str, alpha: float = 1e-4, l1: float = 0.5) -> PipelineModel:
    _, sd = _moments(train, target)
    a, b = alpha * l1, alpha * (1 - l1)
    reg = a + b * sd
    return Pipeline(stages=[_assemble(features), LinearRegression(labelCol=target, regParam=reg, elasticNetParam=a / reg, standardization=False)]).fit(train)


def fit_huber(train: DataFrame, features: Sequence[str], target: str, epsilon: float = 1.35, alpha: float = 1e-4) -> PipelineModel:
    n, _ = _moments(train, target)
    return Pipeline(stages=[_assemble(features), LinearRegression(labelCol=target, loss="huber", epsilon=epsilon, regParam=alpha / n, standardization=False)]).fit(train)


def fit_forest(train: DataFrame, features: Sequence[str], target: str, classify: bool = True, trees: int = 300, leaf: int = 10, seed: int = 42) -> PipelineModel:
    kind = RandomForestClassifier if classify else RandomForestRegressor
    return Pipeline(stages=[_assemble(features), kind(labelCol=target, numTrees=trees, minInstancesPerNode=leaf, seed=seed)]).fit(train)


def importances(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))


def fit_boosting(train: DataFrame, features: Sequence[str], target: str, classify: bool = True, rounds: int = 300, leaf: int = 20, depth: int = 5, weight: str | None = None, holdout: str | None = None, seed: int = 42, rate: float = 0.1) -> PipelineModel:
    """weight: a column of row weights; holdout: a boolean column whose rows stop training early."""
    kind = GBTClassifier if classify else GBTRegressor
    learner = kind(labelCol=target, maxIter=rounds, minInstancesPerNode=leaf, maxDepth=depth, seed=seed, stepSize=rate)
    if weight:
        learner.setWeightCol(weight)
    if holdout:
        learner.setValidationIndicatorCol(holdout)
    return Pipeline(stages=[_assemble(features), learner]).fit(train)


def tune_boosting(train: DataFrame, features: Sequence[str], target: str, ret: str, grid: Sequence[dict], tail: float = 0.2) -> tuple[PipelineModel, dict]:
    """The configuration with the best mean daily rank IC on the last dates, refitted on all rows."""
    from panelspark.operators.splits import inner_tail

    rows = inner_tail(train, tail).persist()
    best = max(grid, key=lambda g: (rank_ic(predict(fit_boosting(rows.where(~F.col("is_tail")), features, target, **g), rows.where("is_tail")), ret), -list(grid).index(g)))
    rows.unpersist()
    return fit_boosting(train, features, target, **best), best


def rank_ic(scored: DataFrame, ret: str) -> float:
    rows = scored.where(F.col(ret).isNotNull()).withColumns({"_a": average_rank("y_score", ["date"]), "_b": average_rank(ret, ["date"])})
    return rows.groupBy("date").agg(safe_corr("_a", "_b").alias("ic")).agg(F.coalesce(F.avg("ic"), F.lit(-1.0))).first()[0]


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """y_score: the probability of class 1, or the predicted value."""
    out = model.transform(df)
    score = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.withColumn("y_score", score).drop("features", "rawPrediction", "probability", "prediction")


def pca(train: DataFrame, df: DataFrame, features: Sequence[str], k: int, prefix: str = "pc") -> tuple[DataFrame, list[float]]:
    """Components of standardised training rows for all rows; signs by the largest loading; shares of variance."""
    stats = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)]).first()

    def scaled(rows: DataFrame) -> DataFrame:
        return rows.withColumns({f"_z{i}": F.coalesce((F.col(c) - stats[f"m{i}"]) / (stats[f"s{i}"] or 1.0), F.lit(0.0)) for i, c in enumerate(features)})

    names = [f"_z{i}" for i in range(len(features))]
    model = Pipeline(stages=[_assemble(names), PCA(k=k, inputCol="features", outputCol="_pc")]).fit(scaled(train))
    loadings = model.stages[-1].pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    out = model.transform(scaled(df)).withColumn("_a", vector_to_array("_pc"))
    out = out.withColumns({f"{prefix}{j + 1}": F.col("_a")[j] * signs[j] for j in range(k)})
    return out.drop("features", "_pc", "_a", *names), model.stages[-1].explainedVariance.toArray().tolist()


def grouped_pca(train: DataFrame, df: DataFrame, groups: dict[str, Sequence[str]], k: int) -> DataFrame:
    """One PCA a family; k components are dealt round-robin, largest family first."""
    room = {g: len(c) for g, c in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0]))}
    share = dict.fromkeys(room, 0)
    while sum(share.values()) < min(k, sum(room.values())):
        for g in room:
            if share[g] < room[g] and sum(share.values()) < k:
                share[g] += 1
    for g, n in share.items():
        if n:
            df, _ = pca(train, df, list(groups[g]), n, f"{g}_pc")
    return df


def walk_forward(rows: DataFrame, features: Sequence[str], target: str, models: dict, splits: Sequence[int], parallelism: int = 8) -> DataFrame:
    """Predictions of each model on each split's validation rows. rows: split_id, role and the columns; models: name -> fit(train, features, target).

    Fits of different splits and models don't depend on each other: `parallelism` of them run at once, as jobs of one session,
    the first models' before the others' (so name the slow ones first) and the later splits', which learn from more, before the earlier.
    """
    from functools import reduce
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target

    rows = rows.persist()

    def one(fold: tuple[int, str]) -> DataFrame:
        s, name = fold
        train = rows.where((F.col("split_id") == s) & (F.col("role") == "train") & F.col(target).isNotNull())
        test = rows.where((F.col("split_id") == s) & (F.col("role") == "validation"))
        return predict(models[name](train, features, target), test).withColumn("model", F.lit(name))

    with ThreadPool(parallelism) as pool:
        out = pool.map(inheritable_thread_target(rows.sparkSession)(one), [(s, name) for name in models for s in sorted(splits, reverse=True)], chunksize=1)
    return reduce(lambda a, b: a.unionByName(b), out)
