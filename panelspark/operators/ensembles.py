"""Ensembles of model scores per row key (split_id, symbol, date)."""

from __future__ import annotations

from functools import reduce
from itertools import permutations, product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.expr import average_rank, percent_rank, safe_corr
from panelspark.sources import tables

ROW = ["split_id", "symbol", "date"]


def average(preds: DataFrame) -> DataFrame:
    """Mean score over models that have every row of the split."""
    whole = preds.select(*ROW).distinct().groupBy("split_id").count().withColumnRenamed("count", "n_rows")
    complete = preds.where("y_score IS NOT NULL").groupBy("split_id", "model").agg(F.count(F.lit(1)).alias("n_rows")).join(whole, ["split_id", "n_rows"]).select("split_id", "model")
    return preds.join(F.broadcast(complete), ["split_id", "model"], "left_semi").groupBy(*ROW).agg(F.avg("y_score").alias("y_score"), F.count(F.lit(1)).alias("n_models"))


def rank_average(preds: DataFrame) -> DataFrame:
    ranked = preds.withColumn("_r", percent_rank("y_score", ["split_id", "date", "model"]))
    return ranked.groupBy(*ROW).agg(F.avg("_r").alias("y_score"))


def sensitivity(preds: DataFrame) -> DataFrame:
    """Leaving out one model: rank correlation with the full average, and mean absolute change."""
    by = Window.partitionBy(*ROW)
    rows = preds.withColumns({"_s": F.sum("y_score").over(by), "_k": F.count("y_score").over(by)}).where("_k > 1 AND y_score IS NOT NULL")
    rows = rows.withColumns({"_full": F.col("_s") / F.col("_k"), "_rest": (F.col("_s") - F.col("y_score")) / (F.col("_k") - 1)})
    rows = rows.withColumns({"_a": average_rank("_full", ["split_id", "model"]), "_b": average_rank("_rest", ["split_id", "model"])})
    return rows.groupBy("split_id", "model").agg(safe_corr("_a", "_b").alias("rank_corr"), F.avg(F.abs(F.col("_full") - F.col("_rest"))).alias("mean_change"))


def seed_ensemble(preds: DataFrame) -> DataFrame:
    """Mean score over runs (model is the run) and their dispersion."""
    return preds.groupBy(*ROW).agg(F.avg("y_score").alias("y_score"), F.stddev_pop("y_score").alias("dispersion"), F.count(F.lit(1)).alias("n_runs"))


def seed_summary(preds: DataFrame) -> DataFrame:
    """One row: runs, mean and largest dispersion of a row's scores, the smallest correlation of two runs over the rows both score.

    Runs (model) that give the same scores throughout have collapsed, which is an error. All pairs come from one aggregate.
    """
    runs = sorted(r["model"] for r in preds.select("model").distinct().collect())  # a row a run
    pairs = [(a, b) for i, a in enumerate(runs) for b in runs[i + 1 :]]
    spread = preds.groupBy(*ROW).agg(F.stddev_pop("y_score").alias("d")).agg(F.avg("d").alias("dispersion_mean"), F.max("d").alias("dispersion_max"))
    both = wide(preds, runs).agg(*[safe_corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)], F.count(F.lit(1)).alias("n_rows"))
    least = F.array_min(F.array(*[F.col(f"c{i}") for i in range(len(pairs))]).cast("array<double>"))
    out = both.crossJoin(spread).select(F.lit(len(runs)).alias("n_runs"), "n_rows", "dispersion_mean", "dispersion_max", least.alias("min_pairwise_correlation"))  # one row each
    collapsed = F.lit(len(runs) > 1) & (F.col("dispersion_max") <= 1e-12)
    return out.withColumn("dispersion_max", F.when(collapsed, F.raise_error(F.lit("runs with different seeds gave the same scores")).cast("double")).otherwise(F.col("dispersion_max")))


def wide(preds: DataFrame, models: list[str]) -> DataFrame:
    return preds.groupBy(*ROW).pivot("model", models).agg(F.first("y_score"))


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _clipped(x: Column) -> Column:
    return F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), x))


def _split_ids(preds: DataFrame) -> list:
    return sorted(r[0] for r in preds.select("split_id").distinct().collect())


def calibration_maps(preds: DataFrame, least: int = 20, rounds: int = 25) -> DataFrame:
    """model, cur, a, b (a row a model and split): the logistic curve of the scores of all splits before `cur`, with a penalty of a * a / 2.

    Newton's method for all models and splits at once, an aggregate a round; the driver gets a row a model and
    split. Rows are neither copied nor shuffled: each meets the few curves of the splits after its own and goes
    into their sums at once. Where history has fewer than `least` rows or one class alone, there is no map.
    """
    spark = preds.sparkSession
    scores = preds.where("y_score IS NOT NULL AND y_true IS NOT NULL").select("model", "split_id", "y_score", F.col("y_true").cast("double").alias("p")).persist()
    kind = preds.select("model", "split_id", F.col("split_id").alias("cur")).schema.add("a", "double").add("b", "double")
    splits, have = _split_ids(preds), {}
    for r in scores.groupBy("model", "split_id").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p")).collect():
        have[r["model"], r["split_id"]] = (r["n"], r["p"])
    at = {}
    for model in {m for m, _ in have}:
        n = p = 0
        for before, cur in zip(splits, splits[1:]):  # what a split adds to the history of the next
            n, p = n + have.get((model, before), (0, 0))[0], p + have.get((model, before), (0, 0))[1]
            if n >= least and 0 < p < n:
                at[model, cur] = (0.0, 0.0)
    s, q = F.col("y_score"), _logistic(F.col("a") * F.col("y_score") + F.col("b"))
    gap, weight = q - F.col("p"), q * (1 - q)
    sums = [F.sum(s * gap).alias("ga"), F.sum(gap).alias("gb"), F.sum(weight * s * s).alias("aa"), F.sum(weight * s).alias("ab"), F.sum(weight).alias("bb")]
    for _ in range(rounds if at else 0):
        table = spark.createDataFrame([(m, old, cur, *v) for (m, cur), v in at.items() for old in splits if old < cur], kind)
        moved = 0.0
        for r in scores.join(F.broadcast(table), ["model", "split_id"]).groupBy("model", "cur").agg(*sums).collect():
            a, b = at[r["model"], r["cur"]]
            ga, aa = r["ga"] + a, r["aa"] + 1
            det = max(aa * r["bb"] - r["ab"] ** 2, 1e-12)
            da, db = (r["bb"] * ga - r["ab"] * r["gb"]) / det, (aa * r["gb"] - r["ab"] * ga) / det
            shrink = min(1.0, 10 / max(abs(da), abs(db), 1e-12))
            at[r["model"], r["cur"]] = (a - shrink * da, b - shrink * db)
            moved = max(moved, abs(da), abs(db))
        if moved < 1e-8:
            break
    scores.unpersist()
    return spark.createDataFrame([(*k, *v) for k, v in at.items()], T.StructType([f for f in kind if f.name != "split_id"]))


def calibrate(preds: DataFrame, least: int = 20) -> DataFrame:
    """Adds calibrated: the score on the curve learnt from earlier splits; the clipped score where there is none."""
    maps = calibration_maps(preds, least).withColumnRenamed("cur", "split_id")
    out = preds.join(F.broadcast(maps), ["model", "split_id"], "left")
    return out.withColumn("calibrated", F.when(F.col("a").isNotNull(), _logistic(F.col("a") * F.col("y_score") + F.col("b"))).otherwise(_clipped(F.col("y_score")))).drop("a", "b")


OUTCOMES = ["y_true", "forward_return", "forward_excess_return"]


def _scores(preds: DataFrame, models: list[str]) -> DataFrame:
    """A row a key with its outcomes (absent returns are null) and x, the scores of the models in order."""
    preds = preds.withColumns({c: F.lit(None).cast("double") for c in OUTCOMES[1:] if c not in preds.columns})
    pivoted = preds.groupBy(*ROW, *OUTCOMES).pivot("model", models).agg(F.first("y_score"))
    return pivoted.select(*ROW, *OUTCOMES, F.array(*[F.col(f"`{m}`").cast("double") for m in models]).alias("x"))


def _scaled(rows: DataFrame, maps: DataFrame | None, models: list[str], split: str) -> DataFrame:
    """x on the curves that `split` has."""
    if maps is None:
        return rows
    by_model = maps.groupBy(F.col("cur").alias(split)).agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct("a", "b")))).alias("_maps"))

    def one(i: int, m: str) -> Column:
        x, curve = F.col("x")[i], F.col("_maps")[m]
        return F.when(curve.isNotNull(), _logistic(curve["a"] * x + curve["b"])).otherwise(F.when(x.isNotNull(), _clipped(x)))

    return rows.join(F.broadcast(by_model), split, "left").withColumn("x", F.array(*[one(i, m) for i, m in enumerate(models)])).drop("_maps")


def _dot(x: str, weights: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(x)[i] * w for i, w in enumerate(weights)])


def _moves(w: tuple[float, ...], step: float) -> list[tuple[float, ...]]:
    """The weights and those with up to `step`, or a quarter of it, moved from one model to another."""
    out = [w]
    for (i, j), most in product(permutations(range(len(w)), 2), (step, step / 4)):
        t = min(most, w[j])
        out.append(tuple(x + t if k == i else x - t if k == j else x for k, x in enumerate(w)))
    return out


def _with_before(rows: DataFrame, splits: list) -> DataFrame:
    """Adds before: the rows (date, split_id, x) of the symbol that some later split sees as the one just before; where splits follow each other in time, one."""
    past = Window.partitionBy("symbol").orderBy("date", "split_id").rowsBetween(Window.unboundedPreceding, -1)
    own = F.struct("date", "split_id", "x")
    last = F.array_compact(F.array(*[F.last(F.when(F.col("split_id") == s, own), ignorenulls=True).over(past) for s in splits or [None]]))

    def hidden(e: Column) -> Column:  # from every later split, by a newer row
        return F.exists("_last", lambda f: (f > e) & (f["split_id"] <= F.greatest("split_id", e["split_id"])))

    return rows.withColumn("_last", last).withColumn("before", F.filter("_last", lambda e: ~hidden(e))).drop("_last")


def _candidates(history: DataFrame, splits: list, tried: dict, curves: dict, models: list[str]) -> DataFrame:
    """split_id, cur, w (weight vectors), curves (a, b of each model): a row a pair of splits."""
    kind = history.select("split_id", F.col("split_id").alias("cur")).schema
    kind = kind.add("w", T.ArrayType(T.ArrayType(T.DoubleType()))).add("curves", T.ArrayType(T.ArrayType(T.DoubleType())))
    found = {cur: [curves.get((m, cur)) for m in models] for cur in tried}
    return history.sparkSession.createDataFrame([(old, cur, [list(w) for w in ws], found[cur]) for cur, ws in tried.items() for old in splits if old < cur], kind)


def _on_curve(x: Column, i: int) -> Column:
    """A score of the i-th model on its curve, clipped where it has none."""
    curve = F.col("curves")[i]
    return F.when(curve.isNotNull(), _logistic(curve[0] * x + curve[1])).otherwise(_clipped(x))


def _rank_ics(ranked: DataFrame, wanted: set, known: dict) -> None:
    """Adds to `known` the rank correlation with excess returns of each wanted (split, weights); it is the same for every later split."""
    new = sorted(wanted - known.keys())
    if not new:
        return
    kind = ranked.select("split_id").schema.add("c", T.IntegerType()).add("w", T.ArrayType(T.DoubleType()))
    table = ranked.sparkSession.createDataFrame([(s, c, list(w)) for c, (s, w) in enumerate(new)], kind)
    count = len(new[0][1])
    scored = ranked.join(F.broadcast(table), "split_id").select("c", "_b", _dot("x", [F.col("w")[i] for i in range(count)]).alias("s"))
    found = {r["c"]: r["ic"] for r in scored.withColumn("_a", average_rank("s", ["c"])).groupBy("c").agg(safe_corr("_a", "_b").alias("ic")).collect()}
    known.update({key: found.get(c) for c, key in enumerate(new)})


def _objectives(history: DataFrame, ranked: DataFrame | None, ics: dict, splits: list, tried: dict, curves: dict, models: list[str], turnover: float, dispersion: float) -> dict:
    """The objective of each weight vector tried for each split: loss, its spread over earlier splits, mean change of a symbol's score.

    Sums are taken by pairs of splits where the rows are and put together over the earlier splits in the driver.
    """
    k = len(models)
    rows = history.join(F.broadcast(_candidates(history, splits, tried, curves, models)), "split_id")  # a row a pair of splits
    rows = rows.withColumn("_p", F.array_max(F.filter("before", lambda e: e["split_id"] < F.col("cur")))["x"])
    at = (lambda x, i: F.col(x)[i]) if ranked is not None else (lambda x, i: _on_curve(F.col(x)[i], i))
    rows = rows.withColumns({**{f"_now{i}": at("x", i) for i in range(k)}, **{f"_then{i}": F.when(F.col("_p").isNotNull(), at("_p", i)) for i in range(k)}})
    rows = rows.select("cur", "split_id", "y_true", "_p", *[f"_now{i}" for i in range(k)], *[(F.col(f"_now{i}") - F.col(f"_then{i}")).alias(f"_d{i}") for i in range(k)], F.posexplode("w").alias("c", "v"))

    def dot(x: str) -> Column:
        return reduce(lambda a, b: a + b, [F.col(f"{x}{i}") * F.col("v")[i] for i in range(k)])

    sums = [F.count(F.lit(1)).alias("n"), F.count("_p").alias("nd"), F.sum(F.abs(dot("_d"))).alias("t")]
    if ranked is None:
        s = _clipped(dot("_now"))
        sums.append(F.sum(-F.ln(F.when(F.col("y_true").cast("int") == 1, s).otherwise(1 - s))).alias("l"))
    else:
        _rank_ics(ranked, {(old, w) for cur, ws in tried.items() for w in ws for old in splits if old < cur}, ics)
    found = {(r["cur"], r["c"], r["split_id"]): r for r in rows.groupBy("cur", "c", "split_id").agg(*sums).collect()}
    out: dict = {}
    for cur, ws in tried.items():
        out[cur] = []
        for c, w in enumerate(ws):
            own = [found[cur, c, old] for old in splits if (cur, c, old) in found]
            if ranked is None:
                values = [(r["n"], r["l"] / r["n"]) for r in own]
            else:
                values = [(1, -ics[old, w]) for old in splits if old < cur and ics[old, w] is not None]
            base = sum(n * v for n, v in values) / sum(n for n, _ in values) if values else 0.0
            mean = sum(v for _, v in values) / len(values) if values else 0.0
            spread = (sum((v - mean) ** 2 for _, v in values) / len(values)) ** 0.5 if values else 0.0
            change = sum(r["t"] or 0.0 for r in own) / max(sum(r["nd"] for r in own), 1)
            out[cur].append(base + dispersion * spread + turnover * change)
    return out


def _learn(rows: DataFrame, maps: DataFrame | None, models: list[str], splits: list, every: list, task: str, least: int, turnover: float, dispersion: float, finest: float = 1 / 64) -> dict:
    """split -> (weights, source) for each of `splits`, learnt on those of `every` before it; the search for all of them runs in step.

    From equal weights, the best shift of weight between two models is taken as long as one helps, else shifts
    get smaller, down to a quarter of `finest`. The rows are kept once, whatever the number of splits; the
    driver gets sums by pairs of splits alone.
    """
    equal = tuple(1 / len(models) for _ in models)
    curves = {(r["model"], r["cur"]): [r["a"], r["b"]] for r in maps.collect()} if maps is not None else {}
    known = rows.where("y_true IS NOT NULL AND NOT exists(x, v -> v IS NULL)")
    history = _with_before(known, every).select("split_id", "y_true", "forward_excess_return", "x", "before").persist()
    ranked = None
    if task != "classification":
        ranked = history.where("forward_excess_return IS NOT NULL").select("split_id", "x", average_rank("forward_excess_return", ["split_id"]).alias("_b")).persist()
    counts = {r["split_id"]: r["count"] for r in history.groupBy("split_id").count().collect()}
    enough = [s for s in splits if sum(n for old, n in counts.items() if old < s) >= least]
    weights, step, ics = dict.fromkeys(enough, equal), dict.fromkeys(enough, 0.25), {}
    while running := [c for c in enough if step[c] >= finest]:
        tried = {c: _moves(weights[c], step[c]) for c in running}
        for c, values in _objectives(history, ranked, ics, sorted(counts), tried, curves, models, turnover, dispersion).items():
            best = min(range(len(values)), key=values.__getitem__)
            if values[best] < values[0] - 1e-9:
                weights[c] = tried[c][best]
            else:
                step[c] /= 16
    history.unpersist()
    if ranked is not None:
        ranked.unpersist()
    return {s: (weights[s], "chronological_constrained") if s in enough else (equal, "equal_weight_insufficient_history") for s in splits}


def stack_weights(preds: DataFrame, models: list[str], task: str = "classification", least: int = 20, turnover: float = 0.01, dispersion: float = 0.1) -> DataFrame:
    """split_id, model, weight, weight_source: not negative, of sum 1, learnt on earlier splits alone.

    They minimise log loss (ranking: the negated mean rank correlation with excess returns), plus `dispersion` times its
    standard deviation over splits, plus `turnover` times the mean absolute change of a symbol's score. Classifiers are calibrated first.
    """
    preds = tables.written(preds, "stacked")  # some dozen jobs read it
    maps = calibration_maps(preds, least) if task == "classification" else None
    every = _split_ids(preds)
    learned = _learn(_scores(preds, models), maps, models, every, every, task, least, turnover, dispersion)
    kind = preds.select("split_id", "model").schema.add("weight", "double").add("weight_source", "string")
    return preds.sparkSession.createDataFrame([(s, m, x, source) for s, (w, source) in learned.items() for m, x in zip(models, w)], kind)


class Chronological(NamedTuple):
    """predictions: keys, outcomes, model, y_score. weights: task, split_id, model, weight, weight_source. sensitivity: task, split_id, model (left out), rank_corr, mean_change."""

    predictions: DataFrame
    weights: DataFrame
    sensitivity: DataFrame


def chronological(preds: DataFrame, least: int = 20, turnover: float = 0.01, dispersion: float = 0.1) -> Chronological:
    """Average, rank average and constrained stack of the models of each task, calibrated and weighted by earlier splits alone.

    Models whose y_true is 0 or 1 throughout are classifiers, others rankers; names with "ensemble" are left
    out. A split combines the models that score all its rows, if there are two or more.
    """
    base = tables.written(preds.where(~F.col("model").contains("ensemble")), "combined")  # some dozen jobs read it
    binary = F.bool_and(F.col("y_true").isNull() | F.col("y_true").isin(0, 1))
    tasks: dict[str, list[str]] = {"classification": [], "ranking": []}
    for r in base.groupBy("model").agg(binary.alias("binary")).orderBy("model").collect():
        tasks["classification" if r["binary"] else "ranking"].append(r["model"])
    parts = []
    for task, models in tasks.items():
        if len(models) < 2:
            continue
        own = base.where(F.col("model").isin(models))
        maps = calibration_maps(own, least) if task == "classification" else None
        filled = [F.count(F.col("x")[i]).alias(f"n{i}") for i in range(len(models))]
        sets: dict[tuple, list] = {}
        for r in _scores(own, models).groupBy("split_id").agg(F.count(F.lit(1)).alias("n"), *filled).orderBy("split_id").collect():
            sets.setdefault(tuple(m for i, m in enumerate(models) if r[f"n{i}"] == r["n"]), []).append(r["split_id"])
        parts += [_combined(own.where(F.col("model").isin(list(of))), maps, list(of), at, task, least, turnover, dispersion) for of, at in sets.items() if len(of) > 1]
    if not parts:
        raise ValueError("no split has two models of a task that score all its rows")
    return Chronological(*[reduce(DataFrame.unionByName, each) for each in zip(*parts)])


def _combined(preds: DataFrame, maps: DataFrame | None, models: list[str], splits: list, task: str, least: int, turnover: float, dispersion: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark, rows = preds.sparkSession, _scores(preds, models)
    every = sorted(splits)
    learned = _learn(rows, maps, models, every, _split_ids(preds), task, least, turnover, dispersion)
    kind = preds.select("split_id", "model").schema.add("weight", "double").add("weight_source", "string")
    weights = spark.createDataFrame([(s, m, x, source) for s, (w, source) in learned.items() for m, x in zip(models, w)], kind).withColumn("task", F.lit(task))
    by_split = spark.createDataFrame([(s, list(w)) for s, (w, _) in learned.items()], preds.select("split_id").schema.add("w", T.ArrayType(T.DoubleType())))
    now = _scaled(rows.where(F.col("split_id").isin(every)), maps, models, "split_id").join(F.broadcast(by_split), "split_id")
    k = len(models)
    xs = [F.col("x")[i] for i in range(k)]
    now = now.withColumns({f"_x{i}": x for i, x in enumerate(xs)})
    now = now.withColumns({f"_r{i}": percent_rank(f"_x{i}", ["split_id", "date"]) for i in range(k)})
    total = reduce(lambda a, b: a + b, xs)
    stacked = _dot("x", [F.col("w")[i] for i in range(k)])
    methods = {"simple_average": total / k, "rank_average": reduce(lambda a, b: a + b, [F.col(f"_r{i}") for i in range(k)]) / k, "constrained_stack": stacked}
    each = F.explode(F.array(*[F.struct(F.lit(f"{task}_{m}_ensemble").alias("model"), x.alias("y_score")) for m, x in methods.items()])).alias("m")
    predictions = now.select(*ROW, *OUTCOMES, each).select(*ROW, *OUTCOMES, "m.*")
    left_out = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), ((total - xs[i]) / (k - 1)).alias("rest")) for i, m in enumerate(models)])).alias("m")
    long = now.select("split_id", stacked.alias("full"), left_out).select("split_id", "full", "m.*")
    long = long.withColumns({"_a": average_rank("full", ["split_id", "model"]), "_b": average_rank("rest", ["split_id", "model"])})
    sensitivity = long.groupBy("split_id", "model").agg(safe_corr("_a", "_b").alias("rank_corr"), F.avg(F.abs(F.col("full") - F.col("rest"))).alias("mean_change")).withColumn("task", F.lit(task))
    return predictions, weights, sensitivity
