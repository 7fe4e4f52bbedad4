"""Features chosen split by split from training rows alone, with the history of earlier choices."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.expr import percent_rank, safe_corr
from panelspark.operators.audit import long_features
from panelspark.operators.joins import assign_roles
from panelspark.operators.splits import fit_preprocessor, transform

#: Share of the splits so far that a feature was a candidate in, and of its signs that agree, to be stable.
LEAST_FREQUENCY, LEAST_AGREEMENT = 0.6, 2 / 3


def prepared(df: DataFrame, features: Sequence[str], splits: DataFrame, target: str) -> DataFrame:
    """A row a split, role and panel row with a target; features imputed and scaled by the split's training rows."""
    roled = assign_roles(df, splits).where(F.col(target).isNotNull())
    return transform(roled, fit_preprocessor(roled.where("role = 'train'"), features), features)


def fold_profiles(train: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """split_id, feature, score, sign: abs(median daily correlation) * share of days that don't contradict it, and its sign."""
    daily = long_features(train, features, ["split_id", "date", target]).groupBy("split_id", "feature", "date").agg(safe_corr("value", target).alias("d"))
    days = daily.where("d IS NOT NULL").withColumn("m", F.percentile("d", 0.5).over(Window.partitionBy("split_id", "feature")))  # a row a date
    found = days.groupBy("split_id", "feature").agg(F.max("m").alias("m"), F.avg((F.col("d") * F.col("m") >= 0).cast("double")).alias("share"))
    every = daily.select("split_id", "feature").distinct().join(found, ["split_id", "feature"], "left")
    score = F.when(F.col("m") != 0, F.abs("m") * F.col("share"))
    return every.select("split_id", "feature", F.coalesce(score, F.lit(0.0)).alias("score"), F.coalesce(F.signum("m"), F.lit(0.0)).cast("int").alias("sign"))


def candidate_history(profiles: DataFrame, counts: DataFrame) -> DataFrame:
    """The best `feature_count` features of each split, with what the splits so far say of them, ranked for the choice.

    counts: split_id, feature_count. Frequency is the share of splits so far with the feature among the
    candidates, agreement the larger share of its non-zero signs, median_score that of its scores; a later
    split changes nothing of an earlier one.
    """
    best = Window.partitionBy("split_id").orderBy(F.col("score").desc(), "feature")
    seen = counts.select("split_id", F.col("feature_count").cast("long").alias("feature_count"), F.row_number().over(Window.orderBy("split_id")).alias("_seen"))  # a row a split
    chosen = profiles.join(seen, "split_id").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= F.col("feature_count"))
    so_far = Window.partitionBy("feature").orderBy("split_id").rowsBetween(Window.unboundedPreceding, 0)
    up, down = F.count_if(F.col("sign") > 0).over(so_far), F.count_if(F.col("sign") < 0).over(so_far)
    history = chosen.withColumns({
        "frequency": F.count(F.lit(1)).over(so_far) / F.col("_seen"),
        "agreement": F.coalesce(F.try_divide(F.greatest(up, down), up + down), F.lit(0.0)),
        "median_score": F.percentile("score", 0.5).over(so_far),
    })
    ranked = Window.partitionBy("split_id").orderBy(*[F.col(c).desc() for c in ("frequency", "agreement", "median_score", "feature")])
    stable = (F.col("frequency") >= LEAST_FREQUENCY) & (F.col("agreement") >= LEAST_AGREEMENT - 1e-12)
    return history.select("split_id", "feature", "score", "sign", "frequency", "agreement", "median_score", "feature_count", stable.alias("is_stable"), F.row_number().over(ranked).alias("place"))


def fold_correlations(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """split_id, left, right, abs_corr (undefined: 0) of all pairs, in one aggregate for all splits."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    row = train.groupBy("split_id").agg(*[F.coalesce(F.abs(safe_corr(a, b)), F.lit(0.0)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    each = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"c{i}").alias("abs_corr")) for i, (a, b) in enumerate(pairs)])
    return row.select("split_id", F.explode(each).alias("x")).select("split_id", "x.*")


def greedy(ranked: Sequence[str], near: dict[frozenset, float], n: int, threshold: float, start: Sequence[str] = (), fill: bool = True) -> list[str]:
    """The first features of `ranked` that don't reach the threshold with a chosen one, after `start`; then, if too few, the first others."""
    chosen = list(start)
    for f in ranked:
        if len(chosen) < n and f not in chosen and all(near.get(frozenset((f, g)), 0.0) < threshold for g in chosen):
            chosen.append(f)
    for f in ranked if fill else ():
        if len(chosen) < n and f not in chosen:
            chosen.append(f)
    return chosen


def family_order(chosen: Sequence[str], near: dict[frozenset, float], families: dict[str, str]) -> list[str]:
    """Families by name; within one, from the first chosen feature always to the one most correlated with the last."""
    out: list[str] = []
    for family in sorted({families.get(f, "other") for f in chosen}):
        rest = [f for f in chosen if families.get(f, "other") == family]
        line = [rest.pop(0)]
        while rest:
            line.append(max(rest, key=lambda f: (near.get(frozenset((line[-1], f)), 0.0), f)))
            rest.remove(line[-1])
        out += line
    return out


def select_by_fold(df: DataFrame, features: Sequence[str], families: dict[str, str], splits: DataFrame, target: str, counts: DataFrame, n: int, core: int = 6, threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """The manifest (a row a split and chosen feature) and the encoded table of training and validation rows.

    For each split: the best candidates by daily profile on its training rows; of those that are stable over
    the splits so far (of all, if none is) `core` that don't correlate; then `n` from all candidates. The
    table has selected_feature_00 and so on: ranks within the date from -1 to 1. What the driver collects
    has a row a split and feature, or pair of features. Too few candidates in a split are an error.
    """
    rows = prepared(df, features, splits, target)
    train = rows.where("role = 'train'")
    history = candidate_history(fold_profiles(train, features, target), counts).collect()
    near: dict[int, dict[frozenset, float]] = {}
    for r in fold_correlations(train, features).collect():
        near.setdefault(r["split_id"], {})[frozenset((r["left"], r["right"]))] = r["abs_corr"]
    chosen: dict[int, list[str]] = {}
    manifest: list[tuple] = []
    for s in sorted({r["split_id"] for r in history}):
        own = {r["feature"]: r for r in sorted((r for r in history if r["split_id"] == s), key=lambda r: r["place"])}
        ranked, apart = list(own), near.get(s, {})
        kernel = greedy([f for f in ranked if own[f]["is_stable"]] or ranked, apart, min(core, n), threshold)
        picked = greedy(ranked, apart, n, threshold, kernel)
        if len(picked) < n:
            raise ValueError(f"split {s} has fewer than {n} candidates")
        chosen[s] = family_order(picked, apart, families)
        for i, f in enumerate(chosen[s]):
            after = chosen[s][(i + 1) % n]
            r = own[f]
            manifest.append((s, i, f"selected_feature_{i:02d}", f, families.get(f, "other"), r["score"], f in kernel, r["frequency"], r["agreement"], after, apart.get(frozenset((f, after)), 0.0 if f != after else 1.0), r["feature_count"]))
    schema = "split_id long, place int, selected string, feature string, family string, score double, is_core boolean, frequency double, agreement double, next_feature string, next_abs_corr double, feature_count long"
    listed = df.sparkSession.createDataFrame(manifest, schema).join(splits.select("split_id", "train_start", "train_end", "validation_start"), "split_id")
    return listed, encoded(rows, chosen, n, target)


def encoded(rows: DataFrame, chosen: dict[int, list[str]], n: int, target: str) -> DataFrame:
    """The chosen features of each split as ranks within the date, from -1 to 1; missing ones are 0."""
    at = F.create_map(*chain.from_iterable((F.lit(s), F.array(*map(F.lit, fs))) for s, fs in chosen.items())) if chosen else None
    names = sorted({f for fs in chosen.values() for f in fs})

    def source(i: int) -> Column:
        name = F.get(F.element_at(at, F.col("split_id").cast("int")), F.lit(i))
        value = F
        for f in names:
            value = value.when(name == f, F.col(f))
        return value

    picked = rows.where(F.col("split_id").isin(list(chosen))).withColumns({f"_s{i}": source(i) for i in range(n)})
    keys = ["split_id", "role", "date"]
    ranks = picked.withColumns({f"selected_feature_{i:02d}": F.coalesce(2 * percent_rank(f"_s{i}", keys) - 1, F.lit(0.0)) for i in range(n)})
    return ranks.select("symbol", "date", "split_id", "role", (F.col(target) > 0).cast("int").alias("target"), F.col(target).alias("ranking_target"), *[f"selected_feature_{i:02d}" for i in range(n)])
