"""Principal components of each split's training rows, of all features or of groups of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The components that a group of features is meant to have.
COMPONENT_TARGETS = {"raw_price": 2, "returns_momentum": 3, "volatility": 2, "volume_liquidity": 2, "benchmark_relative": 3, "macro": 2, "fundamentals": 1, "other": 1}


def allocate_components(sizes: Mapping[str, int], k: int, rows: int, targets: Mapping[str, int] = COMPONENT_TARGETS) -> dict[str, int]:
    """How many of k components each group gets: its target as far as it has features and rows; then the largest
    groups (first of equals) give up, or groups in turn take, one at a time. Groups left with none are absent."""
    room = {g: min(n, rows) for g, n in sizes.items() if n}
    if not 0 < k <= sum(room.values()):
        raise ValueError(f"{k} components of {sum(room.values())} possible")
    share = {g: min(targets.get(g, 1), most) for g, most in room.items()}
    while sum(share.values()) > k:
        share[max(share, key=lambda g: share[g])] -= 1
        share = {g: n for g, n in share.items() if n}
    while sum(share.values()) < k:
        for g, most in room.items():
            if share.get(g, 0) < most and sum(share.values()) < k:
                share[g] = share.get(g, 0) + 1
    return {g: share[g] for g in room if g in share}


def principal_components(rows: DataFrame, groups: Mapping[str, Sequence[str]], k: int, targets: Mapping[str, int] = COMPONENT_TARGETS, keep: Sequence[str] = ("symbol", "date", "split_id", "role")) -> tuple[DataFrame, DataFrame]:
    """Components of training and validation rows, and the variance that each explains.

    rows: split_id, role and standardised features without nulls (see splits.transform). One aggregate over
    training rows gives the means and products of all splits; the driver takes the eigenvectors of a matrix a
    split and group. A component's largest loading is positive. Columns are <group>_pca_00 and so on; with
    a single group the budget is all its own. Splits with fewer training rows than components are refused.
    """
    names = [f for g in groups.values() for f in g]
    within = [(a, b) for g in groups.values() for i, a in enumerate(g) for b in list(g)[i:]]
    train, n = F.col("role") == "train", F.count_if(F.col("role") == "train")
    only = lambda c: F.when(train, c)
    sums = [F.sum(only(F.col(a) * F.col(b))).alias(f"p{i}") for i, (a, b) in enumerate(within)]
    found = rows.groupBy("split_id").agg(n.alias("train_rows"), F.count_if(F.col("role") == "validation").alias("validation_rows"), *[F.avg(only(F.col(f))).alias(f"m{i}") for i, f in enumerate(names)], *sums).collect()  # a row a split
    loadings, shares = [], []
    for r in sorted(found, key=lambda r: r["split_id"]):
        rows_in = r["train_rows"]
        mean = {f: r[f"m{i}"] for i, f in enumerate(names)}
        product = {x: r[f"p{i}"] for i, x in enumerate(within)}
        budget = allocate_components({g: len(c) for g, c in groups.items()}, k, rows_in, targets)
        for g, wanted in budget.items():
            own = list(groups[g])
            cov = np.zeros((len(own), len(own)))
            for i, a in enumerate(own):
                for j, b in enumerate(own[i:], i):
                    cov[i, j] = cov[j, i] = (product[a, b] - rows_in * mean[a] * mean[b]) / max(rows_in - 1, 1)
            values, vectors = np.linalg.eigh(cov)
            values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
            vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), range(len(own))] < 0, -1, 1)
            ratio = values / (values.sum() or 1.0)
            for i in range(wanted):
                name = f"{g}_pca_{i:02d}"
                weights = dict(zip(own, vectors[:, i].tolist()))
                loadings.append((r["split_id"], name, [weights.get(f, 0.0) for f in names], sum(w * mean[f] for f, w in weights.items())))
                shares.append((r["split_id"], g, name, i, len(own), wanted, rows_in, r["validation_rows"], float(values[i]), float(ratio[i]), float(ratio[: i + 1].sum())))
    spark = rows.sparkSession
    columns = sorted({x[1] for x in loadings}, key=lambda c: [f"{g}_pca_{i:02d}" for g in groups for i in range(len(groups[g]))].index(c))
    table = spark.createDataFrame(loadings, "split_id long, name string, weights array<double>, shift double")
    wide = table.groupBy("split_id").pivot("name", columns).agg(F.first(F.struct("weights", "shift"))) if columns else table.select("split_id")
    vector = F.array(*names)
    project = lambda c: F.aggregate(F.zip_with(vector, F.col(f"{c}.weights"), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x) - F.col(f"{c}.shift")
    out = rows.join(wide, "split_id").select(*keep, *[project(c).alias(c) for c in columns])
    schema = "split_id long, feature_group string, component string, component_index int, n_original_features int, n_components int, train_rows long, validation_rows long, explained_variance double, explained_variance_ratio double, cumulative_explained_variance_ratio double"
    return out, spark.createDataFrame(shares, schema)
