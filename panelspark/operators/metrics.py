"""Metrics of predictions: classification, ranking, blocks, regimes, correlation, resampling inference.

Predictions: model, split_id, symbol, date, y_true, y_score, forward_return.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.expr import average_rank, finite, hash_draw, safe_corr
from panelspark.operators.splits import date_index, near_equal_block

#: Of gram_diagnostics: cells of the matrix that a pass makes (8 bytes each, in every task), tasks, rows at once, rows of the matrix sent together, labels held.
GRAM_CELLS, GRAM_TASKS, GRAM_ROWS, GRAM_BAND, GRAM_LABELS = 1 << 23, 64, 1024, 64, 1000


def ranking_by_date(preds: DataFrame, fraction: float = 0.1, ret: str = "forward_return") -> DataFrame:
    """Per model, split and date: Pearson and Spearman IC, mean return of both tails, their spread."""
    keys = ["model", "split_id", "date"]
    rows = preds.where(F.col("y_score").isNotNull() & F.col(ret).isNotNull())
    group = Window.partitionBy(*keys)
    rows = rows.withColumns(
        {
            "_rs": average_rank("y_score", keys),
            "_rr": average_rank(ret, keys),
            "_k": F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(group) * F.lit(fraction))),
            "_top": F.row_number().over(group.orderBy(F.col("y_score").desc(), "symbol")),
            "_low": F.row_number().over(group.orderBy(F.col("y_score"), "symbol")),
        }
    )
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        safe_corr("y_score", ret).alias("ic"),
        safe_corr("_rs", "_rr").alias("rank_ic"),
        F.avg(F.when(F.col("_top") <= F.col("_k"), F.col(ret))).alias("top_return"),
        F.avg(F.when(F.col("_low") <= F.col("_k"), F.col(ret))).alias("bottom_return"),
    )
    return out.withColumn("spread", F.when(F.col("n_rows") >= 2, F.col("top_return") - F.col("bottom_return")))


def ranking_summary(by_date: DataFrame) -> DataFrame:
    """Split and overall rows: means over dates."""
    measures = ["ic", "rank_ic", "top_return", "bottom_return", "spread"]
    means = [F.avg(c).alias(c) for c in measures]
    split = by_date.groupBy("model", "split_id").agg(F.count(F.lit(1)).alias("n_dates"), *means)
    overall = by_date.groupBy("model").agg(F.count(F.lit(1)).alias("n_dates"), *means).withColumn("split_id", F.lit(None).cast(by_date.schema["split_id"].dataType))
    return split.withColumn("scope", F.lit("split")).unionByName(overall.withColumn("scope", F.lit("overall")))


def roc_auc(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact, with ties, by rank sums; null with one class."""
    # rows with one score share a rank, so the ranks are summed by score: windows hold distinct scores
    each = preds.groupBy(*keys, "y_score").agg(F.sum("y_true").alias("p"), F.count(F.lit(1)).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("y_score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("r", F.when(F.col("y_score").isNotNull(), F.col("p") * (below + (F.col("n") + 1) / 2)))
    p, n = F.sum("p"), F.sum("n") - F.sum("p")
    return each.groupBy(*keys).agg(F.when((p > 0) & (n > 0), (F.sum("r") - p * (p + 1) / 2) / (p * n)).alias("roc_auc"))


def average_precision(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Step-wise, equal scores together."""
    each = preds.groupBy(*keys, "y_score").agg(F.sum("y_true").alias("p"), F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*keys).orderBy(F.col("y_score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumns({"tp": F.sum("p").over(upto), "all": F.sum("n").over(upto), "total": F.sum("p").over(Window.partitionBy(*keys))})
    return each.groupBy(*keys).agg(F.when(F.max("total") > 0, F.sum(F.col("p") / F.col("total") * F.col("tp") / F.col("all"))).alias("average_precision"))


def classification(preds: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Counts, rates, calibration gap, accuracy, precision, recall (0 on empty), Brier, log loss."""
    y, s = F.col("y_true").cast("double"), F.col("y_score")
    hit = (s >= threshold).cast("double")
    clipped = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), s))
    tp, pos, call = F.sum(y * hit), F.sum(y), F.sum(hit)
    return preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(y).alias("positive_rate"),
        F.avg(hit).alias("predicted_rate"),
        (F.avg(s) - F.avg(y)).alias("calibration_gap"),
        F.avg((y == hit).cast("double")).alias("accuracy"),
        F.coalesce(F.try_divide(tp, call), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, pos), F.lit(0.0)).alias("recall"),
        F.avg(F.pow(s - y, 2)).alias("brier"),
        F.avg(-(y * F.ln(clipped) + (1 - y) * F.ln(1 - clipped))).alias("log_loss"),
    )


def with_overall(preds: DataFrame, metric, keys: Sequence[str] = ("model",), split: str = "split_id") -> DataFrame:
    """A metric per split and pooled over all rows, in one table."""
    each = metric(preds, [*keys, split]).withColumn("scope", F.lit("split"))
    pooled = metric(preds, list(keys)).withColumn(split, F.lit(None).cast(preds.schema[split].dataType)).withColumn("scope", F.lit("overall"))
    return each.unionByName(pooled)


def date_block_auc(preds: DataFrame, days: int) -> DataFrame:
    """AUC on near-equal chronological blocks of about `days` dates; blocks of one class are left out."""
    dates = date_index(preds).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    blocks = dates.select("date", near_equal_block(F.col("i"), F.col("n"), F.ceil(F.col("n") / F.lit(days)).cast("long")).alias("block"))
    return roc_auc(preds.join(F.broadcast(blocks), "date"), ["model", "block"]).where("roc_auc IS NOT NULL")


def by_regime(preds: DataFrame, regimes: DataFrame, columns: Sequence[str], least: int = 50) -> DataFrame:
    """Accuracy, AUC, Brier and log loss per kind of regime, regime and model, from `least` rows on."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("regime_type"), F.col(c).alias("regime")) for c in columns])).alias("x")
    rows = preds.join(F.broadcast(regimes), "date").select(*preds.columns, each).select(*preds.columns, "x.*").where("regime IS NOT NULL")
    keys = ["regime_type", "regime", "model"]
    return classification(rows, keys).where(F.col("n_rows") >= least).join(roc_auc(rows, keys), keys).select(*keys, "n_rows", "accuracy", "roc_auc", "brier", "log_loss")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Absolute correlation of each pair of columns in one pass; undefined ones are 0."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.coalesce(F.abs(safe_corr(a, b)), F.lit(0.0)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"c{i}").alias("abs_corr")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def with_value_ranks(df: DataFrame, value: str, out: str, keys: Sequence[str] = (), parts: int = 200) -> DataFrame:
    """df with out, the rank of value from 1 within keys, ties averaged, null where value is; for groups that one task can't hold.

    Distinct values are counted, then dealt by value to ranges cut at approximate quantiles, and each range
    starts after the counts below it: a window sees one range, whatever rows share a value. Any cuts give the
    same ranks. NaN is a value above all others; keys are not null.
    """
    rows = df.withColumn("_value", F.col(value).cast("double"))
    counts = rows.where("_value IS NOT NULL").groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_n"))
    cuts = sorted(set(counts.where("NOT isnan(_value)").approxQuantile("_value", [i / parts for i in range(1, parts)], 0.5 / parts)))
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c <= F.col("_value")))
    ranged = counts.withColumn("_part", place)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_t"))
    bases = totals.select(*keys, "_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    ranks = ranged.withColumn("_below", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(bases, [*keys, "_part"])
    ranks = ranks.select(*keys, "_value", (F.col("_base") + F.col("_below") + (F.col("_n") + 1) / 2.0).alias(out))
    return rows.join(ranks, [*keys, "_value"], "left").drop("_value")


def bootstrap_means(values: DataFrame, keys: Sequence[str], value: str, order: str, draws: int, seed: int) -> DataFrame:
    """keys, draw, mean of n values drawn with replacement. values: a small table, already aggregated by day or split."""
    by = Window.partitionBy(*keys)
    indexed = values.withColumns({"_i": F.row_number().over(by.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(by)})
    slots = indexed.select(*keys, F.col("_i").alias("slot"), "_n").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    slots = slots.withColumn("_pick", hash_draw(F.col("_n"), seed, "draw", "slot"))
    picked = slots.alias("s").join(indexed.alias("v"), [*[F.col(f"s.{k}") == F.col(f"v.{k}") for k in keys], F.col("s._pick") == F.col("v._i")])
    return picked.groupBy(*[F.col(f"s.{k}").alias(k) for k in keys], F.col("s.draw").alias("draw")).agg(F.avg(f"v.{value}").alias("mean"))


def bootstrap_summary(values: DataFrame, keys: Sequence[str], value: str, order: str, draws: int = 200, seed: int = 42) -> DataFrame:
    """Mean, median, sd of the values and the 95 % interval of their bootstrapped mean."""
    own = values.groupBy(*keys).agg(F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.stddev_samp(value).alias("sd"))
    ends = bootstrap_means(values, keys, value, order, draws, seed).groupBy(*keys).agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    return own.join(ends, list(keys))


def bootstrap_lower_bound(values: DataFrame, keys: Sequence[str], value: str, order: str, draws: int = 2000, seed: int = 42, level: float = 0.025) -> DataFrame:
    """keys, lower_bound: the `level` quantile of bootstrapped means of the finite values; minus infinity under two of them."""
    clean = values.withColumn(value, finite(value))
    n = clean.groupBy(*keys).agg(F.count(value).alias("_n"))
    ends = bootstrap_means(clean.where(F.col(value).isNotNull()), keys, value, order, draws, seed).groupBy(*keys).agg(F.percentile("mean", level).alias("_low"))
    return n.join(ends, list(keys), "left").select(*keys, F.when(F.col("_n") >= 2, F.col("_low")).otherwise(float("-inf")).alias("lower_bound"))


def sign_permutation(values: DataFrame, keys: Sequence[str], value: str, order: str, draws: int, seed: int, block: int = 1, two_sided: bool = True) -> DataFrame:
    """p of the mean under random signs, one sign a block of `block` values; (1 + hits) / (1 + draws)."""
    by = Window.partitionBy(*keys).orderBy(order)
    blocks = values.withColumn("_b", F.floor((F.row_number().over(by) - 1) / block)).groupBy(*keys, "_b").agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_c"))
    signed = blocks.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_sign", 1 - 2 * hash_draw(2, seed, "draw", "_b"))
    null = signed.groupBy(*keys, "draw").agg((F.sum(F.col("_s") * F.col("_sign")) / F.sum("_c")).alias("null_mean"))
    own = values.groupBy(*keys).agg(F.avg(value).alias("observed"))
    joined = null.join(own, list(keys))
    hit = F.abs("null_mean") >= F.abs("observed") - 1e-12 if two_sided else F.col("null_mean") >= F.col("observed") - 1e-12
    return joined.groupBy(*keys).agg(F.max("observed").alias("observed"), F.avg("null_mean").alias("null_mean"), ((F.count_if(hit) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


def holm(df: DataFrame, p: str = "p_value", order: str = "model") -> DataFrame:
    """Step-down adjustment over the rows of a small table."""
    by = Window.orderBy(p, order)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    out = df.withColumn("_p", F.least(F.lit(1.0), F.col(p) * (n - F.row_number().over(by) + 1)))
    return out.withColumn("p_holm", F.max("_p").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_p")


def _gram_sums(batches: Iterator[pa.RecordBatch], d: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Sums over unit vectors of their products of two coordinates (p): p p', rows low to high; with low = 0 also p, p by label, and powers of |p|."""
    a, b = np.triu_indices(d)
    weight = np.where(a == b, 1.0, np.sqrt(2.0))  # so that p . q is the squared cosine
    quartic, every, diagonal = np.zeros((high - low, len(a))), np.zeros(len(a)), np.zeros(3)
    labels: dict[str, np.ndarray] = {}

    def rows(part: str, sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part] * len(sums), pa.string()), pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "key", "sums"])

    for batch in batches:
        for at in range(0, batch.num_rows, GRAM_ROWS):
            piece = batch.slice(at, GRAM_ROWS)
            e = piece.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            p = e[:, a] * e[:, b] * weight
            quartic += p[:, low:high].T @ p
            if low:
                continue
            own = (p * p).sum(1)
            every += p.sum(0)
            diagonal += [len(p), own.sum(), (own * own).sum()]
            names = np.array(piece.column(1).to_pylist(), object)
            for name in {x for x in names if x is not None}:
                labels[name] = labels.get(name, 0.0) + p[names == name].sum(0)
            if len(labels) > GRAM_LABELS:
                yield rows("label", labels)
                labels = {}
    # in bands, so that no task holds whole matrices of all others
    for start in range(0, high - low, GRAM_BAND):
        yield rows("quartic", {str(low + start): quartic[start : start + GRAM_BAND]})
    if not low:
        yield rows("every", {"": every})
        yield rows("diagonal", {"": diagonal})
        yield rows("label", labels)


def _gram_total(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
    part = table.column("part")[0].as_py()
    n, x, y = total if part == "diagonal" else (0.0, float(total @ total), 0.0)
    return pa.table({"part": [part], "n": [float(n)], "x": [float(x)], "y": [float(y)]})


def gram_diagnostics(vectors: DataFrame) -> DataFrame:
    """Squared-cosine similarities of all pairs of vectors: mean and sd off the diagonal, effective rank, alignment with labels.

    No pairs are made: a squared cosine is the product of two rows of d (d + 1) / 2 coordinate products, so sums of
    it are squared norms of summed rows (for the alignment by label), and the sum of its squares is the squared norm
    of the matrix of summed fourth moments. Work grows with the rows; the matrix has about d ** 4 / 4 cells (35 MB
    at 64 dimensions), of which a pass over the table makes GRAM_CELLS at most.

    vec_id is unique. Vectors that are null, hold a null or have no length have no cosines, vectors of different
    lengths none with each other; their cells count in `cells` and, with equal labels, in the alignment.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.transform("embedding", lambda x: x.cast("double")).alias("e"), F.col("label").cast("string").alias("label"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    fine = v.where(norm != 0).select(F.transform("e", lambda x: F.try_divide(x, norm)).alias("e"), "label")
    sums = spark.createDataFrame([], "d int, part string, n double, x double, y double")
    for d in sorted(r["d"] for r in fine.select(F.size("e").alias("d")).distinct().collect()):
        size = d * (d + 1) // 2
        step = max(1, GRAM_CELLS // size)
        own = fine.where(F.size("e") == d).coalesce(GRAM_TASKS)
        for low in range(0, size, step):
            some = own.mapInArrow(lambda it, d=d, low=low, high=min(low + step, size): _gram_sums(it, d, low, high), "part string, key string, sums binary")
            totals = some.groupBy("part", "key").applyInArrow(_gram_total, "part string, n double, x double, y double")
            sums = sums.unionByName(totals.select(F.lit(d).alias("d"), "part", "n", "x", "y"))

    def of(part: str, column: str):
        return F.sum(F.when(F.col("part") == part, F.col(column)))

    by_length = sums.groupBy("d").agg(of("every", "x").alias("k"), of("quartic", "x").alias("kk"), of("label", "x").alias("same"), of("diagonal", "n").alias("n"), of("diagonal", "x").alias("trace"), of("diagonal", "y").alias("tt"))
    total = by_length.agg(F.sum("k").alias("k"), F.sum("kk").alias("kk"), F.sum("same").alias("same"), F.sum("trace").alias("trace"), F.sum("tt").alias("tt"), F.sum(F.col("n") * (F.col("n") - 1)).alias("off"))
    counts = v.groupBy("label").agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), F.sum(F.when(F.col("label").isNotNull(), F.col("c").cast("double") * F.col("c"))).alias("agree"))
    mean = F.try_divide(F.col("k") - F.col("trace"), F.col("off"))
    var = F.try_divide(F.col("kk") - F.col("tt"), F.col("off")) - mean * mean
    return total.crossJoin(counts).select(
        (F.col("rows") * F.col("rows")).alias("cells"), mean.alias("off_diagonal_mean"), F.when(var.isNotNull(), F.sqrt(F.greatest(var, F.lit(0.0)))).alias("off_diagonal_sd"),
        F.try_divide(F.col("trace") * F.col("trace"), F.col("kk")).alias("effective_rank"), F.try_divide(F.col("same"), F.sqrt(F.col("kk") * F.col("agree"))).alias("label_alignment"),
    )
