"""Forward-looking labels, their integrity, diagnostics and residuals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.expr import average_rank, percent_rank, rolling, safe_corr, series
from panelspark.operators.joins import join_benchmark


def forward_labels(prices: DataFrame, horizons: Sequence[int], benchmark: str, sector: str | None = None, neutral: float = 0.01, vol_window: int = 20) -> DataFrame:
    """A row per symbol, date and horizon: forward return, excess over the benchmark, normalised excess, ranks, classes.

    All horizons come from one window pass over the price table.
    """
    by = series()
    daily = F.try_divide(F.col("close"), F.lag("close").over(by)) - 1
    wide = prices.withColumns({"_daily": daily, **{f"_f{h}": F.try_divide(F.lead("close", h).over(by), F.col("close")) - 1 for h in horizons}})
    wide = join_benchmark(wide, benchmark, ["_daily", *[f"_f{h}" for h in horizons]], "_b")
    excess = F.col("_daily") - F.col("_b_daily")
    wide = wide.withColumn("_vol", rolling(F.stddev_samp, excess, vol_window, max(2, vol_window // 2)))
    keep = ["symbol", "date", *([sector] if sector else []), "_vol"]
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("label_horizon_days"), F.col(f"_f{h}").alias("forward_return"), F.col(f"_b_f{h}").alias("benchmark_forward_return")) for h in horizons])).alias("x")
    out = wide.select(*keep, each).select(*keep, "x.*").withColumn("forward_excess_return", F.col("forward_return") - F.col("benchmark_forward_return"))
    e = F.col("forward_excess_return")
    new = {
        "normalized_excess_return": F.try_divide(e, F.col("_vol") * F.sqrt(F.col("label_horizon_days"))),
        "excess_rank": percent_rank("forward_excess_return", ["label_horizon_days", "date"]),
        "outperform": F.when(e > 0, 1).when(e.isNotNull(), 0),
        "neutral_outperform": F.when(e > neutral, 1).when(e < -neutral, 0),
    }
    if sector:
        group = ["label_horizon_days", "date", sector]
        new["sector_relative_return"] = F.col("forward_return") - F.avg("forward_return").over(Window.partitionBy(*group))
        new["sector_excess_rank"] = percent_rank("forward_excess_return", group)
    return out.withColumns(new).drop("_vol")


def integrity_flags(labels: DataFrame, column: str, impossible: float = -1.0, absolute: float = 1.0, z_limit: float = 8.0) -> DataFrame:
    """Robust z per date and a status; later rules override: missing, cross-section, absolute, impossible, passed."""
    day = Window.partitionBy("date")
    out = labels.withColumn("_median", F.median(column).over(day)).withColumn("_mad", F.median(F.abs(F.col(column) - F.col("_median"))).over(day))
    z = F.try_divide(F.col(column) - F.col("_median"), F.nullif(F.col("_mad") * 1.4826, F.lit(0.0)))
    x = F.col(column)
    status = F.when(x.isNull(), "missing").when(x <= impossible, "impossible").when(F.abs(x) > absolute, "absolute").when(F.abs(F.col("robust_z")) > z_limit, "cross_section").otherwise("passed")
    return out.withColumn("robust_z", z).withColumn("integrity_status", status).withColumn("is_valid", F.col("integrity_status") == "passed").drop("_median", "_mad")


def target_diagnostics(labels: DataFrame, targets: dict[str, str], horizons: Sequence[int], economic: str = "forward_excess_return") -> DataFrame:
    """Per target, horizon and year: rows, missing and positive rates, turnover, autocorrelation, purged-lag rank IC, magnitude.

    labels: a row per symbol, date and label_horizon_days. targets: column -> family; only binary and neutral_zone
    families have a positive rate. Lags count a symbol's non-null rows of the year; the purged lag is the horizon.
    The autocorrelation is the mean over symbols with three values, the rank IC the mean over dates of the rank
    correlation between the purged lag and the economic column. Years without any value are left out.
    """
    keys = ["target", "target_family", "label_horizon_days", "period"]
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(f).alias("target_family"), F.col(t).cast("double").alias("value")) for t, f in targets.items()])).alias("x")
    base = ["symbol", "date", "label_horizon_days", "period", "_economic"]
    long = labels.select("symbol", "date", "label_horizon_days", F.year("date").alias("period"), F.col(economic).alias("_economic"), each).select(*base, "x.*")
    has = F.col("value").isNotNull()
    some = Window.partitionBy(*keys, "symbol", has).orderBy("date")
    purged = F.coalesce(*[F.when(F.col("label_horizon_days") == h, F.lag("value", h).over(some)) for h in horizons])
    long = long.withColumns({"_before": F.when(has, F.lag("value").over(some)), "_purged": F.when(has, purged)})
    moved = F.abs(F.col("value") - F.col("_before"))
    size = F.abs(F.when(has, F.col("_economic")))
    symbols = long.groupBy(*keys, "symbol").agg(
        F.count(F.lit(1)).alias("every"), F.count("value").alias("n"), F.sum("value").alias("total"), F.sum(moved).alias("moved"), F.count(moved).alias("moves"),
        F.sum(size).alias("size"), F.count(size).alias("sizes"), F.when(F.count("value") >= 3, safe_corr("value", "_before")).alias("own"),
    )
    out = symbols.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        (1 - F.sum("n") / F.sum("every")).alias("missing_rate"),
        F.when(F.col("target_family").isin("binary", "neutral_zone"), F.try_divide(F.sum("total"), F.sum("n"))).alias("positive_rate"),
        F.try_divide(F.sum("moved"), F.sum("moves")).alias("turnover"),
        F.avg("own").alias("autocorrelation"),
        F.try_divide(F.sum("size"), F.sum("sizes")).alias("magnitude"),
    ).where("n_rows > 0")
    both = long.where(F.col("_purged").isNotNull() & F.col("_economic").isNotNull())
    both = both.withColumns({"_a": average_rank("_purged", [*keys, "date"]), "_b": average_rank("_economic", [*keys, "date"])})
    ic = both.groupBy(*keys, "date").agg(safe_corr("_a", "_b").alias("ic")).groupBy(*keys).agg(F.avg("ic").alias("rank_ic"))
    return out.join(ic, keys, "left")


def nested_roles(periods: DataFrame, inner: int, column: str = "period") -> DataFrame:
    """Of the periods, the last is outer, the `inner` before it are inner folds, the rest calibration."""
    place = F.dense_rank().over(Window.orderBy(F.col(column).desc()))
    out = periods.withColumn("_n", place)
    return out.withColumn("role", F.when(F.col("_n") == 1, "outer").when(F.col("_n") <= inner + 1, "inner").otherwise("calibration")).withColumn("fold", F.when(F.col("role") == "inner", inner + 2 - F.col("_n"))).drop("_n")


def residualize_one(labels: DataFrame, exposure: str, target: str) -> DataFrame:
    """The case of one numeric exposure, in closed form."""
    day = Window.partitionBy("date")
    both = F.col(exposure).isNotNull() & F.col(target).isNotNull()
    x, y = F.when(both, F.col(exposure)), F.when(both, F.col(target))
    slope = F.when(F.var_pop(x).over(day) > 1e-18, F.covar_pop(x, y).over(day) / F.var_pop(x).over(day))
    fine = both & (F.count(x).over(day) >= 20)
    return labels.withColumn("residual_target", F.when(fine, F.col(target) - F.avg(y).over(day) - slope * (F.col(exposure) - F.avg(x).over(day))))


def relevance_grades(labels: DataFrame, column: str, grades: int = 4) -> DataFrame:
    """Grades 0 to `grades` by percentile of the date, and a dense id of each date."""
    dates = labels.select("date").distinct().withColumn("query_id", F.row_number().over(Window.orderBy("date")))  # a row a date
    graded = labels.withColumn("grade", F.bround(percent_rank(column, ["date"]) * grades).cast("int")).alias("l")
    return graded.join(dates.alias("d"), F.col("l.date").eqNullSafe(F.col("d.date"))).select("l.*", "query_id")


def date_weights(df: DataFrame) -> DataFrame:
    """One over the rows of the date, scaled to mean 1: all dates count alike."""
    every = Window.partitionBy()
    dates = df.groupBy("date").agg(F.count(F.lit(1)).alias("_n"))  # a row a date
    mean = F.sum("_n").over(every) / F.greatest(F.count("date").over(every), F.lit(1))
    weights = dates.select("date", (mean / F.col("_n")).alias("weight"))
    return df.alias("l").join(weights.alias("d"), F.col("l.date").eqNullSafe(F.col("d.date"))).select("l.*", "weight")
