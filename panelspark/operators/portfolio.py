"""Cost-aware portfolio backtests of predictions, and their risk.

The rebalance counter and the previous weights run across a model's splits; cumulative returns
restart in each split, and the drawdown's peak starts at the first wealth value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def select_names(preds: DataFrame, k: int | None = None, fraction: float | None = None, sector: str | None = None) -> DataFrame:
    """The top k (or fraction, at least one) per model and date, or per sector of it; ties by symbol."""
    keys = ["model", "split_id", "date", *([sector] if sector else [])]
    by = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(by)
    most = F.lit(k) if k is not None else F.greatest(F.lit(1), F.ceil(n * F.lit(fraction)))
    place = F.row_number().over(by.orderBy(F.col("y_score").desc(), "symbol"))
    return preds.where("y_score IS NOT NULL").withColumns({"_place": place, "_most": most}).where("_place <= _most").drop("_place", "_most")


def rebalance_calendar(preds: DataFrame, every: int) -> DataFrame:
    """Each model's periods: every `every`-th of its (date, split) in order, numbered across splits."""
    slots = preds.select("model", "date", "split_id").distinct()
    slots = slots.withColumn("_n", F.row_number().over(Window.partitionBy("model").orderBy("date", "split_id")) - 1)
    return slots.where(F.col("_n") % every == 0).select("model", "date", "split_id", (F.col("_n") / every).cast("long").alias("period"))


def weigh(selected: DataFrame, sector: str | None = None) -> DataFrame:
    """Equal weights of a period, or equal budgets of its sectors and equal weights inside."""
    keys = ["model", "period"]
    if not sector:
        return selected.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    sectors = F.size(F.collect_set(sector).over(Window.partitionBy(*keys)))
    return selected.withColumn("weight", 1.0 / sectors / F.count(F.lit(1)).over(Window.partitionBy(*keys, sector)))


def turnover(weights: DataFrame) -> DataFrame:
    """1 in a model's first period, else half the sum of absolute weight changes over the union of names."""
    now = weights.select("model", "period", "symbol", F.col("weight").alias("w"))
    before = weights.select("model", (F.col("period") + 1).alias("period"), "symbol", F.col("weight").alias("v"))
    periods = weights.select("model", "period").distinct()
    moved = now.join(before, ["model", "period", "symbol"], "full").groupBy("model", "period").agg((F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("v", F.lit(0.0)))) / 2).alias("t"))
    return periods.join(moved, ["model", "period"]).select("model", "period", F.when(F.col("period") == 0, 1.0).otherwise(F.col("t")).alias("turnover"))


def backtest(preds: DataFrame, k: int | None = None, fraction: float | None = None, every: int = 1, cost_bps: float = 10.0, sector: str | None = None) -> DataFrame:
    """A row per model and period: gross, cost, net, benchmark and excess returns, and their running products per split."""
    calendar = rebalance_calendar(preds, every)
    chosen = select_names(preds.join(calendar, ["model", "date", "split_id"]), k, fraction, sector)
    held = weigh(chosen, sector)
    gross = held.groupBy("model", "split_id", "date", "period").agg(
        F.count(F.lit(1)).alias("n_names"),
        F.sum(F.col("weight") * F.col("forward_return")).alias("gross_return"),
        F.sum(F.col("weight") * (F.col("forward_return") - F.col("forward_excess_return"))).alias("benchmark_return"),
    )
    out = gross.join(turnover(held), ["model", "period"]).withColumn("cost", F.col("turnover") * cost_bps / 1e4)
    out = out.withColumn("net_return", F.col("gross_return") - F.col("cost")).withColumn("net_excess_return", F.col("net_return") - F.col("benchmark_return"))
    upto = Window.partitionBy("model", "split_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({f"cumulative_{c}": F.product(1 + F.col(f"{c}_return")).over(upto) - 1 for c in ("gross", "net", "benchmark")})


def risk(returns: DataFrame, per_year: float, split: bool = True) -> DataFrame:
    """Per model (and split): volatility, Sharpe, largest drawdown, extremes, hit rate, turnover, cost and plausibility."""
    keys = ["model", "split_id"] if split else ["model"]
    upto = Window.partitionBy(*keys).orderBy("split_id", "date").rowsBetween(Window.unboundedPreceding, 0)
    wealth = returns.withColumn("_w", F.product(1 + F.col("net_return")).over(upto))
    wealth = wealth.withColumn("_d", F.col("_w") / F.max("_w").over(upto) - 1)
    n, sd = F.count("net_return"), F.stddev_samp("net_return")
    return wealth.groupBy(*keys).agg(
        n.alias("n_periods"),
        (F.product(1 + F.col("net_return")) - 1).alias("cumulative_return"),
        (F.product(1 + F.col("net_return")) - F.product(1 + F.col("benchmark_return"))).alias("cumulative_net_excess_return"),
        F.count_if(F.abs("net_return") > 1).alias("n_over_100pct"),
        F.when(F.count_if(F.abs("net_return") > 1) > 0, "invalid_extreme_period_return").otherwise("passed").alias("plausibility_status"),
        F.when(n >= 2, sd * per_year**0.5).alias("volatility"),
        F.when((n >= 2) & (sd > 1e-12), F.avg("net_return") / sd * per_year**0.5).alias("sharpe"),
        F.min("_d").alias("max_drawdown"),
        F.max("net_return").alias("best"),
        F.min("net_return").alias("worst"),
        F.avg((F.col("net_return") > 0).cast("double")).alias("hit_rate"),
        F.avg("turnover").alias("avg_turnover"),
        F.sum("cost").alias("total_cost"),
    )


def rolling_sharpe(returns: DataFrame, w: int, per_year: float, least: int = 5) -> DataFrame:
    frame = Window.partitionBy("model").orderBy("split_id", "date").rowsBetween(-(w - 1), 0)
    sd = F.stddev_samp("net_return").over(frame)
    return returns.select("model", "split_id", "date", F.when((F.count("net_return").over(frame) >= least) & (sd > 1e-12), F.avg("net_return").over(frame) / sd * per_year**0.5).alias("rolling_sharpe"))


def valuation_metrics(values: DataFrame, keys: list[str]) -> DataFrame:
    """Per account: return from first to last equity, largest drawdown, mean exposure."""
    upto = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    v = values.withColumn("_d", F.try_divide(F.col("equity"), F.max("equity").over(upto)) - 1)
    return v.groupBy(*keys).agg((F.try_divide(F.max_by("equity", "date"), F.min_by("equity", "date")) - 1).alias("cumulative_return"), F.min("_d").alias("max_drawdown"), F.avg(F.try_divide(F.col("gross_exposure"), F.col("equity"))).alias("avg_exposure"), F.count(F.lit(1)).alias("n_days"))
