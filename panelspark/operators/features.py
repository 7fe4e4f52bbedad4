"""Features of a panel: returns, volatility, volume, benchmark-relative, market signals, macro, filings.

All price windows share one partitioning and order, so Spark plans one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.expr import change, percent_rank, rolling, rolling_corr, rolling_pair, series
from panelspark.operators.joins import join_benchmark

ANNUAL = 252


def add_returns(panel: DataFrame, windows: Sequence[int] = (1, 5, 10, 20, 60), price: str = "close") -> DataFrame:
    return panel.withColumns({f"return_{w}d": change(price, w) for w in windows})


def add_volatility(panel: DataFrame, windows: Sequence[int] = (5, 20, 60), value: str = "return_1d", per_year: int = ANNUAL) -> DataFrame:
    return panel.withColumns({f"volatility_{w}d": rolling(F.stddev_pop, value, w) * per_year**0.5 for w in windows})


def add_volume(panel: DataFrame, windows: Sequence[int] = (5, 20, 60), least_dollars: float = 1e6, liquid: int = 20) -> DataFrame:
    """Dollar volume, rolling means, volume over the mean of the w rows before, a flag of liquidity."""
    out = panel.withColumn("dollar_volume", F.col("close") * F.col("volume"))
    new = {f"avg_volume_{w}d": rolling(F.avg, "volume", w) for w in windows}
    new |= {f"avg_dollar_volume_{w}d": rolling(F.avg, "dollar_volume", w) for w in windows}
    new |= {f"volume_shock_{w}d": F.try_divide(F.col("volume"), rolling(F.avg, "volume", w, last=-1)) for w in windows}
    out = out.withColumns(new)
    return out.withColumn("is_liquid", F.coalesce(F.col(f"avg_dollar_volume_{liquid}d") >= least_dollars, F.lit(False)))


def add_benchmark_relative(panel: DataFrame, benchmark: str, windows: Sequence[int] = (20, 60), excess: Sequence[int] = (1, 5, 20)) -> DataFrame:
    """Excess returns, correlation, beta, relative volatility and momentum against the benchmark symbol."""
    wanted = sorted({f"return_{w}d" for w in excess} | {"return_1d"} | {f"{c}_{w}d" for w in windows for c in ("volatility", "return")})
    out = join_benchmark(panel, benchmark, [c for c in wanted if c in panel.columns])
    new = {f"excess_return_{w}d": F.col(f"return_{w}d") - F.col(f"bench_return_{w}d") for w in excess}
    for w in windows:
        new[f"corr_{w}d"] = rolling_corr("return_1d", "bench_return_1d", w)
        new[f"beta_{w}d"] = F.try_divide(rolling_pair(F.covar_pop, "return_1d", "bench_return_1d", w), rolling(F.var_pop, "bench_return_1d", w))
        if f"volatility_{w}d" in panel.columns:
            new[f"relative_volatility_{w}d"] = F.try_divide(F.col(f"volatility_{w}d"), F.col(f"bench_volatility_{w}d"))
        if f"return_{w}d" in panel.columns:
            new[f"relative_momentum_{w}d"] = F.col(f"return_{w}d") - F.col(f"bench_return_{w}d")
    return out.withColumns(new).drop(*[c for c in out.columns if c.startswith("bench_")])


def add_market_signals(panel: DataFrame, benchmark: str, w: int = 20) -> DataFrame:
    """Range, illiquidity, downside volatility, shares of rising days, drawdown, residual momentum, reversals."""
    by = series()
    out = join_benchmark(panel, benchmark, ["return_1d"])
    out = out.withColumns(
        {
            "range_1d": F.try_divide(F.col("high") - F.col("low"), F.lag("close").over(by)),
            "illiquidity": F.try_divide(F.abs("return_1d"), F.nullif(F.col("close") * F.col("volume"), F.lit(0.0))),
            "volume_change_1d": change("volume", 1),
        }
    )
    frame = by.rowsBetween(-(w - 1), 0)
    full = F.count(F.lit(1)).over(frame) >= w

    def share(condition):
        return F.when(full, F.avg(F.coalesce(condition.cast("int"), F.lit(0)).cast("double")).over(frame))

    out = out.withColumns(
        {
            f"downside_volatility_{w}d": rolling(F.stddev_pop, F.when(F.col("return_1d") < 0, F.col("return_1d")), w, w // 2),
            f"positive_share_{w}d": share(F.col("return_1d") > 0),
            f"zero_share_{w}d": share(F.col("return_1d") == 0),
            f"illiquidity_{w}d": rolling(F.avg, "illiquidity", w),
            f"range_{w}d": rolling(F.avg, "range_1d", w),
            f"drawdown_{w}d": F.try_divide(F.col("close"), rolling(F.max, "close", w)) - 1,
            f"return_volume_corr_{w}d": rolling_corr("return_1d", "volume_change_1d", w),
            "_beta": F.try_divide(rolling_pair(F.covar_pop, "return_1d", "bench_return_1d", w), rolling(F.var_pop, "bench_return_1d", w)),
        }
    )
    out = out.withColumn("_residual", F.col("return_1d") - F.col("_beta") * F.col("bench_return_1d"))
    out = out.withColumns({f"residual_momentum_{w}d": rolling(F.sum, "_residual", w), "reversal_1d": -F.col("return_1d"), "reversal_5d": -change("close", 5)})
    return out.drop("_beta", "_residual", "bench_return_1d")


def add_macro(dates: DataFrame, columns: Sequence[str], differences: Sequence[int] = (5, 20, 60), growth: Sequence[int] = (21, 63, 252), spread: tuple[str, str] | None = None) -> DataFrame:
    """Differences and growth over rows of a table with one row a date; a yield spread of two columns, and its differences."""
    by = Window.orderBy("date")
    if spread:
        dates = dates.withColumn("yield_spread", F.col(spread[0]) - F.col(spread[1]))
    new = {f"{c}_diff_{w}": F.col(c) - F.lag(c, w).over(by) for c in [*columns, *(["yield_spread"] if spread else [])] for w in differences}
    new |= {f"{c}_growth_{w}": change(c, w, by) for c in columns for w in growth}
    return dates.withColumns(new)


def lag_features(panel: DataFrame, n: int, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    return panel.select(*keys, *[F.lag(c, n).over(series()).alias(c) for c in panel.columns if c not in keys])


def add_cross_section(panel: DataFrame, columns: Sequence[str], sector: str | None = None) -> DataFrame:
    """Per date: missing flag, average-tie percentile, robust z within 5 (median and MAD), percentile in the sector."""
    day = Window.partitionBy("date")
    out = panel.withColumns({f"_median_{c}": F.median(c).over(day) for c in columns})
    out = out.withColumns({f"_mad_{c}": F.median(F.abs(F.col(c) - F.col(f"_median_{c}"))).over(day) for c in columns})
    new = {}
    for c in columns:
        z = F.try_divide(F.col(c) - F.col(f"_median_{c}"), F.nullif(F.col(f"_mad_{c}") * 1.4826, F.lit(0.0)))
        new[f"{c}_missing"] = F.col(c).isNull().cast("int")
        new[f"{c}_rank"] = percent_rank(c, ["date"])
        new[f"{c}_robust_z"] = F.when(z.isNotNull(), F.greatest(F.lit(-5.0), F.least(F.lit(5.0), z)))
        if sector:
            new[f"{c}_sector_rank"] = F.when(F.col(sector).isNotNull(), percent_rank(c, ["date", sector]))
    return out.withColumns(new).drop(*[f"_{k}_{c}" for k in ("median", "mad") for c in columns])


def add_interactions(df: DataFrame, products: dict[str, tuple[str, str]]) -> DataFrame:
    """Products of an exposure and a regime column; skipped where a column is absent."""
    return df.withColumns({out: F.col(a) * F.col(b) for out, (a, b) in products.items() if {a, b} <= set(df.columns)})


def rank_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percentile ranks of the date, moved to [-1, 1]; null is 0."""
    return df.withColumns({c: F.coalesce(2 * percent_rank(c, ["date"]) - 1, F.lit(0.0)) for c in columns})


def angle_encode(df: DataFrame, columns: Sequence[str], ranks: bool = False) -> DataFrame:
    return df.withColumns({f"{c}_angle": F.pi() * F.col(c) if ranks else 2 * F.atan(c) for c in columns})


def market_regimes(benchmark: DataFrame, rates: DataFrame, w: int = 20, least: int = 20, lag: int = 20, flat: float = 0.0) -> DataFrame:
    """Per date of the benchmark: volatility against the median of earlier ones, direction of rates, shape and trend of the curve.

    rates: date, long_rate, short_rate, a row a date. The level of rates is the mean of those there are; a
    difference of zero has a label of its own, one that can't be formed has none.
    """
    by = Window.orderBy("date")  # a row a date

    def label(x: str, above: str, below: str, even: str, tolerance: float = 0.0):
        return F.when(F.col(x) > tolerance, above).when(F.col(x) < -tolerance, below).when(F.col(x).isNotNull(), even)

    out = benchmark.select("date", (rolling(F.stddev_samp, "return_1d", w, by=by) * ANNUAL**0.5).alias("volatility"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("volatility_threshold", F.when(F.count("volatility").over(before) >= least, F.percentile("volatility", 0.5).over(before)))
    out = out.join(rates, "date", "left").withColumn("rate_level", F.coalesce((F.col("long_rate") + F.col("short_rate")) / 2, "long_rate", "short_rate"))
    out = out.withColumns({"_v": F.col("volatility") - F.col("volatility_threshold"), "rate_change": F.col("rate_level") - F.lag("rate_level", lag).over(by), "yield_spread": F.col("long_rate") - F.col("short_rate")})
    out = out.withColumn("spread_change", F.col("yield_spread") - F.lag("yield_spread", lag).over(by))
    return out.select(
        "date",
        "volatility",
        "volatility_threshold",
        label("_v", "high_volatility", "low_volatility", "normal_volatility").alias("volatility_regime"),
        "rate_level",
        "rate_change",
        label("rate_change", "rising_rates", "falling_rates", "flat_rates").alias("rate_regime"),
        "yield_spread",
        label("yield_spread", "normal_curve", "inverted_curve", "flat_curve", flat).alias("curve_regime"),
        "spread_change",
        label("spread_change", "steepening_curve", "flattening_curve", "unchanged_curve").alias("curve_trend"),
    )


def filing_events(market: DataFrame, events: DataFrame, forms: Sequence[str], windows: Sequence[int] = (5, 20)) -> DataFrame:
    """Days since the last filing of each form and of any form, with flags of recency: one pass for all forms.

    events: symbol, form, filing_date, accession.
    """
    row = F.struct("filing_date", "accession")
    both = events.select("symbol", F.col("filing_date").alias("_time"), F.lit(0).alias("_side"), "form", "accession", row.alias("_event"), F.lit(None).cast("date").alias("date")).unionByName(
        market.select("symbol", F.col("date").alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("form"), F.lit(None).cast(events.schema["accession"].dataType).alias("accession"), F.lit(None).cast(events.select(row.alias("e")).schema["e"].dataType).alias("_event"), "date")
    )
    order = Window.partitionBy("symbol").orderBy("_time", "_side", "form", "accession").rowsBetween(Window.unboundedPreceding, 0)
    new = {f"_last_{f}": F.last(F.when(F.col("form") == f, F.col("_event")), ignorenulls=True).over(order) for f in forms}
    new |= {"_any": F.last("_event", ignorenulls=True).over(order), "last_form": F.last("form", ignorenulls=True).over(order)}
    out = both.withColumns(new).where("_side = 1")
    cols = [F.datediff("date", F.col("_any.filing_date")).alias("days_since_filing"), F.col("_any.accession").alias("last_accession"), "last_form"]
    for f in forms:
        days = F.datediff("date", F.col(f"_last_{f}.filing_date"))
        cols += [days.alias(f"days_since_{f}"), *[F.coalesce(days <= w, F.lit(False)).cast("int").alias(f"recent_{f}_{w}d") for w in windows]]
    return out.select("symbol", "date", *cols)


def filing_facts(facts: DataFrame, concepts: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Wide rows, one a filing: the last value of each concept by end_date; absent concepts are null."""
    for k in keys:
        facts = facts.where(F.col(k).isNotNull())
    return facts.groupBy(*keys).pivot("concept", list(concepts)).agg(F.max_by("value", "end_date"))


def add_growth(filings: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Growth over the last non-null value of the same symbol and fiscal period."""
    by = Window.partitionBy("symbol", "fiscal_period").orderBy("filing_date", "accession")
    return filings.withColumns({f"{c}_growth": F.try_divide(F.col(c), F.last(c, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))) - 1 for c in columns})


def add_ratios(filings: DataFrame, ratios: dict[str, tuple[str, str]]) -> DataFrame:
    return filings.withColumns({name: F.try_divide(F.col(a), F.col(b)) for name, (a, b) in ratios.items()})


def align_rates(dates: DataFrame, rates: DataFrame, columns: Sequence[str], lag_days: int = 0, lag_months: int = 0) -> DataFrame:
    """Observations made available later (by days or months), then carried to trading dates."""
    from panelspark.operators.joins import asof_join

    seen = rates.where(F.coalesce(*columns).isNotNull())
    day = F.add_months(F.date_add("date", lag_days), lag_months) if lag_months else F.date_add("date", lag_days)
    # of observations that become available on one day the last counts
    observed = seen.select(day.alias("available"), F.col("date").alias("_observed"), *columns)
    return asof_join(dates.select("date"), observed, [], "date", "available", ["_observed"]).drop("available", "_observed")


def macro_daily(dates: DataFrame, macro: DataFrame, daily: Sequence[str], monthly: Sequence[str], lag_days: int = 0) -> DataFrame:
    """A row a trading date: daily rates as of it, and monthly series as of a month after their observation."""
    days = dates.select("date").where("date IS NOT NULL").distinct()
    rates = align_rates(days, macro.select("date", *daily), daily, lag_days)
    return rates.join(align_rates(days, macro.select("date", *monthly), monthly, lag_months=1), "date")


#: Groups of features by their name, the first that fits counts; names of raw prices are whole.
RAW_PRICES = ("open", "high", "low", "close", "vwap", "trade_count")
GROUPS = (
    ("volume_liquidity", ("volume", "liquid")),
    ("volatility", ("vol", "realized")),
    ("benchmark_relative", ("_vs_", "benchmark")),
    ("returns_momentum", ("return", "momentum", "moving_average", "ma_", "rsi", "macd")),
    ("macro", ("treasury", "fed_funds", "cpi", "unemployment", "industrial_production", "inflation", "macro")),
    ("fundamentals", ("sec_", "filing", "assets", "liabilities", "revenue", "income", "debt", "equity", "cash", "eps", "shares")),
)


def feature_group(name):
    """The economic group of a feature's name: a column."""
    low = F.lower(name)
    out = F.when(low.isin(*RAW_PRICES), "raw_price")
    for group, words in GROUPS:
        fits = F.regexp_like(low, F.lit("|".join(words)))
        out = out.when(fits | low.startswith("relative_") if group == "benchmark_relative" else fits, group)
    return out.otherwise("other")
