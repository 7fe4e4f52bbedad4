"""Point-in-time universe: membership per symbol and date from what was known then, and its diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.expr import percent_rank, series
from panelspark.operators.joins import asof_join, complete_panel


@dataclass(frozen=True)
class Rules:
    min_price: float = 5.0
    min_dollar_volume: float = 1e6
    window: int = 20
    min_history: int = 20


def membership(prices: DataFrame, assets: DataFrame, metadata: DataFrame, rules: Rules, benchmark: str) -> DataFrame:
    """Six flags, the first rule that excludes, and size buckets of members.

    assets: symbol, effective_date, status, tradable. metadata: symbol, effective_date, sector, market_cap.
    """
    panel = complete_panel(prices.where(F.col("symbol") != benchmark).select("symbol", "date", "close", "volume"))
    by = series()
    upto, frame = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(-(rules.window - 1), 0)
    dollars = F.col("close") * F.col("volume")
    panel = panel.withColumns(
        {
            "observed_days": F.sum(F.col("close").isNotNull().cast("long")).over(upto),
            "median_dollar_volume": F.when(F.count(dollars).over(frame) >= rules.window, F.percentile(dollars, 0.5).over(frame)),
            "last_observed": F.last(F.when(F.col("close").isNotNull(), F.col("date")), ignorenulls=True).over(upto),
        }
    )
    panel = asof_join(panel, assets.select("symbol", "effective_date", "status", "tradable"), ["symbol"], "date", "effective_date").drop("effective_date")
    panel = asof_join(panel, metadata.select("symbol", "effective_date", "sector", "market_cap"), ["symbol"], "date", "effective_date").drop("effective_date")
    flags = {
        "has_price": F.col("close").isNotNull(),
        "is_active": (F.col("status") == "active") & F.col("tradable"),
        "price_ok": F.col("close") >= rules.min_price,
        "volume_ok": F.col("median_dollar_volume") >= rules.min_dollar_volume,
        "history_ok": F.col("observed_days") >= rules.min_history,
        "sector_known": F.col("sector").isNotNull(),
    }
    panel = panel.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    member = F.lit(True)
    reason = F.lit(None).cast("string")
    for k in flags:
        member = member & F.col(k)
    for k in reversed(flags):
        reason = F.when(~F.col(k), k).otherwise(reason)
    panel = panel.withColumns({"is_member": member, "exclusion_reason": reason})
    p = percent_rank("market_cap", ["date", "is_member"])
    bucket = F.when(F.col("is_member"), F.when(p <= 1 / 3, "small").when(p <= 2 / 3, "mid").when(p.isNotNull(), "large"))
    return panel.withColumn("size_bucket", bucket)


def transitions(members: DataFrame) -> DataFrame:
    """Dates on which a symbol enters or leaves; before its first date it is outside."""
    before = F.lag("is_member", 1, False).over(series())
    rows = members.select("symbol", "date", "is_member", before.alias("was_member"))
    return rows.where("is_member <> was_member").select("symbol", "date", F.when(F.col("is_member"), "entered").otherwise("exited").alias("change"))


def daily(members: DataFrame) -> DataFrame:
    """Per date: rows, members, entries, exits, sectors, the smallest sector, turnover."""
    rows = members.withColumn("_was", F.lag("is_member", 1, False).over(series()))
    m = F.col("is_member")
    base = rows.groupBy("date").agg(
        F.count_if("has_price").alias("observed"), F.count_if("is_member").alias("members"), F.count_if(m & ~F.col("_was")).alias("entries"), F.count_if(~m & F.col("_was")).alias("exits"), F.countDistinct(F.when(m, F.col("sector"))).alias("sectors")
    )
    smallest = rows.where("is_member").groupBy("date", "sector").count().groupBy("date").agg(F.min("count").alias("smallest_sector"))
    out = base.join(smallest, "date", "left")
    by = Window.orderBy("date")
    return out.withColumn("turnover", F.try_divide(F.col("entries") + F.col("exits"), F.col("members") + F.lag("members", 1, 0).over(by)))


def summary(days: DataFrame) -> DataFrame:
    return days.agg(F.count(F.lit(1)).alias("n_dates"), F.min("members").alias("min_members"), F.percentile("members", 0.5).alias("median_members"), F.max("members").alias("max_members"), F.avg("turnover").alias("avg_turnover"), F.sum("entries").alias("entries"), F.sum("exits").alias("exits"))


@dataclass(frozen=True)
class PointInTimeRules:
    min_price: float = 5.0
    min_dollar_volume: float = 5e6
    window: int = 20
    min_history: int = 252
    min_names: int = 100
    min_sectors: int = 8
    min_sector_names: int = 3
    asset_class: str = "us_equity"
    security_types: tuple[str, ...] = ("common_stock",)


#: The two ways in which a row's tradability is known.
ASSET_STATE, LEGACY_SEED = "effective_dated_asset_state", "legacy_static_seed_survivorship_limited"


def point_in_time(prices: DataFrame, assets: DataFrame, metadata: DataFrame | None, rules: PointInTimeRules, benchmark: str, seed: Sequence[str] = ()) -> DataFrame:
    """Every symbol on every date with its state as known then, five eligibility flags, membership, its basis, and the first reason against it.

    assets: symbol, effective_date, asset_class, status, tradable, security_type; metadata: symbol,
    effective_date, sector, industry, market_cap. Before the first asset snapshot of any priced symbol the
    symbols of `seed` count as tradable and of a supported type: evidence that is limited to survivors, so such
    rows say so in membership_basis. The benchmark is in the table and never a member.
    """
    rows = complete_panel(prices.select(F.upper("symbol").alias("symbol"), "date", "close", "volume"))
    upto, frame = series().rowsBetween(Window.unboundedPreceding, 0), series().rowsBetween(-(rules.window - 1), 0)
    dollars, has = F.col("close") * F.col("volume"), F.col("close").isNotNull() & F.col("volume").isNotNull()
    observed = F.when(has, F.col("date"))
    rows = rows.withColumns({
        "has_price": has, "dollar_volume": dollars, "history_days": F.sum(has.cast("long")).over(upto),
        "first_observed_date": F.min(observed).over(Window.partitionBy("symbol")), "last_observed_through_date": F.last(observed, ignorenulls=True).over(upto),
        "trailing_median_dollar_volume": F.when(F.count(dollars).over(frame) >= rules.window, F.percentile(dollars, 0.5).over(frame)),
    })
    states = assets.withColumn("symbol", F.upper("symbol")).join(prices.select(F.upper("symbol").alias("symbol")).distinct(), "symbol", "left_semi")
    states = states.select("symbol", "effective_date", "asset_class", "status", "tradable", "security_type")
    rows = asof_join(rows, states, ["symbol"], "date", "effective_date").withColumnRenamed("effective_date", "asset_effective_date")
    if metadata is None:
        rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in (("metadata_effective_date", "date"), ("sector", "string"), ("industry", "string"), ("market_cap", "double"))})
    else:
        known = metadata.withColumn("symbol", F.upper("symbol")).select("symbol", "effective_date", "sector", "industry", F.col("market_cap").cast("double").alias("market_cap"))
        rows = asof_join(rows, known, ["symbol"], "date", "effective_date").withColumnRenamed("effective_date", "metadata_effective_date")
    first = states.agg(F.min("effective_date").alias("_first"))
    legacy = (F.col("date") < F.col("_first")) & F.col("symbol").isin([s.upper() for s in seed])
    rows = rows.crossJoin(F.broadcast(first)).withColumn("legacy_seed_period", F.coalesce(legacy, F.lit(False))).drop("_first")  # first: one row
    active = (F.col("asset_class") == rules.asset_class) & (F.col("status") == "active") & F.col("tradable")
    flags = {
        "eligible_price": F.col("has_price") & (F.col("close") >= rules.min_price),
        "eligible_liquidity": F.col("trailing_median_dollar_volume") >= rules.min_dollar_volume,
        "eligible_history": F.col("history_days") >= rules.min_history,
        "eligible_tradability": F.col("legacy_seed_period") | F.coalesce(active, F.lit(False)),
        "eligible_security_type": F.col("legacy_seed_period") | F.coalesce(F.col("security_type").isin(list(rules.security_types)), F.lit(False)),
        "is_benchmark": F.col("symbol") == benchmark.strip().upper(),
    }
    rows = rows.withColumns({k: F.coalesce(x, F.lit(False)) for k, x in flags.items()})
    rows = rows.withColumns({"asset_state_known": F.col("asset_effective_date").isNotNull(), "membership_basis": F.when(F.col("legacy_seed_period"), LEGACY_SEED).otherwise(ASSET_STATE)})
    against = [
        (F.col("is_benchmark"), "benchmark"), (~F.col("has_price"), "missing_price"), (~F.col("eligible_tradability"), "inactive_or_untradable"),
        (~F.col("eligible_security_type"), "unsupported_security_type"), (~F.col("eligible_history"), "insufficient_history"),
        (~F.col("eligible_liquidity"), "insufficient_liquidity"), (~F.col("eligible_price"), "price_below_minimum"),
    ]
    reason = F
    for test, name in against:
        reason = reason.when(test, name)
    rows = rows.withColumn("exclusion_reason", reason.otherwise("eligible")).withColumn("is_member", F.col("exclusion_reason") == "eligible")
    p = percent_rank("market_cap", ["date", "is_member"])
    return rows.withColumn("size_bucket", F.when(F.col("is_member"), F.when(p <= 1 / 3, "small").when(p <= 2 / 3, "mid").when(p.isNotNull(), "large")))


def daily_coverage(members: DataFrame, rules: PointInTimeRules) -> DataFrame:
    """Per date: names observed, members, entries, exits, known states, legacy rows, sectors and size buckets of members, the
    smallest sector, turnover against the date before, whether deciles and sector controls are stable, and shares of rows covered."""
    m, was = F.col("is_member"), F.lag("is_member", 1, False).over(series())
    rows = members.withColumn("_was", was)
    share = lambda c: F.avg(c.cast("double"))
    days = rows.groupBy("date").agg(
        F.count_if("has_price").alias("observed_names"), F.count_if(m).alias("member_count"), F.count_if(m & ~F.col("_was")).alias("entries"), F.count_if(~m & F.col("_was")).alias("exits"),
        F.count_if("asset_state_known").alias("known_asset_states"), F.count_if("legacy_seed_period").alias("legacy_rows"),
        F.countDistinct(F.when(m, F.col("sector"))).alias("sector_count"), F.countDistinct(F.when(m, F.col("size_bucket"))).alias("size_bucket_count"),
        share(F.col("asset_state_known")).alias("asset_state_coverage"), share(F.col("legacy_seed_period")).alias("legacy_row_share"),
        share(F.col("sector").isNotNull() | F.col("market_cap").isNotNull()).alias("metadata_coverage"),
    )
    least = rows.where(m & F.col("sector").isNotNull()).groupBy("date", "sector").count().groupBy("date").agg(F.min("count").alias("smallest_sector_names"))
    days = days.join(least, "date", "left").na.fill(0, ["smallest_sector_names"])
    before = F.lag("member_count").over(Window.orderBy("date"))  # a row a date
    return days.withColumns({
        "membership_turnover": F.try_divide(F.col("entries") + F.col("exits"), before),
        "stable_deciles": F.col("member_count") >= max(10, rules.min_names),
        "stable_sector_controls": (F.col("sector_count") >= rules.min_sectors) & (F.col("smallest_sector_names") >= rules.min_sector_names),
    })


def coverage_summary(days: DataFrame, members: DataFrame) -> DataFrame:
    """One row over daily_coverage: the range of dates, members, turnover, shares of stable dates and coverage, exits of names that were no longer tradable."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    own = days.agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.percentile("member_count", 0.5).alias("median_member_count"), F.min("member_count").alias("minimum_member_count"),
        F.avg("membership_turnover").alias("mean_membership_turnover"), F.sum("entries").alias("entries"), F.sum("exits").alias("exits"),
        share("stable_deciles").alias("stable_decile_date_share"), share("stable_sector_controls").alias("stable_sector_date_share"),
        *[F.avg(c).alias(c) for c in ("asset_state_coverage", "metadata_coverage", "legacy_row_share")],
    )
    rows = members.withColumn("_was", F.lag("is_member", 1, False).over(series()))
    gone = ~F.col("is_member") & F.col("_was") & ~F.coalesce((F.col("status") == "active") & F.col("tradable"), F.lit(False))
    other = rows.agg(F.count_if(gone).alias("inactive_or_untradable_exits"), F.min(F.when(F.col("asset_state_known"), F.col("date"))).alias("prospective_start_date"))
    return own.crossJoin(other)  # one row each
