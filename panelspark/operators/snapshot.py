"""Quality of a whole snapshot (prices, assets, submissions, fundamentals, macro series): a row a check, and the rows to quarantine.

Values that can't be read as numbers or times count as missing. Times without a zone are of the session's zone.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the columns that each table must have
REQUIRED = {
    "prices": ["symbol", "timestamp", "date", "open", "high", "low", "close", "volume", "ingested_at_utc"],
    "assets": ["symbol", "effective_date", "security_type", "status", "tradable", "ingested_at_utc"],
    "submissions": ["symbol", "filing_date", "accession_number", "report_date", "ingested_at_utc", "earliest_tradable_date"],
    "fundamentals": ["symbol", "filing_date", "accession_number", "end_date", "ingested_at_utc", "earliest_tradable_date"],
    "macro_raw": ["date", "series_id", "value", "retrieved_at"],
}
KEYS = {
    "prices": ["symbol", "timestamp"],
    "assets": ["symbol", "effective_date"],
    "submissions": ["symbol", "accession_number"],
    "fundamentals": ["symbol", "accession_number", "concept", "unit", "end_date"],
    "macro_raw": ["date", "series_id"],
}
PERIOD = {"submissions": "report_date", "fundamentals": "end_date"}
TIME = {"prices": ("timestamp", "timestamp"), "assets": ("effective_date", "effective_date"), "submissions": ("filing_date", "filing"), "fundamentals": ("filing_date", "filing"), "macro_raw": ("date", "observation")}
LEGACY = "Legacy rows may predate provenance capture."


class Snapshot(NamedTuple):
    """checks: check, passed, severity, affected_rows, detail. quarantine: dataset, reason, symbol, observation_time."""

    checks: DataFrame
    quarantine: DataFrame


def _check(name: str, passed: Column, severity: str = "critical", affected: Column | None = None, detail: str = "") -> Column:
    rows = F.lit(0) if affected is None else affected
    return F.struct(F.lit(name).alias("check"), F.coalesce(passed, F.lit(True)).alias("passed"), F.lit(severity).alias("severity"), rows.cast("long").alias("affected_rows"), F.lit(detail).alias("detail"))


def _number(name: str) -> Column:
    x = F.col(name).try_cast("double")
    return F.when(~F.isnan(x), x)


def _time(name: str) -> Column:
    return F.col(name).try_cast("timestamp")


def _late(name: str) -> Column:
    """Filed before the period it reports has ended."""
    return F.coalesce(_time("filing_date") < _time(PERIOD[name]), F.lit(False))


def _jump(limit: float) -> Column:
    """The close moved by more than `limit` of the row before of the symbol; any move from 0 does."""
    before = F.lag(_number("close")).over(Window.partitionBy("symbol").orderBy("timestamp"))
    close = _number("close")
    return F.coalesce(F.when(before == 0, close != 0).otherwise(F.abs(close / F.when(before != 0, before) - 1) > limit), F.lit(False))


def _valid_prices() -> Column:
    o, h, lo, c, volume = (_number(x) for x in ("open", "high", "low", "close", "volume"))
    return F.coalesce((F.least(o, h, lo, c) > 0) & o.isNotNull() & h.isNotNull() & lo.isNotNull() & c.isNotNull() & (volume >= 0) & (h >= F.greatest(o, c, lo)) & (lo <= F.least(o, c, h)), F.lit(False))


def _measured(df: DataFrame, name: str, now: Column) -> DataFrame:
    """All checks of a table but the one of its key, from one pass over it."""
    have = set(df.columns)
    missing = sorted(set(REQUIRED[name]) - have)
    out = [_check(f"{name}.required_columns", F.lit(not missing), detail=", ".join(missing))]
    column, called = TIME[name]
    rows = df
    if name == "prices" and {"open", "high", "low", "close", "volume"} <= have:
        bad = F.count_if(~_valid_prices())
        out.append(_check("prices.valid_ohlcv", bad == 0, affected=bad))
        if {"symbol", "timestamp"} <= have:
            out.append(_check("prices.extreme_returns_quarantined", F.lit(True), "warning", F.count_if("_jump")))
            rows = rows.withColumn("_jump", _jump(1.0))
    if name in PERIOD and {"filing_date", PERIOD[name]} <= have:
        late = F.count_if(_late(name))
        out.append(_check(f"{name}.availability_order", late == 0, affected=late))
    if name in PERIOD and {"filing_date", "earliest_tradable_date"} <= have:
        out.append(_check(f"{name}.next_session_availability", F.bool_and(F.coalesce(_time("earliest_tradable_date") > _time("filing_date"), F.lit(False)))))
    future = F.count_if(_time(column) > now + F.expr("INTERVAL 1 DAY")) == 0 if column in have else F.lit(False)
    out.append(_check(f"{name}.{called}_not_future", future))
    if name == "macro_raw":
        finite = F.bool_and(F.coalesce(F.abs(_number("value")) < float("inf"), F.lit(False))) if "value" in have else F.lit(False)
        out.append(_check("macro_raw.finite_values", finite))
    source = "retrieved_at" if name == "macro_raw" else "ingested_at_utc"
    known, total = (F.count(_time(source)), F.count(F.lit(1))) if source in have else (F.lit(0), F.lit(0))
    out.append(_check(f"{name}.provenance", known > 0))
    out.append(_check(f"{name}.provenance_coverage", (total > 0) & (known == total), "warning", total - known, LEGACY))
    return rows.agg(F.array(*out).alias("c"), F.count(F.lit(1)).alias("n")).select(F.explode("c").alias("c")).select("c.*")


def _unique(df: DataFrame, name: str) -> DataFrame | None:
    """Of filings, the rows that share a key are counted; a null is a value of the key."""
    if not set(KEYS[name]) <= set(df.columns):
        return None
    twice = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    title = "unique_point_in_time_key" if name in PERIOD else "unique_key"
    found = df.groupBy(*KEYS[name]).agg(F.count(F.lit(1)).alias("n")).agg(_check(f"{name}.{title}", twice == 0, affected=twice if name in PERIOD else None).alias("c"))
    return found.select("c.*")


def _set_aside(df: DataFrame, name: str, bad: Column, reason: str) -> DataFrame:
    at = next((c for c in ("date", "timestamp", "filing_date") if c in df.columns), None)
    symbol = F.col("symbol").cast("string") if "symbol" in df.columns else F.lit(None).cast("string")
    return df.withColumn("_bad", bad).where("_bad").select(F.lit(name).alias("dataset"), F.lit(reason).alias("reason"), symbol.alias("symbol"), (F.col(at).cast("string") if at else F.lit(None).cast("string")).alias("observation_time"))


def validate(tables: dict[str, DataFrame], now: Column) -> Snapshot:
    """Checks all five tables by name; a missing table is a KeyError. Two passes a table: its rows, and its keys.

    Empty tables have no bad rows and no provenance. Nothing is collected: the result has some 40 rows.
    """
    parts = []
    for name in REQUIRED:
        parts += [_measured(tables[name], name, now), _unique(tables[name], name)]
    aside = []
    if {"symbol", "timestamp", "open", "high", "low", "close", "volume"} <= set(tables["prices"].columns):
        aside.append(_set_aside(tables["prices"], "prices", _jump(1.0), "absolute_daily_return_over_100pct"))
    for name, period in PERIOD.items():
        if {"filing_date", period} <= set(tables[name].columns):
            aside.append(_set_aside(tables[name], name, _late(name), "filing_precedes_reporting_period"))
    if not aside:
        aside.append(tables["prices"].sparkSession.createDataFrame([], "dataset string, reason string, symbol string, observation_time string"))
    return Snapshot(reduce(DataFrame.unionByName, [p for p in parts if p is not None]), reduce(DataFrame.unionByName, aside))
