"""Quality contract of a snapshot: one row a check, quarantine of suspicious rows, the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.expr import series


def checks(df: DataFrame, table: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """rules: check -> (severity, condition that a bad row meets). One pass, a row a check."""
    row = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, (_, bad) in rules.items()])
    each = F.array(*[F.struct(F.lit(table).alias("table"), F.lit(name).alias("check"), F.lit(severity).alias("severity"), F.col(name).alias("affected_rows")) for name, (severity, _) in rules.items()])
    return row.select(F.explode(each).alias("x")).select("x.*").withColumn("passed", F.col("affected_rows") == 0)


def price_rules(as_of: Column) -> dict[str, tuple[str, Column]]:
    low, high = F.least("open", "close"), F.greatest("open", "close")
    return {
        "positive_prices": ("critical", (F.col("close") <= 0) | F.col("close").isNull()),
        "high_low_order": ("critical", (F.col("high") < F.col("low")) | (F.col("high") < high - 1e-9) | (F.col("low") > low + 1e-9)),
        "volume_not_negative": ("critical", F.col("volume") < 0),
        "not_future": ("critical", F.col("date") > as_of),
        "known_symbol": ("warning", F.col("symbol").isNull() | (F.trim("symbol") == "")),
    }


def unique_check(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    found = df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("affected_rows"))
    return found.select(F.lit(table).alias("table"), F.lit("unique_keys").alias("check"), F.lit("critical").alias("severity"), "affected_rows", (F.col("affected_rows") == 0).alias("passed"))


def filing_rules(market_dates: DataFrame | None = None) -> dict[str, tuple[str, Column]]:
    return {"filing_after_period": ("critical", F.col("filing_date") < F.col("end_date")), "has_accession": ("critical", F.col("accession").isNull())}


def quarantine_returns(prices: DataFrame, limit: float = 1.0) -> DataFrame:
    """Rows whose daily return is larger than the limit in size."""
    r = F.try_divide(F.col("close"), F.lag("close").over(series())) - 1
    return prices.withColumn("value", r).where(F.abs("value") > limit).select("symbol", "date", F.lit("absolute_return").alias("reason"), "value")


def gate(rows: DataFrame) -> DataFrame:
    """Fails if a critical check failed."""
    return rows.agg(F.coalesce(F.bool_and(F.col("passed") | (F.col("severity") != "critical")), F.lit(True)).alias("passed"), F.count(F.lit(1)).alias("n_checks"), F.count_if(~F.col("passed")).alias("n_failed"), F.count_if(~F.col("passed") & (F.col("severity") == "critical")).alias("n_critical"))
