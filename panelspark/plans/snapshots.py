"""Queries of a whole snapshot's quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import quality, snapshot
from panelspark.plans import catalog
from panelspark.plans import views as v
from panelspark.plans.catalog import query

QUERIES, SQL = catalog.QUERIES, catalog.SQL


def tables(spark, d):
    """Brands' weeks, customers, orders as submissions, sums of lines as facts, prices by priority; some rows are late or have no origin."""
    day = F.lit("2001-12-31").cast("date")
    prices = v.panel(spark, d).withColumns({"timestamp": F.col("date"), "open": F.col("close"), "ingested_at_utc": F.when(F.col("symbol") != v.BENCH, F.col("date"))})
    assets = v.table(spark, d, "customer").select(F.col("c_name").alias("symbol"), day.alias("effective_date"), F.col("c_mktsegment").alias("security_type"), F.lit("active").alias("status"), (F.col("c_acctbal") > 0).alias("tradable"), day.alias("ingested_at_utc"))
    filed = v.filings(spark, d).select("symbol", "filing_date", F.col("accession").alias("accession_number"), F.date_add("filing_date", (F.col("accession") % 7 - 5).cast("int")).alias("report_date"), F.col("filing_date").alias("ingested_at_utc"), F.date_add("filing_date", 1).alias("earliest_tradable_date"))
    facts = v.facts(spark, d).select("symbol", "filing_date", F.col("accession").alias("accession_number"), "concept", F.lit("USD").alias("unit"), "end_date", F.lit(None).cast("date").alias("ingested_at_utc"), F.col("filing_date").alias("earliest_tradable_date"))
    macro = v.macro_long(spark, d).select("date", F.col("series").alias("series_id"), "value", F.col("date").alias("retrieved_at"))
    return {"prices": prices, "assets": assets, "submissions": filed, "fundamentals": facts, "macro_raw": macro}


def validated(spark, d):
    return snapshot.validate(tables(spark, d), F.lit("2001-06-30").cast("timestamp"))


TABLES = ", ".join([v.PANEL, v.FILINGS, v.FACTS, v.MACRO]) + """, jump AS (SELECT symbol, date, abs(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1) > 1 AS j FROM panel),
late AS (SELECT symbol, filing_date FROM filings WHERE accession % 7 - 5 > 0), twice AS (SELECT coalesce(sum(n), 0) AS n FROM (SELECT count(*) AS n FROM filings GROUP BY symbol, accession HAVING count(*) > 1)),
p AS (SELECT count(*) FILTER (WHERE NOT coalesce(low > 0 AND volume >= 0 AND high >= close AND low <= close, false)) AS bad, count(*) FILTER (WHERE date > DATE '2001-07-01') AS future, count(*) FILTER (WHERE symbol = 'BENCH') AS old FROM panel),
checks("check", passed, severity, affected_rows, detail) AS (
SELECT * FROM (VALUES ('prices.required_columns', true, 'critical', 0, ''), ('prices.unique_key', true, 'critical', 0, ''), ('prices.provenance', true, 'critical', 0, ''), ('assets.required_columns', true, 'critical', 0, ''), ('assets.effective_date_not_future', false, 'critical', 0, ''),
  ('assets.provenance', true, 'critical', 0, ''), ('assets.provenance_coverage', true, 'warning', 0, 'Legacy rows may predate provenance capture.'), ('submissions.required_columns', true, 'critical', 0, ''), ('submissions.next_session_availability', true, 'critical', 0, ''), ('submissions.provenance', true, 'critical', 0, ''),
  ('submissions.provenance_coverage', true, 'warning', 0, 'Legacy rows may predate provenance capture.'), ('fundamentals.required_columns', true, 'critical', 0, ''), ('fundamentals.unique_point_in_time_key', true, 'critical', 0, ''), ('fundamentals.availability_order', true, 'critical', 0, ''), ('fundamentals.next_session_availability', false, 'critical', 0, ''),
  ('fundamentals.provenance', false, 'critical', 0, ''), ('macro_raw.required_columns', true, 'critical', 0, ''), ('macro_raw.unique_key', true, 'critical', 0, ''), ('macro_raw.provenance', true, 'critical', 0, ''), ('macro_raw.provenance_coverage', true, 'warning', 0, 'Legacy rows may predate provenance capture.'))
UNION ALL SELECT 'prices.valid_ohlcv', bad = 0, 'critical', bad, '' FROM p UNION ALL SELECT 'prices.timestamp_not_future', future = 0, 'critical', 0, '' FROM p UNION ALL SELECT 'prices.provenance_coverage', old = 0, 'warning', old, 'Legacy rows may predate provenance capture.' FROM p
UNION ALL SELECT 'prices.extreme_returns_quarantined', true, 'warning', count(*) FILTER (WHERE j), '' FROM jump UNION ALL SELECT 'assets.unique_key', count(*) = count(DISTINCT c_name), 'critical', 0, '' FROM customer
UNION ALL SELECT 'submissions.unique_point_in_time_key', n = 0, 'critical', n, '' FROM twice UNION ALL SELECT 'submissions.availability_order', count(*) = 0, 'critical', count(*), '' FROM late UNION ALL SELECT 'submissions.filing_not_future', NOT coalesce(bool_or(filing_date > DATE '2001-07-01'), false), 'critical', 0, '' FROM filings
UNION ALL SELECT 'fundamentals.filing_not_future', NOT coalesce(bool_or(filing_date > DATE '2001-07-01'), false), 'critical', 0, '' FROM facts UNION ALL SELECT 'fundamentals.provenance_coverage', false, 'warning', count(*), 'Legacy rows may predate provenance capture.' FROM facts
UNION ALL SELECT 'macro_raw.observation_not_future', NOT coalesce(bool_or(date > DATE '2001-07-01'), false), 'critical', 0, '' FROM macro UNION ALL SELECT 'macro_raw.finite_values', coalesce(bool_and(value IS NOT NULL AND isfinite(value)), true), 'critical', 0, '' FROM macro)"""


@query("check_name passed severity affected_rows:i detail", TABLES, 'SELECT "check" AS check_name, passed, severity, affected_rows, detail FROM checks')
def p11_snapshot_checks(spark, d):
    return validated(spark, d).checks.withColumnRenamed("check", "check_name")


@query("dataset reason symbol observation_time", TABLES, "SELECT 'prices' AS dataset, 'absolute_daily_return_over_100pct' AS reason, symbol, CAST(date AS VARCHAR) AS observation_time FROM jump WHERE j UNION ALL SELECT 'submissions', 'filing_precedes_reporting_period', symbol, CAST(filing_date AS VARCHAR) FROM late")
def p12_snapshot_quarantine(spark, d):
    return validated(spark, d).quarantine


@query("passed n_checks:i n_failed:i n_critical:i", TABLES, "SELECT bool_and(passed OR severity <> 'critical') AS passed, count(*) AS n_checks, count(*) FILTER (WHERE NOT passed) AS n_failed, count(*) FILTER (WHERE NOT passed AND severity = 'critical') AS n_critical FROM checks")
def p13_snapshot_gate(spark, d):
    return quality.gate(validated(spark, d).checks)
