"""Quality of snapshots on hand-made tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from panelspark.operators import snapshot

D = datetime.date


def now():
    return F.lit("2024-01-10").cast("timestamp")


def tables(spark, prices=None, filings=None):
    p = prices or [("A", D(2024, 1, i), 9.0, 12.0, 8.0, 10.0 * (1 + i % 2), 5.0, D(2024, 1, 9)) for i in (2, 4, 6)]
    s = filings or [("A", D(2024, 1, 3), "x1", D(2023, 12, 31), D(2024, 1, 9), D(2024, 1, 4))]
    kind = "symbol string, filing_date date, accession_number string, {} date, ingested_at_utc date, earliest_tradable_date date"
    return {
        "prices": spark.createDataFrame([(r[0], r[1], *r[1:]) for r in p], "symbol string, timestamp date, date date, open double, high double, low double, close double, volume double, ingested_at_utc date"),
        "assets": spark.createDataFrame([("A", D(2024, 1, 2), "stock", "active", True, D(2024, 1, 9))], "symbol string, effective_date date, security_type string, status string, tradable boolean, ingested_at_utc date"),
        "submissions": spark.createDataFrame(s, kind.format("report_date")),
        "fundamentals": spark.createDataFrame(s, kind.format("end_date")).withColumns({"concept": F.lit("c"), "unit": F.lit("USD")}),
        "macro_raw": spark.createDataFrame([(D(2024, 1, 2), "a", 1.0, D(2024, 1, 9))], "date date, series_id string, value double, retrieved_at date"),
    }


def found(s):
    return {r["check"]: r for r in s.checks.collect()}


def test_a_clean_snapshot_passes(spark):
    s = snapshot.validate(tables(spark), now())
    assert all(r["passed"] for r in found(s).values()) and len(found(s)) == 32 and s.quarantine.count() == 0


def test_bad_prices(spark):
    day = D(2024, 1, 9)
    rows = [("A", D(2024, 1, 2), 1.0, 2.0, 1.0, 1.0, 5.0, day), ("A", D(2024, 1, 3), 2.0, 3.0, 2.0, 2.5, 5.0, None), ("A", D(2024, 1, 4), 2.0, 1.0, 2.0, 2.0, 5.0, day),
            ("A", D(2024, 1, 5), 2.0, 3.0, 1.0, float("nan"), 5.0, day), ("A", D(2024, 1, 12), 2.0, 3.0, 1.0, 2.0, -1.0, day), ("B", D(2024, 1, 2), 0.0, 0.0, 0.0, 0.0, 0.0, day), ("B", D(2024, 1, 2), 1.0, 1.0, 1.0, 1.0, 0.0, day)]
    s = snapshot.validate(tables(spark, rows), now())
    got = found(s)
    assert not got["prices.valid_ohlcv"]["passed"] and got["prices.valid_ohlcv"]["affected_rows"] == 4
    assert not got["prices.timestamp_not_future"]["passed"] and not got["prices.unique_key"]["passed"]
    assert got["prices.provenance"]["passed"] and got["prices.provenance_coverage"]["affected_rows"] == 1 and not got["prices.provenance_coverage"]["passed"]
    assert ("prices", "absolute_daily_return_over_100pct", "A", "2024-01-03") in set(map(tuple, s.quarantine.collect()))
    assert got["prices.extreme_returns_quarantined"]["passed"] and got["prices.extreme_returns_quarantined"]["affected_rows"] == s.quarantine.count()


def test_bad_filings(spark):
    rows = [("A", D(2024, 1, 3), "x", D(2024, 1, 5), None, D(2024, 1, 4)), ("A", D(2024, 1, 3), "x", D(2024, 1, 5), None, None), ("B", None, None, None, None, None)]
    s = snapshot.validate(tables(spark, filings=rows), now())
    got = found(s)
    for name in ("submissions", "fundamentals"):
        assert got[f"{name}.unique_point_in_time_key"]["affected_rows"] == 2 and got[f"{name}.availability_order"]["affected_rows"] == 2
        assert not got[f"{name}.next_session_availability"]["passed"] and not got[f"{name}.provenance"]["passed"] and got[f"{name}.filing_not_future"]["passed"]
    assert sorted(map(tuple, s.quarantine.collect())) == sorted((n, "filing_precedes_reporting_period", "A", "2024-01-03") for n in ("submissions", "fundamentals") for _ in range(2))


def test_missing_columns_and_empty_tables(spark):
    t = {k: x.where("false") for k, x in tables(spark).items()}
    t["prices"] = t["prices"].drop("timestamp", "ingested_at_utc")
    t["macro_raw"] = t["macro_raw"].drop("value")
    got = found(snapshot.validate({**t, "prices": t["prices"].drop("open")}, now()))
    assert got["prices.required_columns"]["detail"] == "ingested_at_utc, open, timestamp" and "prices.valid_ohlcv" not in got and "prices.unique_key" not in got
    assert not any(got[c]["passed"] for c in ("prices.timestamp_not_future", "prices.provenance", "prices.provenance_coverage", "macro_raw.finite_values", "assets.provenance"))
    assert got["submissions.next_session_availability"]["passed"] and got["assets.unique_key"]["passed"]
