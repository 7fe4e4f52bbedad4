"""Residuals by normal equations against numpy's least squares."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest

from panelspark.operators import residuals


def numpy_residuals(rows, least=20):
    """rows: symbol, date, x, z, sector, size, y."""
    out = {}
    for date in {r[1] for r in rows}:
        day = [r for r in rows if r[1] == date]
        cats = [sorted({str(r[c]) if r[c] is not None else "unknown" for r in day}) for c in (4, 5)]
        fine = [r for r in day if all(v is not None and math.isfinite(v) for v in (r[2], r[3], r[6]))]
        width = 2 + sum(map(len, cats))
        out |= {(r[0], date): None for r in day}
        if len(fine) < max(least, width + 2):
            continue
        design = [[1.0, r[2], r[3], *(float((r[c] if r[c] is not None else "unknown") == level) for c, ls in zip((4, 5), cats) for level in ls)] for r in fine]
        y = np.array([r[6] for r in fine])
        beta, *_ = np.linalg.lstsq(np.array(design), y, rcond=None)
        out |= {(r[0], date): v for r, v in zip(fine, y - np.array(design) @ beta)}
    return out


SCHEMA = "symbol string, date date, x double, z double, sector string, size string, y double"


def rows_of(days=6, symbols=45):
    r = random.Random(4)
    rows = []
    for d in range(days):
        for i in range(symbols if d != 3 else 12):  # one date is too small
            x = r.choice([None, float("nan"), float("inf")]) if r.random() < 0.06 else r.gauss(1e3, 5)
            z = 2.0 if d == 4 else r.gauss(0, 1e-3)  # a constant on one date
            z = x * 3 if d == 5 and x is not None else z  # a multiple of the other on another
            rows.append((f"S{i}", dt.date(2024, 1, 1 + d), x, z, r.choice(["tech", "bank", "oil", None]), r.choice(["small", "large"]), None if r.random() < 0.05 else r.gauss(0, 1) + (x if x and math.isfinite(x) else 0) / 50))
    return rows


def test_residuals_equal_least_squares(spark):
    rows = rows_of()
    got = {(r["symbol"], r["date"]): r["residual_target"] for r in residuals.residualize(spark.createDataFrame(rows, SCHEMA).repartition(7), ["x", "z"], ["sector", "size"], "y").collect()}
    want = numpy_residuals(rows)
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert (got[k] is None) == (w is None) and (w is None or abs(got[k] - w) < 1e-7), (k, got[k], w)
    assert sum(v is not None for v in want.values()) > 150


def test_residuals_are_free_of_exposures_and_groups(spark):
    rows = [x for x in rows_of() if x[2] is not None and math.isfinite(x[2]) and x[6] is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    both = df.join(residuals.residualize(df, ["x"], ["sector"], "y"), ["symbol", "date"]).where("residual_target IS NOT NULL").collect()
    for date in {r["date"] for r in both}:
        day = [r for r in both if r["date"] == date]
        assert abs(np.cov([r["x"] for r in day], [r["residual_target"] for r in day])[0, 1]) < 1e-6
        for s in {r["sector"] for r in day}:
            assert abs(np.mean([r["residual_target"] for r in day if r["sector"] == s])) < 1e-8


def test_exposures_never_multiply_labels(spark):
    labels = spark.createDataFrame([("A", 1, 0.5, 9.0), ("B", 1, 0.1, 9.0), (None, 1, 0.2, 9.0)], "symbol string, date int, y double, x double")
    exposures = spark.createDataFrame([("A", 1, 2.0), ("A", 1, 1.0), (None, 1, 5.0)], "symbol string, date int, x double")
    got = {r["symbol"]: (r["y"], r["x"]) for r in residuals.join_exposures(labels, exposures, ["x"]).collect()}
    assert got == {"A": (0.5, 1.0), "B": (0.1, None), None: (0.2, None)}


def test_too_many_levels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(residuals, "MOST_LEVELS", 2)
    with pytest.raises(ValueError):
        residuals.residualize(spark.createDataFrame(rows_of(1), SCHEMA), ["x"], ["sector"], "y")


def test_no_rows(spark):
    assert residuals.residualize(spark.createDataFrame([], SCHEMA), ["x"], ["sector"], "y").count() == 0
