"""Samples by split and role and seed ensembles, on fixtures that reach the other ways of each rule."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import pytest

from panelspark.operators import ensembles, sampling

SCHEMA = "symbol string, date date, split_id long, role string, y int"


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(i)


def rows():
    out = [(f"S{s}", day(i), 0, "train", int(s % 3 == 0)) for i in range(6) for s in range(12)]
    out += [(f"S{s}", day(i), 0, "validation", s % 3) for i in range(3) for s in range(9)]  # three classes: not balanced
    out += [(f"S{s}", day(i), 1, "train", 1 if s else None) for i in range(2) for s in range(5)]  # one class
    return out


def test_roles_have_caps_and_seeds_of_their_own(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    got = sampling.sample_roles(df, "y", 5, caps={"train": 9, "validation": 7}).collect()
    counts = Counter((r["split_id"], r["role"], r["y"]) for r in got)
    assert counts[0, "train", 0] == counts[0, "train", 1] == 4
    assert sum(n for (s, role, _), n in counts.items() if role == "validation") == 7
    assert sum(n for (s, _, _), n in counts.items() if s == 1) == 9
    assert sorted(map(str, got)) == sorted(map(str, sampling.sample_roles(df.repartition(7), "y", 5, caps={"train": 9, "validation": 7}).collect()))
    whole = sampling.sample_roles(df, "y", 5).collect()
    assert Counter((r["split_id"], r["role"], r["y"]) for r in whole)[0, "train", 0] == 24 and len(whole) == 48 + 27 + 10
    dates = {(r["split_id"], r["role"], r["date"]) for r in sampling.sample_roles(df, "y", 5, n_dates=2, balanced=False).collect()}
    assert Counter(d[:2] for d in dates) == {(0, "train"): 2, (0, "validation"): 2, (1, "train"): 2}
    assert len({r["symbol"] for r in sampling.sample_roles(df, "y", 5, n_symbols=4, balanced=False).collect()}) == 4
    with pytest.raises(ValueError):
        sampling.sample_roles(df, "y", 5, caps={"train": 1})


def test_cross_sections_spend_their_budget(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    got = sampling.sample_cross_sections(df.where("split_id = 0 AND role = 'train'"), "y", 17, 3, 1).collect()
    # 17 rows of 3 dates (first, middle, last): 6, 6 and 5; both classes alike, 4 rows of class 1 a date
    assert Counter(r["date"] for r in got) == {day(0): 6, day(2): 6, day(5): 5}
    assert Counter((r["date"], r["y"]) for r in got)[day(0), 1] == 3
    full = sampling.sample_cross_sections(df.where("split_id = 0 AND role = 'train'"), "y", 32, 3, 1).collect()
    assert Counter((r["date"], r["y"]) for r in full) == {(day(i), c): n for i, total in ((0, 11), (2, 11), (5, 10)) for c, n in ((1, 4), (0, total - 4))}
    # as many dates as half the limit: all dates, by class
    wide = sampling.sample_cross_sections(df.where("split_id = 0 AND role = 'train'"), "y", 10, 3, 1).collect()
    assert Counter(r["y"] for r in wide) == {0: 5, 1: 5}
    assert sampling.sample_cross_sections(df.limit(0), "y", 10, 3, 1).count() == 0


def test_seed_summary_and_collapse(spark):
    schema = "split_id long, symbol string, date date, model string, y_score double"
    runs = [(0, f"S{i}", day(0), m, float(i * k % 7)) for i in range(9) for k, m in ((1, "a"), (3, "b"), (5, "c"))]
    r = ensembles.seed_summary(spark.createDataFrame(runs, schema)).first()
    import numpy as np

    x = np.array([[i * k % 7 for i in range(9)] for k in (1, 3, 5)], float)
    corr = np.corrcoef(x)
    assert r["n_runs"] == 3 and abs(r["min_pairwise_correlation"] - min(corr[0, 1], corr[0, 2], corr[1, 2])) < 1e-12
    assert abs(r["dispersion_mean"] - x.std(0).mean()) < 1e-12 and abs(r["dispersion_max"] - x.std(0).max()) < 1e-12
    same = [(0, f"S{i}", day(0), m, float(i)) for i in range(9) for m in "ab"]
    with pytest.raises(Exception, match="same scores"):
        ensembles.seed_summary(spark.createDataFrame(same, schema)).collect()
    one = ensembles.seed_summary(spark.createDataFrame(same[::2], schema)).first()
    assert one["n_runs"] == 1 and one["min_pairwise_correlation"] is None
