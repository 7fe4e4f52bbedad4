"""The audit by split against pandas over each split's rows."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
import pytest

from panelspark.operators import fold_audit

DAY = datetime.date(2021, 1, 1)
FEATURES = ["f", "g"]
SCHEMA = "symbol string, date date, f double, g double, g_revision_count int, r double, c int"


def day(i):
    return DAY + datetime.timedelta(days=i)


SPLITS = [(0, day(0), day(9), day(11), day(15)), (1, day(5), day(14), day(16), day(20)), (2, day(10), day(19), day(21), day(29))]


@pytest.fixture(scope="module")
def table():
    g = np.random.default_rng(2)
    rows = []
    for i in range(30):
        for k in range(6):
            f = [None, float("nan"), float("inf"), *[float(x) for x in range(9)]][int(g.integers(0, 12))]
            x = float(g.integers(0, 4))
            rows.append((f"S{k}", day(i), f, None if g.random() < 0.1 else x, int(g.integers(0, 3)), None if i == 29 else float(g.normal() + 0.3 * x), int(g.random() < 0.4)))
    return rows


@pytest.fixture(scope="module")
def frames(spark, table):
    return spark.createDataFrame(table, SCHEMA), spark.createDataFrame(SPLITS, "split_id int, train_start date, train_end date, validation_start date, validation_end date")


def parts(table):
    data = pd.DataFrame(table, columns=["symbol", "date", "f", "g", "n", "r", "c"]).astype({"f": float, "g": float, "r": float})
    for s, a, b, u, w in SPLITS:
        yield s, {"train": data[(data.date >= a) & (data.date <= b)], "validation": data[(data.date >= u) & (data.date <= w)]}


def spearman(a, b, least=3):
    both = pd.DataFrame({"a": a, "b": b}).replace([np.inf, -np.inf], np.nan).dropna()
    return None if len(both) < least or both.a.nunique() < 2 or both.b.nunique() < 2 else both.a.rank().corr(both.b.rank())


def close(a, b):
    return (a is None and (b is None or np.isnan(b))) or (a is not None and b is not None and abs(a - b) < 1e-9)


def test_quality_of_both_roles(frames, table):
    got = {(r["split_id"], r["feature"]): r for r in fold_audit.quality(frames[0], FEATURES, frames[1]).collect()}
    assert len(got) == 6
    for s, roles in parts(table):
        for f in FEATURES:
            row = got[s, f]
            for role, rows in roles.items():
                clean = rows[f].replace([np.inf, -np.inf], np.nan)
                assert row[f"{role}_rows"] == len(rows) and close(row[f"{role}_missing_rate"], clean.isna().mean())
                assert close(row[f"{role}_non_finite_rate"], np.isinf(rows[f]).mean()) and row[f"{role}_symbol_coverage"] == rows[clean.notna()].symbol.nunique()
            train = roles["train"].sort_values(["symbol", "date"])
            last = train.groupby("symbol")[f].shift()
            both = train[f].notna() & last.notna()
            assert close(row["train_stale_rate"], (train[f][both] == last[both]).mean())
            assert row["revision_tracking_available"] == (f == "g") and row["train_revision_count"] == (float(train.n.sum()) if f == "g" else None)


def test_predictive_and_stability(frames, table):
    pred = fold_audit.predictive(frames[0], FEATURES, "r", "c", frames[1])
    got = {(r["split_id"], r["period"], r["feature"]): r for r in pred.collect()}
    assert len(got) == 12
    ics = {}
    for s, roles in parts(table):
        for role, rows in roles.items():
            for f in FEATURES:
                daily = [x for _, d in rows.groupby("date") if (x := spearman(d[f], d.r)) is not None]
                ics[s, role, f] = np.mean(daily)
                row = got[s, role, f]
                assert close(row["rank_ic"], np.mean(daily)) and close(row["classification_association"], spearman(rows[f], rows.c))
                assert row["observations"] == len(rows[[f, "r"]].replace([np.inf, -np.inf], np.nan).dropna())
    for r in fold_audit.stability(pred).collect():
        train, held = (np.array([ics[s, role, r["feature"]] for s in range(3)]) for role in ("train", "validation"))
        assert close(r["train_median_ic"], np.median(train)) and close(r["validation_median_ic"], np.median(held))
        assert close(r["sign_agreement"], (np.sign(train) == np.sign(held)).mean())
        assert r["stable_evidence"] == bool((np.sign(train) == np.sign(held)).mean() >= 0.6 and abs(np.median(held)) >= 0.01)


def test_redundancy_is_of_training_rows(frames, table):
    got = {r["split_id"]: r["spearman_correlation"] for r in fold_audit.redundancy(frames[0], FEATURES, frames[1], 0.0).collect()}
    assert set(got) == {0, 1, 2} and all(close(got[s], spearman(roles["train"].f, roles["train"].g, 2)) for s, roles in parts(table))
    assert fold_audit.redundancy(frames[0], FEATURES, frames[1], 1.0).count() == 0


def test_later_rows_change_no_earlier_split(spark, frames, table):
    later = [(s, d, *((9.0, 1.0) if d > day(15) else (f, g)), *rest) for s, d, f, g, *rest in table]
    old, new = ({tuple(r) for r in fold_audit.predictive(t, FEATURES, "r", "c", frames[1]).where("split_id = 0").collect()} for t in (frames[0], spark.createDataFrame(later, SCHEMA)))
    assert old == new


def test_a_missing_ic_is_no_common_sign(spark):
    rows = [(s, p, "f", ic) for s, (t, v) in enumerate([(0.1, 0.2), (0.1, None), (-0.1, -0.3)]) for p, ic in (("train", t), ("validation", v))]
    r = fold_audit.stability(spark.createDataFrame(rows, "split_id int, period string, feature string, rank_ic double")).first()
    assert r["folds"] == 3 and close(r["sign_agreement"], 2 / 3) and close(r["validation_median_ic"], -0.05) and r["stable_evidence"]


def test_empty_table(spark, frames):
    empty = spark.createDataFrame([], SCHEMA)
    assert fold_audit.predictive(empty, FEATURES, "r", "c", frames[1]).count() == 0
    assert fold_audit.redundancy(empty, FEATURES, frames[1]).count() == 0 and fold_audit.quality(empty, FEATURES, frames[1]).count() == 0


def test_decisions_derive_their_table_once(spark, frames, table):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    fold_audit.decisions(frames[0].mapInArrow(counted, SCHEMA), {"f": "one", "g": "two"}, "r", "c", frames[1], ["symbol"]).collect()
    assert read.value == len(table)
