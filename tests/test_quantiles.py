"""Exact quantiles against numpy, on groups over many partitions, with ties, infinities and a sketch that misses."""

from __future__ import annotations

import random

import numpy as np
import pytest

from panelspark.functions import quantiles as q

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.77, 0.9, 1.0]


def check(spark, rows, partitions=13):
    df = spark.createDataFrame(rows, "g string, v double").repartition(partitions)
    got = {r["g"]: (r["n"], r["quantiles"]) for r in q.quantiles(df, ["g"], "v", PROBABILITIES).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        v = [x for h, x in rows if h == g and x is not None and not np.isnan(x)]
        if v:
            want[g] = (len(v), np.quantile(np.array(v), PROBABILITIES))
    assert got.keys() == want.keys()
    for g, (n, values) in want.items():
        assert got[g][0] == n
        np.testing.assert_allclose(got[g][1], values, rtol=1e-12, atol=1e-300)


def rows():
    r = random.Random(1)
    out = [("hot", r.gauss(0, 1) if i % 3 else 0.0) for i in range(30_000)]  # a third of the rows is one value
    out += [("wide", r.choice([-1, 1]) * 10 ** r.uniform(-200, 200)) for _ in range(5000)]
    out += [("two", 1.0 if i < 500 else 2.0) for i in range(1000)]
    out += [("one", 7.0), ("pair", 1.0), ("pair", 2.0), (None, 3.0), (None, 4.0), (None, 9.0), ("none", None), ("none", float("nan"))]
    return out


def test_quantiles_equal_numpy(spark):
    check(spark, rows())


@pytest.mark.parametrize("accuracy,slack,bins", [(2, 0.3, 4), (2, 0.0, 1024), (10_000, 0.0, 2)])
def test_quantiles_are_exact_when_the_sketch_is_coarse(spark, monkeypatch, accuracy, slack, bins):
    for k, v in (("ACCURACY", accuracy), ("SLACK", slack), ("BINS", bins)):
        monkeypatch.setattr(q, k, v)
    check(spark, [x for x in rows() if x[0] != "hot"] + rows()[:4000])


def test_no_group_is_buffered_whole(spark):
    df = spark.range(1000).selectExpr("'a' AS g", "cast(id AS double) AS v")
    plan = q.quantiles(df, ["g"], "v", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_infinite_values(spark):
    df = spark.createDataFrame([("a", x) for x in (float("-inf"), 1.0, 2.0, 3.0, float("inf"))], "g string, v double")
    assert q.quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.75, 1.0]).first()["quantiles"] == [float("-inf"), 1.0, 2.0, 3.0, float("inf")]
