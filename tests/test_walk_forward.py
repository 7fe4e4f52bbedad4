"""Whole runs in stages: restarts, identity of a run, tuned and weighted boosting on small data."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import models, walk_forward

SCHEMA = "symbol string, date date, split_id long, role string, sector string, return_1d double, noise double, y double, up int, forward_return double, forward_excess_return double"


def rows_of(spark, splits=2, symbols=6):
    r = random.Random(5)
    rows = []
    for s in range(splits):
        for i in range(14):
            for k in range(symbols):
                x, day = r.gauss(0, 1), dt.date(2024, 1, 1) + dt.timedelta(s * 10 + i)
                y = x + r.gauss(0, 0.5)
                rows.append((f"S{k}", day, s, "train" if i < 10 else "validation", f"G{k % 2}", x, r.gauss(0, 1), y, int(y > 0), y / 100, y / 100))
    return spark.createDataFrame(rows, SCHEMA)


def test_a_stopped_run_goes_on_where_it_stopped(spark, tmp_path):
    rows, calls, broken = rows_of(spark), [], [True]

    def sign(train, test, features, target):
        split = test.first()["split_id"]
        calls.append(split)
        if split == 1 and broken[0]:
            raise RuntimeError("lost")
        return models.sign_rank(test)

    learners = {"momentum": (walk_forward.rule(models.momentum_rank), "y"), "sign": (sign, "y")}
    go = lambda fraction: walk_forward.run(rows, ["return_1d"], learners, ["sign"], str(tmp_path), {"data": "a"}, fraction=fraction, iterations=20, parallelism=1)
    with pytest.raises(RuntimeError):
        go(0.4)
    broken[0] = False
    out = go(0.4)
    assert calls == [0, 1, 1]  # the first split's fit was written before
    assert set(out) == set(walk_forward.STAGES)
    preds = out["predictions"].collect()
    assert len(preds) == 2 * 2 * 4 * 6
    held = {(r["symbol"], r["date"], r["split_id"]): r for r in rows.where("role = 'validation'").collect()}
    assert all(p["y_score"] == held[p["symbol"], p["date"], p["split_id"]]["return_1d"] and p["y_true"] == held[p["symbol"], p["date"], p["split_id"]]["y"] for p in preds if p["model"] == "momentum")
    names = {r["model"] for r in out["promotion"].collect()}
    assert {"momentum", "sign", "ranking_simple_average_ensemble", "ranking_constrained_stack_ensemble"} <= names
    first = sorted(map(tuple, out["promotion"].collect()), key=str)
    assert sorted(map(tuple, go(0.4)["promotion"].collect()), key=str) == first and calls == [0, 1, 1]


def test_another_configuration_is_another_run(spark, tmp_path):
    a, b = walk_forward.Stages(spark, str(tmp_path), {"x": 1}), walk_forward.Stages(spark, str(tmp_path), {"x": 2})
    assert a.folder != b.folder and a.folder == walk_forward.Stages(spark, str(tmp_path), {"x": 1}).folder
    made = []
    make = lambda: (made.append(1), spark.range(3))[1]
    assert a.table("t", make).count() == a.table("t", make).count() == 3 and made == [1]
    spark.range(2).write.parquet(f"{b.folder}/t")
    (tmp_path / b.folder.split("/")[-1] / "t" / "_SUCCESS").unlink()  # a stage that was stopped while it was written
    assert b.table("t", make).count() == 3


def test_linear_ranks(spark):
    rows = rows_of(spark, 1)
    train, test = rows.where("role = 'train'"), rows.where("role = 'validation'")
    plain = {(r["symbol"], r["date"]): r for r in walk_forward.linear_rank(train, test, ["return_1d", "noise"], "y").collect()}
    neutral = walk_forward.sector_neutral_rank(train, test, ["return_1d", "noise"], "y").collect()
    for r in neutral:
        group = [x["y_score"] for x in plain.values() if x["date"] == r["date"] and x["sector"] == r["sector"]]
        assert abs(r["y_score"] - (plain[r["symbol"], r["date"]]["y_score"] - sum(group) / len(group))) < 1e-9


def test_tuned_boosting_takes_the_best_of_all_configurations(spark):
    train = rows_of(spark, 1, symbols=20).where("role = 'train'").select("symbol", "date", "return_1d", "noise", "y", "up").cache()
    model, best, tried = walk_forward.tune_boosting(train, ["noise", "return_1d"], "y", counts=(1, None), rounds=2, leaf=2)
    assert len(tried) == 16 and [t["rank"] for t in tried] == list(range(1, 17))
    assert best["selected_features"][0] == "return_1d" and best["inner_rank_ic"] == max(t["inner_rank_ic"] for t in tried) > 0.5
    same = [t["inner_rank_ic"] for t in tried if (t["feature_count"], t["learning_rate"], t["max_leaf_nodes"]) == (1, 0.03, 15)]
    assert len(same) == 2 and same[0] == same[1]
    assert models.predict(model, train).where("y_score IS NULL").count() == 0
    weighted = walk_forward.weighted_boosting(train.withColumn("up", F.col("up").cast("double")), ["return_1d"], "up", rounds=3, depth=2)
    assert 1 <= weighted.stages[-1].getNumTrees <= 3
