"""Chronological ensembles against numpy over all earlier rows."""

from __future__ import annotations

import datetime

import numpy as np
import pytest

from panelspark.operators import ensembles

SCHEMA = "split_id int, symbol string, date date, y_true double, forward_return double, forward_excess_return double, model string, y_score double"


def rows_of(splits=3, days=12, symbols=6, binary=True, models=("a", "b"), seed=3):
    r = np.random.default_rng(seed)
    out = []
    for s in range(splits):
        for d in range(days):
            for k in range(symbols):
                e = float(r.normal())
                day = datetime.date(2020, 1, 1) + datetime.timedelta(days=s * days + d)
                base = (s, f"S{k}", day, float(e > 0) if binary else e, e, e)
                for i, m in enumerate(models):
                    out.append((*base, m, float(1 / (1 + np.exp(-(e * (0.8 - 0.5 * i) + r.normal()))))))
    return out


def curve(s, y):
    """Minimises the summed log loss and a * a / 2 by plain gradient steps of Newton's kind."""
    t = np.zeros(2)
    x = np.column_stack([s, np.ones_like(s)])
    for _ in range(60):
        q = 1 / (1 + np.exp(-x @ t))
        t -= np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + np.diag([1.0, 0.0]), x.T @ (q - y) + np.array([t[0], 0.0]))
    return t


def arrays(rows, split, models=("a", "b")):
    """x, y, split, symbol of the rows before a split, in order of symbol and date."""
    keyed = {}
    for s, k, d, y, _, e, m, v in rows:
        if s < split:
            keyed.setdefault((k, d, s, y, e), {})[m] = v
    order = sorted(keyed)
    return np.array([[keyed[o][m] for m in models] for o in order]), np.array([o[3] for o in order]), np.array([o[2] for o in order]), np.array([o[0] for o in order]), np.array([o[4] for o in order])


def spearman(a, b):
    return np.corrcoef(np.argsort(np.argsort(a)), np.argsort(np.argsort(b)))[0, 1]


def test_calibration_equals_a_fit_on_every_earlier_row(spark):
    rows = rows_of()
    got = {(r["model"], r["cur"]): (r["a"], r["b"]) for r in ensembles.calibration_maps(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {(m, s) for m in "ab" for s in (1, 2)}
    for (m, s), found in got.items():
        old = [r for r in rows if r[6] == m and r[0] < s]
        assert np.allclose(found, curve(np.array([r[7] for r in old]), np.array([r[3] for r in old])), atol=1e-6)


def test_calibration_without_history_or_with_one_class_clips(spark):
    rows = [(s, f"S{i}", datetime.date(2020, 1, 1), 1.0, 0.0, 0.0, "a", (0.0, 0.4, 1.0, None)[i % 4]) for s in (0, 1) for i in range(40)]
    out = ensembles.calibrate(spark.createDataFrame(rows, SCHEMA))
    assert {r[0] for r in out.select("calibrated").distinct().collect()} == {1e-6, 0.4, 1 - 1e-6}


def test_stack_weights_reach_the_best_of_a_fine_grid(spark):
    rows = rows_of()
    got = {(r["split_id"], r["model"]): r for r in ensembles.stack_weights(spark.createDataFrame(rows, SCHEMA), ["a", "b"]).collect()}
    assert got[0, "a"]["weight"] == 0.5 and got[0, "a"]["weight_source"] == "equal_weight_insufficient_history"
    for split in (1, 2):
        x, y, at, symbol, _ = arrays(rows, split)
        x = np.column_stack([1 / (1 + np.exp(-np.column_stack([x[:, i], np.ones(len(x))]) @ curve(x[:, i], y))) for i in range(2)])

        def objective(w):
            s = np.clip(x @ [w, 1 - w], 1e-6, 1 - 1e-6)
            loss = -(y * np.log(s) + (1 - y) * np.log(1 - s))
            change = np.concatenate([np.abs(np.diff((x @ [w, 1 - w])[symbol == k])) for k in set(symbol)])
            return loss.mean() + 0.1 * np.std([loss[at == f].mean() for f in set(at)]) + 0.01 * change.mean()

        grid = np.linspace(0, 1, 1001)
        assert objective(got[split, "a"]["weight"]) <= min(objective(w) for w in grid) + 1e-5
        assert got[split, "a"]["weight_source"] == "chronological_constrained"


def test_rankers_weights_reach_the_best_rank_correlation(spark):
    rows = rows_of(binary=False)
    got = {(r["split_id"], r["model"]): r["weight"] for r in ensembles.stack_weights(spark.createDataFrame(rows, SCHEMA), ["a", "b"], "ranking").collect()}
    x, _, at, symbol, e = arrays(rows, 2)

    def objective(w):
        s = x @ [w, 1 - w]
        ics = [-spearman(s[at == f], e[at == f]) for f in set(at)]
        change = np.concatenate([np.abs(np.diff(s[symbol == k])) for k in set(symbol)])
        return np.mean(ics) + 0.1 * np.std(ics) + 0.01 * change.mean()

    assert objective(got[2, "a"]) <= objective(0.5) and objective(got[2, "a"]) <= min(objective(w) for w in np.linspace(0, 1, 101)) + 5e-3


def test_the_future_changes_no_earlier_ensemble(spark):
    rows = rows_of(models=("a", "b", "c"))
    later = [(*r[:7], 1 - r[7]) if r[0] == 2 else r for r in rows]

    def early(x):
        out = ensembles.chronological(spark.createDataFrame(x, SCHEMA))
        return sorted(map(tuple, out.predictions.where("split_id < 2").collect())), sorted(map(tuple, out.weights.where("split_id <= 2").select("split_id", "model", "weight").collect()))

    assert early(rows) == early(later)


def test_chronological_tasks_and_incomplete_models(spark):
    rows = rows_of(models=("a", "b", "c")) + [r[:6] + (f"r{r[6]}", r[7]) for r in rows_of(binary=False)]
    rows = [r for r in rows if not (r[6] == "c" and r[0] == 1 and r[1] == "S0")]  # c lacks rows of split 1
    rows += [r[:6] + ("old_ensemble", 0.5) for r in rows if r[6] == "a"]
    out = ensembles.chronological(spark.createDataFrame(rows, SCHEMA))
    assert out.predictions.groupBy("model", "split_id").count().where("count <> 72").count() == 0
    assert {r[0] for r in out.predictions.select("model").distinct().collect()} == {f"{t}_{m}_ensemble" for t in ("classification", "ranking") for m in ("simple_average", "rank_average", "constrained_stack")}
    used = {(r["task"], r["split_id"]): r["m"] for r in out.weights.groupBy("task", "split_id").agg({"model": "count"}).toDF("task", "split_id", "m").collect()}
    assert used == {("classification", 0): 3, ("classification", 1): 2, ("classification", 2): 3, **{("ranking", s): 2 for s in range(3)}}
    assert out.sensitivity.where("mean_change < 0 OR abs(rank_corr) > 1 + 1e-9").count() == 0 and out.sensitivity.count() == 14
    with pytest.raises(ValueError):
        ensembles.chronological(spark.createDataFrame([r for r in rows if r[6] == "a"], SCHEMA))


def test_rows_just_before_for_every_later_split_also_where_splits_overlap_in_time(spark):
    r = np.random.default_rng(5)
    rows = [(i % 2 * 2 + int(r.integers(0, 2)), f"S{int(r.integers(0, 3))}", datetime.date(2020, 1, 1) + datetime.timedelta(days=i // 2), [float(i)]) for i in range(80)]
    found = ensembles._with_before(spark.createDataFrame(rows, "split_id int, symbol string, date date, x array<double>"), [0, 1, 2, 3]).collect()
    assert len(found) == len(rows)
    for row in found:
        for cur in range(row["split_id"] + 1, 5):
            older = [(d, s, x) for s, k, d, x in rows if k == row["symbol"] and s < cur and (d, s) < (row["date"], row["split_id"])]
            seen = [(b["date"], b["split_id"], b["x"]) for b in row["before"] if b["split_id"] < cur]
            assert (max(seen) if seen else None)[:2] == max(older)[:2] if older else not seen


def test_history_is_kept_once_whatever_the_number_of_splits(spark):
    rows = spark.createDataFrame(rows_of(splits=6), SCHEMA)
    out = ensembles._with_before(ensembles._scores(rows, ["a", "b"]), list(range(6)))
    assert out.count() == 6 * 12 * 6 and out.where("size(before) > 1").count() == 0


def test_stack_of_an_empty_table_is_empty(spark):
    assert ensembles.stack_weights(spark.createDataFrame([], SCHEMA), ["a", "b"]).count() == 0


@pytest.mark.parametrize("run", [lambda p: ensembles.stack_weights(p, ["a", "b"]), lambda p: ensembles.chronological(p).predictions])
def test_predictions_are_derived_once(spark, run):
    rows, read = rows_of(), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    run(spark.createDataFrame(rows, SCHEMA).mapInArrow(counted, SCHEMA)).collect()
    assert read.value == len(rows)
