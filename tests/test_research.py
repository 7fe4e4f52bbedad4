"""Hand-computed cases of target research, regimes, gates, evidence and pre-trade rules."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelspark.functions import expr
from panelspark.operators import audit, dataset, evidence, features, ingest, labels, metrics, models, orders

DAY = dt.date(2024, 1, 1)


def day(i: int) -> dt.date:
    return DAY + dt.timedelta(days=i)


def test_target_diagnostics_by_hand(spark):
    # two symbols, one horizon of one row; the first symbol's class goes 1, 0, null, 1, the second's 0, 1, 1, 0
    values = {"A": [(1, 0.1), (0, -0.2), (None, 0.4), (1, 0.3)], "B": [(0, -0.1), (1, 0.2), (1, 0.1), (0, -0.3)]}
    rows = [(s, day(i), 1, up, e) for s, xs in values.items() for i, (up, e) in enumerate(xs)]
    got = labels.target_diagnostics(spark.createDataFrame(rows, "symbol string, date date, label_horizon_days int, up int, forward_excess_return double"), {"up": "binary"}, [1]).first()
    assert got["n_rows"] == 7 and abs(got["missing_rate"] - 1 / 8) < 1e-12 and abs(got["positive_rate"] - 4 / 7) < 1e-12
    assert abs(got["turnover"] - 4 / 5) < 1e-12 and abs(got["magnitude"] - 1.3 / 7) < 1e-12
    # lags skip the null: A has pairs (1, 0), (0, 1), B (0, 1), (1, 1), (1, 0): correlations -1 and -0.5
    assert abs(got["autocorrelation"] + 0.75) < 1e-9
    # only days 1 and 3 have both: day 1 lags A 1, B 0 with -0.2, 0.2; day 3 lags A 0, B 1 with 0.3, -0.3
    assert abs(got["rank_ic"] + 1.0) < 1e-9


def test_targets_need_the_margin_and_the_gates(spark):
    def chosen(best, base, missing=0.0):
        rows = [("inner", "a", "continuous", 4, p, best, missing, None, 1.0) for p in (1, 2)] + [("inner", "b", "continuous", 4, p, base, 0.0, None, 1.0) for p in (1, 2)]
        rows += [("calibration", "b", "continuous", 4, 0, 0.9, 0.0, None, 1.0)]
        df = spark.createDataFrame(rows, "role string, target string, target_family string, label_horizon_days int, period int, rank_ic double, missing_rate double, positive_rate double, magnitude double")
        return dataset.select_targets(df, {"ranking": ("b", 4)}).first()

    assert chosen(0.10, 0.05)["decision"] == "promote_candidate"
    assert chosen(0.055, 0.05)["decision"] == "retain_baseline"  # within the margin
    assert chosen(0.50, 0.05, 0.25)["decision"] == "retain_baseline"  # too much is missing
    assert chosen(-0.20, 0.05)["is_stable"] is False  # a negative rank IC scores by its size, but isn't stable


def test_regimes_have_zero_states_and_partial_levels(spark):
    bench = spark.createDataFrame([(day(i), r) for i, r in enumerate((0.01, -0.01, 0.01, -0.01, 0.05, 0.0))], "date date, return_1d double")
    rates = spark.createDataFrame([(day(0), 2.0, 2.0), (day(1), 2.0, 2.0), (day(2), None, 3.0), (day(3), 1.0, 2.0), (day(4), 1.0, 2.0)], "date date, long_rate double, short_rate double")
    got = {r["date"]: r for r in features.market_regimes(bench, rates, 2, 2, 1).collect()}
    assert got[day(0)]["rate_regime"] is None and got[day(0)]["curve_regime"] == "flat_curve"
    assert got[day(1)]["rate_regime"] == "flat_rates" and got[day(1)]["curve_trend"] == "unchanged_curve"
    assert got[day(2)]["rate_level"] == 3.0 and got[day(2)]["rate_regime"] == "rising_rates" and got[day(2)]["curve_regime"] is None
    assert got[day(3)]["rate_regime"] == "falling_rates" and got[day(3)]["curve_regime"] == "inverted_curve"
    assert got[day(3)]["volatility_regime"] == "normal_volatility" and got[day(4)]["volatility_regime"] == "high_volatility"
    assert got[day(5)]["rate_regime"] is None


def test_monthly_series_wait_a_month(spark):
    macro = spark.createDataFrame([(dt.date(2024, 1, 30), 1.0, 10.0), (dt.date(2024, 1, 31), 2.0, 20.0)], "date date, daily double, monthly double")
    dates = spark.createDataFrame([(dt.date(2024, 1, 31),), (dt.date(2024, 2, 28),), (dt.date(2024, 2, 29),), (dt.date(2024, 2, 29),)], "date date")
    got = {r["date"]: (r["daily"], r["monthly"]) for r in features.macro_daily(dates, macro, ["daily"], ["monthly"]).collect()}
    # both observations become available on the last of February; the later one counts
    assert got == {dt.date(2024, 1, 31): (2.0, None), dt.date(2024, 2, 28): (2.0, None), dt.date(2024, 2, 29): (2.0, 20.0)}


def test_feature_groups(spark):
    names = {"Close": "raw_price", "volume_shock": "volume_liquidity", "realized_vol_20d": "volatility", "relative_x": "benchmark_relative", "beta_vs_b": "benchmark_relative", "momentum_5d": "returns_momentum", "cpi_all": "macro", "total_assets": "fundamentals", "other_thing": "other"}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", features.feature_group(F.col("n")).alias("g")).collect()
    assert {r["n"]: r["g"] for r in got} == names


def test_company_tickers(spark):
    docs = spark.createDataFrame([('[{"ticker": " ab ", "cik_str": 7, "title": " First "}, {"ticker": "AB", "cik_str": 8, "title": "x"}, {"ticker": "", "cik_str": 1}, {"ticker": "q", "cik_str": null}]',), ('{"0": {"ticker": "cd", "cik_str": 9, "title": null}}',), (None,), ("no json",)], "payload string")
    got = {r["ticker"]: (r["cik"], r["cik_padded"], r["title"]) for r in ingest.company_tickers(docs).collect()}
    assert got == {"AB": (7, "0000000007", "First"), "CD": (9, "0000000009", "")}


def test_returns_are_attached_once(spark):
    sample = spark.createDataFrame([("A", day(0), 1), ("B", day(0), 2)], "symbol string, date date, x int")
    lab = spark.createDataFrame([("A", day(0), 0.5)], "symbol string, date date, forward_return double")
    assert {r["symbol"]: r["forward_return"] for r in dataset.attach_returns(sample, lab, ["forward_return"]).collect()} == {"A": 0.5, "B": None}
    with pytest.raises(ValueError):
        dataset.attach_returns(sample, lab.unionByName(lab), ["forward_return"])


def test_lower_bound_and_qualification(spark):
    rows = [("one", 1, 0.5), ("two", 1, 0.2), ("two", 2, 0.2), ("nan", 1, float("nan")), ("nan", 2, 0.1)]
    low = {r["model"]: r["lower_bound"] for r in metrics.bootstrap_lower_bound(spark.createDataFrame(rows, "model string, split_id int, x double"), ["model"], "x", "split_id", 50).collect()}
    assert low["one"] == float("-inf") and low["nan"] == float("-inf") and abs(low["two"] - 0.2) < 1e-12
    splits = [("good", i, 0.3) for i in range(4)] + [("lucky", i, x) for i, x in enumerate((0.9, -0.1, -0.1, 0.0))] + [("c1", i, 0.1) for i in range(4)] + [("c2", i, 0.0) for i in range(4)]
    got = {r["model"]: r for r in evidence.qualify_candidates(spark.createDataFrame(splits, "model string, split_id int, x double"), ["good", "lucky"], ["c1", "c2"], "x", 200).collect()}
    assert got["good"]["is_eligible"] and got["good"]["best_control"] == "c1" and not got["lucky"]["is_eligible"]


def test_stability_promotion_needs_every_criterion(spark):
    def run(gains, configs=(1, 2), loss=0.5):
        m = [(n, i, x) for i, g in enumerate(gains) for n, x in (("t", 0.1 + g), ("f", 0.1))]
        c = [(n, i, x, 0.2) for i in range(len(gains)) for n, x in (("t", loss), ("f", 0.5))]
        frames = spark.createDataFrame(m, "model string, split_id int, x double"), spark.createDataFrame(c, "model string, split_id int, log_loss double, brier double"), spark.createDataFrame(list(enumerate(configs)), "split_id int, c int")
        return evidence.stability_promotion(*frames, "t", "f", "x", 100).first()["promoted"]

    assert run([0.1, 0.1, 0.12])
    assert not run([0.5, 0.01, 0.01])  # one split has most of the gains
    assert not run([0.1, 0.1, 0.12], (1, 1)) and not run([0.1, 0.1, 0.12], loss=0.6)


def test_run_stability_names_what_failed(spark):
    steps = [("calm", i, 1.0 - i / 100, 0.1, 1.0) for i in range(4)] + [("wild", i, float(i % 2), 9.0, 1.0) for i in range(4)] + [("broken", 0, float("nan"), 0.1, 1.0), ("broken", 1, 1.0, 0.1, 1.0)]
    losses = [("calm", 0.5, 0.5), ("wild", 0.5, 0.6), ("broken", 0.5, 0.5)]
    runs = evidence.run_stability(spark.createDataFrame(steps, "run string, step int, loss double, gradient_norm double, parameter_norm double"), spark.createDataFrame(losses, "run string, train_loss double, validation_loss double"))
    got = {r["run"]: r for r in runs.collect()}
    assert got["calm"]["failure_modes"] == "none" and got["calm"]["place"] == 1
    assert got["wild"]["failure_modes"] == "exploding_gradient,unstable_loss,overfitting" and "non_finite" in got["broken"]["failure_modes"]
    assert {r["failure_mode"]: r["n_runs"] for r in evidence.failure_counts(runs).collect()}["overfitting"] == 1


def test_promotion_fails_on_nulls(spark):
    ranking = spark.createDataFrame([("m", i, "split", 0.1) for i in range(5)] + [("m", None, "overall", 0.1), ("n", None, "overall", 0.1)], "model string, split_id int, scope string, rank_ic double")
    money = spark.createDataFrame([("m", 0.1, -0.1, 0.5, "passed", "sector_equal_weight")], "model string, cumulative_net_excess_return double, max_drawdown double, avg_turnover double, plausibility_status string, neutralization string")
    naive, p = spark.createDataFrame([("m", True)], "model string, beats_naive boolean"), spark.createDataFrame([("m", 0.01)], "model string, p_holm double")
    got = {r["model"]: r for r in evidence.promotion_table(ranking, money, naive, p).collect()}
    assert got["m"]["is_eligible"] and got["n"]["decision"] == "remain_in_development" and got["n"]["passes_rank_ic"] and not got["n"]["passes_economics"]


def test_lanes(spark):
    m = spark.createDataFrame([("b", "q", False, 0.7, 0.1), ("b", "c", True, 0.6, 0.05), ("e", "c", True, None, 0.2), ("e", "q", False, 0.1, None)], "lane string, model string, is_reference boolean, roc_auc double, rank_ic double")
    assert {r["lane"]: (r["leader"], r["reference_leader"]) for r in evidence.lane_leaders(m).collect()} == {"b": ("q", "c"), "e": ("c", "c")}
    paired = spark.createDataFrame([("q", "c", 0.05, "material_difference")], "model string, baseline string, mean_difference double, decision string")
    outcome = spark.createDataFrame([("b", "q", 0.3), ("b", "c", 0.1)], "lane string, model string, cumulative_net_excess_return double")
    assert evidence.two_lane_claims(m, paired, outcome, "b", ["q"], True).first()["is_defensible"]
    assert not evidence.two_lane_claims(m, paired, outcome, "b", ["q"], False).first()["is_defensible"]


def test_pretrade_rules_in_order(spark):
    o = spark.createDataFrame([(1, s, "id" + s, side, q) for s, side, q in (("A", "buy", 1.5), ("B", "buy", 1.0), ("C", "buy", 1.0), ("D", "buy", 1.0), ("E", "buy", 1.5), ("F", "sell", 3.0), ("G", "sell", 2.0), ("H", "buy", 1.0), ("I", "buy", 1.0))], "account_id int, symbol string, order_id string, side string, quantity double")
    assets = spark.createDataFrame([(s, k, st, t, f) for s, k, st, t, f in (("A", "equity", "active", True, True), ("B", "equity", "active", True, True), ("C", "crypto", "active", True, True), ("D", "equity", "inactive", True, True), ("E", "equity", "active", True, False), ("F", "equity", "active", True, False), ("G", "equity", "active", True, False), ("I", "equity", "active", False, True))], "symbol string, asset_class string, asset_status string, is_tradable boolean, is_fractionable boolean")
    held = spark.createDataFrame([(1, "F", 2.0), (1, "G", 2.0)], "account_id int, symbol string, quantity double")
    seen, opened = spark.createDataFrame([("idA",), ("idA",)], "order_id string"), spark.createDataFrame([(1, "B")], "account_id int, symbol string")
    got = {r["symbol"]: (r["status"], r["reason"]) for r in orders.pretrade_decisions(o, seen, opened, assets, held).collect()}
    assert got == {"A": ("skipped", "duplicate_order_id"), "B": ("rejected", "conflicting_open_order"), "C": ("rejected", "unsupported_asset_class"), "D": ("rejected", "asset_inactive"), "E": ("rejected", "asset_not_fractionable"),
                   "F": ("rejected", "insufficient_position"), "G": ("approved", "risk_checks_passed"), "H": ("rejected", "unsupported_asset_class"), "I": ("rejected", "asset_not_tradable")}


def test_validation_report_digest(spark):
    m = spark.createDataFrame([("a", 1.0), ("b", None)], "model string, x double")
    rules = {"first": [("x", ">=", 0.5)], "second": [("x", ">=", 2.0)]}
    rows = orders.validation_report(m, rules, ["model"]).collect()
    got = {(r["model"], r["stage"]): r for r in rows}
    assert got["a", "first"]["is_eligible"] and not got["a", "second"]["is_eligible"] and not got["b", "first"]["is_eligible"]
    again = {(r["model"], r["stage"]): r["report_digest"] for r in orders.validation_report(m, rules, ["model"]).collect()}
    assert again == {k: r["report_digest"] for k, r in got.items()} and len(set(again.values())) == 4


def test_latest_rows_are_scored_by_a_saved_model(spark, tmp_path):
    rows = spark.createDataFrame([(s, day(i), float(k * i % 5) + k, float(k % 2)) for i in range(20) for k, s in enumerate(("A", "B", "SPY"))], "symbol string, date date, x double, up double")
    models.fit_logistic(rows, ["x"], "up").write().overwrite().save(str(tmp_path / "m"))
    got = models.score_latest(str(tmp_path / "m"), rows, ["x"], "SPY", "logistic").collect()
    assert {r["date"] for r in got} == {day(19)} and sorted(r["place"] for r in got) == [1, 2, 3] and all(0 <= r["score"] <= 1 for r in got)
    with pytest.raises(ValueError):
        models.score_latest(str(tmp_path / "m"), rows.where("symbol <> 'SPY'"), ["x"], "SPY")


def test_decisions_follow_the_order(spark):
    q = spark.createDataFrame([(1, f, miss, 0.1) for f, miss in (("gone", 0.9), ("kept", 0.0), ("twin", 0.0), ("weak", 0.0), ("none", 0.0))], "split_id int, feature string, validation_missing_rate double, psi double")
    stable = spark.createDataFrame([("gone", 3, 0.05, 1.0, True), ("kept", 3, 0.05, 1.0, True), ("twin", 3, 0.05, 1.0, True), ("weak", 3, 0.006, 0.7, False), ("none", 3, 0.001, 0.7, False)], "feature string, folds int, median_ic double, sign_agreement double, has_evidence boolean")
    pairs = spark.createDataFrame([("twin", "none", 0.95)], "left string, right string, rank_corr double")
    ablation, exposed = spark.createDataFrame([("f", 0.01)], "family string, drop_delta double"), spark.createDataFrame([("kept", 0.2)], "feature string, exposure_range double")
    got = {r["feature"]: r["decision"] for r in audit.decisions(q, stable, pairs, ablation, exposed, dict.fromkeys(("gone", "kept", "twin", "weak", "none"), "f")).collect()}
    assert got == {"gone": "insufficient_coverage", "kept": "retain", "twin": "transform", "weak": "conditional", "none": "remove"}


def test_value_ranks_equal_ranks_in_one_window(spark):
    rows = [(k, v) for k in ("a", None, "c") for v in [0.0] * 40 + [-0.0, None, float("nan"), float("nan")] + [float(i % 37) for i in range(200)]]
    df = spark.createDataFrame([r for r in rows if r[0]], "k string, v double")
    for parts in (2, 50):
        got = metrics.with_value_ranks(df, "v", "r", ["k"], parts).withColumn("want", expr.average_rank("v", ["k"]))
        assert got.count() == df.count() and got.where("NOT (r <=> want)").count() == 0
    whole = metrics.with_value_ranks(df, "v", "r").withColumn("want", expr.average_rank("v", [F.lit(0)]))
    assert whole.where("NOT (r <=> want)").count() == 0 and whole.columns == ["k", "v", "r", "want"]
    empty = metrics.with_value_ranks(df.where("v IS NULL"), "v", "r")
    assert [r["r"] for r in empty.collect()] == [None, None]


def test_universe_seed_states_and_coverage(spark):
    from panelspark.operators import universe

    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(i)
    prices = spark.createDataFrame([(s, day(i), 10.0, 100.0) for s in ("a", "b", "spy", "new") for i in range(6) if s != "new" or i >= 4], "symbol string, date date, close double, volume double")
    states = [("A", day(2), "us_equity", "active", True, "common_stock"), ("B", day(2), "us_equity", "active", True, "fund"), ("a", day(4), "us_equity", "inactive", True, "common_stock"), ("zzz", day(0), "us_equity", "active", True, "common_stock")]
    assets = spark.createDataFrame(states, "symbol string, effective_date date, asset_class string, status string, tradable boolean, security_type string")
    rules = universe.PointInTimeRules(5.0, 100.0, 1, 1, 1, 0, 0)
    members = universe.point_in_time(prices, assets, None, rules, "spy", ["b"])
    got = {(r["symbol"], (r["date"] - day(0)).days): (r["exclusion_reason"], r["membership_basis"], r["is_member"]) for r in members.collect()}
    assert len(got) == 24  # all symbols on all dates
    # an unpriced symbol's snapshot starts nothing: the seed overrides until the first one of a priced symbol, on day 2
    assert got["B", 0] == got["B", 1] == ("eligible", universe.LEGACY_SEED, True)
    assert got["B", 2] == ("unsupported_security_type", universe.ASSET_STATE, False)
    assert [got["A", i][0] for i in range(6)] == ["inactive_or_untradable"] * 2 + ["eligible"] * 2 + ["inactive_or_untradable"] * 2
    assert got["NEW", 0][0] == "missing_price" and got["SPY", 3] == ("benchmark", universe.ASSET_STATE, False)
    days = universe.daily_coverage(members, rules)
    table = {(r["date"] - day(0)).days: r for r in days.collect()}
    assert (table[0]["member_count"], table[0]["legacy_rows"], table[0]["legacy_row_share"]) == (1, 1, 0.25)
    assert (table[2]["entries"], table[2]["exits"], table[2]["membership_turnover"], table[2]["asset_state_coverage"]) == (1, 1, 2.0, 0.5)
    one = universe.coverage_summary(days, members).first()
    assert one["inactive_or_untradable_exits"] == 1 and one["prospective_start_date"] == day(2) and one["exits"] == 2


def test_filing_fundamentals(spark):
    from panelspark.operators import fundamentals

    def fact(symbol, year, concept, value, n=0, period="Q1"):
        return (symbol, 1, "0000000001", year, period, dt.date(year, 5, 1), "10-Q", dt.date(year, 3, 31), f"a{year}{n}", concept, value)

    rows = [fact("a", 2020, "revenue", 100.0), fact("a", 2020, "net_income", 10.0), fact("A", 2020, "net_income", 8.0), fact("a", 2021, "net_income", 5.0), fact("a", 2022, "revenue", 150.0), fact("a", 2022, "net_income", 0.0), fact("a", 2022, "operating_cash_flow", 30.0), fact("a", 2022, "capital_expenditure", 15.0)]
    rows += [fact("a", 2023, "revenue", float("nan")), fact("a", 2023, "goodwill", 1.0), fact("b", 2022, "revenue", 1.0, period=None), fact("b", 2022, "revenue", None)]
    schema = "symbol string, cik long, cik_padded string, fiscal_year int, fiscal_period string, filing_date date, form string, end_date date, accession_number string, concept string, value double"
    got = {r["fiscal_year"]: r for r in fundamentals.filing_fundamentals(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {2020, 2021, 2022} and got[2020]["symbol"] == "A"
    assert got[2020]["fundamental_net_income"] == 10.0 and got[2020]["net_income_margin"] == 0.1 and got[2020]["revenue_growth"] is None
    assert got[2021]["revenue_growth"] is None and got[2021]["net_income_growth"] == -0.5
    assert got[2022]["revenue_growth"] == 0.5 and got[2022]["free_cash_flow_margin"] == 0.1 and got[2022]["cash_flow_quality"] is None
    assert all(f"fundamental_{c}" in got[2020].asDict() for c in fundamentals.CONCEPTS) and set(fundamentals.RATIOS) < set(got[2020].asDict())


def test_slice_differences_need_both_sides(spark):
    rows = spark.createDataFrame([("a", "up", "m", 0.5), ("a", "up", "n", 0.2), ("a", "up", "o", None), ("a", "down", "m", 0.1), ("a", "flat", "n", 0.4)], "regime_type string, regime string, model string, x double")
    out = evidence.slice_differences(rows, "m", ["regime_type", "regime"], ["x"]).collect()
    assert sorted((r["regime"], r["other"], r["x_difference"]) for r in out if r["x_difference"] is not None) == [("up", "n", 0.3)] and len(out) == 2
