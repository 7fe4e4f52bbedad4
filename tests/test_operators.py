"""Hand-computed cases, and the property that later rows never change earlier ones."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelspark.functions import expr
from panelspark.operators import audit, contracts, ensembles, evidence, features, ingest, joins, labels, metrics, models, orders, portfolio, quality, residuals, sampling, splits, universe
from panelspark.sources import tables
from panelspark.streaming import streams

DAY = dt.date(2024, 1, 1)


def day(i: int) -> dt.date:
    return DAY + dt.timedelta(days=i)


def prices(spark, n=70):
    rows = []
    for s, start, step in (("AAA", 100.0, 1.3), ("BBB", 50.0, -0.2), ("SPY", 400.0, 2.0)):
        for i in range(n):
            close = start + step * i + ((i * 7919) % 13) / 3
            rows.append((s, day(i), close, close * 1.02, close * 0.98, 1000.0 + (i * 31 % 17) * 10))
    return spark.createDataFrame(rows, "symbol string, date date, close double, high double, low double, volume double")


def get(df, key, column):
    return {tuple(r[k] for k in key): r[column] for r in df.collect()}


def test_returns_and_labels_by_hand(spark):
    rows = [("AAPL", day(i), c) for i, c in enumerate((100.0, 110.0, 121.0))] + [("MSFT", day(i), c) for i, c in enumerate((200.0, 180.0, 162.0))]
    got = get(features.add_returns(spark.createDataFrame(rows, "symbol string, date date, close double"), (1,)), ("symbol", "date"), "return_1d")
    assert got["AAPL", day(0)] is None and abs(got["AAPL", day(1)] - 0.1) < 1e-12 and abs(got["MSFT", day(2)] + 0.1) < 1e-12
    rows = [(s, day(i), a + b * i) for s, a, b in (("AAPL", 100.0, 10.0), ("MSFT", 200.0, 10.0), ("SPY", 400.0, 4.0)) for i in range(6)]
    lab = labels.forward_labels(spark.createDataFrame(rows, "symbol string, date date, close double"), (5,), "SPY").where(F.col("date") == day(0))
    assert {k: round(v, 6) for k, v in get(lab, ("symbol",), "forward_return").items()} == {("AAPL",): 0.5, ("MSFT",): 0.25, ("SPY",): 0.05}
    assert round(get(lab, ("symbol",), "forward_excess_return")[("AAPL",)], 6) == 0.45


@pytest.mark.parametrize("feature", ["returns", "volatility", "volume", "benchmark", "signals", "cross", "asof", "regimes", "universe"])
def test_the_future_changes_nothing_before_it(spark, feature):
    base = prices(spark)
    later = base.withColumn("close", F.when(F.col("date") > day(60), F.col("close") * 3).otherwise(F.col("close")))

    def run(p):
        r = features.add_returns(p, (1, 5, 20))
        if feature == "volatility":
            r = features.add_volatility(r, (5, 20))
        elif feature == "volume":
            r = features.add_volume(r, (5, 20))
        elif feature == "benchmark":
            r = features.add_benchmark_relative(r, "SPY", (20,), (1, 5, 20))
        elif feature == "signals":
            r = features.add_market_signals(r, "SPY", 20)
        elif feature == "cross":
            r = features.add_cross_section(r, ["return_1d"])
        elif feature == "asof":
            r = joins.asof_join(r.select("symbol", "date"), p.where(F.dayofmonth("date") % 3 == 0).select("symbol", F.col("date").alias("seen"), "close"), ["symbol"], "date", "seen")
        elif feature == "regimes":
            spy = r.where("symbol = 'SPY'")
            return features.market_regimes(spy, spy.select("date", F.col("close").alias("long_rate"), F.col("low").alias("short_rate")), 5, 5, 5)
        elif feature == "universe":
            a = p.where(F.col("date") == day(0)).select("symbol", F.col("date").alias("effective_date"), F.lit("active").alias("status"), F.lit(True).alias("tradable"), F.lit("s").alias("sector"), F.lit(1.0).alias("market_cap"))
            r = universe.membership(p, a, a, universe.Rules(5, 1000, 5, 5), "SPY")
        return r

    early = F.col("date") <= day(60)
    assert sorted(map(str, run(base).where(early).collect())) == sorted(map(str, run(later).where(early).collect()))


def test_guarded_windows_and_ranks(spark):
    df = spark.createDataFrame([("A", day(i), x) for i, x in enumerate((1.0, None, 3.0, 3.0, 5.0))], "symbol string, date date, x double")
    assert [r[0] for r in df.select(expr.rolling(F.avg, "x", 2)).collect()].count(None) == 3
    ranks = get(df.withColumn("r", expr.percent_rank("x", ["symbol"])), ("date",), "r")
    assert ranks[(day(0),)] == 0.25 and ranks[(day(1),)] is None and ranks[(day(2),)] == 2.5 / 4
    assert df.agg(expr.safe_corr(F.lit(1.0), "x")).first()[0] is None
    assert get(df.select("date", expr.business_day_after("date").alias("n")), ("date",), "n")[(dt.date(2024, 1, 5),)] == dt.date(2024, 1, 8)


def test_asof_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([("A", day(i)) for i in range(5)] + [("B", day(1))], "symbol string, date date")
    right = spark.createDataFrame([("A", day(1), 1, "x"), ("A", day(1), 2, "y"), ("A", day(3), 1, "z")], "symbol string, seen date, n int, v string")
    got = get(joins.asof_join(left, right, ["symbol"], "date", "seen", ["n"]), ("symbol", "date"), "v")
    assert got == {("A", day(0)): None, ("A", day(1)): "y", ("A", day(2)): "y", ("A", day(3)): "z", ("A", day(4)): "z", ("B", day(1)): None}


def test_portfolio_by_hand(spark):
    rows = []
    for d, scores in ((0, (4, 3, 2, 1)), (1, (4, 1, 3, 2))):
        for s, y in zip("ABCD", scores):
            r = {("A", 0): 0.05, ("B", 0): 0.02, ("A", 1): 0.05, ("C", 1): 0.03}.get((s, d), 0.0)
            rows.append(("m", 0, s, day(d), float(y), r, r - 0.01))
    preds = spark.createDataFrame(rows, "model string, split_id int, symbol string, date date, y_score double, forward_return double, forward_excess_return double")
    out = {r["date"]: r for r in portfolio.backtest(preds, k=2).collect()}
    assert [out[day(i)]["turnover"] for i in (0, 1)] == [1.0, 0.5]
    assert [round(out[day(i)]["gross_return"], 6) for i in (0, 1)] == [0.035, 0.04]
    assert [round(out[day(i)]["net_return"], 6) for i in (0, 1)] == [0.034, 0.0395]
    assert round(out[day(0)]["benchmark_return"], 6) == 0.01
    r = portfolio.risk(portfolio.backtest(preds, k=2), 252).first()
    assert r["n_periods"] == 2 and r["max_drawdown"] == 0


def test_auc_equals_brute_force(spark):
    rows = [("m", i % 3, i % 2 if i % 5 else 1, (i * 7 % 11) / 10) for i in range(60)]
    got = get(metrics.roc_auc(spark.createDataFrame(rows, "model string, split_id int, y_true int, y_score double"), ["split_id"]), ("split_id",), "roc_auc")
    for k in range(3):
        pos, neg = ([s for _, g, y, s in rows if g == k and y == c] for c in (1, 0))
        want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
        assert abs(got[(k,)] - want) < 1e-12


def test_contracts(spark):
    p = prices(spark, 3)
    with pytest.raises(ValueError):
        contracts.require(p, ["absent"])
    with pytest.raises(ValueError):
        contracts.assert_unique(p.unionByName(p), ["symbol", "date"])
    assert contracts.feature_columns(p.withColumn("forward_return", F.lit(1.0))) == ["close", "high", "low", "volume"]
    with pytest.raises(ValueError):
        contracts.refuse_labels(p.withColumn("forward_return", F.lit(1.0)))
    raw = spark.createDataFrame([(" aapl ", "2024-01-05", "x"), ("b", "bad", "2.5")], "symbol string, date string, close string")
    assert [tuple(r) for r in contracts.normalize_panel(raw, ["close"]).collect()] == [("AAPL", dt.date(2024, 1, 5), None), ("B", None, 2.5)]
    assert contracts.filter_dates(p, "2024-01-02").count() == 6
    assert contracts.feature_family("return_5d", [("return_", "momentum")]) == "momentum"
    assert contracts.filter_missing(p.withColumn("x", F.lit(None).cast("double")), ["x", "close"], 0.4).count() == 0
    assert contracts.clean_numbers(p.withColumn("x", F.lit(float("nan"))), ["x"]).where("x is null").count() == 9


def test_residuals_of_both_ways_agree(spark):
    rows = [(f"S{i}", day(d), float(i * (d + 1) % 17), float(i * i % 23)) for d in range(2) for i in range(40)]
    df = spark.createDataFrame(rows, "symbol string, date date, x double, y double")
    a = get(residuals.residualize(df, ["x"], [], "y"), ("symbol", "date"), "residual_target")
    b = get(labels.residualize_one(df, "x", "y"), ("symbol", "date"), "residual_target")
    assert all(abs(a[k] - b[k]) < 1e-8 for k in a)


def test_ingest(spark):
    rows = spark.createDataFrame([("s", "2024", "M01", "1.5"), ("s", "2024", "M13", "2"), ("s", "2024", "M02", " nd ")], "series string, year string, period string, value string")
    assert sorted(map(tuple, ingest.monthly_series(rows).collect())) == [("s", dt.date(2024, 1, 1), 1.5), ("s", dt.date(2024, 2, 1), None)]
    table = spark.createDataFrame([("A", 1), ("B", 22)], "symbol string, cik long")
    want = spark.createDataFrame([("a ",), ("c",)], "symbol string")
    assert {r["symbol"]: r["cik_padded"] for r in ingest.lookup(want, table).collect()} == {"A": "0000000001", "C": None}
    with pytest.raises(ValueError):
        ingest.lookup(want, table, strict=True)
    docs = spark.createDataFrame([("A", ["10-K", "S-1", "8-K"], [day(4), day(5)], ["1", "2", "3"])], "symbol string, form array<string>, filing_date array<date>, accession array<string>")
    got = {r["accession"]: (r["filing_date"], r["earliest_tradable_date"]) for r in ingest.submissions(docs, ["10-K", "8-K"]).collect()}
    assert got == {"1": (day(4), day(7)), "3": (None, None)}
    facts = spark.createDataFrame([("A", {"Revenues": {"USD": [(1.0, day(0)), (None, day(1))]}})], "symbol string, facts map<string, map<string, array<struct<value: double, end_date: date>>>>")
    alias = spark.createDataFrame([("Revenues", "revenue")], "sec_concept string, concept string")
    assert [r["concept"] for r in ingest.facts(facts, alias).collect()] == ["revenue"]
    raw = spark.createDataFrame([("a1", "R", "rev", "USD", day(0), day(9), 1.0), ("a1", "R", "rev2", "EUR", day(0), day(9), 2.0), ("a1", "R", "rev", "USD", day(20), day(9), 3.0)], "accession string, concept string, sec_concept string, unit string, start_date date, end_date date, value double").withColumn("symbol", F.lit("A"))
    kept, lost = ingest.resolve_collisions(raw, ["USD"], ["R"])
    assert [r["value"] for r in kept.collect()] == [1.0] and sorted(r["reason"] for r in lost.collect()) == ["collision", "impossible_period"]
    assets = spark.createDataFrame([(" x ", "Big ETF"), ("", "none"), ("y", None)], "symbol string, name string")
    assert {r["symbol"]: r["security_type"] for r in ingest.asset_snapshot(assets, F.lit(DAY), [("etf", "fund")]).collect()} == {"X": "fund", "Y": "common"}
    assert "ingested_at_utc" in ingest.with_provenance(assets).columns


def test_sampling(spark):
    df = spark.createDataFrame([(f"S{i}", day(i % 6), 0, "train", i % 3 % 2) for i in range(90)], "symbol string, date date, split_id int, role string, y int")
    out = sampling.build_sample(df, "y", 60, 4, 20, 1)
    counts = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts[0] == counts[1] <= 10
    assert sampling.balanced_exact(df, "y", 20, 1).count() == 20
    with pytest.raises(ValueError):
        sampling.balanced_exact(df, "y", 2000, 1)
    assert sampling.cross_sections(df, "y", 12, 3, 1).count() <= 12
    assets = spark.createDataFrame([("A", day(0), True, "N"), ("B", day(1), True, "N"), ("C", day(1), False, "N")], "symbol string, effective_date date, tradable boolean, exchange string")
    assert {r[0] for r in sampling.candidates(assets, ["N"], 5, "SPY").collect()} == {"B", "SPY"}


def test_orders(spark):
    events = spark.createDataFrame([(1, 1, "new"), (1, 2, "filled"), (1, 3, "canceled"), (2, 1, "accepted"), (2, 2, "new"), (2, 3, "odd"), (3, 1, "odd")], "order_id long, seq long, status string")
    assert {r["order_id"]: (r["status"], r["is_ended"]) for r in orders.fold_events(events).collect()} == {1: ("filled", True), 2: ("accepted", False)}
    o = spark.createDataFrame([("a", "buy", 10.003, 100.0), ("b", "sell", 0.50505, 100.0), ("c", "buy", 5.0, 1e9)], "order_id string, side string, price double, notional double")
    got = {r["order_id"]: (r["decision"], r["limit_price"]) for r in orders.pretrade(o, spark.createDataFrame([("a",)], "order_id string"), 1e6).collect()}
    assert got["a"] == ("duplicate", 10.06) and got["b"] == ("accept", 0.5025) and got["c"][0] == "too_large"


def test_quality_and_universe(spark):
    bad = prices(spark, 5).withColumn("open", F.col("close")).withColumn("high", F.when(F.col("date") == day(2), 0.0).otherwise(F.col("high")))
    rows = quality.checks(bad, "prices", quality.price_rules(F.lit(day(100)))).unionByName(quality.unique_check(bad, "prices", ["symbol", "date"]))
    found = {r["check"]: r["affected_rows"] for r in rows.collect()}
    assert found["high_low_order"] == 3 and found["unique_keys"] == 0
    assert quality.gate(rows).first()["passed"] is False


def test_ensembles_and_evidence(spark):
    preds = spark.createDataFrame([(m, s, f"S{i}", day(s), (i * (k + 2) % 7) / 7, i % 2) for k, m in enumerate("abc") for s in range(4) for i in range(30)], "model string, split_id int, symbol string, date date, y_score double, y_true int")
    assert ensembles.average(preds).count() == 120 and ensembles.wide(preds, ["a", "b"]).columns[-1] == "b"
    cal = ensembles.calibrate(preds, 20)
    assert cal.where("calibrated <= 0 OR calibrated >= 1 OR calibrated IS NULL").count() == 0
    w = ensembles.stack_weights(preds, ["a", "b", "c"]).groupBy("split_id").agg(F.sum("weight").alias("s"), F.min("weight").alias("m")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 and r["m"] >= 0 for r in w)
    m = spark.createDataFrame([(x, i, (0.2 if x == "good" else 0.0) + i / 100) for x in ("good", "base") for i in range(12)], "model string, split_id int, v double")
    r = evidence.compare_to_baseline(m, "base", "v").first()
    assert r["decision"] == "better" and abs(r["mean_difference"] - 0.2) < 1e-9


def test_models(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = r.normal(size=(300, 3))
    y = x @ [1.0, -2.0, 0.5] + r.normal(size=300) * 0.1
    rows = [(f"S{i % 10}", day(i // 10), int(i >= 200), *map(float, x[i]), float(y[i]), int(y[i] > 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "symbol string, date date, fold int, a double, b double, c double, y double, up int")
    names = ["a", "b", "c"]
    ridge = models.fit_ridge(df, names, "y").stages[-1]
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    assert np.abs(ridge.coefficients.toArray() - want).max() < 1e-3
    for fit in (models.fit_elastic_net, models.fit_huber):
        assert np.abs(fit(df, names, "y").stages[-1].coefficients.toArray() - [1, -2, 0.5]).max() < 0.05
    scored = models.predict(models.fit_logistic(df, names, "up"), df)
    assert metrics.roc_auc(scored.withColumn("y_true", F.col("up")), ["fold"]).agg(F.min("roc_auc")).first()[0] > 0.95
    forest = models.fit_forest(df, names, "up", trees=5)
    assert models.importances(forest, names)[0][0] == "b"
    held = splits.inner_tail(df)
    assert models.predict(models.fit_boosting(labels.date_weights(held), names, "up", rounds=3, weight="weight", holdout="is_tail"), df).count() == 300
    _, best = models.tune_boosting(df.withColumn("ret", F.col("y")), names, "up", "ret", [{"rounds": 2, "depth": 2}, {"rounds": 3, "depth": 2}])
    assert best["depth"] == 2
    out, shares = models.pca(df, df, names, 2)
    assert {"pc1", "pc2"} <= set(out.columns) and len(shares) == 2
    assert "g_pc1" in models.grouped_pca(df, df, {"g": ["a", "b"], "h": ["c"]}, 2).columns


def test_audit_selection(spark):
    df = spark.createDataFrame([(f"S{i}", day(d), float(i), float(i * 2 + d % 2), float((i * 7 + d) % 5), float(i + (i * d) % 3)) for d in range(6) for i in range(20)], "symbol string, date date, a double, b double, c double, t double")
    chosen = audit.select_features(df, ["a", "b", "c"], "t", 2)
    assert len({"a", "b"} & set(chosen)) == 1
    assert audit.feature_scores(df, ["a", "c"], "t").count() == 2


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.123456789, 0), (2, 2.0, 1)], "id long, x double, y_true int")
    tables.write_table(df, str(tmp_path / "t/a.parquet"))
    tables.write_table(df.withColumn("y_true", F.lit(5)), str(tmp_path / "t/b.parquet"))
    assert tables.read_table(spark, str(tmp_path / "t/a.parquet")).count() == 2
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path / "none.parquet"))
    assert tables.read_tables(spark, str(tmp_path / "t")).count() == 4
    assert tables.read_binary_targets(spark, str(tmp_path / "t")).count() == 2
    tables.write_csv(df, str(tmp_path / "c.csv"))
    assert tables.load_table(spark, str(tmp_path / "c.csv"), "id long, x double, y_true int").count() == 2
    assert tables.load_table(spark, str(tmp_path / "absent.csv"), "id long").count() == 0
    tables.write_json_once(df, str(tmp_path / "j"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        tables.write_json_once(df, str(tmp_path / "j"))
    tables.write_two_lane(df, str(tmp_path / "private"), str(tmp_path / "public"), ["x"])
    public = spark.read.json(str(tmp_path / "public"))
    assert public.columns == ["x"] and public.agg(F.min("x")).first()[0] == 0.123457
    manifest = spark.createDataFrame(tables.build_manifest(spark, str(tmp_path / "t")).collect())
    (tmp_path / "t" / "new.txt").write_text("x")
    status = {r["status"] for r in tables.verify_manifest(spark, str(tmp_path / "t"), manifest).collect()}
    assert status == {"ok", "unexpected"}
    (tmp_path / "rates").mkdir()
    (tmp_path / "rates" / "r.csv").write_text('"Series","RATE_A"\n"Note","x"\n"Time Period","H15_RATE_A","B"\n2020-01-01,1.5,2\n2019-01-01,1,2\nbad,1,2\n2020-02-01,ND,3\n')
    assert [tuple(r) for r in tables.rate_csv(spark, str(tmp_path / "rates"), "RATE_A", 2020).collect()] == [(dt.date(2020, 1, 1), 1.5)]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    schema = "symbol string, timestamp timestamp, close double"
    spark.createDataFrame([("A", dt.datetime(2024, 1, 1), 1.0), ("A", dt.datetime(2024, 1, 1), 1.0), ("B", dt.datetime(2024, 1, 1), -1.0)], schema).coalesce(1).write.parquet(str(src))
    stream = lambda: spark.readStream.schema(schema).parquet(str(src))
    streams.upsert_bars(stream(), str(tmp_path / "bars"), str(tmp_path / "c1")).awaitTermination()
    spark.createDataFrame([("A", dt.datetime(2024, 1, 1), 2.0)], schema).coalesce(1).write.mode("append").parquet(str(src))
    streams.upsert_bars(stream(), str(tmp_path / "bars"), str(tmp_path / "c1")).awaitTermination()
    now = {r["symbol"]: r["close"] for r in streams.current(spark, str(tmp_path / "bars"), ["symbol", "timestamp"]).collect()}
    assert now == {"A": 2.0, "B": -1.0}
    streams.quality_split(stream(), F.col("close") < 0, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1 and spark.read.parquet(str(tmp_path / "good")).count() == 3
    streams.append_snapshots(stream(), str(tmp_path / "snap"), str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 4


def test_order_state_stream(spark, tmp_path):
    src = tmp_path / "in"
    t = dt.datetime(2024, 1, 1, 12)
    rows = [(1, "new", t), (1, "filled", t + dt.timedelta(minutes=1)), (1, "new", t + dt.timedelta(minutes=2)), (2, "accepted", t), (3, "odd", t)]
    schema = "order_id long, status string, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src))
    q = lambda: streams.order_states(spark.readStream.schema(schema).parquet(str(src))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q().awaitTermination()
    spark.createDataFrame([(9, "new", t + dt.timedelta(hours=3))], schema).coalesce(1).write.mode("append").parquet(str(src))
    q().awaitTermination()
    got = sorted((r["order_id"], r["status"], r["is_stale"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "filled", False), (2, "accepted", False), (2, "accepted", True), (9, "new", False)]
    # after the timeout: an ended order stays as it was, an open one goes on
    late = [(1, "new", t + dt.timedelta(hours=4)), (2, "new", t + dt.timedelta(hours=4)), (2, "filled", t + dt.timedelta(hours=5))]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(src))
    q().awaitTermination()
    more = sorted((r["order_id"], r["status"], r["is_stale"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert more == sorted([*got, (2, "filled", False), (9, "new", True)])


def test_order_states_of_a_block_share_a_state(spark, tmp_path):
    """Of ten orders one by one: the states after each batch, told stale once their limit passes, whichever neighbour has events then."""
    import random

    r, t, size = random.Random(3), dt.datetime(2024, 1, 1, 12), streams.BLOCK
    ids = [None, -1, 0, 1, 2, size - 1, size, size + 7, 5 * size, 9]
    batches = [[(r.choice(ids), r.choice(["new", "accepted", "partially_filled", "filled", "odd", None]), t + dt.timedelta(minutes=9 * n + r.randrange(9)), r.randrange(3)) for _ in range(12)] for n in range(8)]
    schema, limit, delay = "order_id long, status string, ts timestamp, seq long", dt.timedelta(minutes=20), dt.timedelta(minutes=10)
    rank, held, mark, want = {s: i for i, s in enumerate(orders.STATES)}, {}, None, []
    seen = set()

    def tell(skip):
        for k, (status, until, told) in held.items():
            if k not in skip and status not in orders.ENDED and not told and mark and until < mark:
                held[k] = (status, until, True)
                want.append((k, status, True))

    for events in batches:
        for k, status, at, seq in sorted(events, key=lambda e: (e[2], e[3], rank.get(e[1], -1))):
            before = held.get(k, (None,))[0]
            if status in rank and before not in orders.ENDED and (before is None or rank[status] > rank[before]):
                held[k] = (status, at + limit, False)
        known = {k for k, status, *_ in events if status in rank}
        want += [(k, held[k][0], False) for k in known if (k, held[k][0]) not in seen]
        seen |= {(k, held[k][0]) for k in known}
        for k in known & set(held):
            if mark and not held[k][2]:
                held[k] = (held[k][0], max(held[k][1], mark + dt.timedelta(milliseconds=1)), False)
        tell(known)
        mark = max([mark or t, max(e[2] for e in events) - delay])
        tell(set())  # the batch without data that follows
    src = str(tmp_path / "in")
    stream = lambda: streams.order_states(spark.readStream.schema(schema).parquet(src), 20, "10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    for events in batches:
        spark.createDataFrame(events, schema).coalesce(1).write.mode("append").parquet(src)
        (q := stream().start()).awaitTermination()
    key = lambda x: str(tuple(x))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=key) == sorted(want, key=key)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 5  # blocks, not orders


def test_splits(spark):
    p = prices(spark, 60)
    f = splits.walk_forward(p, 20, 10, 10, 2).orderBy("split_id").collect()
    assert len(f) == 3 and f[0]["train_end"] == day(19) and f[0]["validation_start"] == day(22) and f[0]["validation_end"] == day(31)
    df = spark.createDataFrame([(0, x) for x in (1.0, None, 3.0, 8.0)], "split_id int, x double")
    fit = splits.fit_preprocessor(df, ["x"]).first()
    assert fit["median"] == 3.0 and abs(fit["mean"] - 3.75) < 1e-12
    assert abs(splits.transform(df, splits.fit_preprocessor(df, ["x"]), ["x"]).agg(F.avg("x")).first()[0]) < 1e-12


def test_gram_diagnostics_of_all_vectors(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(metrics, "GRAM_CELLS", 30)  # several passes
    draw = np.random.default_rng(3)
    x = draw.normal(size=(150, 4))
    label = draw.integers(0, 3, 150)
    rows = [(i, x[i].tolist(), int(label[i])) for i in range(150)] + [(150, [0.0] * 4, 1), (151, None, 2)]
    got = metrics.gram_diagnostics(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).first()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    k = (u @ u.T) ** 2
    off = k[~np.eye(150, dtype=bool)]
    every = np.append(label, [1, 2])
    agree = (every[:, None] == every).sum()
    want = (152 * 152, off.mean(), off.std(), 150**2 / (k * k).sum(), (k * (label[:, None] == label)).sum() / np.sqrt((k * k).sum() * agree))
    assert np.allclose(tuple(got), want, rtol=1e-9)


def test_gram_diagnostics_with_tasks_without_rows_or_labels(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(metrics, "GRAM_LABELS", 1)  # labels sent early: none may be left at the end
    x = np.random.default_rng(4).normal(size=(6, 3))
    label = [None, 1, 1, 2, None, 2]
    rows = spark.sparkContext.parallelize([(i, x[i].tolist(), label[i]) for i in range(6)], 9)  # three parts are empty
    got = metrics.gram_diagnostics(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).first()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    k = (u @ u.T) ** 2
    agree = np.array([[a is not None and a == b for b in label] for a in label])
    off = k[~np.eye(6, dtype=bool)]
    assert np.allclose(tuple(got), (36, off.mean(), off.std(), 36 / (k * k).sum(), (k * agree).sum() / np.sqrt((k * k).sum() * agree.sum())), rtol=1e-9)


def test_order_ids_of_the_last_half_second_and_ties_equal_their_sql(spark, tmp_path):
    import duckdb

    from panelspark.plans import evaluation, sampled

    t = dt.datetime(2024, 1, 1, 5, 59, 59, 700_000)  # rounded to seconds, it would be of the next six hours
    kinds = [["click", "view", "purchase", "signup", "error", "login", "logout", "search"][i % 8] for i in range(40)]
    events = [(100 - i, t - dt.timedelta(seconds=i // 4), i % 5, kinds[i]) for i in range(40)] + [(200, t, 9, None)]  # equal times, ids against time
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    c.execute(f"CREATE VIEW events AS SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name, query in (("x13_order_states", evaluation.x13_order_states), ("t3_t4_stream_order_states", sampled.t3_t4_stream_order_states)):
        df = query(spark, str(tmp_path))
        found = c.execute(f"SELECT {', '.join(df.columns)} FROM ({evaluation.SQL[name]})").fetchall()
        assert sorted(map(tuple, df.collect())) == sorted(found)


def test_walk_forward_predicts_each_later_year(spark):
    from panelspark.plans import evaluation

    rows = [(f"S{s}", dt.date(y, m, 1), (s + m) % 2, 0.01 * s, float((s * m) % 5), float((s + m) % 2), float(s)) for y in (2010, 2011, 2012) for m in (1, 5, 9) for s in range(16)]
    out = evaluation.walk_forward_scores(spark.createDataFrame(rows, "symbol string, date date, y_true int, forward_return double, momentum double, sign double, random double"))
    got = {(r["model"], r["y"]): r["n"] for r in out.groupBy("model", F.year("date").alias("y")).agg(F.count("y_score").alias("n")).collect()}
    assert got == {(m, y): 48 for m in ("logistic", "ridge", "elastic_net", "huber", "forest", "boosting") for y in (2011, 2012)}


def test_walk_forward_boosts_the_whole_number_of_rounds(spark, monkeypatch):
    from panelspark.operators import models
    from panelspark.plans import evaluation

    class Unfitted:  # the stages as they are, without the fits
        def __init__(self, stages):
            self.stages = stages

        def fit(self, train):
            return self.stages[-1]

    monkeypatch.setattr(models, "Pipeline", Unfitted)
    monkeypatch.setattr(models, "walk_forward", lambda rows, features, target, chosen, ids: {name: fit(rows, features, target) for name, fit in chosen.items()})
    rows = [("A", dt.date(y, m, 1), m % 2) for y in (2010, 2011, 2012) for m in (1, 2)]
    got = evaluation.walk_forward_scores(spark.createDataFrame(rows, "symbol string, date date, y_true int"))
    assert got["boosting"].getMaxIter() == 300 and got["forest"].getNumTrees() == 300  # as the reference's learners


def test_walk_forward_rows_are_derived_once(spark, monkeypatch):
    from panelspark.operators import models
    from panelspark.plans import evaluation

    monkeypatch.setattr(models, "walk_forward", lambda rows, *_: rows)  # without the fits
    read, schema = spark.sparkContext.accumulator(0), "symbol string, date date, y_true int"

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [("A", dt.date(y, m, 1), 1) for y in (2010, 2011, 2012) for m in (1, 2)]
    assert evaluation.walk_forward_scores(spark.createDataFrame(rows, schema).mapInArrow(counted, schema)).count() == 10  # of two folds: 2 + 2 and 4 + 2
    assert read.value == len(rows)
