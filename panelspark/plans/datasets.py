"""Queries over datasets, targets, identifiers, signals and comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions import expr
from panelspark.operators import contracts, dataset, evidence, features, ingest, joins, labels, metrics, models, orders, portfolio, sampling, universe
from panelspark.plans import catalog, evaluation, views as v
from panelspark.plans.catalog import query, rank, scorr
from panelspark.plans.evaluation import ACCOUNTS, BY_DATE, CLASSIFY, SPLIT_IC, UNIVERSE, auc_sql

QUERIES, SQL = catalog.QUERIES, catalog.SQL


@query("symbol date positive_share_20d:r return_1d_rank:r product:r", catalog.SIGNALS, f"""SELECT symbol, date, CASE WHEN count(*) {catalog.over(20)} >= 20 THEN avg(CASE WHEN return_1d > 0 THEN 1.0::DOUBLE ELSE 0 END) {catalog.over(20)} END AS positive_share_20d, {catalog.prank('return_1d', 'date')} AS return_1d_rank, return_1d * return_5d AS product
    FROM (SELECT * REPLACE (upper(symbol) AS symbol) FROM returns)""")
def p4_canonical_features(spark, d):
    return dataset.canonical_features(v.returns(spark, d), v.BENCH, ["return_1d"], {"product": ("return_1d", "return_5d")}, check_keys=False)


@query("symbol date close:r sector size_bucket", UNIVERSE, "SELECT symbol, date, close, sector, CASE WHEN p <= 1 / 3.0::DOUBLE THEN 'small' WHEN p <= 2 / 3.0::DOUBLE THEN 'mid' WHEN p IS NOT NULL THEN 'large' END AS size_bucket FROM members WHERE is_member")
def j10_membership(spark, d):
    return dataset.apply_membership(v.panel(spark, d).select("symbol", "date", "close"), evaluation._universe(spark, d))


@query("n_dates:i min_members:i median_members:r max_members:i entries:i exits:i", UNIVERSE + ", mw AS (SELECT *, coalesce(lag(is_member) OVER (PARTITION BY symbol ORDER BY date), false) AS was FROM members), dd AS (SELECT date, count(*) FILTER (WHERE is_member) AS m, count(*) FILTER (WHERE is_member AND NOT was) AS e, count(*) FILTER (WHERE NOT is_member AND was) AS x FROM mw GROUP BY 1)", "SELECT count(*) AS n_dates, min(m) AS min_members, median(m) AS median_members, max(m) AS max_members, sum(e) AS entries, sum(x) AS exits FROM dd")
def a5_universe_summary(spark, d):
    return universe.summary(universe.daily(evaluation._universe(spark, d)))


@query("symbol date change", UNIVERSE + ", mw AS (SELECT *, coalesce(lag(is_member) OVER (PARTITION BY symbol ORDER BY date), false) AS was FROM members)", "SELECT symbol, date, CASE WHEN is_member THEN 'entered' ELSE 'exited' END AS change FROM mw WHERE is_member <> was")
def w23_universe_transitions(spark, d):
    return universe.transitions(evaluation._universe(spark, d))


@query("symbol date return_1d:r return_20d:r fr:9", v.RETURNS + ", lab2 AS (SELECT symbol, date, lead(close, 1) OVER (PARTITION BY symbol ORDER BY date) / nullif(close, 0) - 1 AS fr FROM panel)", "SELECT r.symbol, r.date, return_1d, return_20d, fr FROM returns r JOIN lab2 USING (symbol, date) WHERE fr IS NOT NULL AND r.date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND (return_1d IS NULL)::INT + (return_20d IS NULL)::INT <= 1")
def l7_j9_p6_p8_modeling_dataset(spark, d):
    lab = v.panel(spark, d).select("symbol", "date", (F.try_divide(F.lead("close", 1).over(expr.series()), F.col("close")) - 1).alias("fr"))
    return dataset.modeling_dataset(v.returns(spark, d), lab, "fr", ["return_1d", "return_20d"], "1996-01-01", "1999-12-31", 0.5)


@query("symbol date y_true:r y_score:r forward_return:r model split_id:i", v.PREDS, "SELECT symbol, date, y_true, y_score, forward_return, 'sign' AS model, split_id FROM preds WHERE model = 'sign'")
def p18_prediction_table(spark, d):
    rows = v.preds(spark, d).where("model = 'sign'").withColumnRenamed("forward_return", "forward_return_5d")
    return dataset.prediction_table(rows, "sign", "y_score", "y_true")


@query("model n_rows:i", v.PREDS, "SELECT model, count(*) AS n_rows FROM preds WHERE model <> 'random' GROUP BY 1")
def p17_p20_binary_models(spark, d):
    odd = v.preds(spark, d).withColumn("y_true", F.when(F.col("model") == "random", F.col("y_true") + 0.5).otherwise(F.col("y_true").cast("double")))
    kept = dataset.without_models(dataset.binary_models(odd).unionByName(odd.where("model = 'random'")), ["random"])
    return kept.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"))


@query("split_id:i train_start", catalog.FOLDS, "SELECT split_id, train_start FROM folds ORDER BY split_id DESC LIMIT 3")
def k6_last_splits(spark, d):
    return dataset.first_splits(catalog.folds(spark, d), 3, last=True)


@query("regime n_rows:i weight:r", catalog.REGIMES, "SELECT volatility_regime AS regime, count(*) AS n_rows, count(*) / sum(count(*)) OVER ()::DOUBLE AS weight FROM regimes WHERE volatility_regime IS NOT NULL GROUP BY 1 HAVING count(*) >= 10")
def a10_eligible_regimes(spark, d):
    return dataset.eligible_regimes(catalog.regimes(spark, d), "volatility_regime", 10)


@query("split_id:i symbol date momentum:r random:r sign:r", v.PREDS, "SELECT split_id, symbol, date, max(CASE WHEN model = 'momentum' THEN y_score END) AS momentum, max(CASE WHEN model = 'random' THEN y_score END) AS random, max(CASE WHEN model = 'sign' THEN y_score END) AS sign FROM preds GROUP BY 1, 2, 3")
def a12_wide_predictions(spark, d):
    from panelspark.operators import ensembles

    return ensembles.wide(v.preds(spark, d), ["momentum", "random", "sign"])


@query("split_id:i n_symbols:i n_dates:i n_splits_with:i", v.PREDS, "SELECT split_id, count(DISTINCT symbol) AS n_symbols, count(DISTINCT date) AS n_dates, count(DISTINCT model) AS n_splits_with FROM preds GROUP BY 1")
def a15_a16_distinct_counts(spark, d):
    return v.preds(spark, d).groupBy("split_id").agg(F.countDistinct("symbol").alias("n_symbols"), F.countDistinct("date").alias("n_dates"), F.countDistinct("model").alias("n_splits_with"))


@query("model split_id:i n_rows:i accuracy:r brier:r roc_auc:r", v.BINARY, f"SELECT c.*, roc_auc FROM (SELECT model, split_id, {CLASSIFY} FROM binary_preds GROUP BY 1, 2) c JOIN ({auc_sql('model, split_id', 'binary_preds')}) USING (model, split_id)")
def m8_m10_split_metrics(spark, d):
    p = v.binary_preds(spark, d)
    return metrics.classification(p, ["model", "split_id"]).join(metrics.roc_auc(p, ["model", "split_id"]), ["model", "split_id"])


@query("model rank_ic:r pearson:r n:i", v.PREDS + f", r AS (SELECT *, {rank('y_score', 'model')} AS a, {rank('forward_return', 'model')} AS b FROM preds)", f"SELECT model, {scorr('a', 'b')} AS rank_ic, {scorr('y_score', 'forward_return')} AS pearson, count(*) AS n FROM r GROUP BY 1")
def m11_pooled_correlation(spark, d):
    rows = metrics.with_value_ranks(v.preds(spark, d).select("model", "y_score", "forward_return"), "y_score", "a", ["model"])
    rows = metrics.with_value_ranks(rows, "forward_return", "b", ["model"])
    return rows.groupBy("model").agg(expr.safe_corr("a", "b").alias("rank_ic"), expr.safe_corr("y_score", "forward_return").alias("pearson"), F.count(F.lit(1)).alias("n"))


@query("model mean_value:r best_naive margin:r verdict", SPLIT_IC + ", mn AS (SELECT model, avg(rank_ic) AS mean_value FROM split_ic GROUP BY 1), bn AS (SELECT arg_max(model, round(mean_value, 9)) AS best_naive, max(mean_value) AS nv FROM mn WHERE model IN ('random', 'sign'))", "SELECT model, mean_value, best_naive, mean_value - nv AS margin, CASE WHEN mean_value - nv > 0 THEN 'beats_naive' ELSE 'no_evidence' END AS verdict FROM mn, bn WHERE model NOT IN ('random', 'sign')")
def v1_against_naive(spark, d):
    return evidence.against_naive(evaluation.split_ic(spark, d), ["random", "sign"], "rank_ic")


@query("model family rank_ic:r is_missing", SPLIT_IC + ", sm AS (SELECT model, avg(rank_ic) AS rank_ic FROM split_ic GROUP BY 1), ex(model, family) AS (VALUES ('momentum', 'rank'), ('random', 'naive'), ('forest', 'tree'))", "SELECT ex.model, family, rank_ic, rank_ic IS NULL AS is_missing FROM ex LEFT JOIN sm USING (model)")
def v4_v5_baseline_comparison(spark, d):
    s = evaluation.split_ic(spark, d).groupBy("model").agg(F.avg("rank_ic").alias("rank_ic"))
    return evidence.baseline_comparison(s, [("momentum", "rank"), ("random", "naive"), ("forest", "tree")])


# --- identifiers and sets


@query("symbol cik:i cik_padded", "", "SELECT upper(trim(c_name)) AS symbol, CASE WHEN c_custkey % 3 > 0 THEN c_custkey END AS cik, CASE WHEN c_custkey % 3 > 0 THEN lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS cik_padded FROM customer")
def n9_cik_lookup(spark, d):
    c = v.table(spark, d, "customer")
    known = c.where("c_custkey % 3 > 0").select(F.upper("c_name").alias("symbol"), F.col("c_custkey").alias("cik"))
    return ingest.lookup(c.select(F.col("c_name").alias("symbol")), known)


@query("series date value:r", "", "SELECT o_orderpriority AS series, make_date(CAST(year(o_orderdate) AS INT), CAST(month(o_orderdate) AS INT), 1) AS date, CASE WHEN o_orderkey % 10 > 0 THEN o_totalprice END AS value FROM orders WHERE o_orderkey % 7 > 0")
def n11_n13_monthly_series(spark, d):
    o = v.table(spark, d, "orders")
    month = F.when(F.col("o_orderkey") % 7 > 0, F.concat(F.lit("M"), F.lpad(F.month("o_orderdate").cast("string"), 2, "0"))).otherwise("M13")
    rows = o.select(F.col("o_orderpriority").alias("series"), F.year("o_orderdate").cast("string").alias("year"), month.alias("period"), F.when(F.col("o_orderkey") % 10 > 0, F.col("o_totalprice").cast("string")).otherwise(" N/A ").alias("value"))
    return ingest.monthly_series(rows)


@query("symbol concept unit end_date value:r", v.FACTS, "SELECT symbol, lower(concept) AS concept, 'USD' AS unit, end_date, value FROM facts WHERE concept IN ('AF', 'RF')")
def n8_company_facts(spark, d):
    f = v.facts(spark, d)
    one = f.groupBy("symbol", "concept").agg(F.collect_list(F.struct("value", "end_date")).alias("o")).select("symbol", F.create_map(F.col("concept"), F.create_map(F.lit("USD"), F.col("o"))).alias("facts"))
    alias = spark.createDataFrame([("AF", "af"), ("RF", "rf")], "sec_concept string, concept string")
    return ingest.facts(one, alias)


@query("symbol security_type effective_date", "", "SELECT upper(trim(s_name)) AS symbol, CASE WHEN contains(lower(s_name), '00') THEN 'zero' ELSE 'common' END AS security_type, DATE '2001-01-01' AS effective_date FROM supplier QUALIFY row_number() OVER (PARTITION BY upper(trim(s_name)) ORDER BY s_name) = 1")
def n2_asset_snapshot(spark, d):
    s = v.table(spark, d, "supplier").select(F.col("s_name").alias("symbol"), F.col("s_name").alias("name"))
    return ingest.asset_snapshot(s, F.lit("2001-01-01").cast("date"), [("00", "zero")])


@query("symbol in_both", v.FILINGS + ", a AS (SELECT DISTINCT symbol FROM filings WHERE form = 'P'), b AS (SELECT DISTINCT symbol FROM filings WHERE accession % 50 = 0)", "SELECT symbol, symbol IN (SELECT symbol FROM b) AS in_both FROM a")
def d6s_j18_j19_key_sets(spark, d):
    f = v.filings(spark, d)
    a, b = f.where("form = 'P'").select("symbol").distinct(), f.where("accession % 50 = 0").select("symbol").distinct()
    return a.intersect(b).withColumn("in_both", F.lit(True)).unionByName(a.join(b, "symbol", "left_anti").withColumn("in_both", F.lit(False)))


@query("symbol date close:r source", v.PANEL, "SELECT symbol, date, close, 'old' AS source FROM panel WHERE year(date) < 2000 UNION ALL SELECT symbol, date, close, NULL FROM panel WHERE year(date) >= 2000")
def d1s_union(spark, d):
    p = v.panel(spark, d).select("symbol", "date", "close")
    return p.where(F.year("date") < 2000).withColumn("source", F.lit("old")).unionByName(p.where(F.year("date") >= 2000), allowMissingColumns=True)


@query("date long_rate:r ok", v.MACRO_WIDE, "SELECT date, s1 AS long_rate, true AS ok FROM wide WHERE s1 IS NOT NULL")
def w21_daily_rates(spark, d):
    m = catalog.macro(spark, d)
    twice = m.select("date", "s1").unionByName(m.select("date", "s1")).where("s1 IS NOT NULL")
    return twice.groupBy("date").agg(F.max("s1").alias("long_rate"), (F.min("s1") == F.max("s1")).alias("ok"))


# --- series of portfolios, signals, orders


@query("model split_id:i date wealth:r drawdown:r", v.PREDS + ", " + evaluation.HELD + ", wl AS (SELECT *, product(1 + benchmark_return) OVER (PARTITION BY model, split_id ORDER BY date) AS w FROM bt2)", "SELECT model, split_id, date, w AS wealth, w / max(w) OVER (PARTITION BY model, split_id ORDER BY date) - 1 AS drawdown FROM wl")
def w25_wealth_and_drawdown(spark, d):
    upto = Window.partitionBy("model", "split_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = evaluation.backtest(spark, d).withColumn("wealth", F.product(1 + F.col("benchmark_return")).over(upto))
    return rows.withColumn("drawdown", F.col("wealth") / F.max("wealth").over(upto) - 1)


@query("check_name affected_rows:i passed", v.PREDS + ", s AS (SELECT * FROM preds WHERE model = 'random')", "SELECT unnest(['one_date', 'fresh', 'unique_symbols', 'probability', 'positive_price']) AS check_name, unnest([a, b, c, e, f]) AS affected_rows, unnest([a, b, c, e, f]) = 0 AS passed FROM (SELECT count(DISTINCT date) - 1 AS a, count(*) FILTER (WHERE date_diff('day', date, DATE '2001-11-04') > 30) AS b, count(*) - count(DISTINCT symbol) AS c, count(*) FILTER (WHERE NOT coalesce(y_score BETWEEN 0 AND 1, false)) AS e, count(*) FILTER (WHERE NOT coalesce(forward_return > 0, false)) AS f FROM s)")
def x1_signal_checks(spark, d):
    s = v.preds(spark, d).where("model = 'random'").select("symbol", "date", F.col("y_score").alias("score"), F.col("forward_return").alias("price"))
    return orders.check_signals(s, F.lit("2001-11-04").cast("date"), 30).withColumnRenamed("check", "check_name")


@query("order_id:i status seq:i", "", "SELECT user_id AS order_id, event_type AS status, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def x8_latest_orders(spark, d):
    e = v.table(spark, d, "events").select(F.col("user_id").alias("order_id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"), F.col("ts").alias("updated_at"))
    return orders.unique_orders(e.unionByName(e.where("seq % 2 = 0")))


def _intents(spark, d):
    return orders.build_intents(*evaluation._accounts(spark, d), 5, 0.05, 500.0)


@query("n_accounts:i n_trades:i n_buys:i notional:2", ACCOUNTS, "SELECT count(DISTINCT account_id) AS n_accounts, count(*) AS n_trades, count(*) FILTER (WHERE side = 'buy') AS n_buys, sum(round(notional, 2)) AS notional FROM intents WHERE side <> 'hold'")
def x10_x12_stage_metrics(spark, d):
    return orders.stage_metrics(orders.shadow_records(_intents(spark, d)))


@query("account_id:i symbol decision limit_price:r", ACCOUNTS, """SELECT account_id, symbol, CASE WHEN account_id % 5 = 0 THEN 'duplicate' WHEN price IS NULL OR price <= 0 THEN 'no_price' WHEN notional > 15000 THEN 'too_large' ELSE 'accept' END AS decision,
    CASE WHEN side = 'buy' THEN ceil(round(price * 1.005::DOUBLE * 100, 6)) / 100 ELSE floor(round(price * 0.995::DOUBLE * 100, 6)) / 100 END AS limit_price FROM intents WHERE side <> 'hold'""")
def x7_x14_pretrade(spark, d):
    rows = _intents(spark, d).where("side <> 'hold'").withColumn("order_id", orders.order_id("px", F.lit("2001-01-05").cast("date"), F.col("account_id"), F.col("symbol"), F.col("side")))
    seen = orders.match_observed(rows.where("account_id % 5 = 0").select("order_id"), rows)
    return orders.pretrade(rows, seen, 15000.0)


@query("symbol date y_score:r", v.RETURNS, "SELECT symbol, date, return_20d AS y_score FROM returns")
def r1_momentum_rank(spark, d):
    return models.momentum_rank(v.returns(spark, d))


@query("symbol date split_id:i y_score:r", v.RETURNS, "SELECT symbol, date, year(date) AS split_id, sign(return_1d) AS y_score FROM returns")
def r2_sign_rank(spark, d):
    return models.sign_rank(v.returns(spark, d)).withColumn("split_id", F.year("date"))
