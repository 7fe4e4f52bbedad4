"""Queries over predictions, filings, facts, events and orders."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions import expr
from panelspark.operators import audit, contracts, ensembles, evidence, features, ingest, joins, metrics, models, orders, portfolio, quality, sampling, splits, universe
from panelspark.plans import catalog, views as v
from panelspark.plans.catalog import prank, query, rank, regimes, scorr
from panelspark.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = catalog.QUERIES
SQL: dict[str, str] = catalog.SQL

# --- ranking and classification

BY_DATE = v.PREDS + f""", rk AS (SELECT *, {rank('y_score', 'model, split_id, date')} AS rs, {rank('forward_return', 'model, split_id, date')} AS rr, greatest(1, ceil(count(*) OVER g * 0.1::DOUBLE)) AS k,
    row_number() OVER (PARTITION BY model, split_id, date ORDER BY y_score DESC, symbol) AS t, row_number() OVER (PARTITION BY model, split_id, date ORDER BY y_score, symbol) AS b FROM preds WINDOW g AS (PARTITION BY model, split_id, date)),
by_date AS (SELECT model, split_id, date, count(*) AS n_rows, {scorr('y_score', 'forward_return')} AS ic, {scorr('rs', 'rr')} AS rank_ic, avg(CASE WHEN t <= k THEN forward_return END) AS top_return, avg(CASE WHEN b <= k THEN forward_return END) AS bottom_return FROM rk GROUP BY 1, 2, 3),
ranking AS (SELECT *, CASE WHEN n_rows >= 2 THEN top_return - bottom_return END AS spread FROM by_date)"""


@query("model split_id:i date n_rows:i ic:r rank_ic:r top_return:r bottom_return:r spread:r", BY_DATE, "SELECT * FROM ranking")
def m1_ranking_by_date(spark, d):
    return metrics.ranking_by_date(v.preds(spark, d))


@query("model split_id:i scope n_dates:i ic:r rank_ic:r spread:r", BY_DATE, "SELECT model, split_id, CASE WHEN grouping(split_id) = 0 THEN 'split' ELSE 'overall' END AS scope, count(*) AS n_dates, avg(ic) AS ic, avg(rank_ic) AS rank_ic, avg(spread) AS spread FROM ranking GROUP BY GROUPING SETS ((model, split_id), (model))")
def m2_ranking_summary(spark, d):
    return metrics.ranking_summary(metrics.ranking_by_date(v.preds(spark, d)))


CLASSIFY = """count(*) AS n_rows, avg(y_true::DOUBLE) AS positive_rate, avg(CASE WHEN y_score >= 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS predicted_rate, avg(y_score) - avg(y_true::DOUBLE) AS calibration_gap,
    avg(CASE WHEN (y_score >= 0.5::DOUBLE) = (y_true = 1) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, coalesce(sum(CASE WHEN y_score >= 0.5::DOUBLE THEN y_true ELSE 0 END)::DOUBLE / nullif(count(*) FILTER (WHERE y_score >= 0.5::DOUBLE), 0), 0) AS precision,
    coalesce(sum(CASE WHEN y_score >= 0.5::DOUBLE THEN y_true ELSE 0 END)::DOUBLE / nullif(sum(y_true), 0), 0) AS recall, avg((y_score - y_true) * (y_score - y_true)) AS brier,
    avg(-(y_true * ln(greatest(1e-15, least(1 - 1e-15, y_score))) + (1 - y_true) * ln(1 - greatest(1e-15, least(1 - 1e-15, y_score))))) AS log_loss"""


@query("model split_id:i scope n_rows:i positive_rate:r predicted_rate:r calibration_gap:r accuracy:r precision:r recall:r brier:r log_loss:r", v.BINARY, f"SELECT model, split_id, CASE WHEN grouping(split_id) = 0 THEN 'split' ELSE 'overall' END AS scope, {CLASSIFY} FROM binary_preds GROUP BY GROUPING SETS ((model, split_id), (model))")
def m3_m7_classification(spark, d):
    return metrics.with_overall(v.binary_preds(spark, d), metrics.classification)


def auc_sql(keys: str, table: str) -> str:
    return f"SELECT {keys}, CASE WHEN p > 0 AND p < n THEN (s - p * (p + 1) / 2.0::DOUBLE) / (p * (n - p)::DOUBLE) END AS roc_auc FROM (SELECT {keys}, sum(y_true) AS p, count(*) AS n, sum(CASE WHEN y_true = 1 THEN r END) AS s FROM (SELECT *, {rank('y_score', keys)} AS r FROM {table}) GROUP BY {keys})"


@query("model split_id:i roc_auc:r", v.BINARY, auc_sql("model, split_id", "binary_preds"))
def m4_roc_auc(spark, d):
    return metrics.roc_auc(v.binary_preds(spark, d), ["model", "split_id"])


@query("model split_id:i average_precision:r", v.BINARY + ", e AS (SELECT model, split_id, y_score, sum(y_true) AS p, count(*) AS n FROM binary_preds GROUP BY 1, 2, 3), c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS al, sum(p) OVER (PARTITION BY model, split_id) AS total FROM e WINDOW w AS (PARTITION BY model, split_id ORDER BY y_score DESC ROWS UNBOUNDED PRECEDING))", "SELECT model, split_id, CASE WHEN max(total) > 0 THEN sum(p / total::DOUBLE * tp / al::DOUBLE) END AS average_precision FROM c GROUP BY 1, 2")
def m5_average_precision(spark, d):
    return metrics.average_precision(v.binary_preds(spark, d), ["model", "split_id"])


BLOCKS = v.BINARY + """, di AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n, CAST(ceil(count(*) OVER () / 50::DOUBLE) AS BIGINT) AS k FROM (SELECT DISTINCT date FROM binary_preds)),
bl AS (SELECT date, CASE WHEN i < (n % k) * (n // k + 1) THEN i // (n // k + 1) ELSE n % k + (i - (n % k) * (n // k + 1)) // greatest(n // k, 1) END AS block FROM di), bp AS (SELECT b.*, block FROM binary_preds b JOIN bl USING (date))"""


@query("model block:i roc_auc:r", BLOCKS, f"SELECT * FROM ({auc_sql('model, block', 'bp')}) WHERE roc_auc IS NOT NULL")
def m6_date_block_auc(spark, d):
    return metrics.date_block_auc(v.binary_preds(spark, d), 50)


@query("regime_type regime model n_rows:i accuracy:r roc_auc:r brier:r", catalog.REGIMES + ", " + v.BINARY + """, rg AS (SELECT b.*, unnest(['volatility_regime', 'rate_regime', 'curve_regime']) AS regime_type, unnest([volatility_regime, rate_regime, curve_regime]) AS regime FROM binary_preds b JOIN regimes USING (date)), rg2 AS (SELECT * FROM rg WHERE regime IS NOT NULL)""",
       f"SELECT c.*, roc_auc FROM (SELECT regime_type, regime, model, {CLASSIFY} FROM rg2 GROUP BY 1, 2, 3 HAVING count(*) >= 50) c JOIN ({auc_sql('regime_type, regime, model', 'rg2')}) USING (regime_type, regime, model)")
def m9_metrics_by_regime(spark, d):
    return metrics.by_regime(v.binary_preds(spark, d), regimes(spark, d), ["volatility_regime", "rate_regime", "curve_regime"])


@query("left right abs_corr:r".replace("left", "a").replace("right", "b"), v.RETURNS, "SELECT 'return_1d' AS a, 'return_5d' AS b, coalesce(abs(corr(return_1d, return_5d)), 0) AS abs_corr FROM returns UNION ALL SELECT 'return_1d', 'volume', coalesce(abs(corr(return_1d, volume)), 0) FROM returns UNION ALL SELECT 'return_5d', 'volume', coalesce(abs(corr(return_5d, volume)), 0) FROM returns")
def m12_correlation_matrix(spark, d):
    return metrics.correlation_matrix(v.returns(spark, d), ["return_1d", "return_5d", "volume"]).withColumnsRenamed({"left": "a", "right": "b"})


SPLIT_IC = BY_DATE + ", split_ic AS (SELECT model, split_id, round(avg(rank_ic), 6) AS rank_ic FROM ranking GROUP BY 1, 2)"


def split_ic(spark, d):
    return metrics.ranking_by_date(v.preds(spark, d)).groupBy("model", "split_id").agg(F.round(F.avg("rank_ic"), 6).alias("rank_ic"))


def draw_sql(n: str, *parts: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)})), 1, 8) AS BIGINT) % {n})"


@query(
    "model mean:r median:r sd:r low:r high:r",
    SPLIT_IC + f""", ix AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY split_id) - 1 AS i, count(*) OVER (PARTITION BY model) AS n FROM split_ic),
    sl AS (SELECT model, i AS slot, n, unnest(range(1, 201)) AS draw FROM ix), pk AS (SELECT model, draw, {draw_sql('n', '42', 'draw', 'slot')} AS p FROM sl),
    bm AS (SELECT pk.model, draw, avg(rank_ic) AS m FROM pk JOIN ix ON ix.model = pk.model AND ix.i = p GROUP BY 1, 2), en AS (SELECT model, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM bm GROUP BY 1)""",
    "SELECT model, avg(rank_ic) AS mean, median(rank_ic) AS median, stddev_samp(rank_ic) AS sd, any_value(low) AS low, any_value(high) AS high FROM split_ic JOIN en USING (model) GROUP BY model",
)
def m14_bootstrap_summary(spark, d):
    return metrics.bootstrap_summary(split_ic(spark, d), ["model"], "rank_ic", "split_id")


PERMUTED = f"""dv AS (SELECT model, date, round(rank_ic, 6) AS ic FROM ranking WHERE rank_ic IS NOT NULL), db AS (SELECT model, (row_number() OVER (PARTITION BY model ORDER BY date) - 1) // 5 AS b, ic FROM dv),
    bs AS (SELECT model, b, sum(ic) AS s, count(*) AS c FROM db GROUP BY 1, 2), sg AS (SELECT model, s, c, draw, 1 - 2 * {draw_sql('2', '42', 'draw', 'b')} AS sign FROM (SELECT *, unnest(range(1, 201)) AS draw FROM bs)),
    nl AS (SELECT model, draw, sum(s * sign) / sum(c) AS m FROM sg GROUP BY 1, 2), ob AS (SELECT model, avg(ic) AS observed FROM dv GROUP BY 1),
    pv AS (SELECT model, any_value(observed) AS observed, (count(*) FILTER (WHERE m >= observed - 1e-12) + 1) / (count(*) + 1)::DOUBLE AS p_value FROM nl JOIN ob USING (model) GROUP BY 1)"""
PERMUTED_P = "SELECT model, observed, p_value, max(least(1.0::DOUBLE, p_value * (n - rn + 1))) OVER (ORDER BY p_value, model) AS p_holm FROM (SELECT *, row_number() OVER (ORDER BY p_value, model) AS rn, count(*) OVER () AS n FROM pv)"


@query("model observed:r p_value:r p_holm:r", BY_DATE + ", " + PERMUTED, PERMUTED_P)
def m17_m18_rank_ic_permutation(spark, d):
    daily = metrics.ranking_by_date(v.preds(spark, d)).where("rank_ic IS NOT NULL").withColumn("rank_ic", F.round("rank_ic", 6))
    return metrics.holm(metrics.sign_permutation(daily, ["model"], "rank_ic", "date", 200, 42, 5, two_sided=False))


PAIRED = SPLIT_IC + f""", pd AS (SELECT a.model, a.split_id, a.rank_ic - b.rank_ic AS x, row_number() OVER (PARTITION BY a.model ORDER BY a.split_id) - 1 AS i, count(*) OVER (PARTITION BY a.model) AS n
    FROM split_ic a JOIN split_ic b ON b.model = 'random' AND a.split_id = b.split_id WHERE a.model <> 'random' AND a.rank_ic IS NOT NULL AND b.rank_ic IS NOT NULL),
    sl AS (SELECT model, i AS slot, n, unnest(range(1, 201)) AS draw FROM pd), pk AS (SELECT model, draw, {draw_sql('n', '42', 'draw', 'slot')} AS p FROM sl),
    bm AS (SELECT pk.model, draw, avg(x) AS m FROM pk JOIN pd ON pd.model = pk.model AND pd.i = p GROUP BY 1, 2), en AS (SELECT model, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM bm GROUP BY 1),
    nl AS (SELECT model, draw, avg(x * (1 - 2 * {draw_sql('2', '42', 'draw', 'i')})) AS m FROM (SELECT *, unnest(range(1, 201)) AS draw FROM pd) GROUP BY 1, 2),
    ob AS (SELECT model, avg(x) AS mean_difference, count(*) AS n_splits FROM pd GROUP BY 1),
    pv AS (SELECT model, any_value(mean_difference) AS observed, (count(*) FILTER (WHERE abs(m) >= abs(mean_difference) - 1e-12) + 1) / (count(*) + 1)::DOUBLE AS p_value FROM nl JOIN ob USING (model) GROUP BY 1), hp AS ({PERMUTED_P})"""


@query(
    "model mean_difference:r n_splits:i low:r high:r p_holm:r decision",
    PAIRED,
    "SELECT model, mean_difference, n_splits, low, high, p_holm, CASE WHEN low > 0 AND p_holm < 0.05::DOUBLE THEN 'better' WHEN high < 0 THEN 'worse' ELSE 'inconclusive' END AS decision FROM ob JOIN en USING (model) JOIN hp USING (model)",
)
def m15_v1_paired_comparison(spark, d):
    return evidence.compare_to_baseline(split_ic(spark, d), "random", "rank_ic")


@query("cells:i off_diagonal_mean:r off_diagonal_sd:r effective_rank:r label_alignment:r", "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), k AS (SELECT a.vec_id = b.vec_id AS same, CASE WHEN a.label = b.label THEN 1.0::DOUBLE ELSE 0 END AS agree, pow(list_cosine_similarity(a.e, b.e), 2) AS k FROM v a, v b)",
       "SELECT count(*) AS cells, avg(CASE WHEN NOT same THEN k END) AS off_diagonal_mean, stddev_pop(CASE WHEN NOT same THEN k END) AS off_diagonal_sd, pow(sum(CASE WHEN same THEN k END), 2) / sum(k * k) AS effective_rank, sum(k * agree) / sqrt(sum(k * k) * sum(agree)) AS label_alignment FROM k")
def m19_gram_diagnostics(spark, d):
    return metrics.gram_diagnostics(v.table(spark, d, "embeddings"))


@query("cells:i off_diagonal_mean:r off_diagonal_sd:r effective_rank:r label_alignment:r", "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), k AS (SELECT a.vec_id = b.vec_id AS same, CASE WHEN a.label = b.label THEN 1.0::DOUBLE ELSE 0 END AS agree, pow(list_cosine_similarity(a.e, b.e), 2) AS k FROM v a, v b)",
       "SELECT count(*) AS cells, avg(CASE WHEN NOT same THEN k END) AS off_diagonal_mean, stddev_pop(CASE WHEN NOT same THEN k END) AS off_diagonal_sd, pow(sum(CASE WHEN same THEN k END), 2) / sum(k * k) AS effective_rank, sum(k * agree) / sqrt(sum(k * k) * sum(agree)) AS label_alignment FROM k")
def m19_gram_diagnostics_all(spark, d):
    return metrics.gram_diagnostics(v.table(spark, d, "embeddings"))


@query("model momentum_mean:r random_mean:r".replace("model ", "split_id:i "), SPLIT_IC, "SELECT split_id, max(CASE WHEN model = 'momentum' THEN rank_ic END) AS momentum_mean, max(CASE WHEN model = 'random' THEN rank_ic END) AS random_mean FROM split_ic GROUP BY 1")
def a11_metric_pivot(spark, d):
    out = split_ic(spark, d).groupBy("split_id").pivot("model", ["momentum", "random"]).agg(F.first("rank_ic"))
    return out.withColumnsRenamed({"momentum": "momentum_mean", "random": "random_mean"})


@query("split_id:i n_models:i equal_inputs", v.PREDS, "SELECT split_id, count(*) AS n_models, count(DISTINCT (n, h)) = 1 AS equal_inputs FROM (SELECT split_id, model, count(*) AS n, md5(string_agg(symbol || date, ',' ORDER BY symbol, date)) AS h FROM preds GROUP BY 1, 2) GROUP BY 1")
def j20_equal_inputs(spark, d):
    return joins.equal_inputs(v.preds(spark, d))


@query("model split_id:i baseline_value:r difference:r", SPLIT_IC, "SELECT a.model, a.split_id, b.rank_ic AS baseline_value, a.rank_ic - b.rank_ic AS difference FROM split_ic a JOIN split_ic b ON b.model = 'random' AND a.split_id = b.split_id WHERE a.model <> 'random'")
def j15_j16_paired_metrics(spark, d):
    return joins.pair_metrics(split_ic(spark, d), "random", ["split_id"], "rank_ic")


# --- portfolios

CALENDAR = """cal AS (SELECT model, date, split_id, n // 4 AS period FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY date, split_id) - 1 AS n FROM (SELECT DISTINCT model, date, split_id FROM preds)) WHERE n % 4 = 0)"""
EQUAL = """chosen AS (SELECT p.*, period, row_number() OVER (PARTITION BY model, split_id, date ORDER BY y_score DESC, symbol) AS rn, greatest(1, ceil(count(*) OVER (PARTITION BY model, split_id, date) * 0.2::DOUBLE)) AS k FROM preds p JOIN cal USING (model, date, split_id)),
held AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY model, period) AS weight FROM chosen WHERE rn <= k)"""
TRADED = """mv AS (SELECT coalesce(a.model, b.model) AS model, coalesce(a.period, b.period) AS period, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) / 2 AS t FROM held a FULL JOIN (SELECT model, period + 1 AS period, symbol, weight FROM held) b ON a.model = b.model AND a.period = b.period AND a.symbol = b.symbol GROUP BY 1, 2),
gr AS (SELECT model, split_id, date, period, count(*) AS n_names, sum(weight * forward_return) AS gross_return, sum(weight * (forward_return - forward_excess_return)) AS benchmark_return FROM held GROUP BY 1, 2, 3, 4),
bt AS (SELECT gr.*, CASE WHEN period = 0 THEN 1 ELSE t END AS turnover, (CASE WHEN period = 0 THEN 1 ELSE t END) * 10 / 10000.0::DOUBLE AS cost FROM gr JOIN mv USING (model, period)),
bt2 AS (SELECT *, gross_return - cost AS net_return, gross_return - cost - benchmark_return AS net_excess_return FROM bt)"""
HELD = ",\n".join((CALENDAR, EQUAL, TRADED))


def backtest(spark, d):
    return portfolio.backtest(v.preds(spark, d), fraction=0.2, every=4)


@query("model split_id:i date period:i n_names:i gross_return:r cost:r turnover:r net_return:r benchmark_return:r net_excess_return:r cumulative_net:r", v.PREDS + ", " + HELD, "SELECT *, product(1 + net_return) OVER (PARTITION BY model, split_id ORDER BY date) - 1 AS cumulative_net FROM bt2")
def pf1_pf6_backtest(spark, d):
    return backtest(spark, d)


@query("model n_periods:i volatility:r sharpe:r max_drawdown:r best:r worst:r hit_rate:r avg_turnover:r total_cost:r cumulative_net_excess_return:r n_over_100pct:i plausibility_status", v.PREDS + ", " + HELD + ", wl AS (SELECT *, product(1 + net_return) OVER (PARTITION BY model ORDER BY split_id, date) AS w FROM bt2), dd AS (SELECT *, w / max(w) OVER (PARTITION BY model ORDER BY split_id, date) - 1 AS d FROM wl)",
       "SELECT model, count(*) AS n_periods, stddev_samp(net_return) * sqrt(13) AS volatility, avg(net_return) / stddev_samp(net_return) * sqrt(13) AS sharpe, min(d) AS max_drawdown, max(net_return) AS best, min(net_return) AS worst, avg(CASE WHEN net_return > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hit_rate, avg(turnover) AS avg_turnover, sum(cost) AS total_cost, product(1 + net_return) - product(1 + benchmark_return) AS cumulative_net_excess_return, count(*) FILTER (WHERE abs(net_return) > 1) AS n_over_100pct, CASE WHEN count(*) FILTER (WHERE abs(net_return) > 1) > 0 THEN 'invalid_extreme_period_return' ELSE 'passed' END AS plausibility_status FROM dd GROUP BY model")
def pf7_risk(spark, d):
    return portfolio.risk(backtest(spark, d), 13.0, split=False)


@query("model period:i symbol weight:r", v.PREDS + ", " + CALENDAR + ", sel AS (SELECT p.*, period, row_number() OVER (PARTITION BY model, split_id, date, sector ORDER BY y_score DESC, symbol) AS rn, greatest(1, ceil(count(*) OVER (PARTITION BY model, split_id, date, sector) * 0.2::DOUBLE)) AS k FROM preds p JOIN cal USING (model, date, split_id)), hs AS (SELECT * FROM sel WHERE rn <= k), ns AS (SELECT model, period, count(DISTINCT sector) AS s FROM hs GROUP BY 1, 2)",
       "SELECT model, period, symbol, 1.0::DOUBLE / s / count(*) OVER (PARTITION BY model, period, sector) AS weight FROM hs JOIN ns USING (model, period)")
def k2_pf3_sector_weights(spark, d):
    p = v.preds(spark, d)
    chosen = portfolio.select_names(p.join(portfolio.rebalance_calendar(p, 4), ["model", "date", "split_id"]), fraction=0.2, sector="sector")
    return portfolio.weigh(chosen, "sector")


@query("model split_id:i date rolling_sharpe:r", v.PREDS + ", " + HELD, "SELECT model, split_id, date, CASE WHEN count(*) OVER w >= 5 AND stddev_samp(net_return) OVER w > 1e-12 THEN avg(net_return) OVER w / stddev_samp(net_return) OVER w * sqrt(13) END AS rolling_sharpe FROM bt2 WINDOW w AS (PARTITION BY model ORDER BY split_id, date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def w26_rolling_sharpe(spark, d):
    return portfolio.rolling_sharpe(backtest(spark, d), 12, 13.0)


VALUES = "vals AS (SELECT symbol, date, volume * close AS equity, volume * low AS gross_exposure FROM panel), vd AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol ORDER BY date) - 1 AS dd FROM vals)"


@query("symbol cumulative_return:r max_drawdown:r avg_exposure:r n_days:i", v.PANEL + ", " + VALUES, "SELECT symbol, arg_max(equity, date) / arg_min(equity, date) - 1 AS cumulative_return, min(dd) AS max_drawdown, avg(gross_exposure / equity) AS avg_exposure, count(*) AS n_days FROM vd GROUP BY 1")
def pf8_valuation_metrics(spark, d):
    values = v.panel(spark, d).select("symbol", "date", (F.col("volume") * F.col("close")).alias("equity"), (F.col("volume") * F.col("low")).alias("gross_exposure"))
    return portfolio.valuation_metrics(values, ["symbol"])


# --- ensembles

ROW = "split_id:i symbol date "


@query(ROW + "y_score:r n_models:i", v.PREDS + ", wh AS (SELECT split_id, count(DISTINCT (symbol, date)) AS n FROM preds GROUP BY 1), cm AS (SELECT split_id, model FROM preds GROUP BY 1, 2 HAVING count(*) = (SELECT n FROM wh WHERE wh.split_id = preds.split_id))".replace("cm AS (SELECT split_id, model FROM preds GROUP BY 1, 2 HAVING count(*) = (SELECT n FROM wh WHERE wh.split_id = preds.split_id))", "cm AS (SELECT split_id, model FROM (SELECT split_id, model, count(*) AS c FROM preds GROUP BY 1, 2) JOIN wh USING (split_id) WHERE c = n)"), "SELECT split_id, symbol, date, avg(y_score) AS y_score, count(*) AS n_models FROM preds JOIN cm USING (split_id, model) GROUP BY 1, 2, 3")
def e1_ensemble_average(spark, d):
    return ensembles.average(v.preds(spark, d))


@query(ROW + "y_score:r", v.PREDS, f"SELECT split_id, symbol, date, avg(r) AS y_score FROM (SELECT *, {prank('y_score', 'split_id, date, model')} AS r FROM preds) GROUP BY 1, 2, 3")
def e2_ensemble_rank_average(spark, d):
    return ensembles.rank_average(v.preds(spark, d))


@query("split_id:i model mean_change:r", v.PREDS + ", s AS (SELECT *, sum(y_score) OVER w AS t, count(*) OVER w AS k FROM preds WINDOW w AS (PARTITION BY split_id, symbol, date))", "SELECT split_id, model, avg(abs(t / k - (t - y_score) / (k - 1))) AS mean_change FROM s WHERE k > 1 GROUP BY 1, 2")
def e6_ensemble_sensitivity(spark, d):
    return ensembles.sensitivity(v.preds(spark, d))


@query(ROW + "y_score:9 dispersion:9 n_runs:i", v.PREDS, "SELECT split_id, symbol, date, avg(y_score) AS y_score, stddev_pop(y_score) AS dispersion, count(*) AS n_runs FROM preds GROUP BY 1, 2, 3")
def e8_seed_ensemble(spark, d):
    return ensembles.seed_ensemble(v.preds(spark, d))


CURVES = v.BINARY + """, splits AS (SELECT DISTINCT split_id AS cur FROM binary_preds),
history AS (SELECT model, cur, y_score AS s, y_true::DOUBLE AS p FROM binary_preds JOIN splits ON split_id < cur),
fit AS (SELECT model, cur, 0 AS i, 0::DOUBLE AS a, 0::DOUBLE AS b FROM history GROUP BY 1, 2 HAVING count(*) >= 20 AND sum(p) BETWEEN 1 AND count(*) - 1
        UNION ALL SELECT model, cur, i + 1, a - da * least(1, 10 / greatest(abs(da), abs(db), 1e-12)), b - db * least(1, 10 / greatest(abs(da), abs(db), 1e-12))
        FROM (SELECT *, (bb * ga - ab * gb) / (aa * bb - ab * ab) AS da, (aa * gb - ab * ga) / (aa * bb - ab * ab) AS db
              FROM (SELECT model, cur, i, a, b, sum(s * (q - p)) + a AS ga, sum(q - p) AS gb, sum(q * (1 - q) * s * s) + 1 AS aa, sum(q * (1 - q) * s) AS ab, sum(q * (1 - q)) AS bb
                    FROM (SELECT *, 1 / (1 + exp(-(a * s + b))) AS q FROM fit JOIN history USING (model, cur) WHERE i < 12) GROUP BY model, cur, i, a, b))),
curve AS (SELECT model, cur AS split_id, a, b FROM fit WHERE i = 12)"""


@query("model split_id:i calibrated:r", "RECURSIVE " + CURVES, "SELECT model, split_id, avg(CASE WHEN a IS NULL THEN greatest(1e-6, least(1 - 1e-6, y_score)) ELSE 1 / (1 + exp(-(a * y_score + b))) END) AS calibrated FROM binary_preds LEFT JOIN curve USING (model, split_id) GROUP BY 1, 2")
def e3_calibration(spark, d):
    return ensembles.calibrate(v.binary_preds(spark, d)).groupBy("model", "split_id").agg(F.avg("calibrated").alias("calibrated"))


@query("split_id:i model weight:r weight_source")
def e4_stack_weights(spark, d):
    return ensembles.stack_weights(v.preds(spark, d), ["momentum", "random", "sign"])


@query("model split_id:i n_rows:i y_score:r")
def e5_chronological_ensembles(spark, d):
    """The three rankers as classifiers of outperformance."""
    combined = ensembles.chronological(v.preds(spark, d)).predictions
    return combined.groupBy("model", "split_id").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("y_score").alias("y_score"))


def ranker_targets(spark, d):
    """The three rankers, with the excess return itself as their target."""
    return v.preds(spark, d).withColumn("y_true", F.col("forward_excess_return"))


RANKED = v.PREDS + f""", wh AS (SELECT split_id, count(DISTINCT (symbol, date)) AS n FROM preds GROUP BY 1), cm AS (SELECT split_id, model FROM (SELECT split_id, model, count(*) AS c FROM preds GROUP BY 1, 2) JOIN wh USING (split_id) WHERE c = n),
ck AS (SELECT split_id FROM cm GROUP BY 1 HAVING count(*) > 1), rp AS (SELECT p.*, {prank('y_score', 'split_id, date, model')} AS r FROM preds p JOIN cm USING (split_id, model) JOIN ck USING (split_id)), av AS (SELECT split_id, symbol, date, avg(y_score) AS s, avg(r) AS r FROM rp GROUP BY 1, 2, 3)"""


@query(ROW + "model y_score:r", RANKED, "SELECT split_id, symbol, date, unnest(['ranking_simple_average_ensemble', 'ranking_rank_average_ensemble']) AS model, unnest([s, r]) AS y_score FROM av")
def e5_ranking_averages(spark, d):
    """Of the ensembles of rankers, the two that need no search."""
    return ensembles.chronological(ranker_targets(spark, d)).predictions.where("model <> 'ranking_constrained_stack_ensemble'").select("split_id", "symbol", "date", "model", "y_score")


@query("task split_id:i model rank_corr:r mean_change:r")
def e5_ensemble_sensitivity(spark, d):
    return ensembles.chronological(ranker_targets(spark, d)).sensitivity


# --- sampling and top lists


@query("symbol date y_true:i", v.PREDS, "SELECT symbol, date, y_true FROM (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY sha256('5|' || symbol || '|' || CAST(date AS VARCHAR)), symbol, date) AS n FROM preds WHERE model = 'sign') WHERE n <= 50")
def k16_exactly_balanced(spark, d):
    return sampling.balanced_exact(v.preds(spark, d).where("model = 'sign'"), "y_true", 100, 5)


@query("symbol", "", "SELECT symbol FROM (SELECT DISTINCT c_name AS symbol FROM customer WHERE c_acctbal > 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY sha256(c_name), c_name LIMIT 40) UNION SELECT 'BENCH'")
def k7_candidates(spark, d):
    assets = v.table(spark, d, "customer").select(F.col("c_name").alias("symbol"), F.col("c_mktsegment").alias("exchange"), (F.col("c_acctbal") > 0).alias("tradable"), F.lit("2001-01-01").cast("date").alias("effective_date"))
    return sampling.candidates(assets, ["BUILDING", "MACHINERY"], 40, v.BENCH)


@query("symbol form filing_date accession:i", v.FILINGS, "SELECT symbol, form, filing_date, accession FROM filings QUALIFY row_number() OVER (PARTITION BY symbol, form ORDER BY filing_date DESC, accession DESC) = 1")
def d3s_d4s_last_filings(spark, d):
    return joins.last_row(v.filings(spark, d), ["symbol", "form"], ["filing_date", "accession"])


@query("symbol form share:r", v.FILINGS, "SELECT symbol, form, round(amount / 7::DOUBLE, 3) AS share FROM filings")
def p16_safe_projection(spark, d):
    rows = v.filings(spark, d).withColumn("share", F.col("amount") / 7)
    return contracts.safe_projection(rows, ["symbol", "form", "share", "absent"], 3)



@query("symbol date close:r", v.PANEL, "SELECT symbol, date, close FROM panel QUALIFY row_number() OVER (PARTITION BY date ORDER BY sha256(upper(symbol)), symbol) <= 5")
def k8_cross_section_sample(spark, d):
    return sampling.per_date(v.panel(spark, d), 5)


@query("symbol date y_true:i", v.PREDS + ", p AS (SELECT * FROM preds WHERE model = 'sign'), m AS (SELECT split_id, least(count(*) FILTER (WHERE y_true = 0), count(*) FILTER (WHERE y_true = 1), 50) AS k FROM p GROUP BY 1)", "SELECT symbol, date, y_true FROM (SELECT *, row_number() OVER (PARTITION BY split_id, y_true ORDER BY sha256('5|' || symbol || '|' || CAST(date AS VARCHAR)), symbol, date) AS n FROM p) JOIN m USING (split_id) WHERE n <= k")
def k11_k12_balanced_sample(spark, d):
    return sampling.balance(v.preds(spark, d).where("model = 'sign'"), "y_true", 5, ["split_id"], 100)


@query("symbol date", v.PANEL + ", s AS (SELECT symbol FROM (SELECT DISTINCT symbol FROM panel) ORDER BY sha256('9|' || symbol), symbol LIMIT 10), y AS (SELECT date, row_number() OVER (PARTITION BY year(date) ORDER BY sha256('9|' || CAST(year(date) AS VARCHAR) || '|' || CAST(date AS VARCHAR)), date) AS n FROM (SELECT DISTINCT date FROM panel JOIN s USING (symbol)))", "SELECT symbol, date FROM panel WHERE symbol IN (SELECT symbol FROM s) AND date IN (SELECT date FROM y WHERE n <= 8)")
def k9_k10_symbol_and_date_sample(spark, d):
    rows = sampling.symbols(v.panel(spark, d), 10, 9).withColumn("y", F.year("date"))
    return sampling.dates(rows, 8, 9, ["y"])


@query("date", v.PANEL + ", di AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel))", "SELECT date FROM di WHERE i IN (SELECT CAST(round_even(k * (n - 1) / 9::DOUBLE, 0) AS BIGINT) FROM (SELECT unnest(range(0, 10)) AS k) CROSS JOIN (SELECT any_value(n) AS n FROM di))")
def k14_evenly_spaced_dates(spark, d):
    return sampling.evenly_spaced_dates(v.panel(spark, d), 10)


@query("model symbol date rank:i side", v.PREDS + ", l AS (SELECT model, max(date) AS date FROM preds GROUP BY 1), r AS (SELECT model, symbol, date, row_number() OVER (PARTITION BY model ORDER BY y_score DESC, symbol) AS rank, count(*) OVER (PARTITION BY model) AS n FROM preds JOIN l USING (model, date))", "SELECT *, CASE WHEN rank <= 3 THEN 'top' ELSE 'bottom' END AS side FROM r WHERE rank <= 3 OR rank > n - 3")
def k3_k5_top_and_bottom(spark, d):
    return sampling.top_bottom(sampling.latest_signals(v.preds(spark, d), v.BENCH), 3)


@query("split_id:i n_rows:i positive_rate:r n_symbols:i n_dates:i key_digest:i", v.PREDS, "SELECT split_id, count(*) AS n_rows, avg(y_true::DOUBLE) AS positive_rate, count(DISTINCT symbol) AS n_symbols, count(DISTINCT date) AS n_dates, sum(CAST('0x' || substr(md5(symbol || '|' || CAST(date AS VARCHAR)), 1, 8) AS BIGINT)) AS key_digest FROM preds WHERE model = 'sign' GROUP BY 1")
def a14_sample_manifest(spark, d):
    return sampling.sample_manifest(v.preds(spark, d).where("model = 'sign'"), ["split_id"], "y_true")


@query("model split_id:i rank_ic:r", SPLIT_IC, "SELECT model, split_id, rank_ic FROM split_ic WHERE rank_ic IS NOT NULL QUALIFY row_number() OVER (PARTITION BY model ORDER BY rank_ic DESC NULLS LAST, split_id) = 1")
def k15_best_trial(spark, d):
    return sampling.best_trial(split_ic(spark, d).where("rank_ic IS NOT NULL").withColumn("trial", F.col("split_id")), ["rank_ic"], ["model"])


# --- rankers


@query("symbol date split_id:i y_score:r", v.PREDS, "SELECT symbol, date, split_id, y - avg(y) OVER (PARTITION BY date, coalesce(sector, 'unknown')) AS y_score FROM (SELECT *, CAST('0x' || substr(sha256(symbol || '|' || CAST(date AS VARCHAR) || '|' || CAST(split_id AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS y FROM preds WHERE model = 'sign')")
def r3_c11_random_rank_sector_neutral(spark, d):
    return models.sector_neutral(models.random_rank(v.preds(spark, d).where("model = 'sign'")))


@query("model n_rows:i y_score:r")
def r5_r15_walk_forward_models(spark, d):
    """All earlier years train for each later year of the data: logistic, ridge, elastic net, Huber, forest, boosting."""
    p = v.preds(spark, d)
    rows = p.groupBy("symbol", "date", "y_true", "forward_return").pivot("model", ["momentum", "sign", "random"]).agg(F.first("y_score")).na.drop()
    return walk_forward_scores(rows).groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("y_score").alias("y_score"))


def walk_forward_scores(rows):
    """Predictions for each year of rows after the first, by the learners of r5_r15 with their own parameters."""
    rows = tables.written(rows, "walk-forward")  # the folds and every fit read it
    folds = splits.yearly(rows)
    ids = sorted(r["split_id"] for r in folds.select("split_id").collect())
    chosen = {"boosting": models.fit_boosting, "forest": models.fit_forest, "logistic": models.fit_logistic, "ridge": models.fit_ridge, "elastic_net": models.fit_elastic_net, "huber": models.fit_huber}
    return models.walk_forward(joins.assign_roles(rows, folds), ["momentum", "sign", "random"], "y_true", chosen, ids)


# --- audit

AUD = v.RETURNS + ", aud AS (SELECT *, lead(close, 1) OVER (PARTITION BY symbol ORDER BY date) / nullif(close, 0) - 1 AS fr FROM returns)"


def audited(spark, d):
    return v.returns(spark, d).withColumn("fr", F.try_divide(F.lead("close", 1).over(expr.series()), F.col("close")) - 1)


@query("feature period:i rank_ic:r n_pairs:i", AUD + f""", lg AS (SELECT date, year(date) AS period, fr, unnest(['return_1d', 'return_5d']) AS feature, unnest([return_1d, return_5d]) AS value FROM aud), lr AS (SELECT * FROM lg WHERE value IS NOT NULL AND fr IS NOT NULL),
    rk AS (SELECT *, {rank('value', 'feature, date')} AS a, {rank('fr', 'feature, date')} AS b FROM lr), dy AS (SELECT feature, period, date, {scorr('a', 'b', 3)} AS ic, count(*) AS n FROM rk GROUP BY 1, 2, 3)""", "SELECT feature, period, avg(ic) AS rank_ic, sum(n) AS n_pairs FROM dy GROUP BY 1, 2")
def au3_predictive(spark, d):
    return audit.predictive(audited(spark, d).withColumn("up", (F.col("fr") > 0).cast("int")), ["return_1d", "return_5d"], "fr", "up")


AUQ = catalog.ROLED.format("rr").replace("folds AS", "rr AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS return_1d FROM panel), folds AS", 1)


@query("split_id:i feature psi:r", AUQ + """, q AS (SELECT split_id, list_distinct(quantile_cont(return_1d, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1.0])) AS e FROM roled WHERE role = 'train' GROUP BY 1),
    iq AS (SELECT split_id, list_sort(e)[2:len(e) - 1] AS inner_edges, len(e) - 1 AS nb FROM q WHERE len(e) >= 3), bn AS (SELECT split_id, role, len(list_filter(inner_edges, lambda x: x < return_1d)) AS bin FROM roled JOIN iq USING (split_id) WHERE return_1d IS NOT NULL),
    ct AS (SELECT split_id, bin, count(*) FILTER (WHERE role = 'train') AS t, count(*) FILTER (WHERE role = 'validation') AS v FROM bn GROUP BY 1, 2), ev AS (SELECT split_id, unnest(range(0, nb)) AS bin FROM iq), fu AS (SELECT split_id, bin, coalesce(t, 0) AS t, coalesce(v, 0) AS v FROM ev LEFT JOIN ct USING (split_id, bin)),
    sh AS (SELECT *, greatest(1e-6, v / sum(v) OVER (PARTITION BY split_id)::DOUBLE) AS a, greatest(1e-6, t / sum(t) OVER (PARTITION BY split_id)::DOUBLE) AS x FROM fu)""", "SELECT split_id, 'return_1d' AS feature, sum((a - x) * ln(a / x)) AS psi FROM sh GROUP BY 1")
def au2_psi(spark, d):
    rows = joins.assign_roles(audit.long_features(v.returns(spark, d), ["return_1d"]), catalog.folds(spark, d))
    return audit.psi(rows)


@query("split_id:i feature n_rows:i missing_rate:r symbol_coverage:r stale_rate:r", AUQ + ", lg AS (SELECT split_id, symbol, date, unnest(['close', 'return_1d']) AS feature, unnest([close, return_1d]) AS value FROM roled), stl AS (SELECT symbol, date, unnest(['close', 'return_1d']) AS feature, unnest([CASE WHEN close = lag(close) OVER w THEN 1.0::DOUBLE WHEN close IS NOT NULL AND lag(close) OVER w IS NOT NULL THEN 0 END, CASE WHEN return_1d = lag(return_1d) OVER w THEN 1.0::DOUBLE WHEN return_1d IS NOT NULL AND lag(return_1d) OVER w IS NOT NULL THEN 0 END]) AS stale FROM rr WINDOW w AS (PARTITION BY symbol ORDER BY date))",
       "SELECT split_id, feature, count(*) AS n_rows, avg(CASE WHEN value IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS missing_rate, count(DISTINCT CASE WHEN value IS NOT NULL THEN symbol END) / count(DISTINCT symbol)::DOUBLE AS symbol_coverage, avg(stale) AS stale_rate FROM lg JOIN stl USING (symbol, date, feature) GROUP BY 1, 2")
def au1_w24_feature_quality(spark, d):
    return audit.quality(v.returns(spark, d), ["close", "return_1d"], catalog.folds(spark, d))


@query("a b rank_corr:r", v.RETURNS + f", z AS (SELECT * FROM returns WHERE return_5d IS NOT NULL AND return_10d IS NOT NULL), y AS (SELECT {rank('return_5d', '')} AS a, {rank('return_10d', '')} AS b FROM z)", "SELECT 'return_5d' AS a, 'return_10d' AS b, corr(a, b) AS rank_corr FROM y")
def au5_redundant_features(spark, d):
    return audit.redundancy(v.returns(spark, d), ["return_5d", "return_10d"], 0.0).withColumnsRenamed({"left": "a", "right": "b"})


@query("feature score:r sign:i", AUD + f""", lg AS (SELECT date, fr, unnest(['return_1d', 'return_5d', 'volume']) AS feature, unnest([return_1d, return_5d, volume]) AS value FROM aud), cv AS (SELECT feature, avg(CASE WHEN value IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS coverage FROM lg GROUP BY 1),
    dy AS (SELECT * FROM (SELECT feature, date, {scorr('value', 'fr', 3)} AS d FROM lg GROUP BY 1, 2) WHERE d IS NOT NULL), md AS (SELECT feature, median(d) AS m FROM dy GROUP BY 1)""", "SELECT feature, abs(any_value(m)) * avg(CASE WHEN sign(d) = sign(m) THEN 1.0::DOUBLE ELSE 0 END) * any_value(coverage) AS score, CAST(sign(any_value(m)) AS INT) AS sign FROM dy JOIN md USING (feature) JOIN cv USING (feature) GROUP BY 1")
def au10_au12_daily_profile(spark, d):
    return audit.daily_profile(audited(spark, d), ["return_1d", "return_5d", "volume"], "fr")


# --- facts, filings, series, universe

WIDE_FACTS = v.FACTS + ", wf AS (SELECT symbol, fiscal_period, filing_date, accession, " + ", ".join(f"max(CASE WHEN concept = '{c}' THEN value END) AS {c}" for c in v.CONCEPTS) + " FROM facts GROUP BY 1, 2, 3, 4)"


@query("symbol fiscal_period filing_date AF:r NO:r RF:r AF_growth:r NO_growth:r share:r", WIDE_FACTS, "SELECT *, AF / nullif(last_value(AF IGNORE NULLS) OVER w, 0) - 1 AS AF_growth, NO / nullif(last_value(NO IGNORE NULLS) OVER w, 0) - 1 AS NO_growth, AF / nullif(RF, 0) AS share FROM wf WINDOW w AS (PARTITION BY symbol, fiscal_period ORDER BY filing_date, accession ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def a1_a3_fundamentals(spark, d):
    wide = features.filing_facts(v.facts(spark, d), v.CONCEPTS, ["symbol", "fiscal_period", "filing_date", "accession"])
    return features.add_ratios(features.add_growth(wide, ["AF", "NO"]), {"share": ("AF", "RF")})


@query("symbol date days_since:i AF:r", v.FILINGS + ", " + v.MARKET + ", " + WIDE_FACTS, "SELECT m.symbol, m.date, date_diff('day', filing_date, m.date) AS days_since, AF FROM market m ASOF LEFT JOIN wf ON wf.symbol = m.symbol AND m.date >= wf.filing_date")
def j7_fundamentals_asof(spark, d):
    wide = features.filing_facts(v.facts(spark, d), v.CONCEPTS, ["symbol", "fiscal_period", "filing_date", "accession"])
    out = joins.asof_join(v.market_weeks(spark, d), wide, ["symbol"], "date", "filing_date", ["accession"])
    return out.withColumn("days_since", F.datediff("date", "filing_date"))


@query("date s1:r s2:r s3:r s4:r s5:r", v.MACRO_WIDE, "SELECT * FROM wide")
def n14_macro_wide(spark, d):
    return catalog.macro(spark, d)


@query("symbol form filing_date accession:i next_day", v.FILINGS, "SELECT *, CAST(filing_date + CAST(CASE dayofweek(filing_date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS INT) AS DATE) AS next_day FROM filings QUALIFY row_number() OVER (PARTITION BY symbol, form, filing_date ORDER BY accession DESC) = 1")
def d5s_n15_filing_events(spark, d):
    return joins.last_row(v.filings(spark, d), ["symbol", "form", "filing_date"], ["accession"]).withColumn("next_day", expr.business_day_after("filing_date"))


@query("symbol date close:r volume:i")
def n1_bar_pages(spark, d):
    return bar_pages(v.panel(spark, d))


@query("symbol date close:r volume:i", v.PANEL, "SELECT upper(symbol) AS symbol, date, close, volume FROM panel")
def n1_bar_pages_all(spark, d):
    return bar_pages(v.panel(spark, d))


def bar_pages(p):
    """A page a date, built from the panel and parsed."""
    bars = p.groupBy("date").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("symbol", F.array(F.struct(F.date_format("date", "yyyy-MM-dd'T'00:00:00'Z'").alias("t"), F.col("close").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").cast("long").alias("v")))))).alias("bars"))).alias("payload"))
    return ingest.bar_pages(bars)


SQL["n1_bar_pages"] = f"WITH {v.PANEL} SELECT upper(symbol) AS symbol, date, round(close, 6) + 0.0::DOUBLE AS close, CAST(volume AS BIGINT) AS volume FROM panel"


@query("symbol form filing_date accession:i", v.FILINGS, "SELECT * FROM filings WHERE form IN ('F', 'O')")
def n7_submissions(spark, d):
    f = v.filings(spark, d).withColumn("page", F.pmod(F.col("accession"), F.lit(97)))
    docs = f.groupBy("symbol", "page").agg(F.collect_list(F.struct("form", "filing_date", "accession")).alias("x")).select("symbol", F.col("x.form").alias("form"), F.col("x.filing_date").alias("filing_date"), F.col("x.accession").alias("accession"))
    return ingest.submissions(docs, ["F", "O"])


@query("symbol padded kind", "", "SELECT upper(trim(c_name)) AS symbol, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS padded, CASE WHEN contains(lower(c_mktsegment), 'auto') THEN 'vehicle' WHEN contains(lower(c_mktsegment), 'house') THEN 'home' ELSE 'common' END AS kind FROM customer")
def n3_n6_identifiers(spark, d):
    c = v.table(spark, d, "customer")
    return c.select(ingest.ticker(F.col("c_name")).alias("symbol"), ingest.format_cik(F.col("c_custkey")).alias("padded"), ingest.classify_security(F.col("c_mktsegment"), [("auto", "vehicle"), ("house", "home")]).alias("kind"))


@query("symbol accession concept unit value:r reason", v.FACTS, "SELECT symbol, accession, concept, 'EUR' AS unit, value + 1 AS value, 'collision' AS reason FROM facts WHERE concept = 'AF' UNION ALL SELECT symbol, accession, concept, 'shares', value, 'collision' FROM facts WHERE concept <> 'AF'")
def n17_fact_collisions(spark, d):
    f = v.facts(spark, d).withColumns({"unit": F.when(F.col("concept") == "AF", "USD").otherwise("shares"), "start_date": F.add_months("end_date", -3), "sec_concept": F.col("concept")})
    twice = f.unionByName(f.withColumns({"unit": F.lit("EUR"), "value": F.col("value") + 1}))
    return ingest.resolve_collisions(twice, ["USD", "EUR"], ["AF"])[1]


CHECKS = v.PANEL + ", lagged AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS r FROM panel)"


@query("table check severity affected_rows:i passed".replace("table", "table_name").replace("check", "check_name"), v.PANEL, """SELECT 'prices' AS table_name, unnest(['positive_prices', 'high_low_order', 'volume_not_negative', 'not_future', 'known_symbol']) AS check_name, unnest(['critical', 'critical', 'critical', 'critical', 'warning']) AS severity, unnest([a, b, c, e, f]) AS affected_rows, unnest([a, b, c, e, f]) = 0 AS passed
    FROM (SELECT count(*) FILTER (WHERE close <= 0 OR close IS NULL) AS a, count(*) FILTER (WHERE high < low OR high < close - 1e-9 OR low > close + 1e-9) AS b, count(*) FILTER (WHERE volume < 0) AS c, count(*) FILTER (WHERE date > DATE '2001-10-01') AS e, count(*) FILTER (WHERE symbol IS NULL OR trim(symbol) = '') AS f FROM panel)""")
def p11_quality_checks(spark, d):
    rows = v.panel(spark, d).withColumn("open", F.col("close"))
    return quality.checks(rows, "prices", quality.price_rules(F.lit("2001-10-01").cast("date"))).withColumnsRenamed({"table": "table_name", "check": "check_name"})


@query("symbol date reason value:r", CHECKS, "SELECT symbol, date, 'absolute_return' AS reason, r AS value FROM lagged WHERE abs(r) > 0.5::DOUBLE")
def p12_quarantine(spark, d):
    return quality.quarantine_returns(v.panel(spark, d), 0.5)


@query("passed n_checks:i n_failed:i n_critical:i", v.PANEL, "SELECT f = 0 AS passed, 5 AS n_checks, CASE WHEN f > 0 THEN 1 ELSE 0 END AS n_failed, CASE WHEN f > 0 THEN 1 ELSE 0 END AS n_critical FROM (SELECT count(*) FILTER (WHERE date > DATE '2001-10-01') AS f FROM panel)")
def p13_quality_gate(spark, d):
    rows = v.panel(spark, d).withColumn("open", F.col("close"))
    return quality.gate(quality.checks(rows, "prices", quality.price_rules(F.lit("2001-10-01").cast("date"))))


@query("symbol n_rows:i", v.FILINGS, "SELECT symbol, count(*) AS n_rows FROM filings GROUP BY 1 HAVING count(*) > 1")
def p3_repeated_keys(spark, d):
    from panelspark.operators import contracts

    return contracts.repeated_keys(v.filings(spark, d), ["symbol"])


def _universe(spark, d):
    p = v.panel(spark, d).where(F.col("symbol") != v.BENCH)
    assets = p.where(F.month("date") == 1).select("symbol", F.col("date").alias("effective_date"), F.when(F.col("volume") > 20, "active").otherwise("inactive").alias("status"), F.lit(True).alias("tradable"))
    meta = p.where(F.month("date").isin(1, 7)).select("symbol", F.col("date").alias("effective_date"), v.sector().alias("sector"), (F.col("close") * F.col("volume")).alias("market_cap"))
    return universe.membership(v.panel(spark, d), assets, meta, universe.Rules(5.0, 10_000.0, 10, 10), v.BENCH)


UNIVERSE = v.PANEL + f""", pp AS (SELECT * FROM panel WHERE symbol <> 'BENCH'), full_panel AS (SELECT s.symbol, t.date, close, volume FROM (SELECT DISTINCT symbol FROM pp) s CROSS JOIN (SELECT DISTINCT date FROM pp) t LEFT JOIN pp ON pp.symbol = s.symbol AND pp.date = t.date),
u0 AS (SELECT *, count(close) OVER (PARTITION BY symbol ORDER BY date) AS observed_days, CASE WHEN count(close * volume) OVER w >= 10 THEN quantile_cont(close * volume, 0.5) OVER w END AS mdv FROM full_panel WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
u1 AS (SELECT u0.*, status, sector, market_cap FROM u0 ASOF LEFT JOIN (SELECT symbol, date AS ed, CASE WHEN volume > 20 THEN 'active' ELSE 'inactive' END AS status FROM pp WHERE month(date) = 1) a ON a.symbol = u0.symbol AND u0.date >= a.ed ASOF LEFT JOIN (SELECT symbol, date AS md, {v.SECTOR} AS sector, close * volume AS market_cap FROM pp WHERE month(date) IN (1, 7)) b ON b.symbol = u0.symbol AND u0.date >= b.md),
u2 AS (SELECT *, close IS NOT NULL AS h, coalesce(status = 'active', false) AS ac, coalesce(close >= 5, false) AS pr, coalesce(mdv >= 10000, false) AS vo, coalesce(observed_days >= 10, false) AS hi, sector IS NOT NULL AS se FROM u1),
u3 AS (SELECT *, h AND ac AND pr AND vo AND hi AND se AS is_member, CASE WHEN NOT h THEN 'has_price' WHEN NOT ac THEN 'is_active' WHEN NOT pr THEN 'price_ok' WHEN NOT vo THEN 'volume_ok' WHEN NOT hi THEN 'history_ok' WHEN NOT se THEN 'sector_known' END AS exclusion_reason FROM u2),
members AS (SELECT *, {prank('market_cap', 'date, is_member')} AS p FROM u3)"""


@query("symbol date is_member exclusion_reason size_bucket", UNIVERSE, "SELECT symbol, date, is_member, exclusion_reason, CASE WHEN is_member THEN CASE WHEN p <= 1 / 3.0::DOUBLE THEN 'small' WHEN p <= 2 / 3.0::DOUBLE THEN 'mid' WHEN p IS NOT NULL THEN 'large' END END AS size_bucket FROM members")
def u1_universe_membership(spark, d):
    return _universe(spark, d)


@query("date observed:i members:i entries:i exits:i sectors:i smallest_sector:i turnover:r", UNIVERSE + ", mw AS (SELECT *, coalesce(lag(is_member) OVER (PARTITION BY symbol ORDER BY date), false) AS was FROM members), sm AS (SELECT date, min(c) AS smallest_sector FROM (SELECT date, sector, count(*) AS c FROM members WHERE is_member GROUP BY 1, 2) GROUP BY 1), dd AS (SELECT date, count(*) FILTER (WHERE h) AS observed, count(*) FILTER (WHERE is_member) AS members, count(*) FILTER (WHERE is_member AND NOT was) AS entries, count(*) FILTER (WHERE NOT is_member AND was) AS exits, count(DISTINCT CASE WHEN is_member THEN sector END) AS sectors FROM mw GROUP BY 1)",
       "SELECT dd.*, smallest_sector, (entries + exits) / nullif(members + coalesce(lag(members) OVER (ORDER BY dd.date), 0), 0)::DOUBLE AS turnover FROM dd LEFT JOIN sm USING (date)")
def u2_a4_w23_universe_daily(spark, d):
    return universe.daily(_universe(spark, d))


# --- orders


def _accounts(spark, d):
    s = v.panel(spark, d).where(f"symbol <> '{v.BENCH}'").groupBy("symbol").agg(F.max_by("close", "date").alias("price"), F.max_by("volume", "date").alias("volume"))
    accounts = v.table(spark, d, "nation").select(F.col("n_nationkey").alias("account_id"))
    draw = expr.hash_draw(1000, "account_id", "symbol")
    signals = s.crossJoin(F.broadcast(accounts)).select("account_id", "symbol", (draw / 1000.0).alias("score"), "price", F.lit(100000.0).alias("equity"))
    positions = s.crossJoin(F.broadcast(accounts)).where(expr.hash_draw(5, "symbol", "account_id") == 0).select("account_id", "symbol", (F.col("price") * 3).alias("market_value"))
    return signals, positions


ACCOUNTS = v.PANEL + f""", sp AS (SELECT symbol, arg_max(close, date) AS price FROM panel WHERE symbol <> 'BENCH' GROUP BY 1), sig AS (SELECT n_nationkey AS account_id, symbol, {draw_sql('1000', 'n_nationkey', 'symbol')} / 1000.0::DOUBLE AS score, price FROM sp, nation),
pos AS (SELECT n_nationkey AS account_id, symbol, price * 3 AS market_value FROM sp, nation WHERE {draw_sql('5', 'symbol', 'n_nationkey')} = 0),
ch AS (SELECT account_id, symbol, 0.95::DOUBLE / count(*) OVER (PARTITION BY account_id) AS target_weight FROM (SELECT * FROM sig QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY score DESC, symbol) <= 5)),
it0 AS (SELECT coalesce(ch.account_id, pos.account_id) AS account_id, coalesce(ch.symbol, pos.symbol) AS symbol, coalesce(target_weight, 0) AS target_weight, coalesce(market_value / 100000.0::DOUBLE, 0) AS current_weight FROM ch FULL JOIN pos ON ch.account_id = pos.account_id AND ch.symbol = pos.symbol),
it1 AS (SELECT it0.*, price, target_weight - current_weight AS delta_weight, abs(target_weight - current_weight) * 100000 AS notional FROM it0 JOIN sp USING (symbol)),
intents AS (SELECT *, CASE WHEN notional >= 500 AND delta_weight > 0 THEN 'buy' WHEN notional >= 500 THEN 'sell' ELSE 'hold' END AS side FROM it1)"""


@query("account_id:i symbol target_weight:r current_weight:r delta_weight:r notional:r side quantity:r", ACCOUNTS, "SELECT *, CASE WHEN side <> 'hold' THEN notional / price END AS quantity FROM intents")
def x2_order_intents(spark, d):
    return orders.build_intents(*_accounts(spark, d), 5, 0.05, 500.0)


@query("account_id:i symbol order_id", ACCOUNTS, "SELECT account_id, symbol, 'px-20010105-' || substr(sha256(CAST(account_id AS VARCHAR) || '|' || symbol || '|' || side), 1, 24) AS order_id FROM intents WHERE side <> 'hold'")
def x6_order_ids(spark, d):
    rows = orders.build_intents(*_accounts(spark, d), 5, 0.05, 500.0).where("side <> 'hold'")
    return rows.withColumn("order_id", orders.order_id("px", F.lit("2001-01-05").cast("date"), F.col("account_id"), F.col("symbol"), F.col("side")))


@query("account_id:i n_orders:i avg_fill:r n_short:i status", ACCOUNTS + f", fl AS (SELECT account_id, 1 - {draw_sql('4', 'symbol', 'account_id')} / 10.0::DOUBLE AS f FROM intents WHERE side <> 'hold')", "SELECT account_id, count(*) AS n_orders, avg(f) AS avg_fill, count(*) FILTER (WHERE f < 0.99) AS n_short, CASE WHEN count(*) FILTER (WHERE f < 0.99) > 0 THEN 'partial' ELSE 'ok' END AS status FROM fl GROUP BY 1")
def x3_x5_reconciliation(spark, d):
    rows = orders.build_intents(*_accounts(spark, d), 5, 0.05, 500.0).where("side <> 'hold'")
    rows = rows.withColumn("order_id", orders.order_id("px", F.lit("2001-01-05").cast("date"), F.col("account_id"), F.col("symbol"), F.col("side")))
    fills = rows.select("order_id", (F.col("quantity") * (1 - expr.hash_draw(4, "symbol", "account_id") / 10.0)).alias("filled_qty"), (F.col("price") * 1.001).alias("filled_price"))
    return orders.reconcile(orders.order_report(fills, rows), ["account_id"])


@query("account_id:i symbol market_value:r target_value:r residual:r", ACCOUNTS, "SELECT coalesce(ch.account_id, pos.account_id) AS account_id, coalesce(ch.symbol, pos.symbol) AS symbol, coalesce(market_value, 0) AS market_value, coalesce(target_weight * 100000, 0) AS target_value, coalesce(market_value, 0) - coalesce(target_weight * 100000, 0) AS residual FROM ch FULL JOIN pos ON ch.account_id = pos.account_id AND ch.symbol = pos.symbol")
def x4_position_report(spark, d):
    signals, positions = _accounts(spark, d)
    targets = orders.build_intents(signals, positions, 5, 0.05, 500.0).where("target_weight > 0").select("account_id", "symbol", (F.col("target_weight") * 100000).alias("target_value"))
    return orders.position_report(positions, targets, ["account_id", "symbol"])


@query("symbol last_date days_since:i is_due", v.FILINGS + ", cal AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM (SELECT DISTINCT filing_date AS d FROM filings)), la AS (SELECT symbol, max(filing_date) AS last_date FROM filings WHERE form = 'P' GROUP BY 1)", "SELECT symbol, last_date, (SELECT max(i) FROM cal) - i AS days_since, (SELECT max(i) FROM cal) - i >= 5 AS is_due FROM la JOIN cal ON d = last_date")
def x9_cadence(spark, d):
    f = v.filings(spark, d)
    return orders.cadence(f.where("form = 'P'").select("symbol", F.col("filing_date").alias("date")), f.select(F.col("filing_date").alias("date")), ["symbol"], 5)


@query("model gate actual:r operator threshold:r passed", v.PREDS + ", " + HELD + ", wl AS (SELECT *, product(1 + net_return) OVER (PARTITION BY model ORDER BY split_id, date) AS w FROM bt2), dd AS (SELECT *, w / max(w) OVER (PARTITION BY model ORDER BY split_id, date) - 1 AS d FROM wl), rs AS (SELECT model, min(d) AS max_drawdown, avg(turnover) AS avg_turnover FROM dd GROUP BY 1)",
       "SELECT model, unnest(['max_drawdown', 'avg_turnover']) AS gate, unnest([max_drawdown, avg_turnover]) AS actual, unnest(['>=', '<=']) AS operator, unnest([-0.5::DOUBLE, 0.6::DOUBLE]) AS threshold, unnest([coalesce(max_drawdown >= -0.5::DOUBLE, false), coalesce(avg_turnover <= 0.6::DOUBLE, false)]) AS passed FROM rs")
def x11_stage_gates(spark, d):
    return orders.gates(portfolio.risk(backtest(spark, d), 13.0, split=False), [("max_drawdown", ">=", -0.5), ("avg_turnover", "<=", 0.6)], ["model"])


ORDER_EVENTS = """ev AS (SELECT user_id * 1000 + (CAST(floor(epoch(ts)) AS BIGINT) // 21600) % 1000 AS order_id, event_id AS seq, ts, CAST(crc AS INT) AS r FROM (SELECT *, CASE event_type {} END AS crc FROM events)),
    nm AS (SELECT order_id, seq, ts, r, ['new', 'accepted', 'partially_filled', 'filled', 'canceled'][r + 1] AS status FROM ev WHERE r IS NOT NULL)""".format(" ".join(f"WHEN '{t}' THEN {zlib.crc32(t.encode()) % 5}" for t in ("click", "view", "purchase", "signup", "error", "login", "logout", "search", "add_to_cart", "page_view", "scroll", "refund")))


@query("order_id:i status is_ended n_events:i", ORDER_EVENTS,
       "SELECT order_id, coalesce(arg_min(status, {'seq': seq, 'status': status}) FILTER (WHERE r >= 3), arg_max(status, r)) AS status, coalesce(bool_or(r >= 3), false) AS is_ended, count(*) AS n_events FROM nm GROUP BY 1")
def x13_order_states(spark, d):
    return orders.fold_events(v.order_events(spark, d))


# --- evidence


@query("model rank_ic:r spread:r composite_rank:r", BY_DATE + ", sm AS (SELECT model, round(avg(rank_ic), 6) AS rank_ic, round(avg(spread), 6) AS spread FROM ranking GROUP BY 1)", "SELECT *, (rank() OVER (ORDER BY rank_ic DESC) + rank() OVER (ORDER BY spread DESC)) / 2.0::DOUBLE AS composite_rank FROM sm")
def v3_composite_rank(spark, d):
    s = metrics.ranking_by_date(v.preds(spark, d)).groupBy("model").agg(F.round(F.avg("rank_ic"), 6).alias("rank_ic"), F.round(F.avg("spread"), 6).alias("spread"))
    return evidence.composite_rank(s, {"rank_ic": True, "spread": True})


@query("regime_type regime model accuracy:r", SQL["m9_metrics_by_regime"].split("\nSELECT ", 1)[0].removeprefix("WITH ") , f"SELECT regime_type, regime, model, {CLASSIFY} FROM rg2 GROUP BY 1, 2, 3 HAVING count(*) >= 50 QUALIFY row_number() OVER (PARTITION BY regime_type, regime ORDER BY round(accuracy, 9) DESC, model) = 1")
def v6_regime_leaders(spark, d):
    m = metrics.by_regime(v.binary_preds(spark, d), regimes(spark, d), ["volatility_regime", "rate_regime", "curve_regime"])
    return evidence.regime_leaders(m.withColumn("accuracy", F.round("accuracy", 9)), "accuracy")


SLICES = ["accuracy", "brier", "log_loss"]


@query("regime_type regime other " + " ".join(f"{m}_own:r {m}_other:r {m}_difference:r" for m in SLICES), SQL["m9_metrics_by_regime"].split("\nSELECT ", 1)[0].removeprefix("WITH ") + f", sl AS (SELECT regime_type, regime, model, {CLASSIFY} FROM rg2 GROUP BY 1, 2, 3 HAVING count(*) >= 50)",
       "SELECT a.regime_type, a.regime, b.model AS other, " + ", ".join(f"a.{m} AS {m}_own, b.{m} AS {m}_other, a.{m} - b.{m} AS {m}_difference" for m in SLICES) + " FROM sl a JOIN sl b ON a.model = 'mF' AND b.model <> 'mF' AND a.regime_type = b.regime_type AND a.regime = b.regime")
def j16_slice_differences(spark, d):
    m = metrics.by_regime(v.binary_preds(spark, d), regimes(spark, d), ["volatility_regime", "rate_regime", "curve_regime"])
    return evidence.slice_differences(m, "mF", ["regime_type", "regime"], SLICES)


@query("symbol", v.FILINGS, "SELECT symbol FROM (SELECT c_name AS symbol FROM customer WHERE c_acctbal > 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY sha256(c_name), c_name LIMIT 40) UNION SELECT 'BENCH' UNION SELECT symbol FROM filings")
def d7s_with_legacy(spark, d):
    """The latest candidates and the nations that ever filed."""
    return sampling.with_legacy(k7_candidates(spark, d), v.filings(spark, d))


# --- upserts


@query("symbol date close:r", v.PANEL, "SELECT symbol, date, CASE WHEN year(date) >= 2000 THEN close + 1 ELSE close END AS close FROM panel")
def d2s_upsert(spark, d):
    p = v.panel(spark, d).select("symbol", "date", "close")
    return joins.upsert(p, p.where(F.year("date") >= 2000).withColumn("close", F.col("close") + 1), ["symbol", "date"])
