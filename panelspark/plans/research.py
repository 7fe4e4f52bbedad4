"""Queries over target research, audits, evidence, gates and pre-trade rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import expr
from panelspark.operators import audit, dataset, evidence, features, ingest, labels, metrics, models, orders, portfolio
from panelspark.plans import catalog, evaluation, views as v
from panelspark.plans.catalog import prank, query, rank, scorr
from panelspark.plans.evaluation import ACCOUNTS, AUD, CALENDAR, CLASSIFY, HELD, PERMUTED, PERMUTED_P, SPLIT_IC, TRADED, audited, auc_sql, backtest, draw_sql, split_ic

QUERIES, SQL = catalog.QUERIES, catalog.SQL
DRAWS = 200


def share(test: str) -> str:
    return f"avg(CASE WHEN {test} THEN 1.0::DOUBLE ELSE 0 END)"


def booted(table: str, value: str) -> str:
    """model, lower_bound: of the bootstrapped means of a table of model and split_id."""
    return f"""bx AS (SELECT model, {value} AS bv, row_number() OVER (PARTITION BY model ORDER BY split_id) - 1 AS i, count(*) OVER (PARTITION BY model) AS n FROM {table} WHERE {value} IS NOT NULL),
bsl AS (SELECT model, i AS slot, n, unnest(range(1, {DRAWS + 1})) AS draw FROM bx), bpk AS (SELECT model, draw, {draw_sql('n', '42', 'draw', 'slot')} AS p FROM bsl),
bmn AS (SELECT bpk.model, draw, any_value(n) AS n, avg(bv) AS m FROM bpk JOIN bx ON bx.model = bpk.model AND bx.i = p GROUP BY 1, 2),
low AS (SELECT model, CASE WHEN any_value(n) >= 2 THEN quantile_cont(m, 0.025) ELSE CAST('-infinity' AS DOUBLE) END AS lower_bound FROM bmn GROUP BY 1)"""


# --- targets and datasets


@query(
    "selected_role target target_family label_horizon_days:i periods:i mean_rank_ic:r rank_ic_spread:r mean_magnitude:r mean_missing_rate:r class_balance:r positive_share:r selection_score:r baseline_score:r improves is_stable decision",
    catalog.DIAG + f""", ro AS (SELECT *, dense_rank() OVER (ORDER BY period DESC) AS pn FROM diag),
su AS (SELECT target, target_family, label_horizon_days, CASE WHEN target_family IN ('binary', 'neutral_zone') THEN 'classification' ELSE 'ranking' END AS selected_role, count(DISTINCT period) AS periods, avg(rank_ic) AS mean_rank_ic, stddev_samp(rank_ic) AS rank_ic_spread, avg(magnitude) AS mean_magnitude,
    avg(missing_rate) AS mean_missing_rate, 1 - abs(avg(positive_rate) - 0.5) * 2 AS class_balance, avg(CASE WHEN rank_ic > 0 THEN 1.0::DOUBLE WHEN rank_ic IS NOT NULL THEN 0 END) AS positive_share FROM ro WHERE pn <= 4 GROUP BY 1, 2, 3),
ss AS (SELECT *, round(coalesce(abs(mean_rank_ic), 0) - coalesce(rank_ic_spread, 0) - mean_missing_rate + coalesce(class_balance, 0) * 0.1::DOUBLE, 9) AS selection_score FROM su),
sb AS (SELECT *, max(CASE WHEN label_horizon_days = 4 AND target IN ('outperform', 'forward_excess_return') THEN selection_score END) OVER (PARTITION BY selected_role) AS baseline_score, row_number() OVER (PARTITION BY selected_role ORDER BY selection_score DESC, label_horizon_days, target) AS place FROM ss),
sg AS (SELECT *, baseline_score IS NULL OR selection_score >= baseline_score + 0.01::DOUBLE AS improves, periods >= 2 AND mean_missing_rate <= 0.2::DOUBLE AND coalesce(positive_share >= 0.5, false) AND (selected_role <> 'classification' OR class_balance IS NULL OR class_balance >= 0.6::DOUBLE) AS is_stable FROM sb WHERE place = 1)""",
    "SELECT *, CASE WHEN improves AND is_stable THEN 'promote_candidate' ELSE 'retain_baseline' END AS decision FROM sg",
)
def a9_target_selection(spark, d):
    rows = labels.nested_roles(catalog.diagnostics(spark, d), 3)
    return dataset.select_targets(rows, {"classification": ("outperform", 4), "ranking": ("forward_excess_return", 4)})


def _next_week(spark, d):
    return labels.forward_labels(v.panel(spark, d), (1,), v.BENCH)


@query("symbol date return_1d:r forward_return:r forward_excess_return:r", v.PREDS, "SELECT r.symbol, r.date, return_1d, forward_return, forward_excess_return FROM returns r LEFT JOIN lab USING (symbol, date)")
def j21_attached_returns(spark, d):
    return dataset.attach_returns(v.returns(spark, d).select("symbol", "date", "return_1d"), _next_week(spark, d), ["forward_return", "forward_excess_return"])


@query("symbol date close:r return_1d:r forward_return:r role", v.PREDS, "SELECT symbol, date, close, return_1d, forward_return, CASE WHEN date <= DATE '1997-12-31' THEN 'train' ELSE 'validation' END AS role FROM returns JOIN lab USING (symbol, date) WHERE forward_return IS NOT NULL")
def l8_train_validation(spark, d):
    rows = v.returns(spark, d).select("symbol", "date", "close", "return_1d")
    return dataset.train_validation(rows, _next_week(spark, d), "forward_return", ("1900-01-01", "1997-12-31"), ("1998-01-01", "2099-12-31"))


@query("ticker cik:i cik_padded title", "", "SELECT upper(trim(c_name)) AS ticker, c_custkey AS cik, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik_padded, trim(c_mktsegment) AS title FROM customer WHERE c_custkey % 10 > 0")
def n4_company_tickers(spark, d):
    """Two records a document, of which the second repeats the ticker; arrays and objects in turn; every tenth has no cik."""
    cik = F.when(F.col("c_custkey") % 10 > 0, F.col("c_custkey"))
    records = [F.struct(F.concat(F.lit(" "), F.lower("c_name")).alias("ticker"), cik.alias("cik_str"), F.col("c_mktsegment").alias("title")), F.struct(F.col("c_name").alias("ticker"), cik.alias("cik_str"), F.lit("later").alias("title"))]
    keyed = F.to_json(F.create_map(F.lit("0"), records[0], F.lit("1"), records[1]))
    payload = F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.array(*records))).otherwise(keyed)
    return ingest.company_tickers(v.table(spark, d, "customer").select(payload.alias("payload")))


NAMES = ("close", "high", "volume", "return_1d", "return_5d")


@query("feature_group n_features:i n_values:i", v.RETURNS + f", lg AS (SELECT unnest({list(NAMES)}) AS feature, unnest([{', '.join(f'{n}::DOUBLE' for n in NAMES)}]) AS value FROM returns)", "SELECT CASE WHEN feature IN ('close', 'high') THEN 'raw_price' WHEN feature LIKE '%volume%' THEN 'volume_liquidity' WHEN feature LIKE '%return%' THEN 'returns_momentum' ELSE 'other' END AS feature_group, count(DISTINCT feature) AS n_features, count(value) AS n_values FROM lg GROUP BY 1")
def p15_feature_groups(spark, d):
    long = audit.long_features(v.returns(spark, d), NAMES).withColumn("feature_group", features.feature_group(F.col("feature")))
    return long.groupBy("feature_group").agg(F.countDistinct("feature").alias("n_features"), F.count("value").alias("n_values"))


@query("date s1:r s2:r s3:r", v.PANEL + ", " + v.MACRO_WIDE + """, dy AS (SELECT DISTINCT date FROM panel), ra AS (SELECT dy.date, s1, s2 FROM dy ASOF LEFT JOIN (SELECT date AS available, s1, s2 FROM wide WHERE coalesce(s1, s2) IS NOT NULL) w ON dy.date >= w.available),
mo AS (SELECT CAST(date + INTERVAL 1 MONTH AS DATE) AS available, s3 FROM wide WHERE s3 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY CAST(date + INTERVAL 1 MONTH AS DATE) ORDER BY date DESC) = 1), ma AS (SELECT dy.date, s3 FROM dy ASOF LEFT JOIN mo ON dy.date >= mo.available)""", "SELECT date, s1, s2, s3 FROM ra JOIN ma USING (date)")
def w29_macro_daily(spark, d):
    return features.macro_daily(v.panel(spark, d), catalog.macro(spark, d), ["s1", "s2"], ["s3"])


# --- audit

FAMILIES = {"return_1d": "short", "return_5d": "short", "volume": "size"}
FEATURES = f"unnest({list(FAMILIES)}) AS feature, unnest([{', '.join(f'{f}::DOUBLE' for f in FAMILIES)}]) AS value"
ABLATION = AUD + ", " + catalog.FOLD_CTES + f""", roled AS (SELECT p.*, split_id, CASE WHEN p.date BETWEEN train_start AND train_end THEN 'train' ELSE 'validation' END AS role FROM aud p JOIN folds ON p.date BETWEEN train_start AND train_end OR p.date BETWEEN validation_start AND validation_end),
fam(feature, family) AS (VALUES {', '.join(str(x) for x in FAMILIES.items())}), lgr AS (SELECT split_id, role, symbol, date, fr, {FEATURES} FROM roled),
tk AS (SELECT *, {rank('value', 'split_id, feature, date')} AS a, {rank('fr', 'split_id, feature, date')} AS b FROM lgr WHERE role = 'train' AND value IS NOT NULL AND fr IS NOT NULL),
wt AS (SELECT * FROM (SELECT split_id, feature, round(avg(ic), 9) AS weight FROM (SELECT split_id, feature, date, {scorr('a', 'b', 3)} AS ic FROM tk GROUP BY ALL) GROUP BY ALL) WHERE weight <> 0),
vl AS (SELECT *, {prank('value', 'split_id, feature, date')} AS r FROM lgr WHERE role = 'validation' AND value IS NOT NULL), vw AS (SELECT vl.*, family, r * weight AS s FROM vl JOIN wt USING (split_id, feature) JOIN fam USING (feature)),
cs AS (SELECT split_id, 'all' AS case_name, date, symbol, fr, s FROM vw UNION ALL SELECT split_id, 'only_' || family, date, symbol, fr, s FROM vw UNION ALL SELECT split_id, 'without_' || other, date, symbol, fr, s FROM vw JOIN (SELECT DISTINCT family AS other FROM fam) ON other <> family),
sc AS (SELECT * FROM (SELECT split_id, case_name, date, symbol, any_value(fr) AS fr, round(sum(s), 9) AS score FROM cs GROUP BY 1, 2, 3, 4) WHERE fr IS NOT NULL),
sr AS (SELECT *, {rank('score', 'split_id, case_name, date')} AS a, {rank('fr', 'split_id, case_name, date')} AS b FROM sc), si AS (SELECT split_id, case_name, avg(ic) AS ic FROM (SELECT split_id, case_name, date, {scorr('a', 'b', 3)} AS ic FROM sr GROUP BY ALL) GROUP BY ALL),
ab AS (SELECT split_id, family, max(CASE WHEN case_name = 'only_' || family THEN ic END) AS family_ic, max(CASE WHEN case_name = 'all' THEN ic END) AS all_ic, max(CASE WHEN case_name = 'all' THEN ic END) - max(CASE WHEN case_name = 'without_' || family THEN ic END) AS drop_delta FROM si, (SELECT DISTINCT family FROM fam) GROUP BY 1, 2)"""


@query("split_id:i family family_ic:r all_ic:r drop_delta:r verdict", ABLATION, "SELECT *, CASE WHEN drop_delta IS NULL OR abs(drop_delta) < 0.005::DOUBLE THEN 'no_measurable_value' WHEN drop_delta > 0 THEN 'helps' ELSE 'hurts' END AS verdict FROM ab")
def au6_family_ablation(spark, d):
    return audit.family_ablation(audited(spark, d), FAMILIES, "fr", catalog.folds(spark, d))


EXPOSURE = f"""ex0 AS (SELECT {v.SECTOR} AS sector, CASE WHEN close >= 1500 THEN 'large' ELSE 'small' END AS size_bucket, {FEATURES} FROM aud), ex1 AS (SELECT feature, value, unnest(['sector', 'size_bucket']) AS grouping_name, unnest([sector, size_bucket]) AS g FROM ex0),
ex2 AS (SELECT feature, grouping_name, g, avg(value) AS m, {share('value IS NULL')} AS missing FROM ex1 WHERE g IS NOT NULL GROUP BY 1, 2, 3), ex AS (SELECT feature, grouping_name, max(m) - min(m) AS exposure_range, max(missing) - min(missing) AS missing_range, count(*) AS n_groups FROM ex2 GROUP BY 1, 2)"""


def _grouped(spark, d):
    size = F.when(F.col("close") >= 1500, "large").otherwise("small")
    return audited(spark, d).withColumns({"sector": v.sector(), "size_bucket": size, "up": (F.col("fr") > 0).cast("int")})


@query("feature grouping_name exposure_range:r missing_range:r n_groups:i", AUD + ", " + EXPOSURE, "SELECT * FROM ex")
def au7_feature_exposure(spark, d):
    return audit.exposure(_grouped(spark, d), list(FAMILIES), ["sector", "size_bucket"]).withColumnRenamed("grouping", "grouping_name")


STABLE = f"""pl AS (SELECT date, year(date) AS period, fr, {FEATURES} FROM aud), pk0 AS (SELECT *, {rank('value', 'feature, date')} AS a, {rank('fr', 'feature, date')} AS b FROM pl WHERE value IS NOT NULL AND fr IS NOT NULL),
pi AS (SELECT feature, period, avg(ic) AS rank_ic FROM (SELECT feature, period, date, {scorr('a', 'b', 3)} AS ic FROM pk0 GROUP BY ALL) GROUP BY ALL), pm AS (SELECT *, median(rank_ic) OVER (PARTITION BY feature) AS m FROM pi WHERE rank_ic IS NOT NULL),
stable AS (SELECT feature, count(*) AS folds, any_value(m) AS median_ic, {share('sign(rank_ic) = sign(m)')} AS sign_agreement FROM pm GROUP BY 1)"""
STABLE_FLAG = "folds >= 2 AND sign_agreement >= 0.6::DOUBLE AND abs(median_ic) >= 0.01::DOUBLE"


@query("feature folds:i median_ic:r sign_agreement:r has_evidence", AUD + ", " + STABLE, f"SELECT *, {STABLE_FLAG} AS has_evidence FROM stable")
def au4_feature_stability(spark, d):
    rows = _grouped(spark, d)
    return audit.stability(audit.predictive(rows, list(FAMILIES), "fr", "up"))


def _redundant(a: str, b: str) -> str:
    return f"SELECT {scorr('x', 'y')} AS c, ['{a}', '{b}'] AS named FROM (SELECT {rank(a, '')} AS x, {rank(b, '')} AS y FROM (SELECT * FROM aud WHERE {a} IS NOT NULL AND {b} IS NOT NULL))"


PAIRS = [(a, b) for i, a in enumerate(FAMILIES) for b in list(FAMILIES)[i + 1 :]]
DECIDED = ABLATION + ", " + EXPOSURE + ", " + STABLE + f""", rd AS (SELECT feature, count(*) AS n_redundant FROM (SELECT unnest(named) AS feature FROM ({' UNION ALL '.join(_redundant(*p) for p in PAIRS)}) WHERE abs(c) >= 0.5::DOUBLE) GROUP BY 1),
mi AS (SELECT feature, median(missing) AS validation_missing_rate FROM (SELECT split_id, feature, {share('value IS NULL')} AS missing FROM lgr WHERE role = 'validation' GROUP BY 1, 2) GROUP BY 1),
pq AS (SELECT split_id, feature, list_sort(list_distinct(quantile_cont(value, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1.0]))) AS e FROM lgr WHERE role = 'train' AND value IS NOT NULL GROUP BY 1, 2), pe AS (SELECT split_id, feature, e[2:len(e) - 1] AS inner_edges, len(e) - 1 AS nb FROM pq WHERE len(e) >= 3),
pb AS (SELECT split_id, feature, role, len(list_filter(inner_edges, lambda x: x < value)) AS bin FROM lgr JOIN pe USING (split_id, feature) WHERE value IS NOT NULL), pc AS (SELECT split_id, feature, bin, count(*) FILTER (WHERE role = 'train') AS t, count(*) FILTER (WHERE role = 'validation') AS v FROM pb GROUP BY 1, 2, 3),
pf AS (SELECT split_id, feature, bin, coalesce(t, 0) AS t, coalesce(v, 0) AS v FROM (SELECT split_id, feature, unnest(range(0, nb)) AS bin FROM pe) LEFT JOIN pc USING (split_id, feature, bin)),
ps AS (SELECT split_id, feature, greatest(1e-6, v / sum(v) OVER w::DOUBLE) AS a, greatest(1e-6, t / sum(t) OVER w::DOUBLE) AS x FROM pf WINDOW w AS (PARTITION BY split_id, feature)),
pd AS (SELECT feature, median(psi) AS median_psi FROM (SELECT split_id, feature, sum((a - x) * ln(a / x)) AS psi FROM ps GROUP BY 1, 2) GROUP BY 1), fd AS (SELECT family, median(drop_delta) AS family_delta FROM ab GROUP BY 1), er AS (SELECT feature, max(exposure_range) AS exposure_range FROM ex GROUP BY 1),
al AS (SELECT stable.*, family, validation_missing_rate, median_psi, coalesce(n_redundant, 0) AS n_redundant, family_delta, exposure_range, {STABLE_FLAG} AS sure FROM stable JOIN fam USING (feature) LEFT JOIN mi USING (feature) LEFT JOIN pd USING (feature) LEFT JOIN rd USING (feature) LEFT JOIN fd USING (family) LEFT JOIN er USING (feature))"""
STEPS = "CASE WHEN validation_missing_rate > 0.5::DOUBLE THEN {} WHEN sure AND n_redundant = 0 THEN {} WHEN sure THEN {} WHEN sign_agreement >= 0.6::DOUBLE AND abs(median_ic) >= 0.005::DOUBLE THEN {} ELSE {} END"


@query("feature family decision reason median_ic:r sign_agreement:r validation_missing_rate:r median_psi:r n_redundant:i family_delta:r exposure_range:r", DECIDED,
       f"SELECT *, {STEPS.format(*[repr(x) for x in ('insufficient_coverage', 'retain', 'transform', 'conditional', 'remove')])} AS decision, {STEPS.format(*[repr(x) for x in ('median validation missing rate above 0.5', 'stable and not redundant', 'stable but redundant', 'weak evidence', 'no stable evidence')])} AS reason FROM al")
def au8_au9_feature_decisions(spark, d):
    return audit.audit_features(_grouped(spark, d), FAMILIES, "fr", "up", catalog.folds(spark, d), ["sector", "size_bucket"], 0.5)


# --- evidence


@query("model lower_bound:r", SPLIT_IC + ", " + booted("split_ic", "rank_ic"), "SELECT * FROM low")
def m16_bootstrap_lower_bound(spark, d):
    return metrics.bootstrap_lower_bound(split_ic(spark, d), ["model"], "rank_ic", "split_id", DRAWS)


MEANS = SPLIT_IC + ", mn AS (SELECT model, avg(rank_ic) AS m FROM split_ic GROUP BY 1), bc AS (SELECT arg_max(model, round(m, 9)) AS best_control, max(m) AS control_value FROM mn WHERE model IN ('random', 'sign')), adv AS (SELECT a.model, a.split_id, a.rank_ic - b.rank_ic AS advantage FROM bc JOIN split_ic b ON b.model = best_control JOIN split_ic a ON a.split_id = b.split_id WHERE a.model = 'momentum')"


@query("model best_control mean_value:r control_value:r positive_share:r n_splits:i lower_bound:r beats_control is_eligible", MEANS + ", " + booted("adv", "advantage") + f", qc AS (SELECT model, avg(rank_ic) AS mean_value, {share('rank_ic > 0')} AS positive_share, count(*) AS n_splits FROM split_ic WHERE model = 'momentum' GROUP BY 1)",
       "SELECT *, mean_value > control_value AS beats_control, coalesce(n_splits >= 2 AND mean_value > 0 AND positive_share >= 2.0::DOUBLE / 3 AND mean_value > control_value AND lower_bound > 0, false) AS is_eligible FROM qc LEFT JOIN low USING (model), bc")
def v8_qualified_candidates(spark, d):
    return evidence.qualify_candidates(split_ic(spark, d), ["momentum"], ["random", "sign"], "rank_ic", DRAWS)


@query(
    "n_splits:i tuned_value:r fixed_value:r positive_share:r largest_share:r lower_bound:r is_calibrated n_configs:i promoted",
    SPLIT_IC + ", gn AS (SELECT 1 AS model, a.split_id, a.rank_ic AS tuned, b.rank_ic AS fixed, a.rank_ic - b.rank_ic AS gain FROM split_ic a JOIN split_ic b USING (split_id) WHERE a.model = 'momentum' AND b.model = 'random'), " + booted("gn", "gain") + f""", ga AS (SELECT count(*) AS n_splits, avg(tuned) AS tuned_value, avg(fixed) AS fixed_value, {share('tuned > 0')} AS positive_share, coalesce(max(greatest(gain, 0)) / nullif(sum(greatest(gain, 0)), 0), 1) AS largest_share FROM gn),
cb AS (SELECT model, split_id, {CLASSIFY} FROM preds GROUP BY 1, 2), cf AS (SELECT avg(CASE WHEN model = 'momentum' THEN log_loss END) <= avg(CASE WHEN model = 'random' THEN log_loss END) + 0.01::DOUBLE AND avg(CASE WHEN model = 'momentum' THEN brier END) <= avg(CASE WHEN model = 'random' THEN brier END) + 0.005::DOUBLE AS is_calibrated FROM cb),
nc AS (SELECT count(DISTINCT c) AS n_configs FROM (SELECT split_id, count(DISTINCT date) AS c FROM preds GROUP BY 1))""",
    "SELECT *, coalesce(tuned_value > fixed_value AND positive_share >= 2.0::DOUBLE / 3 AND lower_bound > 0 AND is_calibrated AND largest_share <= 0.6::DOUBLE AND n_configs >= 2, false) AS promoted FROM ga, low, cf, nc",
)
def v9_stability_promotion(spark, d):
    preds = v.preds(spark, d)
    configs = preds.groupBy("split_id").agg(F.countDistinct("date").alias("n_dates"))
    return evidence.stability_promotion(split_ic(spark, d), metrics.classification(preds, ["model", "split_id"]), configs, "momentum", "random", "rank_ic", DRAWS)


@query(
    "run initial_loss:r final_loss:r loss_volatility:r median_gradient:r largest_gradient:r largest_norm:r train_loss:r validation_loss:r overfit_gap:r is_stable failure_modes place:i",
    v.PANEL + """, hs AS (SELECT symbol AS run, date AS step, close / 1000::DOUBLE AS loss, (high - low) / close AS gradient_norm, volume / 100::DOUBLE AS parameter_norm FROM panel), hc AS (SELECT *, loss - lag(loss) OVER (PARTITION BY run ORDER BY step) AS c FROM hs),
hr AS (SELECT run, arg_min(loss, step) AS initial_loss, arg_max(loss, step) AS final_loss, coalesce(stddev_pop(c), 0) AS loss_volatility, median(gradient_norm) AS median_gradient, max(gradient_norm) AS largest_gradient, max(parameter_norm) AS largest_norm, min(loss) AS train_loss, avg(loss) AS validation_loss, avg(loss) - min(loss) AS overfit_gap FROM hc GROUP BY 1),
hm AS (SELECT *, concat_ws(',', CASE WHEN median_gradient < 1e-5 THEN 'vanishing_gradient' END, CASE WHEN largest_gradient > 5 THEN 'exploding_gradient' END, CASE WHEN loss_volatility > 0.2::DOUBLE THEN 'unstable_loss' END, CASE WHEN largest_norm > 10 THEN 'parameter_growth' END, CASE WHEN overfit_gap > 0.05::DOUBLE THEN 'overfitting' END) AS modes FROM hr)""",
    "SELECT *, modes = '' AS is_stable, CASE WHEN modes = '' THEN 'none' ELSE modes END AS failure_modes, row_number() OVER (ORDER BY modes = '' DESC, round(validation_loss, 9), round(loss_volatility, 9), run) AS place FROM hm",
)
def v10_run_stability(spark, d):
    loss = F.col("close") / 1000
    p = v.panel(spark, d).select(F.col("symbol").alias("run"), F.col("date").alias("step"), loss.alias("loss"), ((F.col("high") - F.col("low")) / F.col("close")).alias("gradient_norm"), (F.col("volume") / 100).alias("parameter_norm"))
    return evidence.run_stability(p, p.groupBy("run").agg(F.min("loss").alias("train_loss"), F.avg("loss").alias("validation_loss")))


RISK = "wl AS (SELECT *, product(1 + net_return) OVER (PARTITION BY model ORDER BY split_id, date) AS w FROM bt2), dd0 AS (SELECT *, w / max(w) OVER (PARTITION BY model ORDER BY split_id, date) - 1 AS d FROM wl), risk AS (SELECT model, min(d) AS max_drawdown, avg(turnover) AS avg_turnover, product(1 + net_return) - product(1 + benchmark_return) AS cumulative_net_excess_return, max(abs(net_return)) <= 1 AS is_plausible, avg(net_return) / stddev_samp(net_return) * sqrt(13) AS sharpe, avg(CASE WHEN net_return > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hit_rate FROM dd0 GROUP BY 1)"
OVERALL = "ov AS (SELECT model, avg(rank_ic) AS rank_ic FROM ranking GROUP BY 1)"


@query(
    "model rank_ic:r best_single best_single_value:r delta_single:r delta_equal:r win_share:r cumulative_net_excess_return:r max_drawdown:r improves_after_costs",
    SPLIT_IC + ", " + HELD + ", " + RISK + ", " + OVERALL + f""", bs AS (SELECT arg_max(model, round(rank_ic, 9)) AS best_single, max(rank_ic) AS best_single_value FROM ov WHERE model = 'random'), ws AS (SELECT a.model, {share('a.rank_ic > b.rank_ic')} AS win_share FROM bs JOIN split_ic b ON b.model = best_single JOIN split_ic a ON a.split_id = b.split_id WHERE a.model IN ('momentum', 'sign') GROUP BY 1),
ce AS (SELECT ov.model, ov.rank_ic, best_single, best_single_value, ov.rank_ic - best_single_value AS delta_single, ov.rank_ic - eq.rank_ic AS delta_equal, win_share, cumulative_net_excess_return, max_drawdown FROM ov JOIN bs ON true LEFT JOIN ov eq ON ov.model = 'momentum' AND eq.model = 'sign' LEFT JOIN ws ON ws.model = ov.model LEFT JOIN risk ON risk.model = ov.model WHERE ov.model IN ('momentum', 'sign'))""",
    "SELECT *, coalesce(rank_ic > best_single_value AND win_share >= 0.6::DOUBLE AND cumulative_net_excess_return > 0, false) AS improves_after_costs FROM ce",
)
def e7_ensemble_evidence(spark, d):
    overall = metrics.ranking_summary(metrics.ranking_by_date(v.preds(spark, d))).where("scope = 'overall'").select("model", "rank_ic")
    return evidence.compare_ensembles(overall, split_ic(spark, d), portfolio.risk(backtest(spark, d), 13.0, split=False), {"momentum": "sign", "sign": None}, "rank_ic")


SECTOR_EQUAL = """chosen AS (SELECT p.*, period, row_number() OVER (PARTITION BY model, split_id, date, sector ORDER BY y_score DESC, symbol) AS rn, greatest(1, ceil(count(*) OVER (PARTITION BY model, split_id, date, sector) * 0.2::DOUBLE)) AS k FROM preds p JOIN cal USING (model, date, split_id)),
nsec AS (SELECT model, period, count(DISTINCT sector) AS s FROM chosen WHERE rn <= k GROUP BY 1, 2), held AS (SELECT c.*, 1.0::DOUBLE / s / count(*) OVER (PARTITION BY model, period, sector) AS weight FROM chosen c JOIN nsec USING (model, period) WHERE rn <= k)"""
GATES = ("rank_ic", "stability", "split_count", "permutation", "naive", "economics")


@query(
    "model rank_ic:r positive_share:r n_splits:i cumulative_net_excess_return:r max_drawdown:r avg_turnover:r p_holm:r " + " ".join(f"passes_{g}" for g in GATES) + " is_eligible decision",
    ", ".join((SPLIT_IC, PERMUTED, f"perm AS ({PERMUTED_P})", CALENDAR, SECTOR_EQUAL, TRADED, RISK, OVERALL)) + f""", sp AS (SELECT model, {share('coalesce(ic, 0) > 0')} AS positive_share, count(*) AS n_splits FROM (SELECT model, split_id, avg(rank_ic) AS ic FROM ranking GROUP BY 1, 2) GROUP BY 1),
nv AS (SELECT model, avg(rank_ic) AS m FROM split_ic GROUP BY 1), bn AS (SELECT model, m > (SELECT max(m) FROM nv WHERE model IN ('random', 'sign')) AS beats_naive FROM nv WHERE model NOT IN ('random', 'sign')),
pt AS (SELECT ov.model, ov.rank_ic, positive_share, n_splits, cumulative_net_excess_return, max_drawdown, avg_turnover, p_holm, coalesce(ov.rank_ic >= 0.02::DOUBLE, false) AS passes_rank_ic, coalesce(positive_share >= 0.6::DOUBLE, false) AS passes_stability, coalesce(n_splits >= 5, false) AS passes_split_count, coalesce(p_holm <= 0.05::DOUBLE, false) AS passes_permutation, coalesce(beats_naive, false) AS passes_naive,
    coalesce(cumulative_net_excess_return > 0 AND avg_turnover <= 0.75::DOUBLE AND max_drawdown >= -0.3::DOUBLE AND is_plausible, false) AS passes_economics FROM ov LEFT JOIN sp USING (model) LEFT JOIN risk USING (model) LEFT JOIN bn USING (model) LEFT JOIN perm USING (model))""",
    f"SELECT *, {' AND '.join(f'passes_{g}' for g in GATES)} AS is_eligible, CASE WHEN {' AND '.join(f'passes_{g}' for g in GATES)} THEN 'eligible_to_freeze_for_locked_test' ELSE 'remain_in_development' END AS decision FROM pt",
)
def v2_promotion(spark, d):
    preds = v.preds(spark, d)
    ranking = metrics.ranking_summary(metrics.ranking_by_date(preds))
    risk = portfolio.risk(portfolio.backtest(preds, fraction=0.2, every=4, sector="sector"), 13.0, split=False).withColumn("neutralization", F.lit("sector_equal_weight"))
    naive = evidence.against_naive(split_ic(spark, d), ["random", "sign"], "rank_ic").withColumn("beats_naive", F.col("verdict") == "beats_naive")
    daily = metrics.ranking_by_date(preds).where("rank_ic IS NOT NULL").withColumn("rank_ic", F.round("rank_ic", 6))
    permutation = metrics.holm(metrics.sign_permutation(daily, ["model"], "rank_ic", "date", DRAWS, 42, 5, two_sided=False))
    return evidence.promotion_table(ranking, risk, naive, permutation)


LANE = "CASE WHEN split_id % 2 = 0 THEN 'equal_input' ELSE 'best_available' END"


def _lanes(spark, d):
    """Predictions of even years and of odd years as the two lanes."""
    return v.preds(spark, d).withColumn("lane", F.expr(LANE))


def _lane_metrics(spark, d):
    ic = split_ic(spark, d).withColumn("lane", F.expr(LANE)).groupBy("lane", "model").agg(F.avg("rank_ic").alias("rank_ic"))
    return metrics.roc_auc(_lanes(spark, d), ["lane", "model"]).join(ic, ["lane", "model"]).withColumn("is_reference", F.col("model").isin("random", "sign"))


LANES = SPLIT_IC + f", lanes AS (SELECT *, {LANE} AS lane FROM preds), li AS (SELECT {LANE} AS lane, model, avg(rank_ic) AS rank_ic FROM split_ic GROUP BY 1, 2), lm AS (SELECT lane, model, roc_auc, rank_ic, round(coalesce(roc_auc, 0) + coalesce(rank_ic, 0), 9) AS score FROM ({auc_sql('lane, model', 'lanes')}) JOIN li USING (lane, model))"


@query("lane leader reference_leader", LANES, "SELECT lane, arg_max(model, score) AS leader, arg_max(CASE WHEN model <> 'momentum' THEN model END, CASE WHEN model <> 'momentum' THEN score END) AS reference_leader FROM lm GROUP BY 1")
def v7_lane_leaders(spark, d):
    return evidence.lane_leaders(_lane_metrics(spark, d))


@query(
    "model baseline mean_difference:r decision rank_gain:r net_gain:r is_defensible",
    MEANS + f", lanes AS (SELECT *, {LANE} AS lane FROM preds), li AS (SELECT {LANE} AS lane, model, avg(rank_ic) AS rank_ic FROM split_ic GROUP BY 1, 2), " + booted("adv", "advantage") + ", " + HELD + ", " + RISK + """, pw AS (SELECT model, avg(advantage) AS mean_difference FROM adv GROUP BY 1),
dc AS (SELECT pw.*, CASE WHEN abs(mean_difference) >= 0.02::DOUBLE AND lower_bound > 0 THEN 'material_difference' ELSE 'inconclusive' END AS decision FROM pw JOIN low USING (model)),
cl AS (SELECT dc.model, best_control AS baseline, mean_difference, decision, a.rank_ic - b.rank_ic AS rank_gain, x.cumulative_net_excess_return - y.cumulative_net_excess_return AS net_gain FROM dc, bc, li a, li b, risk x, risk y WHERE a.lane = 'best_available' AND b.lane = 'best_available' AND a.model = dc.model AND b.model = best_control AND x.model = dc.model AND y.model = best_control)""",
    "SELECT *, coalesce(decision = 'material_difference' AND mean_difference > 0 AND rank_gain >= 0.01::DOUBLE AND net_gain > 0, false) AS is_defensible FROM cl",
)
def v7_two_lane_claims(spark, d):
    base = evidence.qualify_candidates(split_ic(spark, d), ["momentum"], ["random", "sign"], "rank_ic", DRAWS)
    means = split_ic(spark, d).join(base.select(F.col("best_control").alias("baseline"), F.col("model").alias("candidate"), "lower_bound"))  # base: a row a candidate
    at = means.groupBy("candidate", "baseline", "lower_bound", "split_id").agg(F.max(F.when(F.col("model") == F.col("candidate"), F.col("rank_ic"))).alias("c"), F.max(F.when(F.col("model") == F.col("baseline"), F.col("rank_ic"))).alias("b"))
    paired = at.groupBy(F.col("candidate").alias("model"), "baseline", "lower_bound").agg(F.avg(F.col("c") - F.col("b")).alias("mean_difference"))
    paired = paired.withColumn("decision", F.when((F.abs("mean_difference") >= 0.02) & (F.col("lower_bound") > 0), "material_difference").otherwise("inconclusive"))
    outcome = portfolio.risk(backtest(spark, d), 13.0, split=False).withColumn("lane", F.lit("best_available"))
    return evidence.two_lane_claims(_lane_metrics(spark, d), paired, outcome, "best_available", ["momentum"], True)


@query("lane model runtime_seconds:r peak_memory_mb:r", "", "SELECT CASE WHEN o_orderstatus = 'O' THEN 'equal_input' ELSE 'best_available' END AS lane, o_orderpriority AS model, avg(o_totalprice / 1000::DOUBLE) AS runtime_seconds, avg(CAST(o_custkey AS DOUBLE)) AS peak_memory_mb FROM orders WHERE o_orderstatus IN ('O', 'F', 'P') GROUP BY 1, 2")
def a13_resource_summary(spark, d):
    o = v.table(spark, d, "orders").select("o_orderstatus", F.col("o_orderpriority").alias("model"), (F.col("o_totalprice") / 1000).alias("runtime_seconds"), F.col("o_custkey").cast("double").alias("peak_memory_mb"))
    return evidence.resource_summary({"equal_input": o.where("o_orderstatus = 'O'"), "best_available": o.where("o_orderstatus IN ('F', 'P')")})


# --- signals, orders and stages


@query("date symbol score place:i is_benchmark model")
def r16_latest_signals(spark, d):
    names = ["return_1d", "return_5d"]
    rows = audited(spark, d).select("symbol", "date", "fr", *names).na.drop(subset=names)
    fitted = models.fit_logistic(rows.where("fr IS NOT NULL").withColumn("up", (F.col("fr") > 0).cast("double")), names, "up")
    return models.score_latest(fitted, rows, names, v.BENCH, "logistic")


@query("account_id:i turnover:r is_allowed", ACCOUNTS, "SELECT account_id, sum(abs(delta_weight)) / 2 AS turnover, sum(abs(delta_weight)) / 2 <= 0.75::DOUBLE AS is_allowed FROM intents GROUP BY 1")
def x2_turnover_gate(spark, d):
    return orders.turnover_gate(_intents(spark, d), 0.75)


def _intents(spark, d):
    return orders.build_intents(*evaluation._accounts(spark, d), 5, 0.05, 500.0)


@query(
    "account_id:i symbol side status reason",
    ACCOUNTS + f""", ast AS (SELECT symbol, CASE WHEN {draw_sql('7', '1', 'symbol')} = 0 THEN 'crypto' ELSE 'equity' END AS asset_class, CASE WHEN {draw_sql('5', '2', 'symbol')} = 0 THEN 'inactive' ELSE 'active' END AS asset_status, {draw_sql('6', '3', 'symbol')} > 0 AS is_tradable, {draw_sql('3', '4', 'symbol')} > 0 AS is_fractionable FROM sp),
pl AS (SELECT i.account_id, symbol, side, notional / price AS quantity, pos.symbol IS NOT NULL AS has_position, asset_class, asset_status, is_tradable, is_fractionable FROM intents i JOIN ast USING (symbol) LEFT JOIN pos USING (account_id, symbol) WHERE side <> 'hold'),
de AS (SELECT account_id, symbol, side, CASE WHEN account_id % 5 = 0 THEN 'duplicate_order_id' WHEN {draw_sql('8', '5', 'account_id', 'symbol')} = 0 THEN 'conflicting_open_order' WHEN asset_class <> 'equity' THEN 'unsupported_asset_class' WHEN asset_status <> 'active' THEN 'asset_inactive' WHEN NOT is_tradable THEN 'asset_not_tradable'
    WHEN abs(quantity - round(quantity)) > 1e-9 AND NOT is_fractionable THEN 'asset_not_fractionable' WHEN side = 'sell' AND quantity > CASE WHEN has_position THEN 2.5::DOUBLE ELSE 0 END + 1e-9 THEN 'insufficient_position' ELSE 'risk_checks_passed' END AS reason FROM pl)""",
    "SELECT *, CASE reason WHEN 'risk_checks_passed' THEN 'approved' WHEN 'duplicate_order_id' THEN 'skipped' ELSE 'rejected' END AS status FROM de",
)
def x7_pretrade_decisions(spark, d):
    planned = _intents(spark, d).where("side <> 'hold'").withColumn("order_id", orders.order_id("px", F.lit("2001-01-05").cast("date"), F.col("account_id"), F.col("symbol"), F.col("side")))
    signals, positions = evaluation._accounts(spark, d)
    draw = expr.hash_draw
    assets = signals.select("symbol").distinct().select(
        "symbol", F.when(draw(7, 1, "symbol") == 0, "crypto").otherwise("equity").alias("asset_class"), F.when(draw(5, 2, "symbol") == 0, "inactive").otherwise("active").alias("asset_status"), (draw(6, 3, "symbol") > 0).alias("is_tradable"), (draw(3, 4, "symbol") > 0).alias("is_fractionable")
    )
    held = positions.select("account_id", "symbol", F.lit(2.5).alias("quantity"))
    return orders.pretrade_decisions(planned, planned.where("account_id % 5 = 0"), planned.where(draw(8, 5, "account_id", "symbol") == 0), assets, held)


@query("model stage is_eligible n_failed:i", v.PREDS + ", " + HELD + ", " + RISK + """, st AS (SELECT model, 'shadow_to_paper' AS stage, [coalesce(max_drawdown >= -0.5::DOUBLE, false), coalesce(avg_turnover <= 0.6::DOUBLE, false)] AS passed FROM risk UNION ALL SELECT model, 'paper_to_live_review', [coalesce(sharpe >= 0, false), coalesce(hit_rate >= 0.5::DOUBLE, false), coalesce(cumulative_net_excess_return >= 0, false)] FROM risk)""",
       "SELECT model, stage, len(list_filter(passed, lambda p: NOT p)) = 0 AS is_eligible, len(list_filter(passed, lambda p: NOT p)) AS n_failed FROM st")
def x15_validation_report(spark, d):
    criteria = {"shadow_to_paper": [("max_drawdown", ">=", -0.5), ("avg_turnover", "<=", 0.6)], "paper_to_live_review": [("sharpe", ">=", 0.0), ("hit_rate", ">=", 0.5), ("cumulative_net_excess_return", ">=", 0.0)]}
    return orders.validation_report(portfolio.risk(backtest(spark, d), 13.0, split=False), criteria, ["model"])
