"""Queries of features chosen, compressed and learnt from split by split."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import audit, compression, dataset, labels, models, selection, splits, walk_forward
from panelspark.plans import catalog, evaluation
from panelspark.plans import views as v
from panelspark.plans.catalog import query, scorr
from panelspark.sources import tables

QUERIES = catalog.QUERIES
SQL = catalog.SQL

FEATURES = ("return_1d", "return_5d", "return_10d", "return_20d", "volume", "high", "low", "close")
FAMILIES = {f: "momentum" if f.startswith("return") else "volume" if f == "volume" else "price" for f in FEATURES}
NAMES, VALUES = ", ".join(f"'{f}'" for f in FEATURES), ", ".join(f"CAST({f} AS DOUBLE)" for f in FEATURES)

#: Training rows with a target, unpivoted and imputed by the split's medians.
TRAINED = (
    v.RETURNS + ", aud AS (SELECT *, lead(close, 1) OVER (PARTITION BY symbol ORDER BY date) / nullif(close, 0) - 1 AS fr FROM returns), " + catalog.FOLD_CTES
    + f""", roled AS (SELECT p.*, split_id FROM aud p JOIN folds ON p.date BETWEEN train_start AND train_end WHERE fr IS NOT NULL),
    tall AS (SELECT split_id, symbol, date, fr, unnest([{NAMES}]) AS feature, unnest([{VALUES}]) AS raw FROM roled),
    mids AS (SELECT split_id, feature, coalesce(median(raw), 0) AS mid FROM tall GROUP BY 1, 2),
    imputed AS (SELECT split_id, symbol, date, fr, feature, coalesce(raw, mid) AS value FROM tall JOIN mids USING (split_id, feature))"""
)
PROFILES = TRAINED + f""",
    dy AS (SELECT * FROM (SELECT split_id, feature, date, {scorr('value', 'fr')} AS d FROM imputed GROUP BY 1, 2, 3) WHERE d IS NOT NULL),
    md AS (SELECT split_id, feature, median(d) AS m FROM dy GROUP BY 1, 2),
    profiles AS (SELECT split_id, feature, abs(any_value(m)) * avg(CASE WHEN d * m >= 0 THEN 1.0::DOUBLE ELSE 0 END) AS score, CAST(sign(any_value(m)) AS INT) AS sign FROM dy JOIN md USING (split_id, feature) GROUP BY 1, 2)"""


def counts(spark, d):
    """Six candidates in even splits, five in odd ones, as a tuner would say."""
    return catalog.folds(spark, d).select("split_id", (6 - F.col("split_id") % 2).alias("feature_count"))


@query("feature score:r", evaluation.AUD + f""", lg AS (SELECT date, fr, unnest([{NAMES}]) AS feature, unnest([{VALUES}]) AS value FROM aud),
    po AS (SELECT feature, coalesce({scorr('value', 'fr')}, 0) AS c, avg(CASE WHEN value IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS coverage FROM lg GROUP BY 1),
    da AS (SELECT * FROM (SELECT feature, date, {scorr('value', 'fr')} AS d FROM lg GROUP BY 1, 2) WHERE d IS NOT NULL),
    sh AS (SELECT feature, avg(CASE WHEN sign(d) = sign(c) THEN 1.0::DOUBLE ELSE 0 END) AS share FROM da JOIN po USING (feature) WHERE c <> 0 GROUP BY 1)""",
    "SELECT feature, abs(c) * coalesce(share, 0.5) * coverage AS score FROM po LEFT JOIN sh USING (feature)")
def au10_feature_scores(spark, d):
    return audit.feature_scores(evaluation.audited(spark, d), FEATURES, "fr")


@query("split_id:i feature score:r sign:i frequency:r agreement:r median_score:r is_stable place:i", PROFILES + """,
    seen AS (SELECT split_id, 6 - split_id % 2 AS feature_count, row_number() OVER (ORDER BY split_id) AS seen FROM folds),
    cand AS (SELECT p.*, seen FROM profiles p JOIN seen USING (split_id) QUALIFY row_number() OVER (PARTITION BY split_id ORDER BY score DESC, feature) <= feature_count),
    hist AS (SELECT *, count(*) OVER w / seen::DOUBLE AS frequency, count(*) FILTER (WHERE sign > 0) OVER w AS up, count(*) FILTER (WHERE sign < 0) OVER w AS down, median(score) OVER w AS median_score FROM cand WINDOW w AS (PARTITION BY feature ORDER BY split_id)),
    agreed AS (SELECT *, coalesce(greatest(up, down) / nullif(up + down, 0)::DOUBLE, 0) AS agreement FROM hist)""",
    "SELECT *, frequency >= 0.6::DOUBLE AND agreement >= 2.0::DOUBLE / 3 - 1e-12 AS is_stable, row_number() OVER (PARTITION BY split_id ORDER BY frequency DESC, agreement DESC, median_score DESC, feature DESC) AS place FROM agreed")
def au12_candidate_history(spark, d):
    rows = selection.prepared(evaluation.audited(spark, d), FEATURES, catalog.folds(spark, d), "fr")
    return selection.candidate_history(selection.fold_profiles(rows.where("role = 'train'"), FEATURES, "fr"), counts(spark, d))


def selected(spark, d):
    return selection.select_by_fold(evaluation.audited(spark, d), FEATURES, FAMILIES, catalog.folds(spark, d), "fr", counts(spark, d), 4, core=3)


@query("split_id:i place:i selected feature family score:r is_core frequency:r agreement:r next_feature next_abs_corr:r feature_count:i train_start train_end validation_start")
def au12_selected_features(spark, d):
    return selected(spark, d)[0]


@query("symbol date split_id:i role target:i ranking_target:r selected_feature_00:r selected_feature_01:r selected_feature_02:r selected_feature_03:r")
def au12_selected_table(spark, d):
    return selected(spark, d)[1]


PAIRS = {"returns_momentum": ["return_1d", "return_5d"], "raw_price": ["high", "low"]}
PAIR_SQL = TRAINED + f""",
    held AS (SELECT split_id, count(*) AS validation_rows FROM aud p JOIN folds ON p.date BETWEEN validation_start AND validation_end WHERE fr IS NOT NULL GROUP BY 1),
    wide AS (SELECT split_id, symbol, date, {", ".join(f"max(CASE WHEN feature = '{f}' THEN value END) AS {f}" for g in PAIRS.values() for f in g)} FROM imputed GROUP BY 1, 2, 3),
    rho AS ({" UNION ALL ".join(f"SELECT split_id, '{g}' AS grp, {wanted} AS n_components, abs(corr({a}, {b})) AS r, count(*) AS n FROM wide GROUP BY 1" for g, (a, b), wanted in (("returns_momentum", PAIRS["returns_momentum"], 2), ("raw_price", PAIRS["raw_price"], 1)))})"""


@query("split_id:i feature_group component_index:i n_original_features:i n_components:i train_rows:i validation_rows:i explained_variance:r explained_variance_ratio:r cumulative_explained_variance_ratio:r", PAIR_SQL, """
    SELECT split_id, grp AS feature_group, i AS component_index, 2 AS n_original_features, n_components, n AS train_rows, validation_rows,
           (1 + (1 - 2 * i) * r) * n / (n - 1)::DOUBLE AS explained_variance, (1 + (1 - 2 * i) * r) / 2 AS explained_variance_ratio, CASE i WHEN 0 THEN (1 + r) / 2 ELSE 1 END AS cumulative_explained_variance_ratio
    FROM rho JOIN held USING (split_id), (VALUES (0), (1)) x(i) WHERE i < n_components""")
def r14_grouped_pca_shares(spark, d):
    """Of two features a group has a closed form: shares are (1 + r) / 2 and (1 - r) / 2."""
    rows = selection.prepared(evaluation.audited(spark, d), [f for g in PAIRS.values() for f in g], catalog.folds(spark, d), "fr")
    return compression.principal_components(rows, PAIRS, 3, {"returns_momentum": 2, "raw_price": 1})[1]


@query("symbol date split_id:i role global_pca_00:r global_pca_01:r global_pca_02:r")
def r13_pca_by_split(spark, d):
    rows = selection.prepared(evaluation.audited(spark, d), FEATURES, catalog.folds(spark, d), "fr")
    return compression.principal_components(rows, {"global": FEATURES}, 3)[0]


def outcomes(spark, d):
    """The panel with what follows each row: the week's return, its excess, and whether that is positive."""
    after = labels.forward_labels(v.panel(spark, d), (1,), v.BENCH).select("symbol", "date", "forward_return", "forward_excess_return")
    rows = v.returns(spark, d).where(F.col("symbol") != v.BENCH).withColumn("sector", v.sector()).join(after, ["symbol", "date"])
    return rows.where("forward_return IS NOT NULL AND forward_excess_return IS NOT NULL").withColumn("up", (F.col("forward_excess_return") > 0).cast("int"))


@query("rank:i config_id:i feature_count:i learning_rate:r max_leaf_nodes:i l2_regularization:r inner_rank_ic:r selected_features")
def r11_tuned_boosting(spark, d):
    """All 24 configurations on the training rows of the last split; of eight features the best 3, 6 and all; 4 rounds, not 300."""
    rows = outcomes(spark, d)
    last = dataset.first_splits(splits.yearly(rows), 1, last=True)
    train = tables.written(selection.prepared(rows, FEATURES, last, "forward_excess_return").where("role = 'train'"), "training")
    _, best, tried = walk_forward.tune_boosting(train, FEATURES, "forward_excess_return", counts=(3, 6, None), rounds=4)
    kind = "rank long, config_id long, feature_count long, learning_rate double, max_leaf_nodes long, l2_regularization double, inner_rank_ic double"
    listed = spark.createDataFrame([tuple(t[c.split()[0]] for c in kind.split(", ")) for t in tried], kind)
    return listed.withColumn("selected_features", F.when(F.col("rank") == 1, F.lit(" ".join(best["selected_features"]))))


LEARNERS = {
    "momentum_rank": (walk_forward.rule(models.momentum_rank), "forward_excess_return"),
    "sign_rank": (walk_forward.rule(models.sign_rank), "forward_excess_return"),
    "random_rank": (walk_forward.rule(models.random_rank), "forward_excess_return"),
    "linear_rank": (walk_forward.linear_rank, "forward_excess_return"),
    "sector_neutral_rank": (walk_forward.sector_neutral_rank, "forward_excess_return"),
    "logistic": (walk_forward.fitted(models.fit_logistic), "up"),
    "weighted_boosting": (walk_forward.fitted(walk_forward.weighted_boosting, rounds=3), "up"),
}


def whole_run(spark, d):
    rows = selection.prepared(outcomes(spark, d), FEATURES, splits.yearly(outcomes(spark, d)), "forward_excess_return")
    return walk_forward.run(rows, FEATURES, LEARNERS, ["sign_rank", "random_rank"], tables.scratch_folder(spark, "walk-forward"), {"data": d}, fraction=0.2, every=4, per_year=13.0, block=5)


@query("model rank_ic:r positive_share:r n_splits:i cumulative_net_excess_return:r max_drawdown:r avg_turnover:r p_holm:r passes_rank_ic passes_stability passes_split_count passes_permutation passes_naive passes_economics is_eligible decision")
def r15_whole_run(spark, d):
    """From panel to promotion: rankers, linear and sector-neutral ranks, a logistic and a weighted boosted classifier (3 rounds, not 500), and their ensembles."""
    return whole_run(spark, d)["promotion"]
