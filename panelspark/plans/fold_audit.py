"""Queries of the audit by split."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import fold_audit
from panelspark.plans import catalog
from panelspark.plans.catalog import query, rank, scorr
from panelspark.plans.evaluation import AUD
from panelspark.plans.research import FAMILIES, _grouped

QUERIES, SQL = catalog.QUERIES, catalog.SQL

NAMES = list(FAMILIES)
SPLIT = AUD + ", " + catalog.FOLD_CTES + f""", lf AS (SELECT symbol, date, fr, CASE WHEN fr > 0 THEN 1 WHEN fr <= 0 THEN 0 END AS up, unnest({NAMES}) AS feature, unnest([{', '.join(f'{f}::DOUBLE' for f in NAMES)}]) AS value FROM aud),
rl AS (SELECT lf.*, split_id, train_start, CASE WHEN date BETWEEN train_start AND train_end THEN 'train' ELSE 'validation' END AS period FROM lf JOIN folds ON date BETWEEN train_start AND train_end OR date BETWEEN validation_start AND validation_end)"""
PERIOD = "split_id, period, feature"
PREDICTIVE = SPLIT + f""", dr AS (SELECT *, {rank('value', PERIOD + ', date')} AS a, {rank('fr', PERIOD + ', date')} AS b FROM rl WHERE value IS NOT NULL AND fr IS NOT NULL),
di2 AS (SELECT {PERIOD}, date, {scorr('a', 'b', 3)} AS ic, count(*) AS n FROM dr GROUP BY ALL), ic2 AS (SELECT {PERIOD}, avg(ic) AS rank_ic, sum(n) AS observations FROM di2 GROUP BY ALL),
cr AS (SELECT *, {rank('value', PERIOD)} AS a, {rank('up', PERIOD)} AS b FROM rl WHERE value IS NOT NULL AND up IS NOT NULL), ca AS (SELECT {PERIOD}, {scorr('a', 'b', 3)} AS classification_association FROM cr GROUP BY ALL),
pr AS (SELECT split_id, period, feature, rank_ic, classification_association, coalesce(observations, 0) AS observations FROM (SELECT DISTINCT {PERIOD} FROM rl) LEFT JOIN ic2 USING ({PERIOD}) LEFT JOIN ca USING ({PERIOD}))"""
STABILITY = PREDICTIVE + """, sp AS (SELECT split_id, feature, any_value(rank_ic) FILTER (WHERE period = 'train') AS t, any_value(rank_ic) FILTER (WHERE period = 'validation') AS v FROM pr GROUP BY 1, 2),
sb AS (SELECT feature, count(*) AS folds, median(t) AS train_median_ic, median(v) AS validation_median_ic, avg(CASE WHEN sign(t) = sign(v) THEN 1::DOUBLE ELSE 0 END) AS sign_agreement FROM sp GROUP BY 1)"""


@query("split_id:i feature train_rows:i validation_rows:i train_missing_rate:r validation_missing_rate:r train_symbol_coverage:i validation_symbol_coverage:i train_stale_rate:r train_revision_count:r revision_tracking_available",
       SPLIT + """, pv AS (SELECT *, lag(value) OVER w AS last, lag(date) OVER w AS last_date FROM lf WINDOW w AS (PARTITION BY feature, symbol ORDER BY date)),
       rp AS (SELECT pv.*, split_id, train_start, CASE WHEN date BETWEEN train_start AND train_end THEN 'train' ELSE 'validation' END AS period FROM pv JOIN folds ON date BETWEEN train_start AND train_end OR date BETWEEN validation_start AND validation_end),
       vols AS (SELECT split_id, sum(CAST(volume AS BIGINT) % 3)::DOUBLE AS revised FROM panel JOIN folds ON date BETWEEN train_start AND train_end GROUP BY 1)""",
       """SELECT split_id, feature, count(*) FILTER (WHERE period = 'train') AS train_rows, count(*) FILTER (WHERE period = 'validation') AS validation_rows,
       avg(CASE WHEN value IS NULL THEN 1::DOUBLE ELSE 0 END) FILTER (WHERE period = 'train') AS train_missing_rate, avg(CASE WHEN value IS NULL THEN 1::DOUBLE ELSE 0 END) FILTER (WHERE period = 'validation') AS validation_missing_rate,
       count(DISTINCT symbol) FILTER (WHERE period = 'train' AND value IS NOT NULL) AS train_symbol_coverage, count(DISTINCT symbol) FILTER (WHERE period = 'validation' AND value IS NOT NULL) AS validation_symbol_coverage,
       avg(CASE WHEN value = last THEN 1::DOUBLE ELSE 0 END) FILTER (WHERE period = 'train' AND value IS NOT NULL AND last IS NOT NULL AND last_date >= train_start) AS train_stale_rate,
       CASE WHEN feature = 'volume' THEN any_value(revised) END AS train_revision_count, feature = 'volume' AS revision_tracking_available FROM rp JOIN vols USING (split_id) GROUP BY 1, 2""")
def au1_quality_by_split(spark, d):
    """Revisions are the volume modulo 3."""
    rows = _grouped(spark, d).withColumn("volume_revision_count", F.col("volume").cast("long") % 3)
    return fold_audit.quality(rows, NAMES, catalog.folds(spark, d))


@query("split_id:i period feature rank_ic:r classification_association:r observations:i", PREDICTIVE, "SELECT * FROM pr")
def au3_predictive_by_split(spark, d):
    return fold_audit.predictive(_grouped(spark, d), NAMES, "fr", "up", catalog.folds(spark, d))


@query("feature folds:i train_median_ic:r validation_median_ic:r sign_agreement:r stable_evidence", STABILITY, "SELECT *, folds >= 2 AND sign_agreement >= 0.6 AND coalesce(abs(validation_median_ic) >= 0.01, false) AS stable_evidence FROM sb")
def au4_stability_by_split(spark, d):
    return fold_audit.stability(fold_audit.predictive(_grouped(spark, d), NAMES, "fr", "up", catalog.folds(spark, d)))


def _pair(a: str, b: str) -> str:
    return f"SELECT split_id, '{a}' AS feature_a, '{b}' AS feature_b, {scorr('x', 'y')} AS spearman_correlation FROM (SELECT split_id, {rank(a, 'split_id')} AS x, {rank(b, 'split_id')} AS y FROM tr WHERE {a} IS NOT NULL AND {b} IS NOT NULL) GROUP BY 1"


@query("split_id:i feature_a feature_b spearman_correlation:r", AUD + ", " + catalog.FOLD_CTES + ", tr AS (SELECT split_id, return_1d, return_5d, volume FROM aud JOIN folds ON date BETWEEN train_start AND train_end)",
       "SELECT * FROM (" + " UNION ALL ".join(_pair(a, b) for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]) + ") WHERE abs(spearman_correlation) >= 0.02")
def au5_redundancy_by_split(spark, d):
    return fold_audit.redundancy(_grouped(spark, d), NAMES, catalog.folds(spark, d), 0.02)


@query("feature family decision reason median_ic:r sign_agreement:r validation_missing_rate:r median_psi:r n_redundant:i family_delta:r exposure_range:r")
def au9_decisions_by_split(spark, d):
    return fold_audit.decisions(_grouped(spark, d), FAMILIES, "fr", "up", catalog.folds(spark, d), ["sector", "size_bucket"], 0.5)
