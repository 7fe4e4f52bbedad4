"""Queries over the supplied tables, each with the SQL that gives the same rows.

A query is registered with the list of its columns; `:r` rounds to six digits (`:2`, `:9`: to as
many), `:i` makes a long, in Spark and in SQL alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions import expr
from panelspark.operators import audit, contracts, ensembles, evidence, features, ingest, joins, labels, metrics, orders, portfolio, quality, residuals, sampling, splits, universe
from panelspark.plans import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [(c.split(":")[0], (c.split(":") + [""])[1]) for c in spec.split()]


def query(spec: str, with_: str = "", sql: str = ""):
    """Registers a query; without sql it has rows only."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            shape = {"r": lambda c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0), "i": lambda c: F.col(c).cast("long"), "2": lambda c: F.round(F.col(c).cast("double"), 2) + F.lit(0.0), "9": lambda c: F.round(F.col(c).cast("double"), 9) + F.lit(0.0), "": F.col}
            return df.select(*[shape[k](c).alias(c) for c, k in _columns(spec)]) if spec != "*" else df

        QUERIES[f.__name__] = run
        if sql:
            shape = {"r": "round(CAST({0} AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS {0}", "i": "CAST({0} AS BIGINT) AS {0}", "2": "round(CAST({0} AS DOUBLE), 2) + CAST(0 AS DOUBLE) AS {0}", "9": "round(CAST({0} AS DOUBLE), 9) + CAST(0 AS DOUBLE) AS {0}", "": "{0}"}
            chosen = ", ".join(shape[k].format(c) for c, k in _columns(spec))
            SQL[f.__name__] = f"{'WITH ' + with_ if with_ else ''}\nSELECT {chosen} FROM ({sql})"
        return f

    return add


# --- pieces of SQL that mirror the helpers of functions.expr


def over(w: int, last: int = 0, by: str = "symbol") -> str:
    end = "CURRENT ROW" if last == 0 else f"{-last} PRECEDING"
    return f"OVER (PARTITION BY {by} ORDER BY date ROWS BETWEEN {w - 1 - last} PRECEDING AND {end})"


def roll(agg: str, x: str, w: int, least: int | None = None, last: int = 0) -> str:
    return f"CASE WHEN count({x}) {over(w, last)} >= {w if least is None else least} THEN {agg}({x}) {over(w, last)} END"


def pair(agg: str, x: str, y: str, w: int) -> str:
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"CASE WHEN count({a}) {over(w)} >= {w} THEN {agg}({a}, {b}) {over(w)} END"


def rcorr(x: str, y: str, w: int) -> str:
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"CASE WHEN count({a}) {over(w)} >= {w} AND stddev_pop({a}) {over(w)} > 1e-12 AND stddev_pop({b}) {over(w)} > 1e-12 THEN corr({a}, {b}) {over(w)} END"


def rank(x: str, keys: str, desc: bool = False) -> str:
    k = f"{keys + ', ' if keys else ''}{x} IS NOT NULL"
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {k} ORDER BY {x}{' DESC' if desc else ''}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0::DOUBLE END"


def prank(x: str, keys: str) -> str:
    k = f"{keys + ', ' if keys else ''}{x} IS NOT NULL"
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY {k}) END"


def scorr(x: str, y: str, least: int = 2) -> str:
    a, b = f"CAST(CASE WHEN {y} IS NOT NULL THEN {x} END AS DOUBLE)", f"CAST(CASE WHEN {x} IS NOT NULL THEN {y} END AS DOUBLE)"
    return f"CASE WHEN count({a}) >= {least} AND stddev_pop({a}) > 1e-12 AND stddev_pop({b}) > 1e-12 THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, corr({a}, {b}))) END"


BENCHED = v.RETURNS + ", benched AS (SELECT r.*, b.return_1d AS bench_return_1d, b.return_5d AS bench_return_5d, b.return_20d AS bench_return_20d FROM returns r LEFT JOIN returns b ON b.symbol = 'BENCH' AND r.date = b.date)"


# --- window features


@query("symbol date return_1d:r return_5d:r return_20d:r", v.RETURNS, "SELECT * FROM returns")
def w1_returns(spark, d):
    return v.returns(spark, d)


@query("symbol date volatility_5d:r volatility_20d:r", v.RETURNS, f"SELECT symbol, date, ({roll('stddev_pop', 'return_1d', 5)}) * sqrt(252) AS volatility_5d, ({roll('stddev_pop', 'return_1d', 20)}) * sqrt(252) AS volatility_20d FROM returns")
def w2_volatility(spark, d):
    return features.add_volatility(v.returns(spark, d), (5, 20))


@query(
    "symbol date avg_volume_5d:r avg_dollar_volume_20d:2 volume_shock_5d:r is_liquid",
    v.RETURNS,
    f"SELECT symbol, date, {roll('avg', 'volume', 5)} AS avg_volume_5d, {roll('avg', 'close * volume', 20)} AS avg_dollar_volume_20d, volume / nullif({roll('avg', 'volume', 5, last=-1)}, 0) AS volume_shock_5d, coalesce({roll('avg', 'close * volume', 20)} >= 1000000, false) AS is_liquid FROM returns",
)
def w3_volume(spark, d):
    return features.add_volume(v.returns(spark, d), (5, 20))


@query(
    "symbol date excess_return_1d:r excess_return_5d:r relative_momentum_20d:r corr_20d:r beta_20d:r",
    BENCHED,
    f"SELECT symbol, date, return_1d - bench_return_1d AS excess_return_1d, return_5d - bench_return_5d AS excess_return_5d, return_20d - bench_return_20d AS relative_momentum_20d, CASE WHEN symbol <> 'BENCH' THEN {rcorr('return_1d', 'bench_return_1d', 20)} ELSE 1 END AS corr_20d, ({pair('covar_pop', 'return_1d', 'bench_return_1d', 20)}) / nullif({roll('var_pop', 'bench_return_1d', 20)}, 0) AS beta_20d FROM benched",
)
def w4_w6_benchmark_relative(spark, d):
    out = features.add_benchmark_relative(v.returns(spark, d), v.BENCH, (20,), (1, 5, 20))
    # of the benchmark with itself: 1 wherever there is a window, exactly
    return out.withColumn("corr_20d", F.when(F.col("symbol") == v.BENCH, F.lit(1.0)).otherwise(F.col("corr_20d")))


SIGNALS = BENCHED + f""", sig AS (SELECT *, (high - low) / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) AS range_1d, abs(return_1d) / nullif(close * volume, 0) AS illiquidity,
    volume / nullif(lag(volume) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS volume_change_1d, CASE WHEN return_1d < 0 THEN return_1d END AS neg,
    ({pair('covar_pop', 'return_1d', 'bench_return_1d', 20)}) / nullif({roll('var_pop', 'bench_return_1d', 20)}, 0) AS beta FROM benched),
sig2 AS (SELECT *, return_1d - beta * bench_return_1d AS residual FROM sig)"""


@query(
    "symbol date range_1d:r downside_volatility_20d:r positive_share_20d:r zero_share_20d:r illiquidity_scaled:r range_20d:r drawdown_20d:r return_volume_corr_20d:r residual_momentum_20d:r reversal_1d:r reversal_5d:r",
    SIGNALS,
    f"""SELECT symbol, date, range_1d, {roll('stddev_pop', 'neg', 20, 10)} AS downside_volatility_20d,
    CASE WHEN count(*) {over(20)} >= 20 THEN avg(CASE WHEN return_1d > 0 THEN 1.0::DOUBLE ELSE 0 END) {over(20)} END AS positive_share_20d,
    CASE WHEN count(*) {over(20)} >= 20 THEN avg(CASE WHEN return_1d = 0 THEN 1.0::DOUBLE ELSE 0 END) {over(20)} END AS zero_share_20d,
    ({roll('avg', 'illiquidity', 20)}) * 1e6 AS illiquidity_scaled, {roll('avg', 'range_1d', 20)} AS range_20d, close / nullif({roll('max', 'close', 20)}, 0) - 1 AS drawdown_20d,
    {rcorr('return_1d', 'volume_change_1d', 20)} AS return_volume_corr_20d, {roll('sum', 'residual', 20)} AS residual_momentum_20d, -return_1d AS reversal_1d, -return_5d AS reversal_5d FROM sig2 WHERE symbol <> 'BENCH'""",
)
def w7_w13_market_signals(spark, d):
    out = features.add_market_signals(v.returns(spark, d), v.BENCH, 20)
    return out.where(F.col("symbol") != v.BENCH).withColumn("illiquidity_scaled", F.col("illiquidity_20d") * 1e6)


@query("date s1:r s1_diff_5:r s1_growth_21:r s2_diff_5:r s2_growth_21:r yield_spread:r yield_spread_diff_5:r", v.MACRO_WIDE, "SELECT *, s1 - s2 AS yield_spread, (s1 - s2) - lag(s1 - s2, 5) OVER (ORDER BY date) AS yield_spread_diff_5, s1 - lag(s1, 5) OVER (ORDER BY date) AS s1_diff_5, s1 / nullif(lag(s1, 21) OVER (ORDER BY date), 0) - 1 AS s1_growth_21, s2 - lag(s2, 5) OVER (ORDER BY date) AS s2_diff_5, s2 / nullif(lag(s2, 21) OVER (ORDER BY date), 0) - 1 AS s2_growth_21 FROM wide")
def w14_macro_features(spark, d):
    return features.add_macro(macro(spark, d), ["s1", "s2"], (5,), (21,), ("s1", "s2"))


def macro(spark, d):
    wide = ingest.macro_wide(v.macro_long(spark, d), v.SERIES)
    return wide.withColumnsRenamed({s: f"s{s}" for s in v.SERIES})


@query("symbol date close:r return_1d:r", v.RETURNS, "SELECT symbol, date, lag(close, 2) OVER (PARTITION BY symbol ORDER BY date) AS close, lag(return_1d, 2) OVER (PARTITION BY symbol ORDER BY date) AS return_1d FROM returns")
def w15_lagged_features(spark, d):
    return features.lag_features(v.returns(spark, d), 2)


REGIMES = v.RETURNS + ", " + v.MACRO_WIDE.replace("macro AS", "macro AS", 1) + """, weekly AS (SELECT CAST(date_trunc('week', date) AS DATE) AS date, avg(s1) AS long_rate, avg(s5) AS short_rate FROM wide GROUP BY 1),
vol AS (SELECT date, CASE WHEN count(return_1d) OVER w >= 20 THEN stddev_samp(return_1d) OVER w * sqrt(252) END AS volatility FROM returns WHERE symbol = 'BENCH' WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
vol2 AS (SELECT *, CASE WHEN count(volatility) OVER w >= 20 THEN quantile_cont(volatility, 0.5) OVER w END AS volatility_threshold FROM vol WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
reg0 AS (SELECT vol2.*, volatility - volatility_threshold AS vd, coalesce((long_rate + short_rate) / 2, long_rate, short_rate) AS rate_level, long_rate - short_rate AS yield_spread FROM vol2 LEFT JOIN weekly USING (date)),
reg1 AS (SELECT *, rate_level - lag(rate_level, 20) OVER (ORDER BY date) AS rate_change, yield_spread - lag(yield_spread, 20) OVER (ORDER BY date) AS spread_change FROM reg0),
regimes AS (SELECT date, volatility, volatility_threshold, CASE WHEN vd > 0 THEN 'high_volatility' WHEN vd < 0 THEN 'low_volatility' WHEN vd = 0 THEN 'normal_volatility' END AS volatility_regime, rate_level, rate_change,
    CASE WHEN rate_change > 0 THEN 'rising_rates' WHEN rate_change < 0 THEN 'falling_rates' WHEN rate_change = 0 THEN 'flat_rates' END AS rate_regime, yield_spread, CASE WHEN yield_spread > 0 THEN 'normal_curve' WHEN yield_spread < 0 THEN 'inverted_curve' WHEN yield_spread = 0 THEN 'flat_curve' END AS curve_regime,
    spread_change, CASE WHEN spread_change > 0 THEN 'steepening_curve' WHEN spread_change < 0 THEN 'flattening_curve' WHEN spread_change = 0 THEN 'unchanged_curve' END AS curve_trend FROM reg1)"""


def regimes(spark, d):
    weekly = macro(spark, d).groupBy(F.date_trunc("week", "date").cast("date").alias("date")).agg(F.avg("s1").alias("long_rate"), F.avg("s5").alias("short_rate"))
    return features.market_regimes(v.returns(spark, d).where(F.col("symbol") == v.BENCH), weekly)


@query("date volatility:r volatility_threshold:r volatility_regime rate_level:r rate_change:r rate_regime yield_spread:r curve_regime spread_change:r curve_trend", REGIMES, "SELECT * FROM regimes")
def w20_market_regimes(spark, d):
    return regimes(spark, d)


@query("date s1:r s5:r", v.PANEL + ", " + v.MACRO_WIDE, "SELECT p.date, s1, s5 FROM (SELECT DISTINCT date FROM panel) p ASOF LEFT JOIN (SELECT CAST(date + INTERVAL 1 DAY AS DATE) AS available, s1, s5 FROM wide WHERE coalesce(s1, s5) IS NOT NULL) w ON p.date >= w.available")
def w27_w28_aligned_rates(spark, d):
    return features.align_rates(v.panel(spark, d).select("date").distinct(), macro(spark, d).select("date", "s1", "s5"), ["s1", "s5"], 1)


# --- cross-sections


@query(
    "symbol date return_1d_missing:i return_1d_rank:r return_1d_robust_z:r return_1d_sector_rank:r",
    v.RETURNS + f""", c0 AS (SELECT *, {v.SECTOR} AS sector, median(return_1d) OVER (PARTITION BY date) AS med FROM returns), c1 AS (SELECT *, median(abs(return_1d - med)) OVER (PARTITION BY date) AS mad FROM c0)""",
    f"""SELECT symbol, date, CASE WHEN return_1d IS NULL THEN 1 ELSE 0 END AS return_1d_missing, {prank('return_1d', 'date')} AS return_1d_rank,
    CASE WHEN mad > 0 AND return_1d IS NOT NULL THEN greatest(-5.0::DOUBLE, least(5.0::DOUBLE, (return_1d - med) / (mad * 1.4826::DOUBLE))) END AS return_1d_robust_z, CASE WHEN sector IS NOT NULL THEN {prank('return_1d', 'date, sector')} END AS return_1d_sector_rank FROM c1""",
)
def c1_c3_cross_section(spark, d):
    return features.add_cross_section(v.returns(spark, d).withColumn("sector", v.sector()), ["return_1d"], "sector")


@query("symbol date return_5d:r angle:r product:r", v.RETURNS, f"SELECT symbol, date, e AS return_5d, 2 * atan(e) AS angle, return_1d * return_20d AS product FROM (SELECT *, coalesce(2 * ({prank('return_5d', 'date')}) - 1, 0) AS e FROM returns)")
def c7_p5_p19_encodings(spark, d):
    out = features.add_interactions(v.returns(spark, d), {"product": ("return_1d", "return_20d"), "absent": ("x", "y")})
    return features.angle_encode(features.rank_encode(out, ["return_5d"]), ["return_5d"]).withColumnRenamed("return_5d_angle", "angle")


@query("symbol date grade:i query_id:i weight:r", v.RETURNS, f"""SELECT symbol, date, CAST(CASE WHEN g * 4 - floor(g * 4) = 0.5 THEN 2 * round(g * 4 / 2) ELSE round(g * 4) END AS INT) AS grade, dense_rank() OVER (ORDER BY date) AS query_id, (count(*) OVER () / (SELECT count(DISTINCT date) FROM returns)::DOUBLE) / count(*) OVER (PARTITION BY date) AS weight FROM (SELECT *, {prank('return_1d', 'date')} AS g FROM returns)""")
def c9_c10_grades_and_weights(spark, d):
    return labels.date_weights(labels.relevance_grades(v.returns(spark, d), "return_1d"))


# --- labels

LABELS = v.PANEL + f""", l0 AS (SELECT *, {v.SECTOR} AS sector, close / nullif(lag(close) OVER s, 0) - 1 AS daily, lead(close, 1) OVER s / nullif(close, 0) - 1 AS f1, lead(close, 4) OVER s / nullif(close, 0) - 1 AS f4 FROM panel WINDOW s AS (PARTITION BY symbol ORDER BY date)),
l1 AS (SELECT a.*, b.daily AS bdaily, b.f1 AS bf1, b.f4 AS bf4 FROM l0 a LEFT JOIN l0 b ON b.symbol = 'BENCH' AND a.date = b.date),
l2 AS (SELECT *, {roll('stddev_samp', '(daily - bdaily)', 20, 10)} AS vol FROM l1),
l3 AS (SELECT symbol, date, sector, vol, unnest([1, 4]) AS label_horizon_days, unnest([f1, f4]) AS forward_return, unnest([bf1, bf4]) AS benchmark_forward_return FROM l2),
labels_table AS (SELECT *, forward_return - benchmark_forward_return AS forward_excess_return FROM l3)"""


def label_rows(spark, d):
    return labels.forward_labels(v.panel(spark, d).withColumn("sector", v.sector()), v.HORIZONS, v.BENCH, "sector")


@query(
    "symbol date label_horizon_days:i forward_return:r forward_excess_return:r normalized_excess_return:r excess_rank:r outperform:i neutral_outperform:i sector_relative_return:r sector_excess_rank:r",
    LABELS,
    f"""SELECT *, forward_excess_return / nullif(vol * sqrt(label_horizon_days), 0) AS normalized_excess_return, {prank('forward_excess_return', 'label_horizon_days, date')} AS excess_rank, CASE WHEN forward_excess_return > 0 THEN 1 WHEN forward_excess_return IS NOT NULL THEN 0 END AS outperform,
    CASE WHEN forward_excess_return > 0.01::DOUBLE THEN 1 WHEN forward_excess_return < -0.01::DOUBLE THEN 0 END AS neutral_outperform, forward_return - avg(forward_return) OVER (PARTITION BY label_horizon_days, date, sector) AS sector_relative_return, {prank('forward_excess_return', 'label_horizon_days, date, sector')} AS sector_excess_rank
    FROM labels_table WHERE symbol <> 'BENCH'""".replace("FROM labels_table WHERE symbol <> 'BENCH'", "FROM labels_table QUALIFY true"),
)
def w16_w19_forward_labels(spark, d):
    # the benchmark's excess is 0 or null by construction; its normalised excess is 0 / 0
    return label_rows(spark, d)


@query(
    "symbol date robust_z:r integrity_status is_valid",
    LABELS + ", i0 AS (SELECT *, median(forward_return) OVER (PARTITION BY date) AS med FROM labels_table WHERE label_horizon_days = 1), i1 AS (SELECT *, median(abs(forward_return - med)) OVER (PARTITION BY date) AS mad FROM i0), i2 AS (SELECT *, (forward_return - med) / nullif(mad * 1.4826::DOUBLE, 0) AS robust_z FROM i1)",
    "SELECT *, integrity_status = 'passed' AS is_valid FROM (SELECT *, CASE WHEN forward_return IS NULL THEN 'missing' WHEN forward_return <= -1 THEN 'impossible' WHEN abs(forward_return) > 1 THEN 'absolute' WHEN abs(robust_z) > 3 THEN 'cross_section' ELSE 'passed' END AS integrity_status FROM i2)",
)
def p10_label_integrity(spark, d):
    return labels.integrity_flags(label_rows(spark, d).where("label_horizon_days = 1"), "forward_return", z_limit=3.0)


@query("symbol date residual_target:r", v.RETURNS + ", lab AS (SELECT symbol, date, lead(close, 1) OVER (PARTITION BY symbol ORDER BY date) / nullif(close, 0) - 1 AS y, return_5d AS x FROM returns), fit AS (SELECT date, regr_slope(y, x) AS s, avg(CASE WHEN x IS NOT NULL THEN y END) AS my, avg(CASE WHEN y IS NOT NULL THEN x END) AS mx, regr_count(y, x) AS n FROM lab GROUP BY date)", "SELECT symbol, date, CASE WHEN n >= 20 AND x IS NOT NULL AND y IS NOT NULL THEN y - my - s * (x - mx) END AS residual_target FROM lab JOIN fit USING (date)")
def c8_residual_target(spark, d):
    lab = labels.forward_labels(v.panel(spark, d), (1,), v.BENCH).select("symbol", "date", "forward_return")
    return labels.residualize_one(v.returns(spark, d).join(lab, ["symbol", "date"]), "return_5d", "forward_return")


@query(
    "symbol date residual_target:r",
    v.RETURNS + f""", lab0 AS (SELECT symbol, date, {v.SECTOR} AS sector, return_1d AS a, return_5d AS b, lead(close, 1) OVER (PARTITION BY symbol ORDER BY date) / nullif(close, 0) - 1 AS y FROM returns WHERE symbol <> 'BENCH'),
    ok AS (SELECT * FROM lab0 WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL),
    width AS (SELECT date, count(DISTINCT coalesce(sector, 'unknown')) + 2 AS k FROM lab0 GROUP BY date),
    dm AS (SELECT symbol, date, a - avg(a) OVER g AS a, b - avg(b) OVER g AS b, y - avg(y) OVER g AS y FROM ok WINDOW g AS (PARTITION BY date, sector)),
    s AS (SELECT date, count(*) AS n, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS yb FROM dm GROUP BY date),
    fit AS (SELECT date, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS p, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS q FROM s JOIN width USING (date) WHERE n >= greatest(20, k + 2)),
    res AS (SELECT symbol, date, y - p * a - q * b AS residual_target FROM dm JOIN fit USING (date))""",
    "SELECT symbol, date, residual_target FROM lab0 LEFT JOIN res USING (symbol, date)",
)
def c8_residual_target_many(spark, d):
    lab = labels.forward_labels(v.panel(spark, d), (1,), v.BENCH).select("symbol", "date", "forward_return")
    own = v.returns(spark, d).where(F.col("symbol") != v.BENCH).withColumn("sector", v.sector())
    rows = residuals.join_exposures(own.select("symbol", "date").join(lab, ["symbol", "date"], "left"), own, ["return_1d", "return_5d", "sector"])
    return residuals.residualize(rows, ["return_1d", "return_5d"], ["sector"], "forward_return")


TARGETS = {"outperform": "binary", "neutral_outperform": "neutral_zone", "forward_excess_return": "continuous", "normalized_excess_return": "volatility_normalized", "excess_rank": "cross_sectional_rank", "sector_relative_return": "sector_relative", "sector_excess_rank": "sector_rank"}
DIAG_KEYS = "target, target_family, label_horizon_days, period"
DIAG = LABELS + f""", labeled AS (SELECT *, forward_excess_return / nullif(vol * sqrt(label_horizon_days), 0) AS normalized_excess_return, {prank('forward_excess_return', 'label_horizon_days, date')} AS excess_rank, CASE WHEN forward_excess_return > 0 THEN 1 WHEN forward_excess_return IS NOT NULL THEN 0 END AS outperform,
    CASE WHEN forward_excess_return > 0.01::DOUBLE THEN 1 WHEN forward_excess_return < -0.01::DOUBLE THEN 0 END AS neutral_outperform, forward_return - avg(forward_return) OVER (PARTITION BY label_horizon_days, date, sector) AS sector_relative_return, {prank('forward_excess_return', 'label_horizon_days, date, sector')} AS sector_excess_rank FROM labels_table),
t0 AS (SELECT symbol, date, label_horizon_days, year(date) AS period, round(forward_excess_return, 6) AS economic, unnest([{', '.join(f"'{t}'" for t in TARGETS)}]) AS target, unnest([{', '.join(f"'{f}'" for f in TARGETS.values())}]) AS target_family, unnest([{', '.join(f"round({t}::DOUBLE, 6)" for t in TARGETS)}]) AS value FROM labeled WHERE symbol <> 'BENCH'),
t1 AS (SELECT *, CASE WHEN value IS NOT NULL THEN lag(value) OVER w END AS b, CASE WHEN value IS NOT NULL THEN CASE label_horizon_days WHEN 1 THEN lag(value, 1) OVER w ELSE lag(value, 4) OVER w END END AS p FROM t0 WINDOW w AS (PARTITION BY {DIAG_KEYS}, symbol, value IS NOT NULL ORDER BY date)),
tau AS (SELECT {DIAG_KEYS}, avg(own) AS autocorrelation FROM (SELECT {DIAG_KEYS}, symbol, CASE WHEN count(value) >= 3 THEN {scorr('value', 'b')} END AS own FROM t1 GROUP BY ALL) GROUP BY ALL),
tr AS (SELECT *, {rank('p', DIAG_KEYS + ', date')} AS x, {rank('economic', DIAG_KEYS + ', date')} AS y FROM t1 WHERE p IS NOT NULL AND economic IS NOT NULL),
tic AS (SELECT {DIAG_KEYS}, avg(ic) AS rank_ic FROM (SELECT {DIAG_KEYS}, date, {scorr('x', 'y')} AS ic FROM tr GROUP BY ALL) GROUP BY ALL),
tag AS (SELECT {DIAG_KEYS}, count(value) AS n_rows, 1 - count(value) / count(*)::DOUBLE AS missing_rate, CASE WHEN target_family IN ('binary', 'neutral_zone') THEN avg(value) END AS positive_rate, avg(abs(value - b)) AS turnover, avg(CASE WHEN value IS NOT NULL THEN abs(economic) END) AS magnitude FROM t1 GROUP BY {DIAG_KEYS} HAVING count(value) > 0),
diag AS (SELECT * FROM tag JOIN tau USING ({DIAG_KEYS}) LEFT JOIN tic USING ({DIAG_KEYS}))"""


def diagnostics(spark, d):
    rows = label_rows(spark, d).where(f"symbol <> '{v.BENCH}'").withColumns({t: F.round(F.col(t).cast("double"), 6) for t in TARGETS})
    return labels.target_diagnostics(rows, TARGETS, v.HORIZONS)


@query("target target_family label_horizon_days:i period:i n_rows:i missing_rate:r positive_rate:r turnover:r autocorrelation:r rank_ic:r magnitude:r", DIAG, "SELECT * FROM diag")
def a6_target_diagnostics(spark, d):
    return diagnostics(spark, d)


@query("period:i role fold:i", v.PANEL, "SELECT period, CASE WHEN n = 1 THEN 'outer' WHEN n <= 4 THEN 'inner' ELSE 'calibration' END AS role, CASE WHEN n BETWEEN 2 AND 4 THEN 5 - n END AS fold FROM (SELECT period, dense_rank() OVER (ORDER BY period DESC) AS n FROM (SELECT DISTINCT year(date) AS period FROM panel))")
def a8_nested_roles(spark, d):
    return labels.nested_roles(v.panel(spark, d).select(F.year("date").alias("period")).distinct(), 3)


# --- joins


@query("symbol date form filing_date accession:i", v.FILINGS + ", " + v.MARKET, "SELECT m.symbol, m.date, form, filing_date, accession FROM market m LEFT JOIN LATERAL (SELECT form, filing_date, accession FROM filings f WHERE f.symbol = m.symbol AND f.filing_date <= m.date ORDER BY filing_date DESC, accession DESC LIMIT 1) ON true".replace("LEFT JOIN LATERAL (SELECT form, filing_date, accession FROM filings f WHERE f.symbol = m.symbol AND f.filing_date <= m.date ORDER BY filing_date DESC, accession DESC LIMIT 1) ON true", "ASOF LEFT JOIN (SELECT symbol, filing_date, arg_max(form, accession) AS form, max(accession) AS accession FROM filings GROUP BY 1, 2) f ON f.symbol = m.symbol AND m.date >= f.filing_date"))
def j3_asof_join(spark, d):
    right = v.filings(spark, d).select("symbol", "filing_date", "form", "accession")
    return joins.asof_join(v.market_weeks(spark, d), right, ["symbol"], "date", "filing_date", ["accession"])


def _form_sql(f: str) -> str:
    return f"ASOF LEFT JOIN (SELECT symbol, filing_date AS d_{f} FROM filings WHERE form = '{f}' GROUP BY 1, 2) x_{f} ON x_{f}.symbol = m.symbol AND m.date >= x_{f}.d_{f}"


@query(
    "symbol date days_since_filing:i days_since_F:i days_since_O:i recent_F_5d:i recent_O_5d:i",
    v.FILINGS + ", " + v.MARKET,
    f"SELECT m.symbol, m.date, date_diff('day', greatest(d_F, d_O, d_P), m.date) AS days_since_filing, date_diff('day', d_F, m.date) AS days_since_F, date_diff('day', d_O, m.date) AS days_since_O, CASE WHEN date_diff('day', d_F, m.date) <= 5 THEN 1 ELSE 0 END AS recent_F_5d, CASE WHEN date_diff('day', d_O, m.date) <= 5 THEN 1 ELSE 0 END AS recent_O_5d FROM market m {_form_sql('F')} {_form_sql('O')} {_form_sql('P')}",
)
def j5_j6_filing_events(spark, d):
    return features.filing_events(v.market_weeks(spark, d), v.filings(spark, d), ["F", "O", "P"])


@query("symbol date close:r volume:r", v.PANEL, "SELECT s.symbol, t.date, close, volume FROM (SELECT DISTINCT symbol FROM panel) s CROSS JOIN (SELECT DISTINCT date FROM panel) t LEFT JOIN panel p ON p.symbol = s.symbol AND p.date = t.date")
def j8_complete_panel(spark, d):
    return joins.complete_panel(v.panel(spark, d))


def folds(spark, d):
    return splits.walk_forward(v.panel(spark, d), 104, 26, 26, 2)


FOLD_CTES = """di AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel)),
st AS (SELECT i AS s, row_number() OVER (ORDER BY i) - 1 AS split_id FROM di WHERE i % 26 = 0 AND i + 132 <= n),
folds AS (SELECT split_id, max(CASE WHEN i = s THEN date END) AS train_start, max(CASE WHEN i = s + 103 THEN date END) AS train_end, max(CASE WHEN i = s + 106 THEN date END) AS validation_start, max(CASE WHEN i = s + 131 THEN date END) AS validation_end FROM st JOIN di ON i IN (s, s + 103, s + 106, s + 131) GROUP BY split_id)"""
FOLDS = v.PANEL + ", " + FOLD_CTES


@query("split_id:i train_start train_end validation_start validation_end", FOLDS, "SELECT * FROM folds")
def l1_walk_forward_splits(spark, d):
    return folds(spark, d)


ROLED = FOLDS + ", roled AS (SELECT p.*, split_id, CASE WHEN p.date BETWEEN train_start AND train_end THEN 'train' ELSE 'validation' END AS role FROM {} p JOIN folds ON p.date BETWEEN train_start AND train_end OR p.date BETWEEN validation_start AND validation_end)"


@query("split_id:i role n_rows:i", ROLED.format("panel"), "SELECT split_id, role, count(*) AS n_rows FROM roled GROUP BY 1, 2")
def j12_split_roles(spark, d):
    return joins.assign_roles(v.panel(spark, d), folds(spark, d)).groupBy("split_id", "role").agg(F.count(F.lit(1)).alias("n_rows"))


@query("split_id:i train_start train_end validation_start validation_end validation_days:i", v.PANEL + ", di AS (SELECT date, year(date) AS y, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM panel)), ys AS (SELECT y, min(i) AS f, min(date) AS validation_start, max(date) AS validation_end, count(*) AS validation_days FROM di GROUP BY y)", "SELECT row_number() OVER (ORDER BY y) - 1 AS split_id, (SELECT min(date) FROM di) AS train_start, di2.date AS train_end, validation_start, validation_end, validation_days FROM ys JOIN (SELECT date, i FROM di) di2 ON di2.i = f - 3 WHERE f - 2 > 0")
def l2_yearly_splits(spark, d):
    return splits.yearly(v.panel(spark, d), 2)


@query("symbol date role", v.PANEL, "SELECT symbol, date, CASE WHEN b <= 26 THEN 'locked' ELSE 'development' END AS role FROM (SELECT *, dense_rank() OVER (ORDER BY date DESC) AS b FROM panel) WHERE b <= 26 OR b > 28")
def l3_locked_test(spark, d):
    return splits.locked_test(v.panel(spark, d), 26, 2)


@query("symbol date is_tail", v.PANEL, "SELECT symbol, date, i >= n - greatest(1, floor(n * 0.2::DOUBLE)) AS is_tail FROM (SELECT p.*, dense_rank() OVER (ORDER BY date) - 1 AS i, (SELECT count(DISTINCT date) FROM panel) AS n FROM panel p)")
def l6_inner_tail(spark, d):
    return splits.inner_tail(v.panel(spark, d))


@query("split_id:i feature median:r mean:r sd:r", ROLED.format("rr").replace("folds AS", "rr AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS return_1d FROM panel), folds AS", 1) + ", lng AS (SELECT split_id, unnest(['close', 'return_1d']) AS feature, unnest([close, return_1d]) AS value FROM roled WHERE role = 'train'), md AS (SELECT split_id, feature, coalesce(median(value), 0) AS median FROM lng GROUP BY 1, 2)", "SELECT split_id, feature, any_value(median) AS median, avg(coalesce(value, median)) AS mean, CASE WHEN stddev_pop(coalesce(value, median)) > 1e-12 THEN stddev_pop(coalesce(value, median)) ELSE 1 END AS sd FROM lng JOIN md USING (split_id, feature) GROUP BY 1, 2")
def l9_fit_preprocessor(spark, d):
    rows = joins.assign_roles(v.returns(spark, d), folds(spark, d)).where("role = 'train'")
    return splits.fit_preprocessor(rows, ["close", "return_1d"])


ROLED_RETURNS = FOLDS + ", rr AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS return_1d FROM panel), roled AS (SELECT p.*, split_id, CASE WHEN p.date BETWEEN train_start AND train_end THEN 'train' ELSE 'validation' END AS role FROM rr p JOIN folds ON p.date BETWEEN train_start AND train_end OR p.date BETWEEN validation_start AND validation_end)"


@query(
    "split_id:i role n_rows:i close:r return_1d:r",
    ROLED_RETURNS + """, md AS (SELECT split_id, coalesce(median(close), 0) AS mc, coalesce(median(return_1d), 0) AS mr FROM roled WHERE role = 'train' GROUP BY 1),
im AS (SELECT split_id, role, coalesce(close, mc) AS c, coalesce(return_1d, mr) AS r FROM roled JOIN md USING (split_id)),
ft AS (SELECT split_id, avg(c) AS ac, avg(r) AS ar, CASE WHEN stddev_pop(c) > 1e-12 THEN stddev_pop(c) ELSE 1 END AS sc, CASE WHEN stddev_pop(r) > 1e-12 THEN stddev_pop(r) ELSE 1 END AS sr FROM im WHERE role = 'train' GROUP BY 1)""",
    "SELECT split_id, role, count(*) AS n_rows, avg((c - ac) / sc) AS close, avg((r - ar) / sr) AS return_1d FROM im JOIN ft USING (split_id) GROUP BY 1, 2",
)
def l10_transform(spark, d):
    rows = joins.assign_roles(v.returns(spark, d), folds(spark, d))
    fitted = splits.fit_preprocessor(rows.where("role = 'train'"), ["close", "return_1d"])
    return splits.transform(rows, fitted, ["close", "return_1d"]).groupBy("split_id", "role").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("close").alias("close"), F.avg("return_1d").alias("return_1d"))


@query("fold:i role n_rows:i n_dates:i", v.PREDS + """, m AS (SELECT * FROM preds WHERE model = 'momentum'), di AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM m)),
lt AS (SELECT i, i - n // 2 AS j, n - n // 2 AS q FROM di WHERE i >= n // 2), bl AS (SELECT i, CASE WHEN j < (q % 4) * (q // 4 + 1) THEN j // (q // 4 + 1) ELSE q % 4 + (j - (q % 4) * (q // 4 + 1)) // greatest(q // 4, 1) END AS fold FROM lt),
fo AS (SELECT fold, min(i) AS lo, max(i) AS hi FROM bl GROUP BY 1), rw AS (SELECT fold, CASE WHEN i >= lo THEN 'validation' ELSE 'train' END AS role, y_true, m.date FROM m JOIN di USING (date) JOIN fo ON i <= hi AND (i >= lo OR i < lo - 2)),
fi AS (SELECT fold, role, count(DISTINCT y_true) AS c, count(*) AS n_rows, count(DISTINCT date) AS n_dates FROM rw GROUP BY 1, 2)""", "SELECT fold, role, n_rows, n_dates FROM fi WHERE fold IN (SELECT fold FROM fi GROUP BY fold HAVING count(*) FILTER (WHERE c = 2) = 2)")
def l5_inner_folds(spark, d):
    return splits.inner_folds(v.preds(spark, d).where("model = 'momentum'"), 4, 2, "y_true")
