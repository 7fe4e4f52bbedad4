"""Queries of the whole point-in-time universe: states, legacy seed, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import universe
from panelspark.plans import catalog
from panelspark.plans import views as v
from panelspark.plans.catalog import prank, query

QUERIES, SQL = catalog.QUERIES, catalog.SQL
RULES = universe.PointInTimeRules(5.0, 10_000.0, 10, 10, 12, 4, 2)
#: A seed of five brands; snapshots begin in 1996, so it decides on the year before.
SEED = ("Brand#1", "Brand#3", "Brand#5", "Brand#11", "Brand#21")


def members(spark, d):
    p = v.panel(spark, d)
    late = p.where((F.month("date") == 1) & (F.year("date") >= 1996))
    last = F.substring("symbol", -1, 1)
    assets = late.select("symbol", F.col("date").alias("effective_date"), F.lit("us_equity").alias("asset_class"), F.when(F.col("volume") > 20, "active").otherwise("inactive").alias("status"), (F.col("close") > 1000).alias("tradable"), F.when(last == "4", "fund").otherwise("common_stock").alias("security_type"))
    meta = p.where(F.month("date").isin(1, 7) & (last != "2") & (F.col("symbol") != v.BENCH)).select("symbol", F.col("date").alias("effective_date"), v.sector().alias("sector"), F.lit("all").alias("industry"), (F.col("close") * F.col("volume")).alias("market_cap"))
    return universe.point_in_time(p, assets, meta, RULES, v.BENCH, SEED)


MEMBERS = v.PANEL + f""", fp AS (SELECT s.symbol, t.date, close, volume FROM (SELECT DISTINCT symbol FROM panel) s CROSS JOIN (SELECT DISTINCT date FROM panel) t LEFT JOIN panel p ON p.symbol = s.symbol AND p.date = t.date),
a0 AS (SELECT *, close IS NOT NULL AND volume IS NOT NULL AS h FROM fp),
a1 AS (SELECT *, count(*) FILTER (WHERE h) OVER (PARTITION BY symbol ORDER BY date) AS history_days, min(CASE WHEN h THEN date END) OVER (PARTITION BY symbol) AS first_observed_date, max(CASE WHEN h THEN date END) OVER (PARTITION BY symbol ORDER BY date) AS last_observed_through_date,
       CASE WHEN count(close * volume) OVER w >= 10 THEN quantile_cont(close * volume, 0.5) OVER w END AS mdv FROM a0 WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
st AS (SELECT symbol, date AS ed, CASE WHEN volume > 20 THEN 'active' ELSE 'inactive' END AS status, close > 1000 AS tradable, CASE WHEN substr(symbol, -1, 1) = '4' THEN 'fund' ELSE 'common_stock' END AS kind FROM panel WHERE month(date) = 1 AND year(date) >= 1996),
me AS (SELECT symbol, date AS md, {v.SECTOR} AS sector, close * volume AS market_cap FROM panel WHERE month(date) IN (1, 7) AND symbol <> 'BENCH' AND substr(symbol, -1, 1) <> '2'),
a2 AS (SELECT a1.*, ed, status, tradable, kind, sector, market_cap, a1.date < (SELECT min(ed) FROM st) AND a1.symbol IN ({', '.join(f"'{s}'" for s in SEED)}) AS legacy FROM a1 ASOF LEFT JOIN st ON st.symbol = a1.symbol AND a1.date >= st.ed ASOF LEFT JOIN me ON me.symbol = a1.symbol AND a1.date >= me.md),
a3 AS (SELECT *, ed IS NOT NULL AS state_known, CASE WHEN symbol = 'BENCH' THEN 'benchmark' WHEN NOT h THEN 'missing_price' WHEN NOT (legacy OR coalesce(status = 'active' AND tradable, false)) THEN 'inactive_or_untradable'
       WHEN NOT (legacy OR coalesce(kind = 'common_stock', false)) THEN 'unsupported_security_type' WHEN history_days < 10 THEN 'insufficient_history' WHEN NOT coalesce(mdv >= 10000, false) THEN 'insufficient_liquidity' WHEN close < 5 THEN 'price_below_minimum' ELSE 'eligible' END AS exclusion_reason FROM a2),
a4 AS (SELECT *, exclusion_reason = 'eligible' AS is_member FROM a3),
a5 AS (SELECT *, {prank('market_cap', 'date, is_member')} AS p FROM a4),
mb AS (SELECT *, CASE WHEN is_member THEN CASE WHEN p <= 1 / 3.0::DOUBLE THEN 'small' WHEN p <= 2 / 3.0::DOUBLE THEN 'mid' WHEN p IS NOT NULL THEN 'large' END END AS size_bucket, coalesce(lag(is_member) OVER (PARTITION BY symbol ORDER BY date), false) AS was FROM a5)"""
DAYS = MEMBERS + f""", sm AS (SELECT date, min(c) AS smallest FROM (SELECT date, sector, count(*) AS c FROM mb WHERE is_member AND sector IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
d0 AS (SELECT date, count(*) FILTER (WHERE h) AS observed_names, count(*) FILTER (WHERE is_member) AS member_count, count(*) FILTER (WHERE is_member AND NOT was) AS entries, count(*) FILTER (WHERE NOT is_member AND was) AS exits, count(*) FILTER (WHERE state_known) AS known_asset_states, count(*) FILTER (WHERE legacy) AS legacy_rows,
       count(DISTINCT CASE WHEN is_member THEN sector END) AS sector_count, count(DISTINCT CASE WHEN is_member THEN size_bucket END) AS size_bucket_count, count(*) FILTER (WHERE state_known) / count(*)::DOUBLE AS asset_state_coverage, count(*) FILTER (WHERE legacy) / count(*)::DOUBLE AS legacy_row_share,
       count(*) FILTER (WHERE sector IS NOT NULL OR market_cap IS NOT NULL) / count(*)::DOUBLE AS metadata_coverage FROM mb GROUP BY 1),
dy AS (SELECT d0.*, coalesce(smallest, 0) AS smallest_sector_names, (entries + exits) / nullif(lag(member_count) OVER (ORDER BY d0.date), 0)::DOUBLE AS membership_turnover, member_count >= 12 AS stable_deciles, sector_count >= 4 AND coalesce(smallest, 0) >= 2 AS stable_sector_controls FROM d0 LEFT JOIN sm USING (date))"""


@query("symbol date history_days:i first_observed_date last_observed_through_date asset_state_known legacy_seed_period membership_basis is_benchmark is_member exclusion_reason size_bucket", MEMBERS, """
    SELECT upper(symbol) AS symbol, date, history_days, first_observed_date, last_observed_through_date, state_known AS asset_state_known, legacy AS legacy_seed_period,
           CASE WHEN legacy THEN 'legacy_static_seed_survivorship_limited' ELSE 'effective_dated_asset_state' END AS membership_basis, symbol = 'BENCH' AS is_benchmark, is_member, exclusion_reason, size_bucket FROM mb""")
def u1_point_in_time(spark, d):
    return members(spark, d)


@query("date observed_names:i member_count:i entries:i exits:i known_asset_states:i legacy_rows:i sector_count:i size_bucket_count:i smallest_sector_names:i membership_turnover:r stable_deciles stable_sector_controls asset_state_coverage:r legacy_row_share:r metadata_coverage:r", DAYS, "SELECT * FROM dy")
def a4_universe_coverage(spark, d):
    return universe.daily_coverage(members(spark, d), RULES)


@query("start_date end_date median_member_count:r minimum_member_count:i mean_membership_turnover:r entries:i exits:i stable_decile_date_share:r stable_sector_date_share:r asset_state_coverage:r metadata_coverage:r legacy_row_share:r inactive_or_untradable_exits:i prospective_start_date", DAYS + """,
    gone AS (SELECT count(*) FILTER (WHERE NOT is_member AND was AND NOT coalesce(status = 'active' AND tradable, false)) AS inactive_or_untradable_exits, min(CASE WHEN state_known THEN date END) AS prospective_start_date FROM mb)""",
    """SELECT min(date) AS start_date, max(date) AS end_date, median(member_count) AS median_member_count, min(member_count) AS minimum_member_count, avg(membership_turnover) AS mean_membership_turnover, sum(entries) AS entries, sum(exits) AS exits,
       avg(CASE WHEN stable_deciles THEN 1.0::DOUBLE ELSE 0 END) AS stable_decile_date_share, avg(CASE WHEN stable_sector_controls THEN 1.0::DOUBLE ELSE 0 END) AS stable_sector_date_share, avg(asset_state_coverage) AS asset_state_coverage, avg(metadata_coverage) AS metadata_coverage, avg(legacy_row_share) AS legacy_row_share,
       any_value(inactive_or_untradable_exits) AS inactive_or_untradable_exits, any_value(prospective_start_date) AS prospective_start_date FROM dy, gone""")  # fmt: skip
def a5_universe_coverage_summary(spark, d):
    rows = members(spark, d)
    return universe.coverage_summary(universe.daily_coverage(rows, RULES), rows)
