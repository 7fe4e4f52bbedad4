"""Queries of whole accounting features: seventeen concepts, seven growths, twelve ratios."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import fundamentals as fn
from panelspark.plans import catalog
from panelspark.plans import views as v
from panelspark.plans.catalog import query

QUERIES, SQL = catalog.QUERIES, catalog.SQL


def facts(spark, d):
    """Order lines as facts of a nation's quarter; the part says the concept, returned lines count negative."""
    line, supplier = v.table(spark, d, "lineitem"), v.table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    amount = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    rows = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).select(
        F.col("s_nationkey").alias("cik"), F.date_trunc("quarter", "l_shipdate").cast("date").alias("end_date"), F.get(F.array(*map(F.lit, fn.CONCEPTS)), (F.col("l_partkey") % 17).cast("int")).alias("concept"), amount.alias("amount"))
    sums = rows.groupBy("cik", "end_date", "concept").agg(F.round(F.sum("amount"), 2).alias("value"))
    return sums.select(
        F.concat(F.lit("n"), F.col("cik").cast("string")).alias("symbol"), "cik", F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik_padded"), F.year("end_date").alias("fiscal_year"), F.concat(F.lit("Q"), F.quarter("end_date").cast("string")).alias("fiscal_period"),
        F.add_months("end_date", 3).alias("filing_date"), F.when(F.quarter("end_date") == 4, "10-K").otherwise("10-Q").alias("form"), "end_date", F.concat_ws("-", "cik", "end_date").alias("accession_number"), "concept", "value",
    )


NAMES = ", ".join(f"'{c}'" for c in fn.CONCEPTS)
FACTS = f"""fa AS (SELECT s_nationkey AS cik, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS end_date, [{NAMES}][CAST(l_partkey % 17 AS INT) + 1] AS concept, round(sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END), 2) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
wd AS (SELECT cik, end_date, quarter(end_date) AS q, {", ".join(f"max(CASE WHEN concept = '{c}' THEN value END) AS fundamental_{c}" for c in fn.CONCEPTS)} FROM fa GROUP BY 1, 2)"""
GROWTHS = ", ".join(f"fundamental_{c} / nullif(last_value(fundamental_{c} IGNORE NULLS) OVER w, 0) - 1 AS {c}_growth" for c in fn.GROWING)
SHARES = ", ".join(f"({' - '.join(f'fundamental_{c}' for c in (a, b) if c)}) / nullif(fundamental_{u}, 0) AS {name}" for name, (a, b, u) in fn.RATIOS.items())
SPEC = " ".join(["symbol cik:i cik_padded fiscal_year:i fiscal_period filing_date form end_date", *[f"fundamental_{c}:2" for c in fn.CONCEPTS], *[f"{c}_growth:r" for c in fn.GROWING], *[f"{r}:r" for r in fn.RATIOS]])


@query(SPEC, FACTS, f"""
    SELECT *, 'N' || cik AS symbol, lpad(CAST(cik AS VARCHAR), 10, '0') AS cik_padded, year(end_date) AS fiscal_year, 'Q' || q AS fiscal_period, CAST(end_date + INTERVAL 3 MONTH AS DATE) AS filing_date, CASE q WHEN 4 THEN '10-K' ELSE '10-Q' END AS form, {GROWTHS}, {SHARES}
    FROM wd WINDOW w AS (PARTITION BY cik, q ORDER BY end_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def a1_a3_filing_fundamentals(spark, d):
    return fn.filing_fundamentals(facts(spark, d))
