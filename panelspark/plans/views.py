"""Panels, predictions, filings and the like, derived from the supplied tables, with the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.expr import hash_draw, percent_rank
from panelspark.operators import features, labels

BENCH = "BENCH"
HORIZONS = (1, 4)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per brand and week, and the benchmark over all brands."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    raw = line.join(part, line["l_partkey"] == part["p_partkey"]).select(F.col("p_brand").alias("symbol"), F.date_trunc("week", "l_shipdate").cast("date").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_quantity").alias("q"))
    measures = [F.max("px").alias("high"), F.min("px").alias("low"), F.sum("q").alias("volume"), F.count("px").alias("_n")]
    brands = raw.groupBy("symbol", "date").agg(F.sum("px").alias("_sum"), *measures)
    # the benchmark from the brands' partial sums, both means from the same columns: one exchange serves both, no second pass over the lines
    bench = brands.groupBy("date").agg(F.try_divide(F.sum("_sum"), F.sum("_n")).alias("_avg"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume")).withColumn("symbol", F.lit(BENCH))
    columns = ["symbol", "date", F.round("_avg", 9).alias("close"), F.round("high", 9).alias("high"), F.round("low", 9).alias("low"), "volume"]
    return brands.withColumn("_avg", F.try_divide(F.col("_sum"), F.col("_n"))).select(*columns).unionByName(bench.select(*columns))


PANEL = """raw AS (SELECT p_brand AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_extendedprice / l_quantity AS px, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey),
panel AS (SELECT symbol, date, round(avg(px), 9) AS close, round(max(px), 9) AS high, round(min(px), 9) AS low, sum(q) AS volume FROM raw GROUP BY 1, 2
          UNION ALL SELECT 'BENCH', date, round(avg(px), 9), round(max(px), 9), round(min(px), 9), sum(q) FROM raw GROUP BY date)"""


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_returns(panel(spark, sf_dir), (1, 5, 10, 20))


def ret_sql(w: int, table: str = "panel") -> str:
    return f"close / nullif(lag(close, {w}) OVER (PARTITION BY symbol ORDER BY date), 0) - 1"


RETURNS = PANEL + ",\nreturns AS (SELECT *, " + ", ".join(f"{ret_sql(w)} AS return_{w}d" for w in (1, 5, 10, 20)) + " FROM panel)"


def sector(symbol="symbol"):
    """The last digit of the brand modulo 5; the benchmark has none."""
    return F.when(F.col(symbol) != BENCH, F.concat(F.lit("S"), (F.substring(symbol, -1, 1).cast("int") % 5).cast("string")))


SECTOR = "CASE WHEN symbol <> 'BENCH' THEN 'S' || CAST(CAST(substr(symbol, -1, 1) AS INT) % 5 AS VARCHAR) END"


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rankers over weeks: five-week momentum, sign of the last week, a hash; split by year."""
    rows = returns(spark, sf_dir)
    lab = labels.forward_labels(panel(spark, sf_dir), HORIZONS, BENCH).where("label_horizon_days = 1").select("symbol", "date", "forward_return", "forward_excess_return")
    rows = rows.where(F.col("symbol") != BENCH).join(lab, ["symbol", "date"]).withColumn("split_id", F.year("date"))
    hashed = hash_draw(1_000_000, 7, "symbol", "date") / 1e6
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), s.alias("y_score")) for m, s in (("momentum", F.round("return_5d", 6)), ("random", hashed), ("sign", F.signum("return_1d")))])).alias("x")
    out = rows.select("symbol", "date", "split_id", F.round("forward_return", 6).alias("forward_return"), F.round("forward_excess_return", 6).alias("forward_excess_return"), each).select("symbol", "date", "split_id", "forward_return", "forward_excess_return", "x.*")
    out = out.where("y_score IS NOT NULL AND forward_return IS NOT NULL AND forward_excess_return IS NOT NULL")
    return out.withColumns({"y_true": (F.col("forward_excess_return") > 0).cast("int"), "sector": sector()})


PREDS = RETURNS + f""",
fwd AS (SELECT symbol, date, lead(close, 1) OVER (PARTITION BY symbol ORDER BY date) / nullif(close, 0) - 1 AS f FROM panel),
lab AS (SELECT a.symbol, a.date, a.f AS forward_return, a.f - b.f AS forward_excess_return FROM fwd a LEFT JOIN fwd b ON b.symbol = 'BENCH' AND a.date = b.date),
preds0 AS (SELECT r.symbol, r.date, year(r.date) AS split_id, round(forward_return, 6) AS forward_return, round(forward_excess_return, 6) AS forward_excess_return,
                  unnest(['momentum', 'random', 'sign']) AS model,
                  unnest([round(return_5d, 6), (CAST('0x' || substr(md5('7|' || r.symbol || '|' || CAST(r.date AS VARCHAR)), 1, 8) AS BIGINT) % 1000000) / CAST(1000000 AS DOUBLE), CAST(sign(return_1d) AS DOUBLE)]) AS y_score
           FROM returns r JOIN lab USING (symbol, date) WHERE r.symbol <> 'BENCH'),
preds AS (SELECT *, CASE WHEN forward_excess_return > 0 THEN 1 ELSE 0 END AS y_true, {SECTOR} AS sector FROM preds0
          WHERE y_score IS NOT NULL AND forward_return IS NOT NULL AND forward_excess_return IS NOT NULL)"""


def binary_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a classifier: is a line returned, scored by quantity and discount; model by line status, split by month."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    score = F.round((F.col("l_quantity") / 50.0 + F.col("l_discount") * 5.0) / 1.5, 3)
    return line.select(
        F.col("l_orderkey").cast("string").alias("symbol"), F.date_trunc("week", "l_shipdate").cast("date").alias("date"), F.concat(F.lit("m"), "l_linestatus").alias("model"), F.month("l_shipdate").alias("split_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("y_true"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("y_score"),
    )


BINARY = """binary_preds AS (SELECT CAST(l_orderkey AS VARCHAR) AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, 'm' || l_linestatus AS model, CAST(month(l_shipdate) AS INT) AS split_id,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), round((l_quantity / CAST(50 AS DOUBLE) + l_discount * CAST(5 AS DOUBLE)) / CAST(1.5 AS DOUBLE), 3))) AS y_score FROM lineitem)"""


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings of a nation: the status is the form."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("symbol"), F.col("o_orderstatus").alias("form"), F.col("o_orderdate").cast("date").alias("filing_date"), F.col("o_orderkey").alias("accession"), F.col("o_totalprice").alias("amount"))


FILINGS = "filings AS (SELECT 'N' || CAST(c_nationkey AS VARCHAR) AS symbol, o_orderstatus AS form, CAST(o_orderdate AS DATE) AS filing_date, o_orderkey AS accession, o_totalprice AS amount FROM orders JOIN customer ON o_custkey = c_custkey)"


def market_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation on every Monday with an order."""
    f = filings(spark, sf_dir)
    return f.select("symbol").distinct().crossJoin(f.select(F.date_trunc("week", "filing_date").cast("date").alias("date")).distinct())


MARKET = "market AS (SELECT symbol, date FROM (SELECT DISTINCT symbol FROM filings) CROSS JOIN (SELECT DISTINCT CAST(date_trunc('week', filing_date) AS DATE) AS date FROM filings))"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as facts: quarterly sums per nation of supplier and kind of line."""
    line, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    q = F.date_trunc("quarter", "l_shipdate").cast("date")
    return line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).groupBy(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("symbol"), F.concat("l_returnflag", "l_linestatus").alias("concept"), q.alias("end_date")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value")).select(
        "*", F.add_months("end_date", 3).alias("filing_date"), F.concat(F.lit("Q"), F.quarter("end_date").cast("string")).alias("fiscal_period"), F.concat("symbol", F.lit("-"), F.date_format("end_date", "yyyy-MM-dd")).alias("accession")
    )


FACTS = """facts AS (SELECT symbol, concept, end_date, value, CAST(end_date + INTERVAL 3 MONTH AS DATE) AS filing_date, 'Q' || CAST(quarter(end_date) AS VARCHAR) AS fiscal_period, symbol || '-' || CAST(end_date AS VARCHAR) AS accession FROM (
    SELECT 'N' || CAST(s_nationkey AS VARCHAR) AS symbol, l_returnflag || l_linestatus AS concept, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS end_date, round(sum(l_extendedprice), 2) AS value
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3))"""
CONCEPTS = ("AF", "NO", "RF")


def macro_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by day and priority: the mean price."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date"), F.substring("o_orderpriority", 1, 1).alias("series")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"), F.max("o_orderkey").alias("retrieved_at"))


MACRO = "macro AS (SELECT CAST(o_orderdate AS DATE) AS date, substr(o_orderpriority, 1, 1) AS series, round(avg(o_totalprice), 4) AS value, max(o_orderkey) AS retrieved_at FROM orders GROUP BY 1, 2)"
SERIES = ("1", "2", "3", "4", "5")
MACRO_WIDE = MACRO + ", wide AS (SELECT date, " + ", ".join(f"max(CASE WHEN series = '{s}' THEN value END) AS s{s}" for s in SERIES) + " FROM macro GROUP BY date)"


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events as order events: order id from user and hour, states by kind of event."""
    e = table(spark, sf_dir, "events")
    kinds = ["new", "accepted", "partially_filled", "filled", "canceled"]
    state = F.get(F.array(*[F.lit(k) for k in kinds]), F.pmod(F.crc32("event_type"), F.lit(5)).cast("int"))
    hour = (F.unix_timestamp(F.col("ts").cast("timestamp")) / 21600).cast("long")
    return e.select((F.col("user_id") * 1000 + hour % 1000).alias("order_id"), F.col("event_id").alias("seq"), state.alias("status"), F.col("ts"))
