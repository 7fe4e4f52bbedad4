"""Queries that write a table with one of the sinks and read it back with one of the scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.plans import catalog
from panelspark.plans import views as v
from panelspark.plans.catalog import query
from panelspark.sources import tables

QUERIES, SQL = catalog.QUERIES, catalog.SQL


@query("o_orderstatus n_rows:i total:2", "", "SELECT o_orderstatus, count(*) AS n_rows, sum(o_totalprice) AS total FROM orders GROUP BY 1")
def s1_s3_parquet_files(spark, d):
    """A table written by order status, all its files read as one."""
    folder = tables.scratch_folder(spark, "orders")
    tables.write_table(v.table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("status"), "o_orderstatus"), folder, ["status"])
    found = tables.read_tables(spark, folder, "*.parquet", ["o_orderkey", "o_orderstatus", "o_totalprice"])
    return found.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("o_totalprice").alias("total"))


@query("model n_rows:i positives:i", "", "SELECT 'm' || l_linestatus AS model, count(*) AS n_rows, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS positives FROM lineitem GROUP BY 1")
def s4_binary_files(spark, d):
    """A folder of predictions of which the regressor's files, with the quantity as target, are left out."""
    folder = tables.scratch_folder(spark, "predictions")
    rows = v.table(spark, d, "lineitem").select(F.concat(F.lit("m"), "l_linestatus").alias("model"), (F.col("l_returnflag") == "R").cast("double").alias("y_true"), (F.col("l_quantity") + 1).alias("quantity"))
    tables.write_table(rows.select("model", "y_true"), f"{folder}/classifier")
    tables.write_table(rows.select(F.lit("regressor").alias("model"), F.col("quantity").cast("double").alias("y_true")), f"{folder}/regressor")
    return tables.read_binary_targets(spark, folder).groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("y_true").alias("positives"))


@query("s_suppkey:i s_name s_acctbal:2", "", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s5_s6_csv(spark, d):
    folder = tables.scratch_folder(spark, "suppliers")
    tables.write_csv(v.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), folder)
    return tables.read_csv(spark, folder, "s_suppkey long, s_name string, s_acctbal double")


@query("status n_files:i", "r AS (SELECT count(*) AS n FROM region)", "SELECT 'ok' AS status, n - 1 AS n_files FROM r UNION ALL SELECT 'missing', 1 FROM r UNION ALL SELECT 'unexpected', 1 FROM r")
def s10_s11_manifest(spark, d):
    """A manifest of a file for each region's nations, compared after the first region was written anew."""
    folder = tables.scratch_folder(spark, "nations")
    nations = v.table(spark, d, "nation").withColumn("region", F.col("n_regionkey"))
    tables.write_table(nations.repartition(1), folder, ["region"])
    before = tables.written(tables.build_manifest(spark, folder), "manifest")
    tables.write_table(nations.where("region = 0").drop("region").repartition(1), f"{folder}/region=0")
    return tables.verify_manifest(spark, folder, before).groupBy("status").agg(F.count(F.lit(1)).alias("n_files"))


@query("date value:r", v.MACRO, "SELECT date, value FROM macro WHERE series = '1' AND year(date) >= 1996")
def n12_rate_csv(spark, d):
    """The days of two series as a file with a preamble and bad rows, of which one series is read."""
    folder = tables.scratch_folder(spark, "rates")
    wide = v.macro_long(spark, d).groupBy("date").pivot("series", ["1", "2"]).agg(F.first("value"))
    lines = wide.select("date", F.concat_ws(",", F.col("date").cast("string"), F.coalesce(F.col("2").cast("string"), F.lit("ND")), F.coalesce(F.col("1").cast("string"), F.lit("ND"))).alias("line"))
    head = '"Series Description","two","one"\n"Unit:","Percent","Percent"\n"Time Period","RATES/P2","RATES/P1"\n'
    text = lines.agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", "line"))), lambda x: x["line"]), "\n"), F.lit("\nno date,1,2")).alias("value"))  # a line a date
    text.write.text(folder)
    return tables.rate_csv(spark, folder, "P1", 1996)
