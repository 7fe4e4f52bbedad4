"""Queries of samples by split and role, of seed ensembles, and of streams over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import ensembles, sampling
from panelspark.plans import catalog, evaluation
from panelspark.plans import views as v
from panelspark.plans.catalog import query, scorr
from panelspark.sources import tables
from panelspark.streaming import streams

QUERIES, SQL = catalog.QUERIES, catalog.SQL

ROLED = v.PREDS + ", rr AS (SELECT symbol, date, split_id, CASE WHEN month(date) <= 9 THEN 'train' ELSE 'validation' END AS role, y_true FROM preds WHERE model = 'sign')"


def roled(spark, d):
    """One model's rows; the first nine months of a year train, the others validate."""
    rows = v.preds(spark, d).where("model = 'sign'")
    return rows.select("symbol", "date", "split_id", F.when(F.month("date") <= 9, "train").otherwise("validation").alias("role"), "y_true")


@query("split_id:i role symbol date y_true:i", ROLED + """,
    sy AS (SELECT symbol FROM (SELECT DISTINCT symbol FROM rr) ORDER BY sha256('7|' || symbol), symbol LIMIT 15),
    r1 AS (SELECT *, 7 + split_id * 1000 + CASE role WHEN 'train' THEN 0 ELSE 10000 END AS seed FROM rr WHERE symbol IN (SELECT symbol FROM sy)),
    dy AS (SELECT split_id, role, date FROM (SELECT DISTINCT split_id, role, date, seed FROM r1) QUALIFY row_number() OVER (PARTITION BY split_id, role ORDER BY sha256(seed || '|' || date), date) <= 12),
    r2 AS (SELECT * FROM r1 JOIN dy USING (split_id, role, date)),
    gr AS (SELECT split_id, role, least(count(*) FILTER (WHERE y_true = 1), count(*) FILTER (WHERE y_true = 0)) AS c, count(DISTINCT y_true) = 2 AS even, CASE role WHEN 'train' THEN 60 ELSE 25 END AS cap FROM r2 GROUP BY 1, 2),
    r3 AS (SELECT *, row_number() OVER (PARTITION BY split_id, role, y_true ORDER BY h, symbol, date) AS a, row_number() OVER (PARTITION BY split_id, role ORDER BY h, symbol, date) AS b FROM (SELECT *, sha256(seed || '|' || symbol || '|' || date) AS h FROM r2))""",
    "SELECT * FROM r3 JOIN gr USING (split_id, role) WHERE CASE WHEN even THEN a <= least(c, cap // 2) ELSE b <= cap END")
def k13_sample_by_role(spark, d):
    return sampling.sample_roles(roled(spark, d), "y_true", 7, n_symbols=15, n_dates=12, caps={"train": 60, "validation": 25})


@query("split_id:i role symbol date y_true:i", ROLED + """,
    sz AS (SELECT split_id, role, count(*) AS n, count(DISTINCT date) AS nd FROM rr GROUP BY 1, 2),
    di AS (SELECT *, row_number() OVER (PARTITION BY split_id, role ORDER BY date) - 1 AS i FROM (SELECT DISTINCT split_id, role, date FROM rr) JOIN sz USING (split_id, role) WHERE nd < least(100, n) / 2.0),
    wn AS (SELECT DISTINCT split_id, role, nd, least(8, nd, 25) AS w FROM di),
    pl AS (SELECT DISTINCT split_id, role, CAST(round_even(k * (nd - 1) / greatest(w - 1, 1)::DOUBLE, 0) AS BIGINT) AS i FROM (SELECT *, unnest(range(0, w)) AS k FROM wn)),
    ch AS (SELECT split_id, role, date, 100 // count(*) OVER g + CASE WHEN row_number() OVER (PARTITION BY split_id, role ORDER BY date) <= 100 % count(*) OVER g THEN 1 ELSE 0 END AS budget FROM di JOIN pl USING (split_id, role, i) WINDOW g AS (PARTITION BY split_id, role)),
    dd AS (SELECT rr.*, budget, sha256((3 + split_id * 100) || '|' || symbol || '|' || date) AS h FROM rr JOIN ch USING (split_id, role, date)),
    kk AS (SELECT split_id, role, date, count(DISTINCT y_true) AS k FROM dd GROUP BY ALL),
    ff AS (SELECT *, row_number() OVER (PARTITION BY split_id, role, date, y_true ORDER BY h, symbol) <= greatest(1, budget // k) AS first FROM dd JOIN kk USING (split_id, role, date)),
    nn AS (SELECT *, row_number() OVER (PARTITION BY split_id, role, date ORDER BY first DESC, h, symbol) AS n FROM ff)""",
    "SELECT * FROM nn WHERE first OR n <= budget")
def k14_cross_section_sample(spark, d):
    """Every group here has fewer dates than half its limit; the other way is tested on a fixture."""
    return sampling.sample_cross_sections(roled(spark, d), "y_true", 100, 8, 3)


@query("n_runs:i n_rows:i dispersion_mean:r dispersion_max:r min_pairwise_correlation:r", v.PREDS + f""",
    rw AS (SELECT split_id, symbol, date, stddev_pop(y_score) AS d, max(CASE WHEN model = 'momentum' THEN y_score END) AS a, max(CASE WHEN model = 'random' THEN y_score END) AS b, max(CASE WHEN model = 'sign' THEN y_score END) AS c FROM preds GROUP BY 1, 2, 3)""",
    f"SELECT 3 AS n_runs, count(*) AS n_rows, avg(d) AS dispersion_mean, max(d) AS dispersion_max, list_min([{scorr('a', 'b')}, {scorr('a', 'c')}, {scorr('b', 'c')}]) AS min_pairwise_correlation FROM rw")
def e8_seed_summary(spark, d):
    return ensembles.seed_summary(v.preds(spark, d))


# --- streams: the events, written in two steps of which the second corrects the first, read file by file


def _fed(spark, folder: str, *steps):
    """A stream over tables that are written one after the other, a file a batch."""
    for step in steps:
        step.write.mode("append").parquet(folder)
    return spark.readStream.schema(steps[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _bars(spark, d):
    e = v.table(spark, d, "events")
    bars = e.select("user_id", F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").alias("close"))
    fixed = bars.where("user_id % 3 = 0").withColumn("close", F.col("close") + 1)
    return bars.drop("user_id"), fixed.drop("user_id")


@query("symbol timestamp_us:i close:r", "", "SELECT 'U' || user_id AS symbol, epoch_us(ts) AS timestamp_us, value + CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS close FROM events")
def t1_stream_upsert_bars(spark, d):
    """Bars of all users and later corrections of a third of them, upserted by a stream: the newest of each symbol and time."""
    folder = tables.scratch_folder(spark, "bars")
    bars, fixed = _bars(spark, d)
    streams.upsert_bars(_fed(spark, f"{folder}/in", bars, fixed), f"{folder}/table", f"{folder}/log", "36500 days").awaitTermination()
    return streams.current(spark, f"{folder}/table", ["symbol", "timestamp"]).withColumn("timestamp_us", F.unix_micros("timestamp"))


@query("symbol effective_date n_events:i", "", "SELECT 'U' || user_id AS symbol, CAST(ts AS DATE) AS effective_date, count(*) AS n_events FROM events GROUP BY 1, 2")
def t2_stream_snapshots(spark, d):
    """A day's snapshots come twice, at first with a count of 0; the last of a symbol and date stays."""
    folder = tables.scratch_folder(spark, "snapshots")
    days = v.table(spark, d, "events").groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), F.col("ts").cast("date").alias("effective_date")).agg(F.count(F.lit(1)).alias("n_events"))
    streams.append_snapshots(_fed(spark, f"{folder}/in", days.withColumn("n_events", F.lit(0).cast("long")), days), f"{folder}/table", f"{folder}/log").awaitTermination()
    return streams.current(spark, f"{folder}/table", ["symbol", "effective_date"])


@query("lane n_rows:i total:r", "", "SELECT CASE WHEN value < 50 THEN 'bad' ELSE 'good' END AS lane, count(*) AS n_rows, sum(value) AS total FROM events GROUP BY 1")
def t5_stream_quality_split(spark, d):
    folder = tables.scratch_folder(spark, "quality")
    e = v.table(spark, d, "events").select("event_id", "value")
    streams.quality_split(_fed(spark, f"{folder}/in", e), F.col("value") < 50, f"{folder}/good", f"{folder}/bad", f"{folder}/log").awaitTermination()
    lanes = [tables.read_table(spark, f"{folder}/{lane}").withColumn("lane", F.lit(lane)) for lane in ("good", "bad")]
    return lanes[0].unionByName(lanes[1]).groupBy("lane").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("total"))


@query("order_id:i status is_stale", evaluation.ORDER_EVENTS + """,
    st AS (SELECT order_id, coalesce(arg_min(status, {'ts': ts, 'seq': seq, 'r': r}) FILTER (WHERE r >= 3), arg_max(status, r)) AS status, coalesce(bool_or(r >= 3), false) AS ended, max(r) AS top FROM nm GROUP BY 1),
    sn AS (SELECT order_id, min(ts) AS since FROM nm JOIN st USING (order_id) WHERE r = top GROUP BY 1),
    wm AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS mark FROM ev)""",
    "SELECT order_id, status, false AS is_stale FROM st UNION ALL SELECT order_id, status, true FROM st JOIN sn USING (order_id), wm WHERE NOT ended AND date_trunc('millisecond', since) + INTERVAL 30 MINUTE < mark")
def t3_t4_stream_order_states(spark, d):
    """The state of each order after its events, and a stale row for those still open 30 minutes after their last change, by event time."""
    folder = tables.scratch_folder(spark, "orders")
    v.order_events(spark, d).write.parquet(f"{folder}/in")
    events = spark.readStream.schema("order_id long, seq long, status string, ts timestamp").parquet(f"{folder}/in")
    states = streams.order_states(events).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log")
    states.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")
