"""Structured Streaming: upserts of bars, snapshots, quality split, order states with stale flags."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelspark.operators.joins import last_row
from panelspark.operators.orders import ENDED, STATES


def _versioned(batch: DataFrame, number: int, table: str) -> None:
    """Appends under the batch's number; a batch that is written again replaces itself."""
    batch.withColumn("batch", F.lit(number)).write.mode("overwrite").partitionBy("batch").option("partitionOverwriteMode", "dynamic").parquet(table)


def upsert_bars(bars: DataFrame, table: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Appends new bars by batch, without repeats inside the watermark; current() reads the newest of each."""
    fresh = bars.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["symbol", "timestamp", "close"])
    return fresh.writeStream.foreachBatch(lambda b, n: _versioned(b, n, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, table: str, keys: list[str]) -> DataFrame:
    """The newest row of each key over all batches."""
    try:
        return last_row(spark.read.parquet(table), keys, ["batch"])
    except AnalysisException as e:
        raise FileNotFoundError(f"{table} has no batch yet") from e


def append_snapshots(snapshots: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    return snapshots.writeStream.foreachBatch(lambda b, n: _versioned(b, n, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quality_split(rows: DataFrame, bad: Column, good_table: str, bad_table: str, checkpoint: str) -> StreamingQuery:
    """Good rows on, bad ones to quarantine, batch by batch."""

    def split(batch: DataFrame, n: int) -> None:
        flagged = batch.withColumn("_bad", F.coalesce(bad, F.lit(False)))
        _versioned(flagged.where(~F.col("_bad")).drop("_bad"), n, good_table)
        _versioned(flagged.where("_bad").drop("_bad"), n, bad_table)

    return rows.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Orders of ids from a multiple of this up to the next have one state together: at most so many, however many orders there are.
BLOCK = 8192
#: An order in that state: its place in the block, index of its state, whether told stale, ms of its last change and of its limit.
ORDER = np.dtype([("place", "<i4"), ("rank", "i1"), ("told", "?"), ("since", "<i8"), ("until", "<i8")])
NEVER = np.iinfo(np.int64).max


def _ended(rank: np.ndarray) -> np.ndarray:
    return np.isin(rank, [STATES.index(s) for s in ENDED])


def _deciding(events: np.ndarray) -> np.ndarray:
    """Of rows (place, at, seq, rank), one an order: its first ended event, as every open state comes before it, else the first of its furthest state."""
    place, at, seq, rank = events.T
    end = _ended(rank)
    events = events[np.lexsort((np.where(end, rank, 0), np.where(end, seq, at), np.where(end, at, -rank), ~end, place))]
    return events[np.append(True, events[1:, 0] != events[:-1, 0])] if len(events) else events


def order_states(events: DataFrame, stale_minutes: int = 30, delay: str = "10 minutes") -> DataFrame:
    """A row each time an order's state changes, and one when it stays open past the limit. events: order_id, status, ts, and seq if there is one.

    Events count by ts; of those at one time the smaller seq comes first, then the earlier state in STATES.
    A state never goes back and ended ones stay, after the limit too: only orders that are still open are
    told stale, once until their state changes. Unknown states and events without a time are skipped.

    Python is called for a block of ids, not for an order: calls cost far more than events. The timer of a
    block is that of its next order, and orders past their limit are told in any call.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, last = state.getCurrentWatermarkMs(), np.empty((0, 4), np.int64)
        for rows in batches:
            part = rows.loc[rows["rank"] >= 0, ["place", "at", "seq", "rank"]]
            last = _deciding(np.concatenate([last, part.to_numpy(np.int64)]))
        held = np.frombuffer(state.get[0], ORDER) if state.exists else np.empty(0, ORDER)
        new = np.zeros(len(fresh := np.setdiff1d(last[:, 0], held["place"])), ORDER)
        new["place"], new["rank"] = fresh, -1
        held = np.sort(np.concatenate([held, new]), order="place")
        nth, rank = np.searchsorted(held["place"], last[:, 0]), last[:, 3]
        change = ~_ended(held["rank"][nth]) & (rank > held["rank"][nth])
        moved = nth[change]
        held["rank"][moved], held["since"][moved], held["told"][moved] = rank[change], last[change, 1] // 1000, False
        waits = ~_ended(held["rank"][nth]) & ~held["told"][nth]
        held["until"][nth] = np.where(waits, np.maximum(held["since"][nth] + stale_minutes * 60_000, now + 1), NEVER)
        due = np.flatnonzero(held["until"] < now)
        held["told"][due], held["until"][due] = True, NEVER
        if len(held):
            state.update((held.tobytes(),))
            if (until := int(held["until"].min())) < NEVER:
                state.setTimeoutTimestamp(until)
        told = np.concatenate([moved, due])
        if len(told):
            ids = [None] * len(told) if key[0] is None else key[0] + held["place"][told].astype(np.int64)
            yield pd.DataFrame({"order_id": ids, "status": np.array(STATES, object)[held["rank"][told]], "is_stale": np.arange(len(told)) >= len(moved)})

    ts, order = F.col("ts").cast("timestamp"), F.col("order_id").cast("long")
    seq = F.coalesce(F.col("seq").cast("long") if "seq" in events.columns else F.lit(None).cast("long"), F.lit(0))
    place = F.pmod(order, F.lit(BLOCK).cast("long"))
    rank = F.coalesce(*[F.when((F.col("status") == s) & ts.isNotNull(), i) for i, s in enumerate(STATES)], F.lit(-1))
    kept = events.select((order - place).alias("block"), F.coalesce(place, F.lit(0)).alias("place"), rank.alias("rank"), ts.alias("ts"), F.coalesce(F.unix_micros(ts), F.lit(0)).alias("at"), seq.alias("seq")).withWatermark("ts", delay)
    return kept.groupBy("block").applyInPandasWithState(step, "order_id long, status string, is_stale boolean", "orders binary", "append", GroupStateTimeout.EventTimeTimeout)
