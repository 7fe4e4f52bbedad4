"""Order intents, reconciliation and staged validation, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_id(prefix: str, day: Column, *parts: Column) -> Column:
    """The same id for the same order on any run."""
    return F.concat(F.lit(prefix + "-"), F.date_format(day, "yyyyMMdd"), F.lit("-"), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 24))


def build_intents(signals: DataFrame, positions: DataFrame, top: int, cash: float, least_notional: float) -> DataFrame:
    """Per account: target weights of its top names against current ones, with trades from least_notional on.

    signals: account_id, symbol, score, price, equity. positions: account_id, symbol, market_value.
    """
    place = F.row_number().over(Window.partitionBy("account_id").orderBy(F.col("score").desc(), "symbol"))
    chosen = signals.withColumn("_n", place).where(F.col("_n") <= top)
    chosen = chosen.withColumn("target_weight", (1 - cash) / F.count(F.lit(1)).over(Window.partitionBy("account_id"))).select("account_id", "symbol", "target_weight")
    prices = signals.select("account_id", "symbol", "price")
    equity = signals.groupBy("account_id").agg(F.max("equity").alias("equity"))
    out = chosen.join(positions, ["account_id", "symbol"], "full").join(equity, "account_id", "left").join(prices, ["account_id", "symbol"], "left")
    out = out.withColumns({"target_weight": F.coalesce("target_weight", F.lit(0.0)), "current_weight": F.coalesce(F.try_divide(F.col("market_value"), F.col("equity")), F.lit(0.0))})
    delta = F.col("target_weight") - F.col("current_weight")
    out = out.withColumn("delta_weight", delta).withColumn("notional", F.abs("delta_weight") * F.col("equity"))
    side = F.when((F.col("notional") >= least_notional) & (F.col("delta_weight") > 0), "buy").when(F.col("notional") >= least_notional, "sell").otherwise("hold")
    return out.withColumn("side", side).withColumn("quantity", F.when(F.col("side") != "hold", F.try_divide(F.col("notional"), F.col("price"))))


def pretrade(orders: DataFrame, seen: DataFrame, most_notional: float, buffer: float = 0.005) -> DataFrame:
    """Ordered decisions and limit prices. seen: ids known already."""
    out = orders.join(seen.select("order_id", F.lit(True).alias("_seen")).distinct(), "order_id", "left")
    decision = F.when(F.col("_seen"), "duplicate").when(F.col("price").isNull() | (F.col("price") <= 0), "no_price").when(F.col("notional") > most_notional, "too_large").otherwise("accept")
    raw = F.col("price") * F.when(F.col("side") == "buy", 1 + buffer).otherwise(1 - buffer)
    tick = F.when(F.col("price") >= 1, 100.0).otherwise(10000.0)
    limit = F.when(F.col("side") == "buy", F.ceil(F.round(raw * tick, 6)) / tick).otherwise(F.floor(F.round(raw * tick, 6)) / tick)
    return out.withColumns({"decision": decision, "limit_price": limit}).drop("_seen")


def turnover_gate(intents: DataFrame, most: float) -> DataFrame:
    """Per account: half the sum of absolute weight changes, and whether the limit allows it."""
    out = intents.groupBy("account_id").agg((F.sum(F.abs("delta_weight")) / 2).alias("turnover"))
    return out.withColumn("is_allowed", F.col("turnover") <= most + 1e-12)


def pretrade_decisions(orders: DataFrame, seen: DataFrame, open_orders: DataFrame, assets: DataFrame, positions: DataFrame, kind: str = "equity") -> DataFrame:
    """A status and its reason for each planned order, the first rule that applies; only approved orders go out.

    orders: account_id, symbol, order_id, side, quantity. seen: order_id. open_orders: account_id, symbol. assets: symbol,
    asset_class, asset_status, is_tradable, is_fractionable. positions: account_id, symbol, quantity. An unknown asset has no class.
    """
    flag = F.lit(True).alias
    out = orders.join(seen.select("order_id", flag("_seen")).distinct(), "order_id", "left").join(open_orders.select("account_id", "symbol", flag("_open")).distinct(), ["account_id", "symbol"], "left")
    out = out.join(assets.select("symbol", "asset_class", "asset_status", "is_tradable", "is_fractionable"), "symbol", "left")
    out = out.join(positions.groupBy("account_id", "symbol").agg(F.sum("quantity").alias("_held")), ["account_id", "symbol"], "left")
    no = F.lit(False)
    whole = F.abs(F.col("quantity") - F.round("quantity")) <= 1e-9
    reason = (
        F.when(F.col("_seen"), "duplicate_order_id")
        .when(F.col("_open"), "conflicting_open_order")
        .when(~F.coalesce(F.col("asset_class") == kind, no), "unsupported_asset_class")
        .when(~F.coalesce(F.col("asset_status") == "active", no), "asset_inactive")
        .when(~F.coalesce("is_tradable", no), "asset_not_tradable")
        .when(~F.coalesce(whole, no) & ~F.coalesce("is_fractionable", no), "asset_not_fractionable")
        .when((F.col("side") == "sell") & (F.col("quantity") > F.coalesce("_held", F.lit(0.0)) + 1e-9), "insufficient_position")
        .otherwise("risk_checks_passed")
    )
    status = F.when(F.col("reason") == "risk_checks_passed", "approved").when(F.col("reason") == "duplicate_order_id", "skipped").otherwise("rejected")
    return out.withColumn("reason", reason).withColumn("status", status).drop("_seen", "_open", "_held", "asset_class", "asset_status", "is_tradable", "is_fractionable")


def order_report(orders: DataFrame, intents: DataFrame) -> DataFrame:
    """Share filled, at most 1, and slippage in basis points, adverse above zero."""
    out = intents.join(orders.select("order_id", "filled_qty", "filled_price"), "order_id", "left")
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    return out.withColumns({"fill_share": F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("filled_qty"), F.col("quantity")), F.lit(0.0))), "slippage_bps": sign * (F.try_divide(F.col("filled_price"), F.col("price")) - 1) * 1e4})


def position_report(positions: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    out = targets.join(positions, keys, "full").na.fill(0.0, ["target_value", "market_value"])
    return out.withColumn("residual", F.col("market_value") - F.col("target_value"))


def reconcile(report: DataFrame, keys: list[str], fill: float = 0.99, slippage: float = 50.0) -> DataFrame:
    """Counts and a status by priority: no_orders, unfilled, partial, slippage, ok."""
    out = report.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_orders"), F.avg("fill_share").alias("avg_fill"), F.avg("slippage_bps").alias("avg_slippage_bps"), F.count_if(F.col("fill_share") < fill).alias("n_short"))
    status = F.when(F.col("n_orders") == 0, "no_orders").when(F.col("avg_fill") == 0, "unfilled").when(F.col("n_short") > 0, "partial").when(F.col("avg_slippage_bps") > slippage, "slippage").otherwise("ok")
    return out.withColumn("status", status)


def cadence(orders: DataFrame, calendar: DataFrame, keys: list[str], every: int) -> DataFrame:
    """Trading days since the last submission, and whether a rebalance is due. calendar: a row a date."""
    last = orders.groupBy(*keys).agg(F.max("date").alias("last_date"))
    dates = calendar.select(F.col("date").alias("d")).distinct().withColumn("i", F.row_number().over(Window.orderBy("d")))
    top = dates.agg(F.max("i").alias("top"))
    place = last.join(F.broadcast(dates), F.col("last_date") == F.col("d"), "left").crossJoin(F.broadcast(top))
    return place.select(*keys, "last_date", (F.col("top") - F.col("i")).alias("days_since"), (F.col("top") - F.col("i") >= every).alias("is_due"))


def gates(metrics: DataFrame, criteria: list[tuple[str, str, float]], keys: list[str]) -> DataFrame:
    """A row per criterion (metric, operator, threshold): actual value and whether it holds; null fails."""
    holds = {">=": lambda a, t: a >= t, "<=": lambda a, t: a <= t}
    each = F.array(*[F.struct(F.lit(m).alias("gate"), F.col(m).cast("double").alias("actual"), F.lit(op).alias("operator"), F.lit(float(t)).alias("threshold"), F.coalesce(holds[op](F.col(m), F.lit(float(t))), F.lit(False)).alias("passed")) for m, op, t in criteria])
    return metrics.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*")


#: Order of the states of an order; the last three end it.
STATES = ("new", "accepted", "partially_filled", "filled", "canceled", "rejected")
ENDED = ("filled", "canceled", "rejected")


def fold_events(events: DataFrame) -> DataFrame:
    """The state of each order after its events in order of seq: states never go back and ended ones stay; n_events counts every event of a known state.

    events: order_id, seq, status. Equal to taking the first ended state, else the furthest one; so it is an
    aggregate with partial sums, not a list of events.
    """
    rank = F.coalesce(*[F.when(F.col("status") == s, i) for i, s in enumerate(STATES)])
    rows = events.withColumn("rank", rank).where("rank IS NOT NULL")
    end = F.min(F.when(F.col("status").isin(*ENDED), F.struct("seq", "status")))
    out = rows.groupBy("order_id").agg(end.alias("end"), F.max(F.struct("rank", "status")).alias("furthest"), F.count(F.lit(1)).alias("n_events"))
    return out.select("order_id", F.coalesce("end.status", "furthest.status").alias("status"), F.col("end").isNotNull().alias("is_ended"), "n_events")


def check_signals(signals: DataFrame, as_of, stale_days: int) -> DataFrame:
    """A row per check of the signal contract: one date, fresh, unique symbols, probabilities, prices."""
    row = signals.agg(
        (F.countDistinct("date") - 1).alias("one_date"),
        F.count_if(F.datediff(as_of, F.col("date")) > stale_days).alias("fresh"),
        (F.count(F.lit(1)) - F.countDistinct("symbol")).alias("unique_symbols"),
        F.count_if(~F.coalesce(F.col("score").between(0, 1), F.lit(False))).alias("probability"),
        F.count_if(~F.coalesce(F.col("price") > 0, F.lit(False))).alias("positive_price"),
    )
    each = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("affected_rows")) for c in row.columns])
    return row.select(F.explode(each).alias("x")).select("x.*").withColumn("passed", F.col("affected_rows") == 0)


def unique_orders(orders: DataFrame) -> DataFrame:
    """The latest row of each order id."""
    by = Window.partitionBy("order_id").orderBy(F.col("updated_at").desc(), F.col("seq").desc())
    return orders.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def match_observed(observed: DataFrame, planned: DataFrame) -> DataFrame:
    """Observed orders that a plan asked for, by id."""
    return observed.join(planned.select("order_id").distinct(), "order_id", "left_semi")


def shadow_records(intents: DataFrame) -> DataFrame:
    """A document per account: its trades sorted by symbol, with a digest."""
    trades = F.array_sort(F.collect_list(F.struct("symbol", "side", F.round("notional", 2).alias("notional"))))
    out = intents.where("side <> 'hold'").groupBy("account_id").agg(trades.alias("trades"))
    return out.withColumn("digest", F.sha2(F.to_json("trades"), 256))


def stage_metrics(records: DataFrame) -> DataFrame:
    """Counts over the trades of shadow records."""
    rows = records.select("account_id", F.explode("trades").alias("t"))
    return rows.agg(F.countDistinct("account_id").alias("n_accounts"), F.count(F.lit(1)).alias("n_trades"), F.count_if(F.col("t.side") == "buy").alias("n_buys"), F.sum("t.notional").alias("notional"))


def validation_report(metrics: DataFrame, criteria: dict[str, list[tuple[str, str, float]]], keys: list[str]) -> DataFrame:
    """A row per key and stage: its gates in order, whether all pass, and a SHA-256 of the row's canonical JSON.

    metrics: a row per key with the figures that the criteria name. A null figure fails. Passing makes a stage
    eligible; it never approves it.
    """
    from functools import reduce

    stages = [gates(metrics, rules, keys).withColumn("stage", F.lit(stage)) for stage, rules in criteria.items()]
    rows = reduce(DataFrame.unionByName, stages)
    checks = F.array_sort(F.collect_list(F.struct("gate", F.round("actual", 6).alias("actual"), "operator", "threshold", "passed"))).alias("checks")
    out = rows.groupBy(*keys, "stage").agg(checks, F.bool_and("passed").alias("is_eligible"), F.count_if(~F.col("passed")).alias("n_failed"))
    return out.withColumn("report_digest", F.sha2(F.to_json(F.struct(*keys, "stage", "checks", "is_eligible")), 256))
