"""Deterministic samples by hash order, class balance, caps, top lists, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]), 256)


def per_date(df: DataFrame, n: int) -> DataFrame:
    """At most n rows of each date, by the hash of the upper-case symbol."""
    by = Window.partitionBy("date").orderBy(F.sha2(F.upper("symbol"), 256), "symbol")
    return df.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= n).drop("_n")


def symbols(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Rows of n symbols, drawn by hash."""
    chosen = df.select("symbol").distinct().orderBy(hash_key(F.lit(seed), "symbol"), "symbol").limit(n)
    return df.join(F.broadcast(chosen), "symbol", "left_semi")


def dates(df: DataFrame, n: int, seed: int, keys: Sequence[str] = ("split_id", "role")) -> DataFrame:
    """Rows of n dates of each group, drawn by hash."""
    by = Window.partitionBy(*keys).orderBy(hash_key(F.lit(seed), *keys, "date"), "date")
    chosen = df.select(*keys, "date").distinct().withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= n).drop("_n")
    return df.join(chosen, [*keys, "date"], "left_semi")


def balance(df: DataFrame, target: str, seed: int, keys: Sequence[str] = ("split_id", "role"), cap: int | None = None) -> DataFrame:
    """The same number of rows of class 0 and 1 in each group: that of the rarer one, at most cap // 2."""
    rows = df.where(F.col(target).isin(0, 1))
    counts = rows.groupBy(*keys).agg(F.least(F.count_if(F.col(target) == 0), F.count_if(F.col(target) == 1)).alias("_most"))
    if cap is not None:
        counts = counts.withColumn("_most", F.least("_most", F.lit(cap // 2)))
    by = Window.partitionBy(*keys, target).orderBy(hash_key(F.lit(seed), "symbol", "date"), "symbol", "date")
    return rows.withColumn("_n", F.row_number().over(by)).join(F.broadcast(counts), list(keys)).where("_n <= _most").drop("_n", "_most")


def balanced_exact(df: DataFrame, target: str, n: int, seed: int) -> DataFrame:
    """n / 2 rows of each class, or an error."""
    have = {r[target]: r["count"] for r in df.where(F.col(target).isin(0, 1)).groupBy(target).count().collect()}
    if min(have.get(0, 0), have.get(1, 0)) < n // 2:
        raise ValueError(f"{n // 2} rows of each class are asked for, there are {have}")
    return balance(df.withColumn("_all", F.lit(0)), target, seed, ["_all"], n).drop("_all")


def build_sample(df: DataFrame, target: str, n_symbols: int, n_dates: int, cap: int, seed: int) -> DataFrame:
    """Symbols, then dates, then balanced classes under a cap, per split and role."""
    return balance(dates(symbols(df, n_symbols, seed), n_dates, seed), target, seed, cap=cap)


def evenly_spaced_dates(df: DataFrame, n: int) -> DataFrame:
    """n dates at even places of the sorted dates."""
    from panelspark.operators.splits import date_index

    index = date_index(df)
    total = F.count(F.lit(1)).over(Window.partitionBy())
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.bround(k * (F.col("total") - 1) / F.lit(max(n - 1, 1))).cast("long"))
    return index.withColumn("total", total).where(F.array_contains(places, F.col("i").cast("long"))).select("date")


def cross_sections(df: DataFrame, target: str, limit: int, most_dates: int, seed: int) -> DataFrame:
    """A budget of limit / dates rows on evenly spaced dates, both classes alike where possible, the rest filled by hash order."""
    chosen = evenly_spaced_dates(df, most_dates)
    rows = df.join(F.broadcast(chosen), "date", "left_semi")
    budget = max(limit // most_dates, 1)
    by = Window.partitionBy("date", target).orderBy(hash_key(F.lit(seed), "symbol", "date"), "symbol")
    rows = rows.withColumn("_c", F.row_number().over(by))
    fill = Window.partitionBy("date").orderBy((F.col("_c") > budget // 2).cast("int"), hash_key(F.lit(seed), "symbol", "date"), "symbol")
    return rows.withColumn("_n", F.row_number().over(fill)).where(F.col("_n") <= budget).drop("_c", "_n")


def candidates(assets: DataFrame, exchanges: Sequence[str], n: int, benchmark: str) -> DataFrame:
    """Of the latest snapshot, n tradable symbols on the exchanges by SHA-256 of the symbol, and the benchmark."""
    last = assets.agg(F.max("effective_date").alias("effective_date"))
    pool = assets.join(F.broadcast(last), "effective_date").where(F.col("tradable") & F.col("exchange").isin(list(exchanges)))
    chosen = pool.select("symbol").distinct().orderBy(F.sha2("symbol", 256), "symbol").limit(n)
    return chosen.unionByName(assets.sparkSession.createDataFrame([(benchmark,)], "symbol string")).distinct()


def with_legacy(symbols: DataFrame, legacy: DataFrame) -> DataFrame:
    """Symbols of the latest pool and of the legacy list, each once; null and blank ones are left out."""
    return symbols.select("symbol").unionByName(legacy.select("symbol")).where("trim(symbol) <> ''").distinct()


def latest_signals(scored: DataFrame, benchmark: str | None = None) -> DataFrame:
    """The last date's rows per model, ranked by score, the benchmark flagged."""
    last = scored.groupBy("model").agg(F.max("date").alias("date"))
    rows = scored.join(F.broadcast(last), ["model", "date"])
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.col("y_score").desc(), "symbol"))
    return rows.withColumns({"rank": place, "is_benchmark": F.col("symbol") == F.lit(benchmark)})


def top_bottom(signals: DataFrame, n: int) -> DataFrame:
    rows = signals.where(~F.coalesce("is_benchmark", F.lit(False)))
    by = Window.partitionBy("model")
    out = rows.withColumns({"_t": F.row_number().over(by.orderBy("rank")), "_b": F.row_number().over(by.orderBy(F.col("rank").desc()))})
    side = F.when(F.col("_t") <= n, "top").when(F.col("_b") <= n, "bottom")
    return out.withColumn("side", side).where("side IS NOT NULL").drop("_t", "_b")


def best_trial(trials: DataFrame, keys: Sequence[str], group: Sequence[str]) -> DataFrame:
    """The first configuration of each group by descending keys, then by name."""
    by = Window.partitionBy(*group).orderBy(*[F.col(k).desc() for k in keys], "trial")
    return trials.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def sample_manifest(sample: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """Per group: rows, positive rate, symbols, dates, and a digest of its keys: the sum of their hashes, whatever the order."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "symbol", "date")), 1, 8), 16, 10).cast("long")
    return sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(target).cast("double")).alias("positive_rate"), F.countDistinct("symbol").alias("n_symbols"), F.countDistinct("date").alias("n_dates"), F.sum(h).alias("key_digest"))


def role_seed(seed: int) -> Column:
    """A seed for each split and role: seed + 1,000 a split, + 10,000 for other roles than train."""
    return F.lit(seed) + F.col("split_id") * 1000 + F.when(F.col("role") == "train", 0).otherwise(10_000)


def sample_roles(df: DataFrame, target: str, seed: int, n_symbols: int | None = None, n_dates: int | None = None, caps: dict[str, int] | None = None, balanced: bool = True) -> DataFrame:
    """Symbols, then dates, then balanced classes, then a cap on rows, each split and role with a seed of its own.

    Classes are balanced where the group's targets are exactly 0 and 1: as many rows of each as of the rarer
    one, and half the cap at most; other groups are sampled whole. Roles that caps doesn't name have train's.
    """
    caps = caps or {}
    if any(c < 2 for c in caps.values()):
        raise ValueError("a cap is two rows at least")
    keys, own = ["split_id", "role"], role_seed(seed)
    rows = df if n_symbols is None else df.join(df.select("symbol").distinct().orderBy(hash_key(F.lit(seed), "symbol"), "symbol").limit(n_symbols), "symbol", "left_semi")
    if n_dates is not None:
        drawn = Window.partitionBy(*keys).orderBy(hash_key(own, "date"), "date")
        days = rows.select(*keys, "date").distinct().withColumn("_n", F.row_number().over(drawn)).where(F.col("_n") <= n_dates).drop("_n")
        rows = rows.join(days, [*keys, "date"], "left_semi")
    known = F.col(target).isNotNull()
    ones, noughts = (F.count_if(F.col(target) == c) for c in (1, 0))
    groups = rows.groupBy(*keys).agg(F.least(ones, noughts).alias("_class"), (F.lit(balanced) & (ones > 0) & (noughts > 0) & (F.count_if(known) == ones + noughts)).alias("_even"))
    cap = F.coalesce(*[F.when(F.col("role") == r, c) for r, c in caps.items()], F.lit(caps.get("train")).cast("int"), F.lit((1 << 31) - 1))
    groups = groups.withColumn("_cap", cap.cast("long"))
    order = [hash_key(own, "symbol", "date"), F.col("symbol"), F.col("date")]
    ranked = rows.withColumns({"_in_class": F.row_number().over(Window.partitionBy(*keys, target).orderBy(*order)), "_in_group": F.row_number().over(Window.partitionBy(*keys).orderBy(*order))}).join(groups, keys)
    per_class = F.least("_class", F.floor(F.col("_cap") / 2))
    kept = F.when(F.col("_even"), known & (F.col("_in_class") <= per_class)).otherwise(F.col("_in_group") <= F.col("_cap"))
    return ranked.where(kept).select(*df.columns)


def sample_cross_sections(df: DataFrame, target: str, limit: int, most_dates: int, seed: int) -> DataFrame:
    """`limit` rows of each split and role on evenly spaced dates, so that rows of a date can be compared.

    The budget of a date is limit / dates, one more for the first dates as the remainder has it. A date takes
    as many rows of each class, then fills its budget with its other rows. A group with as many dates as half
    its limit (or its rows) takes limit / classes rows of each class from all dates. Orders are by hash.
    """
    keys, own = ["split_id", "role"], F.lit(seed) + F.col("split_id") * 100
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.countDistinct("date").alias("_dates"), F.countDistinct(target).alias("_classes"))
    wide = F.col("_dates") >= F.least(F.lit(limit), F.col("_rows")) / 2
    sizes = sizes.withColumns({"_wide": wide, "_wanted": F.least(F.lit(most_dates), "_dates", F.lit(max(1, limit // 4)))})
    by_date = Window.partitionBy(*keys).orderBy("date")
    days = df.select(*keys, "date").distinct().withColumn("_i", F.row_number().over(by_date) - 1).join(sizes, keys).where(~F.col("_wide"))  # a row a group and date
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("_wanted") - 1), lambda k: F.bround(k * (F.col("_dates") - 1) / F.greatest(F.col("_wanted") - 1, F.lit(1))).cast("long")))
    chosen = days.withColumn("_at", F.array_position(places, F.col("_i").cast("long"))).where("_at > 0").withColumn("_m", F.size(places))
    chosen = chosen.select(*keys, "date", (F.floor(F.lit(limit) / F.col("_m")) + (F.col("_at") <= F.lit(limit) % F.col("_m")).cast("int")).alias("_budget"))
    order = [hash_key(own, "symbol", "date"), F.col("symbol")]
    dated = df.join(chosen, [*keys, "date"])
    dated = dated.join(dated.groupBy(*keys, "date").agg(F.greatest(F.countDistinct(target), F.lit(1)).alias("_k")), [*keys, "date"])
    each = F.greatest(F.lit(1), F.floor(F.col("_budget") / F.col("_k")))
    dated = dated.withColumn("_first", F.row_number().over(Window.partitionBy(*keys, "date", target).orderBy(*order)) <= each)
    place = F.row_number().over(Window.partitionBy(*keys, "date").orderBy(F.col("_first").desc(), *order))
    dated = dated.withColumn("_n", place).where(F.col("_first") | (F.col("_n") <= F.col("_budget"))).select(*df.columns)
    rest = df.join(sizes.where("_wide").select(*keys, "_classes"), keys)
    rest = rest.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, target).orderBy(*order, "date"))).where(F.col("_n") <= F.floor(F.lit(limit) / F.greatest("_classes", F.lit(1))))
    return dated.unionByName(rest.select(*df.columns))
