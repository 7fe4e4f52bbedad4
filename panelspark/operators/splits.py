"""Chronological splits, folds and preprocessing fitted on training rows only. Date tables are small: a row a date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.expr import finite
from panelspark.functions.quantiles import quantiles


def date_index(df: DataFrame) -> DataFrame:
    """Distinct dates, numbered from 0."""
    return df.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)


def walk_forward(df: DataFrame, train: int, validation: int, step: int, purge: int) -> DataFrame:
    """Fixed windows of dates: train, a gap of `purge` dates, validation; moved by `step`."""
    dates = date_index(df)
    last = F.max("i").over(Window.partitionBy())
    starts = dates.withColumn("n", last + 1).where((F.col("i") % step == 0) & (F.col("i") + train + purge + validation <= F.col("n"))).select(F.col("i").alias("s"))
    starts = starts.withColumn("split_id", F.row_number().over(Window.orderBy("s")) - 1)

    def at(name: str, offset: int):
        return F.max(F.when(F.col("i") == F.col("s") + offset, F.col("date"))).alias(name)

    wanted = [("train_start", 0), ("train_end", train - 1), ("validation_start", train + purge), ("validation_end", train + purge + validation - 1)]
    joined = starts.crossJoin(F.broadcast(dates)).where(sum(((F.col("i") == F.col("s") + o).cast("int") for _, o in wanted), F.lit(0)) > 0)
    return joined.groupBy("split_id").agg(*[at(n, o) for n, o in wanted]).withColumns({"train_days": F.lit(train), "validation_days": F.lit(validation), "purge_days": F.lit(purge)})


def yearly(df: DataFrame, purge: int = 0) -> DataFrame:
    """Each calendar year after the first validates what was learnt on all dates before it, less `purge` dates."""
    dates = date_index(df).withColumn("year", F.year("date"))
    years = dates.groupBy("year").agg(F.min("i").alias("first"), F.min("date").alias("validation_start"), F.max("date").alias("validation_end"), F.count(F.lit(1)).alias("validation_days"))
    begin = dates.agg(F.min("date").alias("train_start"))
    ends = dates.select(F.col("i").alias("j"), F.col("date").alias("train_end"))
    out = years.where(F.col("first") - purge > 0).join(F.broadcast(ends), F.col("j") == F.col("first") - 1 - purge).crossJoin(begin)
    return out.select((F.row_number().over(Window.orderBy("year")) - 1).alias("split_id"), "train_start", "train_end", "validation_start", "validation_end", F.col("validation_days"))


def locked_test(df: DataFrame, n: int, embargo: int) -> DataFrame:
    """Rows with a role: the last n dates locked, `embargo` dates before them dropped, the rest development."""
    back = F.dense_rank().over(Window.orderBy(F.col("date").desc()))
    dates = df.select("date").distinct().withColumn("_back", back)
    dates = dates.where(~F.col("_back").between(n + 1, n + embargo)).select("date", F.when(F.col("_back") <= n, "locked").otherwise("development").alias("role"))
    return df.join(F.broadcast(dates), "date")


def near_equal_block(i, n, k):
    """The block (from 0) of item i of n in k near-equal blocks, the longer ones first."""
    size, longer = F.floor(n / k), n % k
    edge = longer * (size + 1)
    return F.when(i < edge, F.floor(i / (size + 1))).otherwise(longer + F.floor((i - edge) / F.greatest(size, F.lit(1)))).cast("long")


def inner_folds(df: DataFrame, k: int, purge: int, target: str) -> DataFrame:
    """The later half of the dates in k near-equal blocks; each block validates, dates before it less `purge` train.

    Folds without both classes in both roles are left out.
    """
    dates = date_index(df).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    late = dates.where(F.col("i") >= F.floor(F.col("n") / 2)).withColumn("fold", near_equal_block(F.col("i") - F.floor(F.col("n") / 2), F.col("n") - F.floor(F.col("n") / 2), F.lit(k)))
    folds = late.groupBy("fold").agg(F.min("i").alias("low"), F.max("i").alias("high"))
    rows = df.join(F.broadcast(dates.select("date", "i")), "date").join(F.broadcast(folds), (F.col("i") <= F.col("high")) & ((F.col("i") >= F.col("low")) | (F.col("i") < F.col("low") - purge)))
    rows = rows.withColumn("role", F.when(F.col("i") >= F.col("low"), "validation").otherwise("train"))
    fine = rows.groupBy("fold", "role").agg(F.countDistinct(target).alias("c"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("date").alias("n_dates"))
    good = fine.groupBy("fold").agg((F.count_if(F.col("c") == 2) == 2).alias("g")).where("g").select("fold")
    return fine.join(good, "fold").select("fold", "role", "n_rows", "n_dates")


def inner_tail(df: DataFrame, fraction: float = 0.2) -> DataFrame:
    """Adds is_tail: whether the row's date is in the last `fraction` of dates."""
    dates = date_index(df).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    cut = F.col("n") - F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(fraction)))
    return df.join(F.broadcast(dates.select("date", (F.col("i") >= cut).alias("is_tail"))), "date")


def fit_preprocessor(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per split and feature: median (nothing there: 0), then mean and population sd of the imputed values (0 or null: 1).

    Values that aren't finite count as missing. Medians are exact, by ranges of values: a split may be the whole table.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), finite(c).alias("value")) for c in columns])).alias("x")
    long = train.select("split_id", each).select("split_id", "x.*")
    medians = quantiles(long, ["split_id", "feature"], "value", [0.5]).select(F.col("split_id").alias("_s"), F.col("feature").alias("_f"), F.get("quantiles", F.lit(0)).alias("_median"))
    # moments of what is there and counts; imputed moments follow in closed form
    s = long.groupBy("split_id", "feature").agg(F.count("value").alias("k"), F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("m"), F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("v"))
    s = s.join(medians, F.col("split_id").eqNullSafe(F.col("_s")) & (F.col("feature") == F.col("_f")), "left").withColumn("median", F.coalesce("_median", F.lit(0.0)))
    share = F.col("k") / F.col("n")
    mean = share * F.col("m") + (1 - share) * F.col("median")
    var = share * (F.col("v") + F.pow(F.col("m") - F.col("mean"), 2)) + (1 - share) * F.pow(F.col("median") - F.col("mean"), 2)
    out = s.withColumn("mean", mean).withColumn("sd", F.sqrt(F.greatest(var, F.lit(0.0))))
    return out.select("split_id", "feature", "median", "mean", F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0).alias("sd"))


def transform(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Imputes and scales with each split's own statistics (a row a split after the pivot)."""
    wide = fitted.groupBy("split_id").pivot("feature", list(columns)).agg(F.first("median").alias("median"), F.first("mean").alias("mean"), F.first("sd").alias("sd"))
    out = df.join(F.broadcast(wide), "split_id")
    out = out.withColumns({c: (F.coalesce(finite(c), F.col(f"{c}_median")) - F.col(f"{c}_mean")) / F.col(f"{c}_sd") for c in columns})
    return out.drop(*[f"{c}_{k}" for c in columns for k in ("median", "mean", "sd")])
