"""Targets net of same-date exposures: a regression for each date, by sums of products alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.expr import finite

#: Levels of a category that one regression can have, as a pivot has.
MOST_LEVELS = 500
#: A column whose remaining variance is below this share of its own depends on the columns before it.
TOLERANCE = 1e-10


def join_exposures(labels: DataFrame, exposures: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """labels with the exposures of their keys, null where there are none. Of several rows of a key the smallest counts, so labels never multiply."""
    named = F.struct(*columns)
    own = exposures.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.min(named).alias("_x"))
    return labels.join(own, list(keys), "left").select(*[labels[c] for c in labels.columns if c not in columns], *[F.col(f"_x.{c}").alias(c) for c in columns])


def _level(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("unknown"))


def _solved(width: int, rows: Column) -> Column:
    """The coefficients of normal equations given as rows (one more number than columns each).

    Gauss and Jordan's elimination in order of columns; one whose pivot has vanished depends on those before
    it (a full set of indicators beside an intercept does) and gets no weight, which leaves residuals as they are.
    """

    def step(state: Column, j: Column) -> Column:
        pivot = F.get(F.get(state["rows"], j), j)
        gone = pivot <= F.get(state["own"], j) * TOLERANCE
        own = F.transform(F.get(state["rows"], j), lambda x: F.when(gone, 0.0).otherwise(F.try_divide(x, pivot)))
        swept = F.transform(F.array(own), lambda p: F.transform(state["rows"], lambda r, i: F.when(i == j, p).when(gone, r).otherwise(F.zip_with(r, p, lambda a, b: a - F.get(r, j) * b))))
        return F.struct(F.get(swept, F.lit(0)).alias("rows"), state["own"].alias("own"))

    start = F.struct(rows.alias("rows"), F.transform(rows, lambda r, i: F.get(r, i)).alias("own"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(width - 1)), start, step, lambda s: F.transform(s["rows"], lambda r: F.get(r, F.lit(width))))


def residualize(labels: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str, least: int = 20, out: str = "residual_target") -> DataFrame:
    """symbol, date, `out`: per date, the residual of the target on an intercept, numbers and categories (null is "unknown").

    A row with a missing or non-finite number or target has null, and so has a date with fewer complete rows
    than `least` or than numbers + levels on that date + 2. Numbers are scaled within the date, which changes
    no residual. All is sums by date, combined before their shuffle: a date's rows never meet in one task.
    """
    levels = {}
    for c in categorical:
        found = [r[0] for r in labels.select(_level(c).alias("l")).distinct().limit(MOST_LEVELS + 1).collect()]
        if len(found) > MOST_LEVELS:
            raise ValueError(f"{c} has more than {MOST_LEVELS} levels")
        levels[c] = sorted(found)
    xs, cs = [f"_x{i}" for i in range(len(numeric))], [f"_c{i}" for i in range(len(categorical))]
    rows = labels.select("symbol", "date", finite(target).alias("_y"), *[finite(c).alias(x) for c, x in zip(numeric, xs)], *[_level(c).alias(k) for c, k in zip(categorical, cs)])
    whole = F.lit(True)
    for c in ("_y", *xs):
        whole &= F.col(c).isNotNull()
    moments = [m for x in xs for m in (F.avg(F.when(whole, F.col(x))).alias(f"{x}_m"), F.stddev_pop(F.when(whole, F.col(x))).alias(f"{x}_s"))]
    days = rows.groupBy("date").agg(F.count_if(whole).alias("_n"), F.avg(F.when(whole, F.col("_y"))).alias("_y_m"), *[F.countDistinct(k).alias(f"{k}_n") for k in cs], *moments)
    width_of_day = sum((F.col(f"{k}_n") for k in cs), F.lit(len(xs)))
    days = days.where(F.col("_n") >= F.greatest(F.lit(least), width_of_day + 2)).withColumnRenamed("date", "_date")
    scaled = rows.join(days, F.col("date").eqNullSafe(F.col("_date"))).where(whole)
    scaled = scaled.withColumns({x: F.coalesce(F.try_divide(F.col(x) - F.col(f"{x}_m"), F.col(f"{x}_s")), F.lit(0.0)) for x in xs} | {"_y": F.col("_y") - F.col("_y_m")})
    scaled = scaled.select("symbol", "date", "_y", *xs, *cs)
    terms: list[tuple[str, Column]] = [("", F.lit(1.0)), *(("", F.col(x)) for x in xs)]
    terms += [(k, (F.col(k) == level).cast("double")) for k, c in zip(cs, categorical) for level in levels[c]]
    n, sums = len(terms), {}
    for i in range(n):
        for j in range(i, n):
            if i == j or not terms[i][0] or terms[i][0] != terms[j][0]:  # two levels of a category never meet
                sums[i, j] = F.sum(terms[i][1] * terms[j][1]).alias(f"_g{i}_{j}")
        sums[i, n] = F.sum(terms[i][1] * F.col("_y")).alias(f"_g{i}_{n}")
    grams = scaled.groupBy("date").agg(*sums.values())
    cell = lambda i, j: F.col(f"_g{i}_{j}") if (i, j) in sums else F.lit(0.0)
    matrix = F.array(*[F.array(*[cell(min(i, j), max(i, j)) for j in range(n)], cell(i, n)) for i in range(n)])
    fitted = grams.select(F.col("date").alias("_date"), _solved(n, matrix).alias("_b"))
    known = scaled.join(fitted, F.col("date").eqNullSafe(F.col("_date")))
    explained = sum((F.get("_b", F.lit(i)) * t for i, (_, t) in enumerate(terms)), F.lit(0.0))
    found = known.select(F.col("symbol").alias("_symbol"), "_date", (F.col("_y") - explained).alias(out))
    return labels.select("symbol", "date").join(found, F.col("symbol").eqNullSafe(F.col("_symbol")) & F.col("date").eqNullSafe(F.col("_date")), "left").select("symbol", "date", out)
