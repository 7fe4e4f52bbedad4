"""Column helpers that fix the semantics of windows, ranks and draws once for all operators.

A rolling value needs as many non-null rows as asked for; x / 0 is null; ranks of ties are averaged
and ignore nulls; draws come from a hash, so they repeat on any cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def series(keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("date",)) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def rolling(agg: Callable[..., Column], x: Column | str, w: int, least: int | None = None, by: WindowSpec | None = None, last: int = 0) -> Column:
    """agg of the w rows that end `last` rows before this one, if at least `least` (w) of them aren't null."""
    frame = (by or series()).rowsBetween(-(w - 1) + last, last)
    return F.when(F.count(col(x)).over(frame) >= (w if least is None else least), agg(col(x)).over(frame))


def rolling_pair(agg: Callable[..., Column], x: Column | str, y: Column | str, w: int, least: int | None = None, by: WindowSpec | None = None) -> Column:
    """agg(x, y) over complete pairs of the last w rows."""
    frame = (by or series()).rowsBetween(-(w - 1), 0)
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    return F.when(F.count(a).over(frame) >= (w if least is None else least), agg(a, b).over(frame))


def rolling_corr(x: Column | str, y: Column | str, w: int, by: WindowSpec | None = None) -> Column:
    """Correlation over w complete pairs; null where one of them doesn't vary."""
    frame = (by or series()).rowsBetween(-(w - 1), 0)
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    sa, sb = F.stddev_pop(a).over(frame), F.stddev_pop(b).over(frame)
    # not corr(): it divides by the spreads before any guard, and fails on a constant under ANSI rules
    return F.when((F.count(a).over(frame) >= w) & (sa > 1e-12) & (sb > 1e-12), F.try_divide(F.covar_pop(a, b).over(frame), sa * sb))


def change(x: Column | str, w: int, by: WindowSpec | None = None) -> Column:
    """x over its value w rows before, less 1; never filled."""
    return F.try_divide(col(x), F.lag(col(x), w).over(by or series())) - 1


def average_rank(x: Column | str, keys: Sequence[Column | str], descending: bool = False) -> Column:
    """Rank from 1 with ties averaged, among non-null values of a group; null where x is."""
    x = col(x)
    parts = [*(col(k) for k in keys), x.isNotNull()]
    order = Window.partitionBy(*parts).orderBy(x.desc() if descending else x)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*parts, x))
    return F.when(x.isNotNull(), F.rank().over(order) + (ties - 1) / 2.0)


def percent_rank(x: Column | str, keys: Sequence[Column | str]) -> Column:
    """average_rank over the number of non-null values."""
    x = col(x)
    parts = [*(col(k) for k in keys), x.isNotNull()]
    return F.when(x.isNotNull(), average_rank(x, keys) / F.count(F.lit(1)).over(Window.partitionBy(*parts)))


def safe_corr(x: Column | str, y: Column | str, least: int = 2) -> Column:
    """Aggregate: correlation of complete pairs, clipped to [-1, 1]; null with too few pairs or no variance."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x).cast("double")), F.when(both, col(y).cast("double"))
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    fine = (F.count(a) >= least) & (sa > 1e-12) & (sb > 1e-12)
    return F.when(fine, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.covar_pop(a, b), sa * sb))))


def hash_draw(n: Column | int, *parts: Column | str | int) -> Column:
    """An integer from 0 to n - 1, from the first 32 bits of an MD5 over the parts."""
    text = F.concat_ws("|", *[(F.lit(p) if isinstance(p, int) else col(p)).cast("string") for p in parts])
    value = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return value % (F.lit(n) if isinstance(n, int) else n)


def finite(x: Column | str) -> Column:
    x = col(x).cast("double")
    return F.when(~(F.isnan(x) | (F.abs(x) == float("inf"))), x)


def business_day_after(d: Column | str) -> Column:
    """The next Monday to Friday after a date."""
    d = col(d)
    return F.date_add(d, F.when(F.dayofweek(d) == 6, 3).when(F.dayofweek(d) == 7, 2).otherwise(1))
