"""Contracts of tables: required columns, unique keys, normalised keys, feature columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.expr import finite

KEYS = ("symbol", "date")


def require(df: DataFrame, columns: Iterable[str], name: str = "table") -> DataFrame:
    """Refuses a table that lacks columns; runs no job."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks columns: {', '.join(missing)}")
    return df


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str], name: str = "table") -> DataFrame:
    found = repeated_keys(df, keys).limit(5).collect()
    if found:
        raise ValueError(f"{name} repeats keys, such as {[tuple(r[k] for k in keys) for r in found]}")
    return df


def normalize_panel(df: DataFrame, numeric: Sequence[str] = ()) -> DataFrame:
    """Upper-case symbols, dates without time, numbers or null."""
    require(df, KEYS)
    text = F.upper(F.trim(F.col("symbol").cast("string")))
    out = {"symbol": text, "date": F.col("date") if isinstance(df.schema["date"].dataType, T.DateType) else F.to_date(F.try_to_timestamp(F.col("date").cast("string")))}
    out |= {c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in numeric}
    return df.withColumns(out)


def feature_columns(df: DataFrame, excluded: Sequence[str] = KEYS, markers: Sequence[str] = ("forward_", "outperform", "target", "label")) -> list[str]:
    """Numeric or boolean columns that are neither keys nor labels."""
    kinds = (T.NumericType, T.BooleanType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name not in excluded and not any(m in f.name for m in markers)]


def refuse_labels(df: DataFrame, markers: Sequence[str] = ("forward_", "outperform")) -> DataFrame:
    found = [c for c in df.columns if any(m in c for m in markers)]
    if found:
        raise ValueError(f"label columns among features: {', '.join(found)}")
    return df


def filter_dates(df: DataFrame, start: str | None = None, end: str | None = None, column: str = "date") -> DataFrame:
    """Both ends inclusive; reaches the Parquet scan."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col(column) <= F.lit(end).cast("date"))


def filter_missing(df: DataFrame, columns: Sequence[str], fraction: float) -> DataFrame:
    """Rows with at most int(k * fraction) nulls among k columns."""
    nulls = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return df.where(nulls <= int(len(columns) * fraction))


def clean_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite(c) for c in columns})


def safe_projection(df: DataFrame, allowed: Sequence[str], digits: int = 6) -> DataFrame:
    """Only listed columns, doubles rounded."""
    return df.select(*[F.round(c, digits).alias(c) if isinstance(df.schema[c].dataType, T.DoubleType) else F.col(c) for c in allowed if c in df.columns])


def feature_family(name: str, families: Sequence[tuple[str, str]]) -> str:
    """The family of the first prefix that fits, else "other"."""
    return next((family for prefix, family in families if name.startswith(prefix)), "other")
