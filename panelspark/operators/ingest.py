"""Semi-structured payloads to tidy rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.expr import business_day_after

BARS = "struct<bars: map<string, array<struct<t: string, o: double, h: double, l: double, c: double, v: bigint, n: bigint, vw: double>>>>"
#: Marks of a missing number.
MISSING_MARKS = ("", "-", "ND", "N/A", "NA", ".")


def bar_pages(pages: DataFrame, column: str = "payload") -> DataFrame:
    """{bars: {SYMBOL: [{t, o, h, l, c, v, n, vw}]}} to a row a bar."""
    by_symbol = pages.select(F.explode(F.from_json(column, BARS)["bars"]).alias("symbol", "bars"))
    rows = by_symbol.select(F.upper(F.trim("symbol")).alias("symbol"), F.explode("bars").alias("b"))
    time = F.try_to_timestamp(F.col("b.t"))
    return rows.select("symbol", time.alias("timestamp"), F.to_date(time).alias("date"), F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"), F.col("b.c").alias("close"), F.col("b.v").alias("volume"), F.col("b.n").alias("trade_count"), F.col("b.vw").alias("vwap"))


def safe_numeric(x: Column) -> Column:
    text = F.trim(x.cast("string"))
    return F.when(~F.upper(text).isin(*MISSING_MARKS), text.try_cast("double"))


def format_cik(x: Column) -> Column:
    return F.lpad(x.cast("string").try_cast("bigint").cast("string"), 10, "0")


def ticker(x: Column) -> Column:
    return F.nullif(F.upper(F.trim(x)), F.lit(""))


def classify_security(name: Column, rules: Sequence[tuple[str, str]], default: str = "common") -> Column:
    """The type of the first keyword in the lower-case name."""
    low = F.lower(name)
    out = F.lit(default)
    for word, kind in reversed(rules):
        out = F.when(low.contains(word), kind).otherwise(out)
    return F.when(name.isNull(), F.lit(default)).otherwise(out)


def asset_snapshot(assets: DataFrame, day: Column, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """An effective-dated snapshot: blank symbols dropped, the first row of a symbol by name."""
    rows = assets.withColumn("symbol", ticker(F.col("symbol"))).where("symbol IS NOT NULL").withColumns({"effective_date": day, "security_type": classify_security(F.col("name"), rules)})
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("symbol", "effective_date").orderBy("name"))).where("_n = 1").drop("_n")


def submissions(docs: DataFrame, forms: Sequence[str]) -> DataFrame:
    """Parallel arrays (form, filing_date, accession) to a row a filing; shorter arrays give nulls; kept forms only."""
    zipped = docs.select("symbol", F.explode_outer(F.arrays_zip("form", "filing_date", "accession")).alias("x"))
    rows = zipped.select("symbol", "x.*").where(F.col("form").isin(list(forms)))
    return rows.withColumn("earliest_tradable_date", business_day_after("filing_date"))


def facts(docs: DataFrame, alias: DataFrame) -> DataFrame:
    """{concept: {unit: [observation]}} to long rows under the alias table's names; null values dropped. alias: a row a concept."""
    by_concept = docs.select("symbol", F.explode("facts").alias("sec_concept", "units"))
    by_unit = by_concept.join(F.broadcast(alias), "sec_concept").select("symbol", "concept", "sec_concept", F.explode("units").alias("unit", "observations"))
    return by_unit.select("symbol", "concept", "sec_concept", "unit", F.inline("observations")).where("value IS NOT NULL")


def resolve_collisions(rows: DataFrame, unit_order: Sequence[str], flows: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One fact per (symbol, accession, concept, end_date): by unit, shortest duration of flows, concept name; the rest with a reason."""
    bad = rows.where(F.col("start_date") > F.col("end_date")).withColumn("reason", F.lit("impossible_period"))
    good = rows.where(F.coalesce(F.col("start_date") <= F.col("end_date"), F.lit(True)))
    unit = F.coalesce(*[F.when(F.col("unit") == u, i) for i, u in enumerate(unit_order)], F.lit(len(unit_order)))
    period = F.when(F.col("concept").isin(list(flows)), F.coalesce(F.datediff("end_date", "start_date"), F.lit(1 << 20))).otherwise(0)
    by = Window.partitionBy("symbol", "accession", "concept", "end_date").orderBy(unit, period, "sec_concept", "value")
    ranked = good.withColumn("_n", F.row_number().over(by))
    lost = ranked.where("_n > 1").drop("_n").withColumn("reason", F.lit("collision"))
    return ranked.where("_n = 1").drop("_n"), lost.unionByName(bad)


def monthly_series(rows: DataFrame) -> DataFrame:
    """(series, year, period, value) with periods M01 to M12 to first-of-month dates; missing marks are null."""
    kept = rows.where(F.col("period").rlike("^M(0[1-9]|1[0-2])$"))
    return kept.select("series", F.make_date(F.col("year").cast("int"), F.substring("period", 2, 2).cast("int"), F.lit(1)).alias("date"), safe_numeric(F.col("value")).alias("value"))


def macro_wide(rows: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Long to wide: the last value of each date and series by retrieved_at; all expected columns, nothing filled."""
    return rows.groupBy("date").pivot("series", list(expected)).agg(F.max_by("value", "retrieved_at"))


def company_tickers(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """ticker, cik, cik_padded, title from JSON objects or arrays of {ticker, cik_str, title}; the first record of a ticker counts.

    Records without a ticker or a number as cik are left out; a null title is empty.
    """
    record = "struct<ticker:string,cik_str:string,title:string>"
    text = F.col(payload)
    records = F.when(F.ltrim(text).startswith("["), F.from_json(text, f"array<{record}>")).otherwise(F.map_values(F.from_json(text, f"map<string,{record}>")))
    rows = docs.select(F.posexplode(records).alias("_place", "r"))
    rows = rows.select("_place", ticker(F.col("r.ticker")).alias("ticker"), F.trim("r.cik_str").try_cast("bigint").alias("cik"), F.coalesce(F.trim("r.title"), F.lit("")).alias("title")).where("ticker IS NOT NULL AND cik IS NOT NULL")
    first = rows.groupBy("ticker").agg(F.min(F.struct("_place", "cik", "title")).alias("x"))
    return first.select("ticker", "x.cik", format_cik(F.col("x.cik")).alias("cik_padded"), "x.title")


def lookup(symbols: DataFrame, table: DataFrame, strict: bool = False) -> DataFrame:
    """symbol -> cik; strict raises on a symbol that the table lacks."""
    wanted = symbols.select(ticker(F.col("symbol")).alias("symbol")).distinct()
    if strict:
        lost = wanted.join(table, "symbol", "left_anti").limit(5).collect()
        if lost:
            raise ValueError(f"no cik for {[r['symbol'] for r in lost]}")
    return wanted.join(table.select("symbol", "cik"), "symbol", "left").withColumn("cik_padded", format_cik(F.col("cik")))


def with_provenance(df: DataFrame) -> DataFrame:
    return df.withColumn("ingested_at_utc", F.current_timestamp())
