"""Accounting values of each filing, their growth and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The concepts that become columns, those that grow, and the ratios as (numerator terms, denominator).
CONCEPTS = (
    "revenue", "net_income", "assets", "liabilities", "stockholders_equity", "operating_income", "operating_cash_flow", "capital_expenditure", "cash",
    "current_assets", "current_liabilities", "debt", "gross_profit", "interest_expense", "research_and_development", "stock_based_compensation", "shares_outstanding",
)
GROWING = ("revenue", "net_income", "operating_income", "operating_cash_flow", "assets", "debt", "shares_outstanding")
RATIOS = {
    "net_income_margin": ("net_income", None, "revenue"),
    "liability_ratio": ("liabilities", None, "assets"),
    "equity_ratio": ("stockholders_equity", None, "assets"),
    "gross_margin": ("gross_profit", None, "revenue"),
    "operating_margin": ("operating_income", None, "revenue"),
    "free_cash_flow_margin": ("operating_cash_flow", "capital_expenditure", "revenue"),
    "cash_flow_quality": ("operating_cash_flow", None, "net_income"),
    "accrual_ratio": ("net_income", "operating_cash_flow", "assets"),
    "current_ratio": ("current_assets", None, "current_liabilities"),
    "debt_ratio": ("debt", None, "assets"),
    "research_and_development_intensity": ("research_and_development", None, "revenue"),
    "stock_based_compensation_intensity": ("stock_based_compensation", None, "revenue"),
}
FILING = ("symbol", "cik", "cik_padded", "fiscal_year", "fiscal_period", "filing_date", "form", "end_date", "accession_number")


def filing_fundamentals(facts: DataFrame) -> DataFrame:
    """A row a filing and period: fundamental_<concept> for all concepts, <concept>_growth and the ratios.

    facts: the filing's columns, concept, value. Facts of other concepts, without a value or with a null among
    the filing's columns are left out; of repeated facts the largest counts. A concept grows over the last filing of
    the symbol and fiscal period that has it. Over zero there is no growth and no ratio.
    """
    own = facts.withColumns({"symbol": F.upper("symbol"), "value": F.col("value").try_cast("double")}).where(F.col("concept").isin(list(CONCEPTS)) & F.col("value").isNotNull() & ~F.isnan("value"))
    for c in FILING:
        own = own.where(F.col(c).isNotNull())
    wide = own.groupBy(*FILING).pivot("concept", list(CONCEPTS)).agg(F.max("value"))
    wide = wide.select(*FILING, *[F.col(c).alias(f"fundamental_{c}") for c in CONCEPTS])
    before = Window.partitionBy("symbol", "fiscal_period").orderBy("filing_date", "end_date", "accession_number").rowsBetween(Window.unboundedPreceding, -1)

    def growth(c: str) -> Column:
        x = F.col(f"fundamental_{c}")
        return F.try_divide(x, F.last(x, ignorenulls=True).over(before)) - 1

    def ratio(over: str, less: str | None, under: str) -> Column:
        top = F.col(f"fundamental_{over}") - F.col(f"fundamental_{less}") if less else F.col(f"fundamental_{over}")
        return F.try_divide(top, F.col(f"fundamental_{under}"))

    return wide.select("*", *[growth(c).alias(f"{c}_growth") for c in GROWING], *[ratio(*r).alias(name) for name, r in RATIOS.items()])
