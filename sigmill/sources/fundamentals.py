"""Quarterly statements: line items by label, and their as-of join into a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmill.functions.fields import RAW_FUNDAMENTALS

from .panel import number, table

LAG_DAYS = 90

# Labels under which statements name each field, the preferred first.
LINE_ITEMS = {
    "revenue": ["Total Revenue", "Operating Revenue"],
    "gross_profit": ["Gross Profit"],
    "operating_income": ["Operating Income", "EBIT"],
    "net_income": ["Net Income", "Net Income Common Stockholders"],
    "ebitda": ["EBITDA", "Normalized EBITDA"],
    "eps": ["Diluted EPS", "Basic EPS"],
    "total_assets": ["Total Assets"],
    "total_debt": ["Total Debt"],
    "total_equity": ["Stockholders Equity", "Common Stock Equity"],
    "cash": ["Cash And Cash Equivalents"],
    "current_assets": ["Current Assets"],
    "current_liabilities": ["Current Liabilities"],
    "operating_cash_flow": ["Operating Cash Flow"],
    "capex": ["Capital Expenditure"],
    "free_cash_flow": ["Free Cash Flow"],
    "dividends_paid": ["Cash Dividends Paid", "Common Stock Dividend Paid"],
}


def reports(items: DataFrame) -> DataFrame:
    """(ticker, report_date, fields) from long statements (ticker, report_date, item, value). free_cash_flow, where absent, is operating cash flow plus capex."""
    value = {name: F.coalesce(*[F.max(F.when(F.col("item") == label, number(F.col("value")))) for label in labels]) for name, labels in LINE_ITEMS.items()}
    out = items.groupBy("ticker", "report_date").agg(*[v.alias(n) for n, v in value.items()])
    return out.withColumn("free_cash_flow", F.coalesce("free_cash_flow", F.col("operating_cash_flow") + F.col("capex")))


def attach(panel: DataFrame, quarterly: DataFrame, lag_days: int = LAG_DAYS) -> DataFrame:
    """panel with the fields of the last report that is at least lag_days old on each date; a missing item of that report stays missing.

    Reports take their place in the ticker's own order as rows of the same sorted window, so the join needs one shuffle by
    ticker and no range comparison.
    """
    names = [c for c in RAW_FUNDAMENTALS if c in quarterly.columns]
    report = F.struct(*[number(F.col(n)).alias(n) for n in names])
    known = quarterly.select("ticker", F.date_add("report_date", lag_days).alias("date"), report.alias("_report"), F.col("report_date").alias("_of"))
    rows = panel.withColumn("_report", F.lit(None).cast(known.schema["_report"].dataType)).withColumn("_of", F.lit(None).cast("date"))
    both = rows.unionByName(known, allowMissingColumns=True)
    # reports come before the row of their own date; of two reports of one date the later counts
    order = Window.partitionBy("ticker").orderBy("date", F.col("_report").isNull(), "_of").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_last", F.last("_report", ignorenulls=True).over(order)).where(F.col("_report").isNull())
    return filled.select(*panel.columns, *[F.col(f"_last.{n}").alias(n) for n in names])


def coverage(panel: DataFrame) -> float:
    """The share of rows with revenue."""
    return panel.agg(F.coalesce(F.avg(F.col("revenue").isNotNull().cast("double")), F.lit(0.0))).first()[0]


def supplier_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly stand-ins for statements of the suppliers: sums of their lineitems, shipped in the quarter that ends at report_date."""
    items = table(spark, sf_dir, "lineitem")
    sale = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    quarter = F.to_date(F.date_trunc("quarter", "l_shipdate"))
    by = items.groupBy(F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"), F.last_day(F.add_months(quarter, 2)).alias("report_date")).agg(
        F.sum(sale).alias("revenue"), F.sum(sale * F.col("l_tax")).alias("tax"), F.sum("l_quantity").alias("units"), F.sum(F.when(F.col("l_returnflag") == "R", sale)).alias("returned"), F.sum("l_extendedprice").alias("gross"),
    )
    r, g = F.col("revenue"), F.col("gross")
    back = F.coalesce("returned", F.lit(0.0))
    return by.select(
        "ticker", "report_date", "revenue", (r * 0.4).alias("gross_profit"), (r * 0.3 - back * 0.1).alias("operating_income"), (r * 0.2 - back * 0.1).alias("net_income"), (r * 0.35).alias("ebitda"),
        ((r * 0.2 - back * 0.1) / F.col("units")).alias("eps"), (g * 3).alias("total_assets"), (g * 1.2).alias("total_debt"), (g * 1.8).alias("total_equity"), (g * 0.3).alias("cash"), (g * 0.9).alias("current_assets"),
        (g * 0.6).alias("current_liabilities"), (r * 0.25).alias("operating_cash_flow"), (-r * 0.05).alias("capex"), (r * 0.2).alias("free_cash_flow"), (-F.col("tax")).alias("dividends_paid"),
    )
