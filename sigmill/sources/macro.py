"""Series that are the same for all tickers: macro series, factor returns, benchmarks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmill.functions.fields import MACRO_BASE, MACRO_SPREADS

from .panel import number, table

FACTORS = ("mkt_rf", "smb", "hml", "rmw", "cma", "rf")


def read_series(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(date, name) of a CSV file with a header, the date first and the value second; `.` is a missing value."""
    raw = spark.read.csv(path, header=True, nullValue=".")
    date, value = raw.columns[:2]
    return raw.select(F.to_date(F.col(date)).alias("date"), number(F.expr(f"try_cast(`{value}` AS double)")).alias(name)).where("date is not null")


def read_factors(spark: SparkSession, path: str) -> DataFrame:
    """(date, mkt_rf, ..., rf) as fractions, of a text file with a preamble and rows `yyyymmdd, percent, ...`. Other lines are skipped."""
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\s*[0-9]{8}\s*,"))
    cells = F.split("value", ",")
    percent = lambda k: (F.expr("try_cast(trim(c[%d]) AS double)" % (k + 1)) / 100)  # noqa: E731, UP031
    return rows.select(cells.alias("c")).select(F.to_date(F.trim(F.col("c")[0]), "yyyyMMdd").alias("date"), *[percent(k).alias(n) for k, n in enumerate(FACTORS)])


def assemble(series: list[DataFrame]) -> DataFrame:
    """Series (date, name) joined on all their dates, with the spreads whose two series are there."""
    out = reduce(lambda a, b: a.join(b, "date", "full"), series)
    for name, (a, b) in MACRO_SPREADS.items():
        if a in out.columns and b in out.columns:
            out = out.withColumn(name, F.col(a) - F.col(b))
    return out


def attach(panel: DataFrame, macro: DataFrame) -> DataFrame:
    """panel with macro's columns on each date: the value of that very date, or else the last value of an earlier panel date."""
    names = [c for c in macro.columns if c != "date"]
    dates = panel.select("date").distinct().join(macro, "date", "left")
    earlier = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row per date: small whatever the panel
    filled = dates.select("date", *[F.last(n, ignorenulls=True).over(earlier).alias(n) for n in names])
    return panel.join(filled, "date", "left")


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly stand-ins for the macro series, from the orders table: means, counts and shares of a month's orders.

    One month in seven is left out of vix, to be filled from the month before.
    """
    orders = table(spark, sf_dir, "orders").withColumn("date", F.to_date(F.date_trunc("month", "o_orderdate")))
    share = lambda test: F.avg(test.cast("double"))
    by = orders.groupBy("date").agg(
        F.avg(F.col("o_totalprice") / 1.25e4).alias("vix"),
        share(F.col("o_orderpriority").startswith("1")).alias("treasury_3m_yield"),
        share(F.col("o_orderpriority").startswith("2")).alias("treasury_2y_yield"),
        share(F.col("o_orderpriority").startswith("3")).alias("treasury_10y_yield"),
        share(F.col("o_orderstatus") == "F").alias("high_yield_spread"),
        share(F.col("o_orderpriority").startswith("4")).alias("baa_yield"),
        share(F.col("o_orderpriority").startswith("5")).alias("aaa_yield"),
        F.count(F.lit(1)).cast("double").alias("dxy"),
        (F.max("o_totalprice") / 1e4).alias("wti_oil"),
    )
    by = by.withColumn("vix", F.when((F.year("date") * 12 + F.month("date")) % 7 != 0, F.col("vix")))
    for name, (a, b) in MACRO_SPREADS.items():
        by = by.withColumn(name, F.col(a) - F.col(b))
    return by.select("date", *MACRO_BASE, *MACRO_SPREADS)


def equal_weight(panel: DataFrame) -> DataFrame:
    """(date, ret): the mean return of all tickers, a benchmark."""
    return panel.groupBy("date").agg(F.coalesce(F.avg("returns"), F.lit(0.0)).alias("ret"))


def panel_factors(panel: DataFrame) -> DataFrame:
    """Stand-ins for factor returns, from the panel: the mean return, and differences of mean returns between halves of the tickers."""
    odd = lambda n: (F.col("ticker_ord") % (2 * n)) < n
    spread = lambda test: F.coalesce(F.avg(F.when(test, F.col("returns"))), F.lit(0.0)) - F.coalesce(F.avg(F.when(~test, F.col("returns"))), F.lit(0.0))
    return panel.groupBy("date").agg(
        F.coalesce(F.avg("returns"), F.lit(0.0)).alias("mkt_rf"), spread(odd(1)).alias("smb"), spread(odd(2)).alias("hml"), spread(odd(3)).alias("rmw"), spread(odd(4)).alias("cma"), F.lit(0.0001).alias("rf"),
    )
