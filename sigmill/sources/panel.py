"""Panels: from price tables, and from the order tables of the test data.

A panel is dense: every date of the calendar for every ticker, with nulls where a ticker has no row. Values are doubles;
a missing value is null, never NaN.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close", "volume")
LABEL_COLUMNS = ("sector", "industry_group", "industry", "sub_industry")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def number(x: Column) -> Column:
    """A double without NaN or infinity."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def normalized(ohlcv: DataFrame) -> DataFrame:
    """(ticker, date, open, high, low, close, volume, returns, vwap) of a price table with any case of column names.

    returns: close against the ticker's last known close of an earlier row.
    """
    lower = ohlcv.select(*[F.col(c).alias(c.lower()) for c in ohlcv.columns])
    out = lower.select(F.upper(F.trim(F.col("ticker").cast("string"))).alias("ticker"), F.to_date("date").alias("date"), *[number(F.col(c)).alias(c) for c in PRICES])
    return with_returns(out)


def with_returns(prices: DataFrame) -> DataFrame:
    own = Window.partitionBy("ticker").orderBy("date")
    filled = F.last("close", ignorenulls=True).over(own)
    out = prices.withColumn("_filled", filled).withColumn("_before", F.lag("_filled").over(own))
    returns = F.try_divide("_filled", F.when(F.col("_before") != 0, F.col("_before"))) - 1
    return out.withColumn("returns", returns).withColumn("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3).drop("_filled", "_before")


def dense(prices: DataFrame, securities: DataFrame | None = None, order: Column | None = None) -> DataFrame:
    """prices on every (date, ticker), with ticker_ord and the labels of securities (ticker, label columns).

    The tickers are far fewer than the rows; both sides of the product come from aggregates, and the product is the panel itself.
    """
    tickers = prices.select("ticker").distinct()
    tickers = tickers.withColumn("ticker_ord", F.row_number().over(Window.orderBy(order if order is not None else F.col("ticker"))))
    dates = prices.select("date").distinct()
    grid = dates.crossJoin(tickers)
    out = grid.join(prices, ["date", "ticker"], "left")
    if securities is not None:
        labels = [c for c in LABEL_COLUMNS if c in securities.columns]
        out = out.join(securities.select("ticker", *labels), "ticker", "left")
    return out


def load(spark: SparkSession, ohlcv_path: str, securities_path: str | None = None) -> DataFrame:
    """A dense panel from Parquet files."""
    securities = spark.read.parquet(securities_path) if securities_path else None
    return dense(normalized(spark.read.parquet(ohlcv_path)), securities)


def _bars(rows: DataFrame) -> DataFrame:
    """Bars from trades (ticker, date, price, l_*): first and last by a total order of the trades."""
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "price")
    return rows.groupBy("ticker", "date").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("l_quantity").alias("volume"),
    )


def supplier_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices per supplier and month: a trade is a lineitem, its price extendedprice by quantity."""
    trades = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("date"), F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
    )
    return _bars(trades)


def brand_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices per part brand and week."""
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    trades = table(spark, sf_dir, "lineitem").join(brands, "l_partkey").select(
        "ticker", F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
    )
    return _bars(trades)


def supplier_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations as group labels of suppliers."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = table(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    return suppliers.select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry_group"), F.col("n_name").alias("industry"),
        F.concat_ws("-", "n_name", (F.col("s_suppkey") % 2).cast("string")).alias("sub_industry"),
    )


_KEPT: dict[tuple[str, str, str], tuple[tuple, DataFrame]] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, tables: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
    """A panel that all queries of a session share: built once, dealt by ticker, in memory or else on the executors' disks.

    It is built anew when one of its tables has changed. The panel is far smaller than the trades that it is made from.
    """
    conf, stamp = spark._jsc.hadoopConfiguration(), []
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        status = path.getFileSystem(conf).getFileStatus(path)
        stamp.append((status.getModificationTime(), status.getLen()))
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _KEPT or _KEPT[key][0] != tuple(stamp):
        release(key)
        _KEPT[key] = (tuple(stamp), build().repartition("ticker").persist(StorageLevel.MEMORY_AND_DISK))
    return _KEPT[key][1]


def release(*keys: tuple[str, str, str]) -> None:
    """Frees the kept panels of keys, or all."""
    for key in keys or list(_KEPT):
        if key in _KEPT:
            _KEPT.pop(key)[1].unpersist()


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense supplier and month panel with labels; tickers in the order of their keys."""
    build = lambda: dense(with_returns(supplier_months(spark, sf_dir)), supplier_labels(spark, sf_dir), F.substring("ticker", 2, 20).cast("long"))
    return kept(spark, sf_dir, "supplier", ("lineitem", "supplier", "nation", "region"), build)


def brand_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense brand and week panel, without labels."""
    return kept(spark, sf_dir, "brand", ("lineitem", "part"), lambda: dense(with_returns(brand_weeks(spark, sf_dir))))


def preview(panel: DataFrame, ticker: str, rows: int = 30) -> DataFrame:
    """The last rows of one ticker."""
    return panel.where(F.col("ticker") == ticker).orderBy(F.desc("date")).limit(rows)


def matrix(panel: DataFrame, field: str) -> DataFrame:
    """(date, ticker, value) of one column."""
    if field not in panel.columns:
        raise KeyError(f"unknown field {field!r}")
    return panel.select("date", "ticker", F.col(field).alias("value"))


def expanded(panel_prices: DataFrame, more: DataFrame) -> DataFrame:
    """Prices of both tables; a row of `more` replaces one of the same ticker and date."""
    keys = ["ticker", "date"]
    old = panel_prices.join(more.select(*keys), keys, "left_anti")
    return reduce(lambda a, b: a.unionByName(b), [old, more.select(*panel_prices.columns)])
