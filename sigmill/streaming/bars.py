"""Bars from a stream of trades, and the latest signal of a formula over each batch of finished bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sigmill.plans.compiler import check, evaluate
from sigmill.sources.panel import dense, with_returns

TRADES = "ts timestamp, ticker string, price double, quantity double, trade_id long"


def read_trades(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Trades from Parquet files as they arrive."""
    return spark.readStream.schema(TRADES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def bars(trades: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(ticker, date, open, high, low, close, volume) of each span of `width`; trades later than `late` behind the newest are dropped.

    First and last prices go by time, then by trade_id. State is one row per ticker and open span.
    """
    at = F.struct("ts", "trade_id")
    by = trades.withWatermark("ts", late).groupBy("ticker", F.window("ts", width))
    out = by.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("quantity").alias("volume"))
    return out.select("ticker", F.to_date(F.col("window.start")).alias("date"), "open", "high", "low", "close", "volume")


def keep_bars(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends finished bars to a Parquet folder; each bar is written once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def signal_after_each(stream: DataFrame, path: str, formula: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Adds each batch of bars to a folder (one subfolder per batch, so a repeated batch replaces itself) and gives the formula's newest date to the sink."""
    check(formula)

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        prices = batch.sparkSession.read.parquet(path).drop("batch")
        values = evaluate(dense(with_returns(prices)), formula)
        newest = values.agg(F.max("date").alias("date"))
        sink(values.join(F.broadcast(newest), "date"), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
