"""Where a book's weight and profit lie: by group, by size. All take the positions table of plans.portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .signal_quality import correlation

SEGMENT = ("segment",)


def _grouped(book: DataFrame, level: str) -> DataFrame:
    return book.withColumn("group", F.coalesce(level, F.lit("Unknown")))


def group_exposure(book: DataFrame, level: str = "sector", by: tuple[str, ...] = SEGMENT) -> DataFrame:
    """(by, group, avg_net, avg_gross, n_tickers): means over dates of a group's net and gross weight."""
    rows = _grouped(book, level)
    tickers = rows.groupBy(*by, "group").agg(F.countDistinct("ticker").alias("n_tickers"))
    per_date = rows.groupBy(*by, "group", "date").agg(F.sum("weight").alias("net"), F.sum(F.abs("weight")).alias("gross"))
    return per_date.groupBy(*by, "group").agg(F.avg("net").alias("avg_net"), F.avg("gross").alias("avg_gross")).join(tickers, [*by, "group"])


def headline(exposure: DataFrame, by: tuple[str, ...] = SEGMENT) -> DataFrame:
    """(by, max_long, max_long_exposure, max_short, max_short_exposure) of group_exposure; null and 0 where no group is on that side."""
    long, short = F.col("avg_net") > 0, F.col("avg_net") < 0
    return exposure.groupBy(*by).agg(
        F.max_by(F.when(long, F.col("group")), F.when(long, F.col("avg_net"))).alias("max_long"), F.coalesce(F.max(F.when(long, F.col("avg_net"))), F.lit(0.0)).alias("max_long_exposure"),
        F.min_by(F.when(short, F.col("group")), F.when(short, F.col("avg_net"))).alias("max_short"), F.coalesce(F.min(F.when(short, F.col("avg_net"))), F.lit(0.0)).alias("max_short_exposure"),
    )


def group_exposure_series(book: DataFrame, level: str = "sector", most: int = 120, by: tuple[str, ...] = SEGMENT) -> DataFrame:
    """(by, date, group, net): net weight by group, averaged over runs of dates so that at most `most` remain; date is the run's last."""
    per_date = _grouped(book, level).groupBy(*by, "date", "group").agg(F.sum("weight").alias("net"))
    place = F.dense_rank().over(Window.partitionBy(*by).orderBy("date"))
    rows = per_date.withColumn("_place", place).withColumn("_n", F.max("_place").over(Window.partitionBy(*by)))
    run = F.floor((F.col("_place") - 1) / F.ceil(F.col("_n") / F.lit(most)))
    return rows.groupBy(*by, run.alias("_run"), "group").agg(F.max("date").alias("date"), F.avg("net").alias("net")).drop("_run")


def size_exposure(book: DataFrame, size: DataFrame, least: int = 3, by: tuple[str, ...] = SEGMENT) -> DataFrame:
    """(by, avg_corr, n_days): mean correlation of weight with the logarithm of size (date, ticker, size), on dates with at least `least` pairs."""
    rows = book.join(size.select("date", "ticker", F.ln(F.when(F.col("size") > 0, F.col("size"))).alias("log_size")), ["date", "ticker"], "left")
    both = F.count(F.when(F.col("weight").isNotNull() & F.col("log_size").isNotNull(), 1))
    per_date = rows.groupBy(*by, "date").agg(correlation("weight", "log_size").alias("c"), both.alias("n")).where((F.col("n") >= least) & F.col("c").isNotNull())
    return per_date.groupBy(*by).agg(F.avg("c").alias("avg_corr"), F.count(F.lit(1)).alias("n_days"))


def size_distribution(book: DataFrame, size: DataFrame, buckets: int = 10, by: tuple[str, ...] = SEGMENT) -> DataFrame:
    """(by, bucket, long_share, short_share): mean over dates of each side's share of weight, by place of size among the date's tickers."""
    rows = book.join(size.select("date", "ticker", "size"), ["date", "ticker"]).where("size > 0 and weight is not null")
    day = Window.partitionBy(*by, "date")
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(day)).withColumn("_place", F.row_number().over(day.orderBy("size", "ticker_ord")) - 1).where(F.col("_n") >= buckets)
    rows = rows.withColumn("bucket", F.floor(F.col("_place") * F.lit(buckets) / F.col("_n")).cast("int"))
    long, short = F.greatest("weight", F.lit(0.0)), F.greatest(-F.col("weight"), F.lit(0.0))
    rows = rows.withColumn("_long", F.try_divide(long, F.when(F.sum(long).over(day) > 0, F.sum(long).over(day)))).withColumn("_short", F.try_divide(short, F.when(F.sum(short).over(day) > 0, F.sum(short).over(day))))
    per_date = rows.groupBy(*by, "date", "bucket").agg(F.sum("_long").alias("l"), F.sum("_short").alias("s"))
    return per_date.groupBy(*by, "bucket").agg(F.coalesce(F.avg("l"), F.lit(0.0)).alias("long_share"), F.coalesce(F.avg("s"), F.lit(0.0)).alias("short_share"))


def size_tilt(distribution: DataFrame, by: tuple[str, ...] = SEGMENT) -> DataFrame:
    """(by, long_avg, short_avg, tilt): mean bucket of both sides of size_distribution, and their difference."""
    out = distribution.groupBy(*by).agg(F.sum(F.col("bucket") * F.col("long_share")).alias("long_avg"), F.sum(F.col("bucket") * F.col("short_share")).alias("short_avg"))
    return out.withColumn("tilt", F.col("long_avg") - F.col("short_avg"))


APPROXIMATE_BELOW = 10_000.0  # fixed value: a size whose largest value is less is a price rather than a market value


def size_quality(sizes: DataFrame) -> DataFrame:
    """(is_approximation): whether `size` can't be a market value, as all its values are below APPROXIMATE_BELOW; false without values."""
    return sizes.agg(F.coalesce(F.max(F.abs("size")) < APPROXIMATE_BELOW, F.lit(False)).alias("is_approximation"))


def attribution(book: DataFrame, level: str = "sector", by: tuple[str, ...] = SEGMENT) -> DataFrame:
    """(by, group, allocation, selection, total, n_tickers): profit of a group's net weight at its mean return of the same date, and the rest."""
    rows = _grouped(book, level)
    per_date = rows.groupBy(*by, "group", "date").agg(F.sum("weight").alias("net"), F.avg("ret").alias("mean"), F.coalesce(F.sum(F.col("weight") * F.col("ret")), F.lit(0.0)).alias("actual"))
    tickers = rows.groupBy(*by, "group").agg(F.countDistinct("ticker").alias("n_tickers"))
    out = per_date.groupBy(*by, "group").agg(F.coalesce(F.sum(F.col("net") * F.col("mean")), F.lit(0.0)).alias("allocation"), F.sum("actual").alias("total"))
    return out.join(tickers, [*by, "group"]).select(*by, "group", "allocation", (F.col("total") - F.col("allocation")).alias("selection"), "total", "n_tickers")


def attribution_totals(parts: DataFrame, by: tuple[str, ...] = SEGMENT) -> DataFrame:
    """Sums over the groups of attribution(), and each part's share of their sizes in percent."""
    out = parts.groupBy(*by).agg(F.sum("allocation").alias("allocation"), F.sum("selection").alias("selection"), F.sum("total").alias("total_pnl"))
    size = F.abs("allocation") + F.abs("selection")
    share = lambda c: F.coalesce(F.try_divide(100 * F.abs(c), F.when(size > 0, size)), F.lit(0.0))
    return out.withColumn("allocation_pct", share("allocation")).withColumn("selection_pct", share("selection"))
