"""How well a signal orders returns, from the positions table of plans.portfolio (segments, date, ticker, signal, ret)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmill.operators.crosssection import mean_rank
from sigmill.operators.timeseries import zero_if_tiny

HORIZONS = (1, 2, 3, 5, 10, 21)
SEGMENT = ("segment",)


def date_rank(value: str, by: tuple[str, ...]) -> Column:
    """Mean-tie rank of value on its date; null for a missing value, and if the date has fewer than two."""
    rank, n = mean_rank(F.col(value), lambda *more: Window.partitionBy(*by, "date", *more))
    return F.when(F.col(value).isNotNull() & (n > 1), rank)


def correlation(x: str, y: str) -> Column:
    """Correlation, as an aggregate, of the pairs with both values; null without spread."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    px, py = F.when(both, F.col(x)), F.when(both, F.col(y))
    var = lambda p: zero_if_tiny(F.var_samp(p), F.avg(p))
    spread = F.sqrt(var(px)) * F.sqrt(var(py))
    return F.try_divide(F.covar_samp(px, py), F.when(spread > 0, spread))


def _ahead(book: DataFrame, horizons: tuple[int, ...], by: tuple[str, ...]) -> DataFrame:
    own = Window.partitionBy(*by, "ticker").orderBy("date")
    return book.select(*by, "date", "ticker", "signal", *[F.lead("ret", h).over(own).alias(f"ret_{h}") for h in horizons])


def ic_series(book: DataFrame, horizons: tuple[int, ...] = (1,), by: tuple[str, ...] = SEGMENT) -> DataFrame:
    """(by, date, horizon, ic): correlation of the ranks of the signal with those of returns `horizon` rows later. All horizons share one pass."""
    rows = _ahead(book, horizons, by)
    ranked = rows.select(*by, "date", date_rank("signal", by).alias("r0"), *[date_rank(f"ret_{h}", by).alias(f"r_{h}") for h in horizons])
    per_date = ranked.groupBy(*by, "date").agg(*[correlation("r0", f"r_{h}").alias(f"ic_{h}") for h in horizons])
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"ic_{h}").alias("ic")) for h in horizons])
    return per_date.select(*by, "date", F.explode(each).alias("e")).select(*by, "date", "e.horizon", "e.ic")


def ic_summary(series: DataFrame, by: tuple[str, ...] = SEGMENT) -> DataFrame:
    """(by, horizon, ic, icir, ic_tstat, ic_pct_positive, n_days) of ic_series."""
    out = series.where("ic is not null").groupBy(*by, "horizon").agg(F.avg("ic").alias("ic"), F.sqrt(F.when(F.var_samp("ic") > 1e-24, F.var_samp("ic"))).alias("_std"), F.avg((F.col("ic") > 0).cast("double")).alias("ic_pct_positive"), F.count(F.lit(1)).alias("n_days"))
    ratio = F.try_divide("ic", "_std")
    return out.select(*by, "horizon", "ic", (ratio * F.lit(252**0.5)).alias("icir"), (ratio * F.sqrt("n_days")).alias("ic_tstat"), "ic_pct_positive", "n_days")


def ic_bands(series: DataFrame, window: int = 21, by: tuple[str, ...] = SEGMENT) -> DataFrame:
    """ic_series with its mean over `window` dates and a band of two standard deviations."""
    w = Window.partitionBy(*by, "horizon").orderBy("date").rowsBetween(-(window - 1), 0)
    full = F.count(F.lit(1)).over(w) == window
    mean, dev = F.avg("ic").over(w), F.stddev_samp("ic").over(w)
    return series.where("ic is not null").select(*by, "date", "horizon", "ic", F.when(full, mean).alias("mean"), F.when(full, mean - 2 * dev).alias("low"), F.when(full, mean + 2 * dev).alias("high"))


def alpha_decay(series: DataFrame, by: tuple[str, ...] = SEGMENT) -> DataFrame:
    """(by, half_life_days, r_squared): a line through the logarithm of the mean IC by horizon, with the shortest horizon's sign. Null where the IC doesn't fall."""
    means = ic_summary(series, by).where("ic != 0").select(*by, "horizon", "ic")
    sign = F.first(F.signum("ic")).over(Window.partitionBy(*by).orderBy("horizon"))
    points = means.withColumn("_y", F.col("ic") * sign).where("_y > 0").withColumn("_y", F.ln("_y")).withColumn("_x", F.col("horizon").cast("double"))
    fit = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("_x", "_y").alias("xy"), F.var_pop("_x").alias("xx"), F.var_pop("_y").alias("yy"))
    slope = F.try_divide("xy", F.when(F.col("xx") > 0, F.col("xx")))
    falls = (F.col("n") >= 2) & (slope < 0)
    found = fit.select(*by, F.when(falls, -F.ln(F.lit(2.0)) / slope).alias("half_life_days"), F.when(falls, F.try_divide(F.col("xy") * F.col("xy"), F.when(F.col("xx") * F.col("yy") > 0, F.col("xx") * F.col("yy")))).alias("r_squared"))
    return series.select(*by).distinct().join(found, list(by), "left")


def quantile_returns(book: DataFrame, n: int = 5, horizon: int = 1, by: tuple[str, ...] = SEGMENT) -> DataFrame:
    """(by, quantile, mean_return, n_days): mean over dates of the mean return `horizon` rows later, by quantile of the date's signal."""
    rows = _ahead(book, (horizon,), by).withColumnRenamed(f"ret_{horizon}", "later").where("signal is not null and later is not null")
    edges = F.percentile("signal", F.array(*[F.lit(k / n) for k in range(1, n)])).over(Window.partitionBy(*by, "date"))
    number = F.count(F.lit(1)).over(Window.partitionBy(*by, "date"))
    rows = rows.withColumn("_edges", edges).withColumn("_n", number).where(F.col("_n") >= n)
    rows = rows.withColumn("quantile", 1 + F.size(F.filter("_edges", lambda e: e <= F.col("signal"))))
    per_date = rows.groupBy(*by, "date", "quantile").agg(F.avg("later").alias("r"))
    return per_date.groupBy(*by, "quantile").agg(F.avg("r").alias("mean_return"), F.count(F.lit(1)).alias("n_days"))


def rank_stability(book: DataFrame, by: tuple[str, ...] = SEGMENT) -> DataFrame:
    """(by, rank_stability): mean correlation of a date's ranks with those of the date before."""
    ranked = book.select(*by, "date", "ticker", date_rank("signal", by).alias("r"))
    paired = ranked.withColumn("before", F.lag("r").over(Window.partitionBy(*by, "ticker").orderBy("date")))
    return paired.groupBy(*by, "date").agg(correlation("r", "before").alias("c")).groupBy(*by).agg(F.avg("c").alias("rank_stability"))
