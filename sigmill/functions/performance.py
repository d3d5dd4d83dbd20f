"""Performance of daily series. Every function takes the daily table of plans.portfolio and groups by its segment columns.

The daily table has one row per date and segment, so windows over one segment's dates are small whatever the panel's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmill.plans.portfolio import TRADING_DAYS, sharpe

YEAR = TRADING_DAYS**0.5
SEGMENT = ("segment",)


def _dates(by: tuple[str, ...]):
    return Window.partitionBy(*by).orderBy("date")


def _so_far(by: tuple[str, ...]):
    return _dates(by).rowsBetween(Window.unboundedPreceding, 0)


def drawdowns(daily: DataFrame, by: tuple[str, ...] = SEGMENT) -> DataFrame:
    """daily with equity (1 plus the sum of returns), peak, drawdown and underwater (whether below the peak)."""
    out = daily.withColumn("equity", 1 + F.sum("ret").over(_so_far(by)))
    out = out.withColumn("peak", F.max("equity").over(_so_far(by)))
    return out.withColumn("drawdown", F.try_divide("equity", "peak") - 1).withColumn("underwater", F.col("equity") < F.col("peak"))


def drawdown_durations(daily: DataFrame, by: tuple[str, ...] = SEGMENT) -> DataFrame:
    """(by, avg_dd_days, max_dd_days, current_dd_days): runs of dates below the peak; the mean is over ended runs, or the current one if no other."""
    rows = drawdowns(daily, by)
    island = F.sum((~F.col("underwater")).cast("int")).over(_so_far(by))
    last = F.max("date").over(Window.partitionBy(*by))
    runs = rows.withColumn("run", island).withColumn("last", last).where("underwater").groupBy(*by, "run").agg(F.count(F.lit(1)).alias("days"), (F.max("date") == F.max("last")).alias("current"))
    found = runs.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(~F.col("current"), F.col("days"))), F.avg("days")).alias("avg_dd_days"), F.max("days").alias("max_dd_days"), F.coalesce(F.max(F.when(F.col("current"), F.col("days"))), F.lit(0)).alias("current_dd_days"),
    )
    zero = F.lit(0).cast("long")
    return daily.select(*by).distinct().join(found, list(by), "left").select(*by, F.coalesce("avg_dd_days", F.lit(0.0)).alias("avg_dd_days"), F.coalesce("max_dd_days", zero).alias("max_dd_days"), F.coalesce("current_dd_days", zero).alias("current_dd_days"))


def annual_return(total: Column, n: Column) -> Column:
    grown = F.pow(F.greatest(1 + total, F.lit(0.0)), F.lit(float(TRADING_DAYS)) / n) - 1
    return F.when(1 + total > 0, grown).otherwise(F.lit(0.0))


def summary(daily: DataFrame, benchmark: DataFrame | None = None, by: tuple[str, ...] = SEGMENT) -> DataFrame:
    """One row per segment: return, risk, ratios, turnover, costs, exposures; with a benchmark (date, ret) beta and information_ratio."""
    rows = drawdowns(daily, by)
    bench = F.lit(None).cast("double")
    if benchmark is not None:
        rows = rows.join(benchmark.select("date", F.col("ret").alias("_bench")), "date", "left")
        bench = F.coalesce("_bench", F.lit(0.0))
    r, pnl = F.col("ret"), F.col("net")
    up, down = F.sum(F.when(pnl > 0, pnl)), F.sum(F.when(pnl < 0, pnl))
    total = lambda c: F.sum(c)
    base = rows.groupBy(*by).agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count(F.lit(1)).alias("n_days"), F.avg(r).alias("mean"), F.sqrt(F.coalesce(F.var_samp(r), F.lit(0.0))).alias("std"), sharpe(r).alias("sharpe"), total(r).alias("total_return"),
        F.min("drawdown").alias("max_drawdown"), F.var_samp(F.when(r < 0, r)).alias("_down_var"), F.avg("turnover").alias("avg_turnover"), F.max("gross_exposure").alias("book"),
        F.avg((pnl > 0).cast("double")).alias("win_rate"), F.coalesce(up, F.lit(0.0)).alias("_up"), F.coalesce(down, F.lit(0.0)).alias("_down"),
        *[total(c).alias(f"{c}_cost") for c in ("flat", "spread", "impact", "borrow")], total("gross").alias("gross_pnl"), total("net").alias("net_pnl"),
        F.avg("long").alias("_long"), F.avg("short").alias("_short"), F.percentile(r, F.lit(0.95)).alias("_q95"), F.percentile(r, F.lit(0.05)).alias("_q05"),
        F.var_samp(bench).alias("_bench_var"), F.covar_samp(r, bench).alias("_cov"), F.avg(r - bench).alias("_active"), F.var_samp(r - bench).alias("_active_var"),
        F.skewness(r).alias("_skew"), F.kurtosis(r).alias("_kurt"),
    )
    positive = lambda x: F.when(F.col(x) > 1e-24, F.col(x))
    n = F.col("n_days")
    cost = F.col("flat_cost") + F.col("spread_cost") + F.col("impact_cost") + F.col("borrow_cost")
    out = base.withColumn("annual_return", annual_return(F.col("total_return"), n)).withColumn("turnover_share", F.coalesce(F.try_divide("avg_turnover", positive("book")), F.lit(0.0)))
    exposure = lambda x: F.try_divide(x, positive("book"))
    size = F.abs("annual_return")
    return out.select(
        *by, "start_date", "end_date", "n_days", "sharpe", "total_return", "annual_return", (F.col("std") * YEAR).alias("annual_vol"), "max_drawdown",
        F.coalesce(F.try_divide("annual_return", F.when(F.col("max_drawdown") < 0, -F.col("max_drawdown"))), F.lit(0.0)).alias("calmar_ratio"),
        F.coalesce(F.try_divide(F.col("mean"), F.sqrt(positive("_down_var"))) * YEAR, F.lit(0.0)).alias("sortino_ratio"),
        "avg_turnover", (F.col("sharpe") * F.sqrt(size) * F.greatest(F.lit(0.0), 1 - F.col("turnover_share"))).alias("fitness"),
        (F.when(F.col("annual_return") >= 0, 1.0).otherwise(-1.0) * F.sqrt(size / F.greatest(F.abs("turnover_share"), F.lit(0.125))) * F.col("sharpe")).alias("fitness_wq"),
        "win_rate", F.when(F.col("_down") < 0, F.col("_up") / -F.col("_down")).when(F.col("_up") <= 0, F.lit(0.0)).alias("profit_factor"),
        F.when((n >= 20) & (F.col("_q05") != 0), F.try_divide(F.abs("_q95"), F.abs("_q05"))).alias("tail_ratio"),
        "gross_pnl", "flat_cost", "spread_cost", "impact_cost", "borrow_cost", cost.alias("total_cost"), "net_pnl", F.coalesce(F.try_divide(100 * cost, F.abs("gross_pnl")), F.lit(0.0)).alias("cost_pct_of_gross"),
        exposure(F.col("_long")).alias("long_exposure"), exposure(F.col("_short")).alias("short_exposure"), exposure(F.col("_long") - F.col("_short")).alias("gross_exposure"), exposure(F.col("_long") + F.col("_short")).alias("net_exposure"),
        F.try_divide("_cov", positive("_bench_var")).alias("beta"), (F.try_divide(F.col("_active"), F.sqrt(positive("_active_var"))) * YEAR).alias("information_ratio"),
        F.when(n > 3, F.coalesce(F.col("_skew") * F.sqrt(n * (n - 1)) / F.try_subtract(n, F.lit(2)), F.lit(0.0))).otherwise(F.lit(0.0)).alias("skew"),
        F.when(n > 3, F.coalesce(((n + 1) * F.col("_kurt") + 6) * F.try_divide((n - 1).cast("double"), ((n - 2) * (n - 3)).cast("double")) + 3, F.lit(3.0))).otherwise(F.lit(3.0)).alias("kurt"),
    )


def rolling_sharpe(daily: DataFrame, window: int = 63, by: tuple[str, ...] = SEGMENT) -> DataFrame:
    """(by, date, rolling_sharpe): of the last `window` dates; null before, and without spread."""
    w = _dates(by).rowsBetween(-(window - 1), 0)
    variance = F.var_samp("ret").over(w)
    value = F.try_divide(F.avg("ret").over(w), F.sqrt(F.when(variance > 1e-24, variance))) * F.lit(YEAR)
    return daily.select(*by, "date", F.when(F.count("ret").over(w) == window, value).alias("rolling_sharpe"))


def monthly_returns(daily: DataFrame, by: tuple[str, ...] = SEGMENT) -> DataFrame:
    return daily.groupBy(*by, F.year("date").alias("year"), F.month("date").alias("month")).agg(F.sum("ret").alias("ret"))


def yearly_returns(daily: DataFrame, by: tuple[str, ...] = SEGMENT) -> DataFrame:
    return daily.groupBy(*by, F.year("date").alias("year")).agg(sharpe(F.col("ret")).alias("sharpe"), F.sum("ret").alias("annual_return"), F.count(F.lit(1)).alias("n_days"))


def positive_months(daily: DataFrame, by: tuple[str, ...] = SEGMENT) -> DataFrame:
    """(by, positive_months_pct): share of months with a gain."""
    return monthly_returns(daily, by).groupBy(*by).agg(F.avg((F.col("ret") > 0).cast("double")).alias("positive_months_pct"))


def stress(daily: DataFrame, regimes: DataFrame, least_days: int = 5, by: tuple[str, ...] = SEGMENT) -> DataFrame:
    """Per regime (name, start, end) that holds at least least_days dates: days, Sharpe, returns, worst drawdown, hit rate, severity."""
    inside = (F.col("date") >= F.col("start")) & (F.col("date") <= F.col("end"))
    rows = daily.select(*by, "date", "ret").join(F.broadcast(regimes.select("name", "start", "end")), inside)  # a few regimes
    keys = (*by, "name")
    rows = drawdowns(rows, keys)
    n, total = F.count(F.lit(1)), F.sum("ret")
    out = rows.groupBy(*keys).agg(n.alias("n_days"), sharpe(F.col("ret")).alias("sharpe"), total.alias("total_return"), F.min("drawdown").alias("max_drawdown"), F.avg((F.col("ret") > 0).cast("double")).alias("hit_rate")).where(F.col("n_days") >= least_days)
    severity = F.when(F.col("sharpe") >= 0.5, "good").when(F.col("sharpe") >= -0.5, "warn").otherwise("bad")
    return out.withColumn("annualised_return", annual_return(F.col("total_return"), F.col("n_days"))).withColumn("severity", severity)


#: Market regimes by name, first and last date.
REGIMES = [
    ("gfc_crash", "2008-09-15", "2009-03-09"), ("euro_debt_2011", "2011-07-22", "2011-10-04"), ("china_2015", "2015-08-17", "2016-02-11"), ("vol_q4_2018", "2018-10-03", "2018-12-24"),
    ("covid_crash", "2020-02-19", "2020-03-23"), ("covid_recovery", "2020-03-24", "2020-08-31"), ("inflation_bear", "2022-01-03", "2022-10-12"), ("svb_crisis", "2023-03-08", "2023-03-31"),
]


def regime_table(spark, regimes=REGIMES) -> DataFrame:
    return spark.createDataFrame(regimes, "name string, start string, end string").select("name", F.to_date("start").alias("start"), F.to_date("end").alias("end"))


#: Severity of a fall of the Sharpe ratio out of sample below each share; a losing second half is severe whatever the fall.
SEVERITIES = ((0.2, "robust"), (0.4, "moderate"), (0.6, "high"))
WORST, OVERFIT = "severe", 0.5


def compare_halves(summary: DataFrame) -> DataFrame:
    """One row from a summary with the segments `is` and `oos`: how far the Sharpe ratio and the yearly return fell, as shares of their size in sample, and how severe that is.

    A share is 0 if the value in sample is 0; all but the dates are null if one half is missing.
    """
    of = lambda s, c: F.max(F.when(F.col("segment") == s, F.col(c)))
    names = {"sharpe": "sharpe", "annual_return": "return", "start_date": "start", "end_date": "end"}
    row = summary.agg(*[of(s, c).alias(f"{s}_{n}") for s in ("is", "oos") for c, n in names.items()])
    fall = lambda n: F.when(F.col(f"is_{n}") == 0, F.when(F.col(f"oos_{n}").isNotNull(), 0.0)).otherwise((F.col(f"is_{n}") - F.col(f"oos_{n}")) / F.abs(f"is_{n}"))
    row = row.withColumn("sharpe_decay", fall("sharpe")).withColumn("return_decay", fall("return"))
    severity = F.when(F.col("sharpe_decay").isNull(), F.lit(None).cast("string")).when(F.col("oos_sharpe") < 0, WORST)
    for bound, name in SEVERITIES:
        severity = severity.when(F.col("sharpe_decay") < bound, name)
    flag = (F.col("sharpe_decay") > OVERFIT) | (F.col("oos_sharpe") < 0)
    return row.select("sharpe_decay", "return_decay", flag.alias("overfitting_flag"), severity.otherwise(WORST).alias("severity"), "is_start", "is_end", "oos_start", "oos_end")
