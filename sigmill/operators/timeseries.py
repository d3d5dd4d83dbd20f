"""Functions of one ticker's own history. A window covers d rows of the dense calendar and is null unless all d have a value."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigmill.functions.catalog import function
from sigmill.plans.syntax import ExpressionError

TINY = 1e-18  # a variance of so small a part of the squared mean is none


def window_size(d: int) -> int:
    if d < 1:
        raise ExpressionError(f"a window of {d} rows")
    return d


def zero_if_tiny(variance: Column, mean: Column) -> Column:
    """variance, or 0 where it is only rounding."""
    return F.when(variance <= F.lit(TINY) * F.greatest(F.lit(1.0), mean * mean), F.lit(0.0)).otherwise(variance)


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


@function("ts_mean(x, d)", "time_series")
def ts_mean(c, x, d):
    """Mean of the last d values."""
    return c.full(x, d, F.avg(x).over(c.rows(d)))


@function("ts_std(x, d)", "time_series")
def ts_std(c, x, d):
    """Standard deviation (n - 1) of the last d values; null for d = 1."""
    w = c.rows(d)
    return c.full(x, d, F.sqrt(zero_if_tiny(F.var_samp(x).over(w), F.avg(x).over(w))))


@function("ts_min(x, d)", "time_series")
def ts_min(c, x, d):
    """Smallest of the last d values."""
    return c.full(x, d, F.min(x).over(c.rows(d)))


@function("ts_max(x, d)", "time_series")
def ts_max(c, x, d):
    """Largest of the last d values."""
    return c.full(x, d, F.max(x).over(c.rows(d)))


@function("ts_sum(x, d)", "time_series")
def ts_sum(c, x, d):
    """Sum of the last d values."""
    return c.full(x, d, F.sum(x).over(c.rows(d)))


@function("ts_median(x, d)", "time_series")
def ts_median(c, x, d):
    """Median of the last d values."""
    return c.full(x, d, F.percentile(x, F.lit(0.5)).over(c.rows(d)))


@function("ts_quantile(x, d, f=0.5)", "time_series")
def ts_quantile(c, x, d, q):
    """The q-quantile of the last d values, interpolated."""
    if not 0 <= q <= 1:
        raise ExpressionError(f"quantile {q} is outside 0 to 1")
    return c.full(x, d, F.percentile(x, F.lit(float(q))).over(c.rows(d)))


@function("ts_product(x, d)", "time_series")
def ts_product(c, x, d):
    """Product of the last d values."""
    return c.full(x, d, F.product(x).over(c.rows(d)))


@function("ts_min_max_diff(x, d)", "time_series")
def ts_min_max_diff(c, x, d):
    """Largest less smallest of the last d values."""
    w = c.rows(d)
    return c.full(x, d, F.max(x).over(w) - F.min(x).over(w))


@function("ts_rank(x, d)", "time_series")
def ts_rank(c, x, d):
    """Rank of the newest among the last d values as a share of d; ties share their mean rank."""
    a = c.settle(F.collect_list(x).over(c.rows(d)))
    below, equal = F.size(F.filter(a, lambda v: v < x)), F.size(F.filter(a, lambda v: v == x))
    return F.when(F.size(a) == window_size(d), (below + (equal + 1) / 2) / d)


@function("ts_arg_max(x, d)", "time_series")
def ts_arg_max(c, x, d):
    """Rows since the largest of the last d values; of equal ones the oldest."""
    a = c.settle(F.collect_list(x).over(c.rows(d)))
    return F.when(F.size(a) == window_size(d), (F.lit(d) - F.array_position(a, F.array_max(a))).cast("double"))


@function("ts_arg_min(x, d)", "time_series")
def ts_arg_min(c, x, d):
    """Rows since the smallest of the last d values; of equal ones the oldest."""
    a = c.settle(F.collect_list(x).over(c.rows(d)))
    return F.when(F.size(a) == window_size(d), (F.lit(d) - F.array_position(a, F.array_min(a))).cast("double"))


@function("delay(x, d)", "time_series")
def delay(c, x, d):
    """The value d rows ago."""
    return F.lag(x, d).over(c.history())


@function("delta(x, d)", "time_series")
def delta(c, x, d):
    """Change over d rows."""
    return x - F.lag(x, d).over(c.history())


@function("ts_returns(x, d)", "time_series")
def ts_returns(c, x, d):
    """Relative change over d rows."""
    return F.try_divide(x, F.lag(x, d).over(c.history())) - 1


def weighted(c, x: Column, weights: list[float]) -> Column:
    """Mean of the last len(weights) values by weights, the oldest first."""
    d, total = len(weights), sum(weights)
    if d <= 8:
        value = reduce(add, [F.lag(x, d - 1 - k).over(c.history()) * F.lit(w / total) for k, w in enumerate(weights)])
        return c.full(x, d, value)
    a = c.settle(F.collect_list(x).over(c.rows(d)))
    parts = F.zip_with(a, F.array(*[F.lit(w / total) for w in weights]), lambda v, w: v * w)
    return F.when(F.size(a) == d, F.aggregate(parts, F.lit(0.0), lambda s, v: s + v))


@function("decay_linear(x, d)", "time_series")
def decay_linear(c, x, d):
    """Mean of the last d values with weights 1 to d, the newest the heaviest."""
    return weighted(c, x, [float(k) for k in range(1, window_size(d) + 1)])


@function("ts_decay_exp(x, d, f=0.5)", "time_series")
def ts_decay_exp(c, x, d, factor):
    """Mean of the last d values with weight factor^k for the one k rows ago."""
    if not 0 < factor <= 1:
        raise ExpressionError(f"factor {factor} is outside 0 to 1")
    return weighted(c, x, [float(factor) ** k for k in range(window_size(d) - 1, -1, -1)])


@function("ts_zscore(x, d)", "time_series")
def ts_zscore(c, x, d):
    """Distance from the mean of the last d values in standard deviations."""
    w = c.rows(d)
    mean = F.avg(x).over(w)
    return c.full(x, d, F.try_divide(x - mean, positive(F.sqrt(zero_if_tiny(F.var_samp(x).over(w), mean)))))


@function("ts_skewness(x, d)", "time_series")
def ts_skewness(c, x, d):
    """Skewness of the last d values, corrected for bias; 0 if they are all equal, null for d < 3."""
    if window_size(d) < 3:
        return c.nothing(x)
    w = c.rows(d)
    same = F.max(x).over(w) == F.min(x).over(w)
    return c.full(x, d, F.when(same, 0.0).otherwise(F.skewness(x).over(w) * F.lit((d * (d - 1)) ** 0.5 / (d - 2))))


@function("ts_kurtosis(x, d)", "time_series")
def ts_kurtosis(c, x, d):
    """Excess kurtosis of the last d values, corrected for bias; -3 if they are all equal, null for d < 4."""
    if window_size(d) < 4:
        return c.nothing(x)
    w = c.rows(d)
    same = F.max(x).over(w) == F.min(x).over(w)
    corrected = (F.lit(d + 1.0) * F.kurtosis(x).over(w) + 6.0) * F.lit((d - 1) / ((d - 2) * (d - 3)))
    return c.full(x, d, F.when(same, -3.0).otherwise(corrected))


def moments(c, x: Column, y: Column, d: int) -> tuple[Column, Column, Column, Column]:
    """(rows with both, covariance, variance of x, variance of y) over the rows of the window where both have a value."""
    w, both = c.rows(d), x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    var_x = zero_if_tiny(F.var_samp(px).over(w), F.avg(px).over(w))
    var_y = zero_if_tiny(F.var_samp(py).over(w), F.avg(py).over(w))
    return F.count(px).over(w), F.covar_samp(px, py).over(w), var_x, var_y


def rolling_correlation(c, x: Column, y: Column, d: int) -> Column:
    n, cov, var_x, var_y = moments(c, x, y, d)
    return F.when(n == window_size(d), F.try_divide(cov, positive(F.sqrt(var_x) * F.sqrt(var_y))))


@function("ts_corr(x, x, d)", "time_series")
def ts_corr(c, x, y, d):
    """Correlation of the last d values; null if either is constant."""
    return rolling_correlation(c, x, y, d)


@function("ts_cov(x, x, d)", "time_series")
def ts_cov(c, x, y, d):
    """Covariance (n - 1) of the last d values."""
    n, cov, _, _ = moments(c, x, y, d)
    return F.when(n == window_size(d), cov)


@function("ts_partial_corr(x, x, x, d)", "time_series")
def ts_partial_corr(c, x, y, z, d):
    """Correlation of x and y over the last d values with z held fixed."""
    xy, xz, yz = (c.settle(rolling_correlation(c, a, b, d)) for a, b in ((x, y), (x, z), (y, z)))
    rest = (1 - xz * xz) * (1 - yz * yz)
    return (xy - xz * yz) / F.sqrt(F.when(rest < 1e-12, 1e-12).otherwise(rest))


@function("ts_regression(x, x, d)", "time_series")
def ts_regression(c, y, x, d):
    """Slope of y on x over the last d values; null if x is constant."""
    w = c.rows(d)
    n, cov, _, _ = moments(c, x, y, d)
    var_x = zero_if_tiny(F.var_samp(x).over(w), F.avg(x).over(w))
    return F.when(n == window_size(d), F.try_divide(cov, positive(var_x)))


@function("days_from_last_change(x)", "time_series")
def days_from_last_change(c, x):
    """Rows since the value last changed; a missing value counts as a change each time. Never null."""
    before = F.lag(x, 1).over(c.history())
    changed = x.isNull() | before.isNull() | (x != before)
    run = c.settle(F.sum(changed.cast("int")).over(c.history()))
    return (F.row_number().over(c.history(run)) - 1).cast("double")


@function("hump(x, f=0.01)", "time_series")
def hump(c, x, threshold):
    """The last value given out, until one differs from it by more than the threshold."""
    return c.fold_history(x, float(threshold))


@function("adv(d)", "time_series")
def adv(c, d):
    """Mean dollar volume of the last d rows."""
    x = c.settle(c.field("dollar_volume"))
    return ts_mean(c, x, window_size(d))
