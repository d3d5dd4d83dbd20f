"""Functions of one date's cross-section."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigmill.functions.catalog import function
from sigmill.plans.syntax import ExpressionError

from .timeseries import positive, zero_if_tiny


def mean_rank(x, across):
    """(mean-tie rank among the values of the rows of across(), number of values); across(more) splits those by more columns.

    Both windows take the rows by value, nulls first, so one sort serves the ranks and the ties.
    """
    n, rows = F.count(x).over(across()), F.count(F.lit(1)).over(across())
    first, ties = F.rank().over(across().orderBy(x.asc())) - (rows - n), F.count(F.lit(1)).over(across(x))
    return first + (ties - 1) / 2, n


def share_of_rank(c, x, *parts):
    """Mean-tie rank among the values of one cross-section part, as a share of their number; null stays null."""
    rank, n = mean_rank(x, lambda *more: c.across(*parts, *more))
    return F.when(x.isNotNull(), rank / n)


@function("rank(x)", "cross_sectional")
def rank(c, x):
    """Rank as a share of the number of values; ties share their mean rank."""
    return share_of_rank(c, x)


@function("zscore(x)", "cross_sectional")
def zscore(c, x):
    """Distance from the mean in standard deviations (n - 1)."""
    w = c.across()
    mean = F.avg(x).over(w)
    return F.try_divide(x - mean, positive(F.sqrt(zero_if_tiny(F.var_samp(x).over(w), mean))))


@function("demean(x)", "cross_sectional")
def demean(c, x):
    """Distance from the mean."""
    return x - F.avg(x).over(c.across())


@function("scale(x)", "cross_sectional")
def scale(c, x):
    """Share of the sum of absolute values."""
    return F.try_divide(x, F.sum(F.abs(x)).over(c.across()))


@function("normalize(x)", "cross_sectional")
def normalize(c, x):
    """demean, then scale."""
    return scale(c, c.settle(demean(c, x)))


@function("winsorize(x, f=4)", "cross_sectional")
def winsorize(c, x, std):
    """Values beyond std standard deviations from the mean are brought to that bound."""
    if std <= 0:
        raise ExpressionError("winsorize needs a positive number of standard deviations")
    w = c.across()
    mean, dev = F.avg(x).over(w), F.sqrt(zero_if_tiny(F.var_samp(x).over(w), F.avg(x).over(w)))
    low, high = mean - F.lit(float(std)) * dev, mean + F.lit(float(std)) * dev
    return F.when(x < low, low).when(x > high, high).otherwise(x)


@function("quantile(x, f=0.5)", "cross_sectional")
def quantile(c, x, q):
    """The q-quantile, interpolated, on every row of the date."""
    if not 0 <= q <= 1:
        raise ExpressionError(f"quantile {q} is outside 0 to 1")
    return F.percentile(x, F.lit(float(q))).over(c.across())


@function("vector_neut(x, x)", "cross_sectional")
def vector_neut(c, x, y):
    """x less its projection on y."""
    w = c.across()
    share = F.try_divide(F.sum(x * y).over(w), positive(F.sum(y * y).over(w)))
    return x - share * y


@function("regression_neut(x, x)", "cross_sectional")
def regression_neut(c, x, y):
    """Residual of x on y, each less its own mean."""
    dx, dy = c.settle(demean(c, x)), c.settle(demean(c, y))
    return vector_neut(c, dx, dy)


@function("correlation(x, x)", "cross_sectional")
def correlation(c, x, y):
    """Correlation of the date's pairs, on every row of the date."""
    w, both = c.across(), x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    var_x = zero_if_tiny(F.var_samp(px).over(w), F.avg(px).over(w))
    var_y = zero_if_tiny(F.var_samp(py).over(w), F.avg(py).over(w))
    return F.try_divide(F.covar_samp(px, py).over(w), positive(F.sqrt(var_x) * F.sqrt(var_y)))


@function("cap_weight(x)", "cross_sectional")
def cap_weight(c, x):
    """Rank of x times market value."""
    return share_of_rank(c, c.settle(x * c.settle(c.field("market_cap"))))


@function("bucket(x, d=5)", "cross_sectional")
def bucket(c, x, n):
    """Number, from 0, of the value's part when the date's values are cut into n parts; ties go by the tickers' order."""
    if n < 2:
        raise ExpressionError("bucket needs at least 2 parts")
    w = c.across()
    place = F.row_number().over(w.orderBy(x.asc_nulls_last(), c.order())) - 1
    part = F.floor(F.try_divide(place * F.lit(n), F.count(x).over(w)))
    return F.when(x.isNotNull(), F.least(part, F.lit(n - 1)).cast("double"))


@function("tail(x, f, f, f)", "cross_sectional")
def tail(c, x, lower, upper, replace):
    """Values from lower to upper; all others, missing ones too, become replace."""
    return F.when(x.between(float(lower), float(upper)), x).otherwise(F.lit(float(replace)))


@function("kth_element(x, d)", "cross_sectional")
def kth_element(c, x, k):
    """The k-th smallest value on every row of the date, from the largest on if k is negative; null if there is none."""
    if k == 0:
        return c.nothing(x)
    place = c.settle(F.row_number().over(c.across().orderBy(x.asc_nulls_last() if k > 0 else x.desc_nulls_last())))
    return F.max(F.when(place == abs(k), x)).over(c.across())


@function("harmonic_mean(x)", "cross_sectional")
def harmonic_mean(c, x):
    """Harmonic mean of the positive values, on every row of the date."""
    w, up = c.across(), F.when(x > 0, x)
    return F.try_divide(F.count(up).over(w), F.sum(1 / up).over(w))


@function("geometric_mean(x)", "cross_sectional")
def geometric_mean(c, x):
    """Geometric mean of the positive values, on every row of the date."""
    return F.exp(F.avg(F.ln(F.when(x > 0, x))).over(c.across()))


@function("step(x)", "cross_sectional")
def step(c, x):
    """Rank brought to -1 to 1; null if the date has a single value."""
    rank_, n = mean_rank(x, c.across)
    return F.when(x.isNotNull() & (n > 1), (rank_ - (n + 1) / 2) / ((n - 1) / 2))


@function("keep(x, d)", "cross_sectional")
def keep(c, x, n):
    """The n values largest in size; all others become 0. Ties go by the tickers' order."""
    if n < 1:
        raise ExpressionError("keep needs at least 1")
    place = F.row_number().over(c.across().orderBy(F.abs(x).desc_nulls_last(), c.order()))
    return F.when(x.isNotNull() & (place <= n), x).otherwise(F.lit(0.0))
