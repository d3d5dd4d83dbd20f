"""Functions of single values. Missing values stay missing unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigmill.functions.catalog import function
from sigmill.plans.syntax import ExpressionError


def no_nan(x: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(x), x)


@function("abs(x)", "arithmetic")
def abs_(c, x):
    """Size without sign."""
    return F.abs(x)


@function("sign(x)", "arithmetic")
def sign(c, x):
    """-1, 0 or 1."""
    return F.signum(x)


@function("log(x)", "arithmetic")
def log(c, x):
    """Natural logarithm; null for 0 and below."""
    return F.ln(F.when(x > 0, x))


@function("sqrt(x)", "arithmetic")
def sqrt(c, x):
    """Square root; null below 0."""
    return F.sqrt(F.when(x >= 0, x))


@function("exp(x)", "arithmetic")
def exp(c, x):
    """e to the power of x."""
    return F.exp(x)


@function("power(x, f)", "arithmetic")
def power(c, x, n):
    """x to the power of n; null where that is no number."""
    return no_nan(F.pow(x, F.lit(float(n))))


@function("signed_power(x, f)", "arithmetic")
def signed_power(c, x, n):
    """Size to the power of n, with the sign of x."""
    return F.signum(x) * F.pow(F.abs(x), F.lit(float(n)))


@function("sigmoid(x)", "arithmetic")
def sigmoid(c, x):
    """1 / (1 + e^-x)."""
    return 1 / (1 + F.exp(-x))


@function("mod(x, x)", "arithmetic")
def mod(c, x, y):
    """What is left of x after whole times y, with the sign of y; null for y = 0."""
    return x - F.floor(F.try_divide(x, y)) * y


def both(x, y, value):
    return F.when(x.isNotNull() & y.isNotNull(), value)


@function("max(x, x)", "arithmetic")
def max_(c, x, y):
    """The larger; null if either is missing."""
    return both(x, y, F.greatest(x, y))


@function("min(x, x)", "arithmetic")
def min_(c, x, y):
    """The smaller; null if either is missing."""
    return both(x, y, F.least(x, y))


@function("clip(x, f=none, f=none)", "arithmetic")
def clip(c, x, low, high):
    """x brought into low to high."""
    if low is not None and high is not None and low > high:
        raise ExpressionError(f"clip from {low} to {high}")
    if low is not None:
        x = F.when(x < float(low), F.lit(float(low))).otherwise(x)
    return x if high is None else F.when(x > float(high), F.lit(float(high))).otherwise(x)


@function("replace(x, f, f)", "arithmetic")
def replace(c, x, old, new):
    """new where x equals old."""
    return F.when(x == F.lit(float(old)), F.lit(float(new))).otherwise(x)


@function("isnan(x)", "arithmetic")
def isnan(c, x):
    """1 where the value is missing, else 0."""
    return x.isNull().cast("double")


@function("pasteurize(x)", "arithmetic")
def pasteurize(c, x):
    """0 where the value is missing or infinite."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def _compare(name: str, doc: str, test, missing: float):
    def build(c, x, y):
        return F.coalesce(test(x, y).cast("double"), F.lit(missing))

    build.__doc__ = f"1 where {doc}, else 0; {missing:.0f} if either is missing."
    function(f"{name}(x, x)", "logical")(build)


_compare("equal", "x equals y", lambda x, y: x == y, 0.0)
_compare("not_equal", "x differs from y", lambda x, y: x != y, 1.0)
_compare("less", "x is below y", lambda x, y: x < y, 0.0)
_compare("greater", "x is above y", lambda x, y: x > y, 0.0)
_compare("less_eq", "x is at most y", lambda x, y: x <= y, 0.0)
_compare("greater_eq", "x is at least y", lambda x, y: x >= y, 0.0)
