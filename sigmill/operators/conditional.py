"""Choices by a condition. A condition holds unless it is 0: a missing one holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigmill.functions.catalog import function


def holds(condition: Column) -> Column:
    return condition.isNull() | (condition != 0)


@function("if_else(x, x, x)", "conditional")
def if_else(c, condition, x, y):
    """x where the condition holds, else y."""
    return F.when(holds(condition), x).otherwise(y)


@function("where(x, x, x)", "conditional")
def where(c, condition, x, y):
    """The same as if_else."""
    return F.when(holds(condition), x).otherwise(y)


@function("when(x, x)", "conditional")
def when(c, condition, x):
    """x where the condition holds, else missing."""
    return F.when(holds(condition), x)


@function("mask(x, x)", "conditional")
def mask(c, x, condition):
    """Missing where the condition holds, else x."""
    return F.when(~holds(condition), x)


@function("trade_when(x, x, x=none)", "conditional")
def trade_when(c, condition, x, leave):
    """x when the condition holds, kept until it holds again; missing from when leave holds, which goes first, until the next condition."""
    typed = lambda v: F.struct(v.cast("double").alias("v"))
    event = F.when(holds(condition), typed(x))
    if leave is not None:
        event = F.when(holds(leave), typed(F.lit(None))).otherwise(event)
    return F.last(event, ignorenulls=True).over(c.history().rowsBetween(c.START, 0))["v"]
