"""Functions of a date's cross-section within the groups of a label. Rows without a label get null."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigmill.functions.catalog import function

from .crosssection import share_of_rank
from .timeseries import positive, zero_if_tiny


def _register(name: str, doc: str, value):
    def build(c, x, g):
        return F.when(g.isNotNull(), value(c, x, g, c.across(g)))

    build.__doc__ = doc
    function(f"{name}(x, g)", "group")(build)


def _zscore(c, x, g, w):
    mean = F.avg(x).over(w)
    return F.try_divide(x - mean, positive(F.sqrt(zero_if_tiny(F.var_samp(x).over(w), mean))))


def _normalize(c, x, g, w):
    moved = c.settle(x - F.avg(x).over(w))
    return F.try_divide(moved, positive(F.sum(F.abs(moved)).over(w)))


_register("group_rank", "rank within the group.", lambda c, x, g, w: share_of_rank(c, x, g))
_register("group_zscore", "zscore within the group.", _zscore)
_register("group_neutralize", "Distance from the group's mean.", lambda c, x, g, w: x - F.avg(x).over(w))
_register("neutralize", "The same as group_neutralize.", lambda c, x, g, w: x - F.avg(x).over(w))
_register("group_mean", "The group's mean, on all its rows.", lambda c, x, g, w: F.avg(x).over(w))
_register("group_sum", "The group's sum, on all its rows; 0 without values.", lambda c, x, g, w: F.coalesce(F.sum(x).over(w), F.lit(0.0)))
_register("group_count", "How many values the group has, on all its rows.", lambda c, x, g, w: F.count(x).over(w).cast("double"))
_register("group_max", "The group's largest value, on all its rows.", lambda c, x, g, w: F.max(x).over(w))
_register("group_min", "The group's smallest value, on all its rows.", lambda c, x, g, w: F.min(x).over(w))
_register("group_normalize", "Distance from the group's mean as a share of the sum of the group's distances.", _normalize)
_register("group_scale", "Share of the group's sum of absolute values.", lambda c, x, g, w: F.try_divide(x, positive(F.sum(F.abs(x)).over(w))))
