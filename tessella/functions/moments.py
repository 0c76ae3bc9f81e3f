"""Aggregate expressions over moments, guarded where a statistic is undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pearson(x: Column, y: Column, least_variance: float = 0.0) -> Column:
    """Correlation from population moments; NULL below two rows or where a variance isn't above the least."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    n = F.count(a)
    vx, vy = F.var_pop(a), F.var_pop(b)
    r = F.try_divide(F.covar_pop(a, b), F.sqrt(vx * vy))
    return F.when((n >= 2) & (vx > least_variance) & (vy > least_variance), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))


def r_squared(y: Column, predicted: Column) -> Column:
    """1 - residual over total sum of squares; NULL for a constant."""
    both = y.isNotNull() & predicted.isNotNull()
    total = F.var_pop(F.when(both, y)) * F.count(F.when(both, y))
    return F.lit(1.0) - F.try_divide(F.sum(F.when(both, (y - predicted) * (y - predicted))), total)


def selectivity_index(x: Column, is_a: Column) -> Column:
    """(mean of a - mean of b) / (mean of a + mean of b); NULL when the sum is 0."""
    a, b = F.avg(F.when(is_a, x)), F.avg(F.when(~is_a, x))
    return F.try_divide(a - b, a + b)


#: Statistics that may be asked for by name.
STATISTICS = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": F.median, "std": F.stddev_pop, "var": F.var_pop}


def statistic(name: str, x: Column) -> Column:
    if name not in STATISTICS:
        raise ValueError(f"{name!r} is none of {', '.join(STATISTICS)}")
    return STATISTICS[name](x)
