"""Aggregates and expressions that skip missing values (NULL and NaN alike)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column | str) -> Column:
    """NaN becomes NULL, as Spark's aggregates skip only NULL."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(c), c)


def mean_sem(x: Column | str, min_count: int = 1, min_ratio: float = 0.0) -> list[Column]:
    """mean, sem, std and n of a group, NULL below max(min_count, ceil(min_ratio * rows)) values."""
    c = clean(x)
    n = F.count(c)
    enough = n >= F.greatest(F.lit(min_count), F.ceil(F.lit(min_ratio) * F.count("*")))
    std = F.stddev_samp(c)
    return [
        F.when(enough, F.avg(c)).alias("mean"),
        F.when(enough, std / F.sqrt(n)).alias("sem"),
        F.when(enough, std).alias("std"),
        n.alias("n"),
    ]


def weighted_mean(x: Column | str, w: Column | str) -> Column:
    c, weight = clean(x), clean(w)
    both = c.isNotNull() & weight.isNotNull()
    return F.try_divide(F.sum(F.when(both, c * weight)), F.sum(F.when(both, weight)))


def poisson_sem(x: Column | str) -> Column:
    """Standard error if counts were Poisson: the variance is sum(x) / (n - 1)."""
    c = clean(x)
    n = F.count(c)
    return F.when(n > 1, F.sqrt(F.sum(c) / (n - 1)) / F.sqrt(n))


def hazen(sorted_values: Column, p: float) -> Column:
    """Quantile p of a sorted array of values: rank p n + 1/2 within 1 .. n, linear between."""
    n = F.size(sorted_values)
    rank = F.greatest(F.lit(1.0), F.least(n.cast("double"), F.lit(p) * n + 0.5))
    low = F.floor(rank).cast("int")
    a = F.get(sorted_values, low - 1)
    b = F.get(sorted_values, F.least(low, n - 1))
    return F.when(n > 0, a + (rank - low) * (b - a))


def hazen_quantile(x: Column | str, p: float) -> Column:
    """hazen() as an aggregate. It gathers the group's values in one row, so it is for groups
    of bounded size (draws, conditions, bins); hazen_by_rank() has no such bound."""
    return hazen(F.sort_array(F.collect_list(clean(x))), p)


def rms_parts(x: Column | str) -> list[Column]:
    """Partial sums of squares about the mean, to be pooled over trials."""
    c = clean(x)
    return [(F.var_pop(c) * F.count(c)).alias("ssq"), F.count(c).alias("n")]


def floor_tol(x: Column, tol: float = 1e-6) -> Column:
    return F.floor(x + F.lit(tol))


def ceil_tol(x: Column, tol: float = 1e-6) -> Column:
    return F.ceil(x - F.lit(tol))


def near(a: Column, b: Column | float, tol: float = 1e-6) -> Column:
    """Equality of numbers within an absolute tolerance."""
    return F.abs(a - b) < F.lit(tol)


def dprime(mean1: Column, var1: Column, mean2: Column, var2: Column) -> Column:
    return F.try_divide(mean1 - mean2, F.sqrt((var1 + var2) / 2))
