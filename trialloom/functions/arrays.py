"""Expressions on array columns: cutting, padding, masking and their inverses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded(x: Column, n: int, fill: object = None) -> Column:
    """x cut or filled up to n elements."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.get(x, i), F.lit(fill)))


def split(x: Column, n: int) -> Column:
    """Arrays of n elements one after another; the last may be shorter."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(n)), lambda i: i <= F.size(x))
    return F.transform(starts, lambda i: F.slice(x, i, F.lit(n)))


def masked(x: Column, mask: Column) -> Column:
    """The elements of x at whose places mask is true."""
    return F.transform(F.filter(F.arrays_zip(x.alias("x"), mask.alias("m")), lambda p: F.coalesce(p["m"], F.lit(False))), lambda p: p["x"])


def inflated(x: Column, mask: Column) -> Column:
    """The inverse: an array as long as mask, with x's elements where mask is true and NULL elsewhere."""
    hits = lambda i: F.size(F.filter(F.slice(mask, F.lit(1), i + 1), lambda m: F.coalesce(m, F.lit(False))))
    return F.transform(mask, lambda m, i: F.when(F.coalesce(m, F.lit(False)), F.get(x, hits(i) - 1)))


def repeated(x: Column, n: int) -> Column:
    """x, n times in a row."""
    return F.flatten(F.array_repeat(x, n))


def picked(x: Column, places: list[int]) -> Column:
    """The elements at some places, in their order; NULL beyond the end."""
    return F.array(*[F.get(x, F.lit(i)) for i in places])
