"""Numeric helpers: exact fixed-point aggregates, NaN handling, vector arithmetic."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def nan_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn NaN into null, once, at ingest: Spark aggregates skip null but propagate NaN."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def fixed_point(x: Column, places: int) -> Column:
    """``x`` as a whole number of ``10**-places`` units."""
    return F.rint(x * F.lit(float(10**places))).cast("bigint")


def total(x: Column, places: int | None = None) -> Column:
    """Sum with null groups as 0.

    With ``places`` the addends are whole units summed as decimals of 38 digits, so the result does not
    depend on the order of rows and no key is too hot for it; without it this is the plain floating sum.
    """
    if places is None:
        return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))
    units = F.coalesce(F.sum(fixed_point(x.cast("double"), places).cast("decimal(20,0)")), F.lit(0))
    return units.cast("double") / F.lit(float(10**places))


def mean(x: Column, places: int | None = None) -> Column:
    """Mean of the non-null values; null for a group without any."""
    if places is None:
        return F.avg(x.cast("double"))
    units = F.sum(fixed_point(x.cast("double"), places).cast("decimal(20,0)")).cast("double")
    return F.try_divide(units, F.lit(float(10**places)) * F.count(x))


def safe_ratio(a: Column, b: Column) -> Column:
    """``a / b`` as double, null when ``b`` is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def add_up(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


UNROLL = 16  # a longer unrolled sum grows past what the JVM compiles to machine code


def _over_pairs(a: Column, b: Column, width: int, term: Callable[[Column, Column], Column]) -> Column:
    """Sum of ``term`` over two arrays of known width: unrolled if short, else a loop."""
    if width <= UNROLL:
        return add_up([term(a[i], b[i]) for i in range(width)])
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, v: s + v)


def l1_distance(a: Column, b: Column, width: int) -> Column:
    return _over_pairs(a, b, width, lambda u, v: F.abs(u - v))


def l2_distance(a: Column, b: Column, width: int) -> Column:
    return F.sqrt(_over_pairs(a, b, width, lambda u, v: (u - v) * (u - v)))


def dot(a: Column, b: Column, width: int) -> Column:
    return _over_pairs(a, b, width, lambda u, v: u * v)
