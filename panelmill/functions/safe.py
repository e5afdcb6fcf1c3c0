"""Guarded arithmetic: results outside the reals become null, never Inf, NaN or an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ln(x: str | Column) -> Column:
    """Natural log; null at zero and below."""
    x = as_col(x)
    return F.when(x > 0, F.log(x))


def ln1p(x: str | Column) -> Column:
    x = as_col(x)
    return F.when(x > -1, F.log1p(x))


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den``; null when ``den`` is zero."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def number(x: str | Column, to: str = "double") -> Column:
    """Parse text as a number; null when it is none."""
    return as_col(x).try_cast(to)


def flag(predicate: Column) -> Column:
    """Predicate as 1.0 / 0.0 (null stays null)."""
    return predicate.cast("double")


def is_finite(x: str | Column) -> Column:
    x = as_col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def not_in(x: str | Column, values: list) -> Column:
    """Non-membership that keeps null ``x``, unlike SQL ``NOT IN``."""
    return F.coalesce(~as_col(x).isin(values), F.lit(True))


def strict(aggregate: Callable[[Column], Column], x: str | Column) -> Column:
    """Aggregate that is null as soon as one input of the group is null."""
    x = as_col(x)
    return F.when(F.count(x) == F.count(F.lit(1)), aggregate(x))
