"""Survey-weighted aggregates; all are plain sums, so Spark combines them before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelmill.functions.safe import as_col, ratio


def _guard(value: Column, strict: bool, *inputs: Column) -> Column:
    if not strict:
        return value
    complete = F.count(F.when(_all_present(inputs), F.lit(1))) == F.count(F.lit(1))
    return F.when(complete, value)


def _all_present(inputs: tuple[Column, ...]) -> Column:
    present = inputs[0].isNotNull()
    for c in inputs[1:]:
        present = present & c.isNotNull()
    return present


def wcount(w: str | Column, predicate: Column | None = None) -> Column:
    """Sum of weights, over the rows meeting ``predicate`` if given (0 where none does)."""
    w = as_col(w)
    return F.sum(w) if predicate is None else F.sum(F.when(predicate, w).otherwise(F.lit(0.0)))


def wmean(x: str | Column, w: str | Column, strict: bool = False) -> Column:
    """``sum(w*x) / sum(w)``; with ``strict`` null when any input is null."""
    x, w = as_col(x), as_col(w)
    return _guard(ratio(F.sum(w * x), F.sum(w)), strict, x, w)


def wshare(predicate: Column, w: str | Column, strict: bool = False) -> Column:
    """Weighted share of the rows that meet ``predicate``."""
    return _guard(ratio(wcount(w, predicate), F.sum(as_col(w))), strict, predicate, as_col(w))


def wmean_if(x: str | Column, w: str | Column, predicate: Column) -> Column:
    """Weighted mean over the rows that meet ``predicate``."""
    x, w = as_col(x), as_col(w)
    return ratio(F.sum(F.when(predicate, w * x)), F.sum(F.when(predicate, w)))


def mean_if(x: str | Column, predicate: Column) -> Column:
    return F.avg(F.when(predicate, as_col(x)))


def endpoint_growth(x: str | Column, rank: str | Column, first: int, last: int) -> Column:
    """Relative growth of the group mean of ``x`` between two period ranks."""
    start = mean_if(x, as_col(rank) == first)
    return ratio(mean_if(x, as_col(rank) == last) - start, start)
