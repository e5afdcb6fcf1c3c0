"""Code strings: area codes, postal codes, classification ladders and money ranges."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelmill.functions.safe import as_col, number


def prefix(x: str | Column, n: int) -> Column:
    return F.left(as_col(x).cast("string"), F.lit(n))


def suffix(x: str | Column, n: int) -> Column:
    return F.right(as_col(x).cast("string"), F.lit(n))


def drop_suffix(x: str | Column, n: int) -> Column:
    """Text without its last ``n`` characters."""
    s = as_col(x).cast("string")
    return F.left(s, F.length(s) - n)


def area_part(code: str | Column) -> Column:
    """Area number inside a combined state-and-area code: its last three digits."""
    return number(suffix(code, 3), "int")


def state_part(code: str | Column) -> Column:
    """State number inside a combined code: everything before the last three digits."""
    return number(drop_suffix(code, 3), "int")


def padded_area(state: str | Column, area: str | Column) -> Column:
    """Map key: two digits of state, three of area; longer numbers keep all their digits."""
    return F.concat(zero_padded(state, 2), zero_padded(area, 3))


def zero_padded(code: str | Column, width: int) -> Column:
    """Text of at least ``width`` characters, zeros in front; nothing is cut."""
    text = as_col(code).cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), "0")


def zip5(code: str | Column) -> Column:
    """Five-digit number from a five- or nine-digit postal code; null when it is not numeric."""
    text = as_col(code).cast("string")
    value = number(text)
    return F.when(F.length(text) > 5, F.floor(value / 10000)).otherwise(value).cast("long")


def major_part(code: str | Column) -> Column:
    """Integer part of a decimal classification code held as text."""
    return F.floor(number(code)).cast("long")


def ladder(rules: Sequence[tuple[Column, Any]], default: Any = None) -> Column:
    """First matching rule wins."""
    if not rules:
        return F.lit(default)
    chain = F.when(rules[0][0], F.lit(rules[0][1]))
    for test, value in rules[1:]:
        chain = chain.when(test, F.lit(value))
    return chain.otherwise(F.lit(default))


def threshold_ladder(x: str | Column, steps: Sequence[tuple[float, Any]], default: Any) -> Column:
    """Class of ``x``: the first step whose upper limit is at or above it."""
    x = as_col(x)
    return F.when(x.isNotNull(), ladder([(x <= top, label) for top, label in steps], default))


def range_mean(text: str | Column) -> Column:
    """Mean of the ends of a money range such as ``$10,000-14,999``; null if an end is no number."""
    bare = F.regexp_replace(as_col(text), r"[$,a-zA-Z/']", "")
    ends = F.transform(F.split(bare, "-"), lambda p: F.trim(p).try_cast("double"))
    total = F.aggregate(ends, F.lit(0.0), lambda acc, v: acc + v)
    return total / F.size(ends)


def open_range_mean(text: str | Column) -> Column:
    """``range_mean`` with open top ranges raised by half and open bottom ranges halved."""
    text = as_col(text)
    mid = range_mean(text)
    return F.when(text.contains("more"), 1.5 * mid).when(text.contains("Less"), 0.5 * mid).otherwise(mid)


def period_start(year: str | Column, width: int) -> Column:
    """First year of the fixed-width period that holds ``year``."""
    return (F.floor(as_col(year) / width) * width).cast("long")
