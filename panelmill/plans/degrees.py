"""Degree counts by area over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions.safe import ln1p, ratio
from panelmill.operators.panel import change_next
from panelmill.session import reused


def degree_counts(rows: DataFrame, unit: Sequence[str], year: str, num: str, kinds: dict[str, Column]) -> DataFrame:
    """One column per kind: the sum of ``num`` over the rows of that kind."""
    return rows.groupBy(*unit, year).agg(
        *[F.sum(F.when(test, F.col(num)).otherwise(0.0)).alias(out) for out, test in kinds.items()]
    )


def degree_changes(counts: DataFrame, unit: Sequence[str], year: str, part: str, whole: str) -> DataFrame:
    """Change in the count and in its share to the unit's next year."""
    return change_next(counts, unit, year, {"del_count": part, "del_share": ratio(part, whole)})


def cumulated_logs(counts: DataFrame, area: Sequence[str], year: str, base: int, kinds: Sequence[str]) -> DataFrame:
    """Per area: log count in the base year and the sum of log counts in later years (logs of count + 1)."""
    yearly = counts.groupBy(*area, year).agg(*[F.sum(k).alias(k) for k in kinds])
    first = F.col(year) == base
    # Base and later years come out of one aggregation; areas need both.
    out = yearly.groupBy(*area).agg(
        *[F.max(F.when(first, ln1p(k))).alias(f"{k}_base") for k in kinds],
        *[F.sum(F.when(F.col(year) > base, ln1p(k))).alias(f"{k}_int") for k in kinds],
        F.count(F.when(F.col(year) > base, F.lit(1))).alias("__later"),
        F.count(F.when(first, F.lit(1))).alias("__first"),
    )
    return out.where((F.col("__later") > 0) & (F.col("__first") > 0)).drop("__later", "__first")


def yearly_logs(counts: DataFrame, area: Sequence[str], year: str, base: int, kinds: Sequence[str]) -> DataFrame:
    """Log count per area and year with the base year's log count beside it."""
    yearly = counts.groupBy(*area, year).agg(*[ln1p(F.sum(k)).alias(k) for k in kinds])
    yearly = reused(yearly)
    first = yearly.where(F.col(year) == base).select(*area, *[F.col(k).alias(f"{k}_base") for k in kinds])
    return yearly.join(first, list(area))
