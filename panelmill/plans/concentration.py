"""Herfindahl indices of areas over industries or other classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions.safe import not_in, ratio
from panelmill.functions.weighted import wmean
from panelmill.operators.scaling import above_median


def industry_concentration(
    persons: DataFrame, unit: Sequence[str], industry: str, weight: str, score: str,
    drop: Sequence = (), drop_on: str | None = None,
) -> DataFrame:
    """(unit..., hh, score, above): concentration, weighted exposure and its median split.

    ``drop`` leaves out classes of ``drop_on`` (the industry column by default).
    """
    rows = persons.where(F.col(industry).isNotNull())
    if drop:
        rows = rows.where(not_in(drop_on or industry, list(drop)))
    cells = rows.groupBy(*unit, industry).agg(F.sum(weight).alias("emp"), wmean(score, weight).alias("score"))
    cells = cells.where(F.col("emp") > 0)
    emp = F.col("emp")
    index = cells.groupBy(*unit).agg(
        ratio(F.sum(emp * emp), F.sum("emp") * F.sum("emp")).alias("hh"),
        ratio(F.sum(emp * F.col("score")), F.sum("emp")).alias("score"),
    )
    return above_median(index, "score", "above")


def count_concentration(rows: DataFrame, unit: Sequence[str], category: str, more_than: int = 100, skip: Sequence[str] = ()) -> DataFrame:
    """Concentration over row counts, for units with more than ``more_than`` rows."""
    kept = rows.where(not_in(category, list(skip))) if skip else rows
    cells = kept.groupBy(*unit, category).agg(F.count(F.lit(1)).cast("double").alias("n"))
    n = F.col("n")
    index = cells.groupBy(*unit).agg(ratio(F.sum(n * n), F.sum("n") * F.sum("n")).alias("hh"), F.sum("n").alias("total"))
    return index.where(F.col("total") > more_than).drop("total")
