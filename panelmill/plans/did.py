"""Difference-in-differences tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.operators.scaling import zscore


def base_rates(rows: DataFrame, area: Sequence[str], period: str, outcome: str) -> DataFrame:
    """Mean outcome per area and period, also standardised within the period."""
    rates = rows.groupBy(*area, period).agg(F.avg(outcome).alias("rate"))
    return zscore(rates, [period], rate_z="rate")


def with_base_rate(rows: DataFrame, rates: DataFrame, area: Sequence[str], period: str, base: int) -> DataFrame:
    """Attach the base period's rate to every row; areas without that period are dropped."""
    first = rates.where(F.col(period) == base).select(*area, F.col("rate").alias("pre"), F.col("rate_z").alias("pre_z"))
    return rows.join(first, list(area))


def group_differences(rows: DataFrame, above: Column, period: str, outcome: str, pre: str) -> DataFrame:
    """(above, period, diffs): mean outcome less its base value in the upper and the lower group."""
    means = rows.groupBy(above.alias("above"), period).agg(F.avg(outcome).alias("__m"), F.avg(pre).alias("__p"))
    return means.select("above", period, (F.col("__m") - F.col("__p")).alias("diffs"))


def difference_in_differences(diffs: DataFrame, period: str) -> DataFrame:
    """(period, diff_upper, diff_lower, diff_diff): both groups side by side in one aggregation."""
    upper = F.max(F.when(F.col("above"), F.col("diffs")))
    lower = F.max(F.when(~F.col("above"), F.col("diffs")))
    both = diffs.groupBy(period).agg(upper.alias("diff_upper"), lower.alias("diff_lower"))
    return both.dropna().withColumn("diff_diff", F.col("diff_upper") - F.col("diff_lower"))


def area_changes(rows: DataFrame, area: Sequence[str], period: str, outcome: str, pre: str) -> DataFrame:
    """(area..., period, diffs) for maps."""
    means = rows.groupBy(*area, period).agg(F.avg(outcome).alias("__m"), F.avg(pre).alias("__p"))
    return means.select(*area, period, (F.col("__m") - F.col("__p")).alias("diffs"))
