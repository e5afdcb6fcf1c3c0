"""Changes over time in panels.

Every function expects one row per (entity, time): reduce microdata to a panel first. A window
partition then holds one entity's few periods, whatever the number of underlying rows, and all
columns of one call share a single sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelmill.functions.safe import ln, ratio
from panelmill.operators.joins import null_safe_merge


def _by_time(entity: Sequence[str], time: str):
    return Window.partitionBy(*entity).orderBy(time)


def log_change_next(df: DataFrame, entity: Sequence[str], time: str, **out: str) -> DataFrame:
    """``ln(next) - ln(current)``; keyword arguments map new columns to measured ones."""
    w = _by_time(entity, time)
    return df.withColumns({new: F.lead(ln(x)).over(w) - ln(x) for new, x in out.items()})


def change_next(df: DataFrame, entity: Sequence[str], time: str, out: Mapping[str, str | Column]) -> DataFrame:
    """Next value minus current value, of columns or expressions."""
    w = _by_time(entity, time)
    cols = {new: F.col(x) if isinstance(x, str) else x for new, x in out.items()}
    return df.withColumns({new: F.lead(x).over(w) - x for new, x in cols.items()})


def change_prev(df: DataFrame, entity: Sequence[str], time: str, out: Mapping[str, str | Column]) -> DataFrame:
    """Current value minus previous value."""
    w = _by_time(entity, time)
    cols = {new: F.col(x) if isinstance(x, str) else x for new, x in out.items()}
    return df.withColumns({new: x - F.lag(x).over(w) for new, x in cols.items()})


def log_change_prev(df: DataFrame, entity: Sequence[str], time: str, **out: str) -> DataFrame:
    return change_prev(df, entity, time, {new: ln(x) for new, x in out.items()})


def growth_prev(df: DataFrame, entity: Sequence[str], time: str, **out: str) -> DataFrame:
    """``(current - previous) / previous``."""
    w = _by_time(entity, time)
    return df.withColumns({new: ratio(F.col(x) - F.lag(x).over(w), F.lag(x).over(w)) for new, x in out.items()})


def attach_base(df: DataFrame, entity: Sequence[str], time: str, base: int, **out: str) -> DataFrame:
    """Copy the base period's value to all periods; null for entities without that period."""
    w = Window.partitionBy(*entity)
    return df.withColumns({new: F.max(F.when(F.col(time) == base, F.col(x))).over(w) for new, x in out.items()})


def occurrence(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, slices: Column) -> DataFrame:
    """Running number of each row within its key.

    ``slices`` must not decrease along ``order`` (say, the month of a leading date). Rows are numbered
    inside (key, slice) and the counts of the key's earlier slices are added, so that a key with very
    many rows is spread over tasks.
    """
    keys = list(keys)
    rows = df.withColumn("__slice", slices)
    sizes = rows.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*keys).orderBy("__slice")
    offsets = sizes.withColumn("__before", F.sum("__n").over(upto) - F.col("__n")).drop("__n")
    inside = Window.partitionBy(*keys, "__slice").orderBy(*order)
    numbered = rows.withColumn("__at", F.row_number().over(inside))
    joined = null_safe_merge(numbered, offsets, [*keys, "__slice"])
    return joined.withColumn(out, F.col("__before") + F.col("__at")).drop("__slice", "__before", "__at")


def interpolate(df: DataFrame, entity: Sequence[str], time: str, **out: str) -> DataFrame:
    """Fill nulls between two known values on a straight line in ``time``; the ends stay null."""
    w = _by_time(entity, time)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    filled = {}
    for new, x in out.items():
        seen_at = F.when(F.col(x).isNotNull(), F.col(time))
        x0, t0 = F.last(x, ignorenulls=True).over(before), F.last(seen_at, ignorenulls=True).over(before)
        x1, t1 = F.first(x, ignorenulls=True).over(after), F.first(seen_at, ignorenulls=True).over(after)
        line = x0 + (x1 - x0) * ratio(F.col(time) - t0, t1 - t0)
        filled[new] = F.coalesce(F.col(x).cast("double"), line)
    return df.withColumns(filled)
