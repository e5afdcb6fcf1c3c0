"""Wide and long forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def widen(df: DataFrame, ids: Sequence[str], key: str, levels: Sequence, values: Sequence[str]) -> DataFrame:
    """One row per ``ids``; columns ``value_level``, or ``level`` when there is one value column.

    Levels are named by the caller, so Spark needs no extra pass to find them.
    """
    wide = df.groupBy(*ids).pivot(key, list(levels))
    if len(values) == 1:
        return wide.agg(F.first(values[0]))
    named = wide.agg(*[F.first(v).alias(v) for v in values])
    return named.withColumnsRenamed({f"{level}_{v}": f"{v}_{level}" for level in levels for v in values})
