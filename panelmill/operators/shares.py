"""Concentration and flow tables built from weighted cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions.safe import ratio
from panelmill.operators.scaling import share_of_total


def weight_shares(df: DataFrame, weight: str, cells: Sequence[str], within: Sequence[str], out: str = "frac") -> DataFrame:
    """Weight per cell and its share of the ``within`` total; rows are reduced to cells first."""
    return share_of_total(df.groupBy(*cells).agg(F.sum(weight).alias(weight)), weight, within, out)


def herfindahl(cells: DataFrame, size: str, unit: Sequence[str], out: str = "hh") -> DataFrame:
    """Sum of squared shares per unit.

    ``sum(size^2) / sum(size)^2`` equals the sum of squared shares and needs one aggregation.
    """
    total = F.sum(size)
    return cells.groupBy(*unit).agg(ratio(F.sum(F.col(size) * F.col(size)), total * total).alias(out))
