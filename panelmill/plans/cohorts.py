"""Wage growth and premium by cohort, and what a later cohort saw of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions.safe import ratio
from panelmill.functions.weighted import endpoint_growth, wmean
from panelmill.operators.joins import shift_key
from panelmill.operators.reshape import widen
from panelmill.operators.scaling import share_of_total


def wage_growth(persons: DataFrame, by: Sequence[str], rank: str, first: int, last: int, wage: str, out: str = "wage_growth") -> DataFrame:
    """Growth of the mean wage between the first and last period rank of each group."""
    return persons.groupBy(*by).agg(endpoint_growth(wage, rank, first, last).alias(out))


def cohort_conditions(
    persons: DataFrame, area: Sequence[str], kind: str, group: str, rank: str, first: int, last: int,
    wage: str, weight: str, kinds: Sequence[str], premium: tuple[str, str], within: Sequence[str] | None = None,
) -> DataFrame:
    """One row per (area, group): growth, employment share and mean wage per kind, and the premium.

    Measured in one group of years and dated to the next one, which decides under these conditions.
    ``within`` names the area keys whose total the employment shares refer to.
    """
    cells = persons.groupBy(*area, kind, group).agg(
        endpoint_growth(wage, rank, first, last).alias("wage_growth"),
        wmean(wage, weight).alias("mean_wage"), F.sum(weight).alias("emp"),
    )
    cells = share_of_total(shift_key(cells, group, 1), "emp", [*(within or area), group], "frac_emp")
    wide = widen(cells, [*area, group], kind, kinds, ["wage_growth", "frac_emp", "mean_wage"])
    top, bottom = premium
    return wide.withColumn("premium", ratio(f"mean_wage_{top}", f"mean_wage_{bottom}"))
