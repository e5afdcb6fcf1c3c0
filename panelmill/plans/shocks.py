"""Leave-one-out shift-share shocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelmill.functions.safe import ratio
from panelmill.operators.panel import attach_base, growth_prev
from panelmill.session import reused


def shift_share(
    persons: DataFrame, area: Sequence[str], industry: str, time: str, weight: str, base: int
) -> DataFrame:
    """(area..., time, shocks): growth of each industry elsewhere, weighted by its base-year local share.

    Persons are reduced to (time, area, industry) cells at once. National totals come from the
    industry totals, a table of industries and years, never from a window over all cells.
    """
    cells = reused(persons.groupBy(time, *area, industry).agg(F.sum(weight).alias("emp")))
    national = cells.groupBy(time, industry).agg(F.sum("emp").alias("ind_emp"))
    national = national.withColumn("all_emp", F.sum("ind_emp").over(Window.partitionBy(time)))
    # One area's industries per window partition; the join stays a join of two small keys.
    cells = cells.withColumn("area_emp", F.sum("emp").over(Window.partitionBy(time, *area)))
    cells = cells.join(national, [time, industry]).withColumns({
        "loo": ratio(F.col("ind_emp") - F.col("emp"), "all_emp"), "local_share": ratio("emp", "area_emp"),
    })
    entity = [industry, *area]
    cells = attach_base(growth_prev(cells, entity, time, growth="loo"), entity, time, base, share="local_share")
    shocks = cells.groupBy(*area, time).agg(F.sum(F.col("growth") * F.col("share")).alias("shocks"))
    return shocks.where(F.col("shocks") != 0)
