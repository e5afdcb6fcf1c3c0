"""Between/within split of area exposure, and industry shares by exposure bin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelmill.functions.safe import ratio
from panelmill.functions.weighted import wmean
from panelmill.operators.panel import change_prev
from panelmill.operators.quantiles import quantile_bins
from panelmill.operators.scaling import attach_stats
from panelmill.session import reused


def between_within(
    persons: DataFrame, area: Sequence[str], time: str, industry: str, occupation: str, score: str, weight: str
) -> DataFrame:
    """(area..., time, between, within, total).

    ``between`` gives each local industry its national occupation mix; ``within`` is the deviation
    of the local mix. All totals derive from one table of cells.
    """
    cells = reused(persons.groupBy(*area, time, industry, occupation, score).agg(F.sum(weight).alias("own")))
    mix = cells.groupBy(industry, time, occupation).agg(F.sum("own").alias("__io"))
    mix = mix.withColumn("share", ratio("__io", F.sum("__io").over(Window.partitionBy(industry, time)))).drop("__io")
    cells = cells.join(mix, [industry, time, occupation])
    # One local industry's occupations per window partition.
    local = F.sum("own").over(Window.partitionBy(*area, time, industry))
    cells = cells.withColumn("expected", F.col("share") * local)
    own, expected, x = F.col("own"), F.col("expected"), F.col(score)
    return cells.groupBy(*area, time).agg(
        ratio(F.sum(expected * x), F.sum("own")).alias("between"),
        ratio(F.sum((own - expected) * x), F.sum("own")).alias("within"),
        ratio(F.sum(x * own), F.sum("own")).alias("total"),
    )


def decomposition_changes(parts: DataFrame, area: Sequence[str], time: str) -> DataFrame:
    return change_prev(parts, area, time, {"del_between": "between", "del_within": "within", "del_total": "total"})


def variances(parts: DataFrame, prefix: str = "") -> DataFrame:
    """Sample variances of the total and its two parts over complete rows."""
    names = ["total", "within", "between"]
    rows = parts.dropna(subset=[prefix + n for n in names])
    return rows.agg(*[F.var_samp(prefix + n).alias(n) for n in names])


def industry_share_changes(
    persons: DataFrame, area: Sequence[str], time: str, industry: str, score: str, weight: str, bins: int = 10
) -> DataFrame:
    """(area..., time, bin, share, del_share): local employment share of industries by exposure bin."""
    cells = persons.where(F.col(score) != 0).groupBy(*area, time, industry).agg(
        F.sum(weight).alias("emp"), F.sum(F.col(weight) * F.col(score)).alias("scored")
    )
    cells = reused(cells)
    exposure = cells.groupBy(industry).agg(ratio(F.sum("scored"), F.sum("emp")).alias("exposure"))
    binned = quantile_bins(exposure, "exposure", bins, "bin").select(industry, "bin")
    by_bin = cells.join(binned, industry).groupBy(*area, time, "bin").agg(F.sum("emp").alias("emp"))
    by_bin = attach_stats(by_bin, [*area, time], {"all": F.sum("emp")}).withColumn("share", ratio("emp", "all"))
    return change_prev(by_bin, [*area, "bin"], time, {"del_share": "share"}).drop("emp", "all")


def mean_exposure(persons: DataFrame, by: Sequence[str], score: str, weight: str) -> DataFrame:
    return persons.groupBy(*by).agg(wmean(score, weight).alias("exposure"))
