"""Area panels from microdata and the change tables built on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelmill.functions.safe import flag, ln, ratio
from panelmill.functions.weighted import wcount, wmean, wmean_if, wshare
from panelmill.operators.joins import merge
from panelmill.operators.panel import log_change_next
from panelmill.operators.quantiles import quantile_bins
from panelmill.operators.reshape import widen
from panelmill.operators.scaling import above_median, centre, scale_by_sd
from panelmill.session import reused


def weighted_panel(
    persons: DataFrame,
    by: Sequence[str],
    weight: str,
    means: Mapping[str, str] | None = None,
    shares: Mapping[str, Column] | None = None,
    counts: Mapping[str, Column | None] | None = None,
    strict: bool = False,
) -> DataFrame:
    """One row per ``by`` with weighted means, shares and counts: a single partially combined shuffle."""
    made = [wmean(x, weight, strict).alias(out) for out, x in (means or {}).items()]
    made += [wshare(p, weight, strict).alias(out) for out, p in (shares or {}).items()]
    made += [wcount(weight, p).alias(out) for out, p in (counts or {}).items()]
    return persons.groupBy(*by).agg(*made)


def long_difference(panel: DataFrame, entity: Sequence[str], time: str, years: Sequence[int], **out: str) -> DataFrame:
    """Keep the given years and attach each measure's log change to the next kept year."""
    return log_change_next(panel.where(F.col(time).isin(list(years))), entity, time, **out)


def wage_response(panel: DataFrame, entity: Sequence[str], time: str, wage: str, exposure: str) -> DataFrame:
    """Log wage change beside exposure in standard deviations of its year."""
    return scale_by_sd(log_change_next(panel, entity, time, del_w=wage), [time], **{exposure: exposure})


def age_panel(
    persons: DataFrame, area: Sequence[str], time: str, young: Column, score: str, weight: str,
    shares: Mapping[str, Column] | None = None, means: Mapping[str, str] | None = None,
) -> DataFrame:
    """Panel by area and age group with the whole area's exposure and size beside each group."""
    rows = persons.withColumn("youth", young)
    panel = weighted_panel(rows, [time, *area, "youth"], weight, {"score": score, **(means or {})}, shares, {"pop": None})
    # Two age groups per window partition.
    whole = Window.partitionBy(time, *area)
    pop = F.col("pop")
    panel = panel.withColumns({
        "area_score": ratio(F.sum(F.col("score") * pop).over(whole), F.sum(pop).over(whole)),
        "area_pop": F.sum(pop).over(whole),
    })
    return log_change_next(panel, [*area, "youth"], time, del_score="score").withColumn("youth", flag(F.col("youth")))


def quartile_changes(
    panel: DataFrame, entity: str, time: str, base: int, exposure: str, wage: str, bins: int = 4
) -> DataFrame:
    """Change in log wage and in exposure since the base year, with the base-year exposure quartile."""
    panel = reused(panel)
    first = panel.where(F.col(time) == base).select(
        entity, F.col(wage).alias("wage_base"), F.col(exposure).alias("exposure_base")
    )
    first = quantile_bins(first, "exposure_base", bins, "quartile", clamp_top=True)
    return merge(first, panel, [entity]).withColumns({
        "d_wage": ln(wage) - ln("wage_base"), "d_exposure": F.col(exposure) - F.col("exposure_base"),
    })


def quartile_means(changes: DataFrame, time: str) -> DataFrame:
    return changes.groupBy(time, "quartile").agg(F.avg("d_wage").alias("d_wage"), F.avg("d_exposure").alias("d_exposure"))


def risk_return(persons: DataFrame, by: str, wage: str, weight: str, logs: bool = True) -> DataFrame:
    """Unweighted mean and spread of (log) wage per class, its weight, and the centred mean."""
    rows = persons.where(F.col(wage) > 0)
    x = ln(wage) if logs else F.col(wage)
    classes = rows.groupBy(by).agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.sum(weight).alias("total"))
    return centre(classes, m_norm="m")


def mean_ratio(classes: DataFrame, by: str, top, bottom) -> DataFrame:
    """Ratio of two classes' means."""
    pick = lambda v: F.max(F.when(F.col(by) == v, F.col("m")))
    return classes.agg(ratio(pick(top), pick(bottom)).alias("mean_ratio"))


def two_period_wide(panel: DataFrame, entity: Sequence[str], time: str, first: int, last: int, measures: Sequence[str]) -> DataFrame:
    """One row per entity with ``measure_year`` columns; entities missing either year are dropped."""
    wide = widen(panel.where(F.col(time).isin(first, last)), entity, time, [first, last], measures)
    lead = measures[0]
    return wide.where(F.col(f"{lead}_{first}").isNotNull() & F.col(f"{lead}_{last}").isNotNull())


def real_log_change(wide: DataFrame, measure: str, first: int, last: int, price_ratio: float) -> Column:
    """Log change with the first year's value raised to the last year's prices."""
    return ln(f"{measure}_{last}") - ln(F.col(f"{measure}_{first}") * price_ratio)


def industry_cells(
    persons: DataFrame, area: Sequence[str], time: str, industry: str, score: str, wage: str, college: Column, weight: str
) -> DataFrame:
    """Industry cells flagged above the year's median exposure and college share, with employment growth."""
    cells = weighted_panel(
        persons, [time, *area, industry], weight, {"w": wage, "score": score}, {"frac_col": college}, {"num": None}
    )
    cells = above_median(cells, "frac_col", "col_int", [time])
    cells = above_median(cells, "score", "comp_int", [time])
    return log_change_next(cells, [*area, industry], time, del_emp="num")


def outcome_rates(rows: DataFrame, by: Sequence[str], outcome: str, weight: str) -> DataFrame:
    """Weighted rate of a 0/1 outcome with the weight behind it; nulls are skipped."""
    return rows.groupBy(*by).agg(
        wmean(outcome, weight).alias("rate"), F.sum(weight).alias("total"),
        F.sum(F.col(weight) * F.col(outcome)).alias("positive"),
    )


def two_period_metrics(
    persons: DataFrame, by: Sequence[str], weight: str, wage: str, scores: Mapping[str, str],
    college: Column, employed: Column, young: Column,
) -> DataFrame:
    """Exposure measures, wages (also of the college educated), employment and population per area and year."""
    return persons.groupBy(*by).agg(
        *[wmean(x, weight).alias(out) for out, x in scores.items()],
        wmean(wage, weight).alias("w"), wmean_if(wage, weight, college).alias("w_col"),
        wcount(weight, employed).alias("emp"), wcount(weight).alias("working_age_pop"),
        wshare(college, weight).alias("frac_col"), wcount(weight, young).alias("youth"),
    )
