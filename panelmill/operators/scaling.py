"""Group statistics set beside each row, and what is computed from them.

A group statistic is a grouped aggregate joined back rather than an unordered window: partial
aggregation absorbs a hot group before the shuffle, and its rows never meet in one task. Statistics
of the whole frame enter as a scalar subquery.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions.safe import as_col, ratio
from panelmill.operators.joins import null_safe_merge
from panelmill.operators.quantiles import exact_quantiles, rounding_slack
from panelmill.session import reused


def attach_stats(df: DataFrame, by: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Add grouped aggregates as columns (of the whole frame when ``by`` is empty)."""
    df = reused(df)
    named = [agg.alias(name) for name, agg in stats.items()]
    if by:
        return null_safe_merge(df, df.groupBy(*by).agg(*named), by, "inner")
    one = df.agg(*named).select(F.struct(*stats).alias("s")).scalar()
    return df.withColumn("__one", one).withColumns({name: F.col("__one")[name] for name in stats}).drop("__one")


def share_of_total(df: DataFrame, x: str, by: Sequence[str], out: str) -> DataFrame:
    return (
        attach_stats(df, by, {"__total": F.sum(x)}).withColumn(out, ratio(x, "__total")).drop("__total")
    )


def zscore(df: DataFrame, by: Sequence[str] = (), **out: str) -> DataFrame:
    """Subtract the group mean and divide by the group's sample standard deviation."""
    stats = {f"__m_{new}": F.avg(x) for new, x in out.items()}
    stats |= {f"__s_{new}": F.stddev_samp(x) for new, x in out.items()}
    scored = {new: ratio(as_col(x) - F.col(f"__m_{new}"), f"__s_{new}") for new, x in out.items()}
    return attach_stats(df, by, stats).withColumns(scored).drop(*stats)


def scale_by_sd(df: DataFrame, by: Sequence[str] = (), **out: str) -> DataFrame:
    stats = {f"__s_{new}": F.stddev_samp(x) for new, x in out.items()}
    scaled = {new: ratio(x, f"__s_{new}") for new, x in out.items()}
    return attach_stats(df, by, stats).withColumns(scaled).drop(*stats)


def centre(df: DataFrame, by: Sequence[str] = (), **out: str) -> DataFrame:
    stats = {f"__m_{new}": F.avg(x) for new, x in out.items()}
    shifted = {new: as_col(x) - F.col(f"__m_{new}") for new, x in out.items()}
    return attach_stats(df, by, stats).withColumns(shifted).drop(*stats)


def attach_quantile(df: DataFrame, x: str, q: float, out: str, by: Sequence[str] = ()) -> DataFrame:
    """The group's ``q`` quantile of ``x`` beside each row."""
    df = reused(df)
    cut = exact_quantiles(df, x, [q], by).withColumn(out, F.col("quantiles")[0]).drop("quantiles")
    if by:
        return null_safe_merge(df, cut, by, "inner")
    return df.withColumn(out, cut.select(out).scalar())


def above_quantile(df: DataFrame, x: str, q: float, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Flag rows strictly above the group's ``q`` quantile."""
    cut = F.col("__cut") + rounding_slack(F.col("__cut"))
    return attach_quantile(df, x, q, "__cut", by).withColumn(out, F.col(x) > cut).drop("__cut")


def above_median(df: DataFrame, x: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    return above_quantile(df, x, 0.5, out, by)


def keep_max(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows that hold the group maximum of ``x``; ties stay."""
    rows = attach_stats(df, by, {"__max": F.max(x)})
    least = F.col("__max")
    if dict(df.dtypes)[x] in ("double", "float"):
        least = least - rounding_slack(least)
    return rows.where(F.col(x) >= least).drop("__max")


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, n, nulls, mean, low, q1, median, q3, high) for each numeric column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "variable", "__v")
    basics = long.groupBy("variable").agg(
        F.count("__v").alias("n"), F.count(F.when(F.col("__v").isNull(), F.lit(1))).alias("nulls"),
        F.avg("__v").alias("mean"), F.min("__v").alias("low"), F.max("__v").alias("high"),
    )
    q = F.col("quantiles")
    middle = exact_quantiles(long, "__v", [0.25, 0.5, 0.75], ["variable"])
    middle = middle.select("variable", q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"))
    return basics.join(middle, "variable", "left")
