"""Exact interpolated quantiles and quantile bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelmill.operators.joins import null_safe_merge
from panelmill.session import reused, staged

# Distinct values that are sorted in one task; ranges that a round cuts one range into.
RANGE_VALUES = 500_000
ROUND_RANGES = 1024


def exact_quantiles(
    df: DataFrame,
    x: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """``(by..., quantiles)``: linearly interpolated quantiles of ``x`` per group, nulls ignored.

    Distinct values are counted first. A group of up to ``RANGE_VALUES`` of them is one range; a larger one is cut into ranges by
    counting rounds, which keep only ranges that hold a wanted order statistic, until each of these is small enough. Then
    running counts inside the ranges give the order statistics, all groups and quantiles in one pass.
    """
    by = list(by)
    # Without keys one constant key keeps the steps below the same.
    keyed = df.select(*by, F.col(x).cast("double").alias("__x")).where(F.col("__x").isNotNull())
    keys = by or ["__all"]
    if not by:
        keyed = keyed.withColumn("__all", F.lit(1))
    cells = reused(keyed.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__n")), "values")
    sizes = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__values"), F.sum("__n").alias("__of"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi")
    )
    # Largest group: one number.
    if (sizes.agg(F.max("__values")).first()[0] or 0) <= RANGE_VALUES:
        whole = Window.partitionBy(*keys)
        rows = cells.withColumns({"__of": F.sum("__n").over(whole), "__to": F.sum("__n").over(whole.orderBy("__x"))})
    else:
        rows = _inside(cells, _narrowed(cells, sizes, keys, probs), keys)
    value, part = F.col("__x"), []
    for p in probs:
        place = F.lit(float(p)) * (F.col("__of") - 1)
        holds = lambda rank: F.max(F.when((rank >= F.col("__to") - F.col("__n")) & (rank < F.col("__to")), value))
        part.append(F.struct(holds(F.floor(place)).alias("low"), holds(F.ceil(place)).alias("high"), F.first(place - F.floor(place)).alias("part")))
    found = rows.groupBy(*keys).agg(F.array(*part).alias("__found"))
    between = F.transform("__found", lambda f: f["low"] + F.when(f["part"] > 0, f["part"] * (f["high"] - f["low"])).otherwise(0.0))
    return found.select(*by, between.alias("quantiles"))


def _wanted(probs: Sequence[float]) -> Column:
    """Distinct ranks, counted from 0, that the quantiles of a group of ``__of`` rows need."""
    places = [F.lit(float(p)) * (F.col("__of") - 1) for p in probs]
    return F.array_distinct(F.array(*[f(p).cast("long") for p in places for f in (F.floor, F.ceil)]))


def _narrowed(cells: DataFrame, sizes: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """(keys, __of, __lo, __hi, __base): ranges of at most ``RANGE_VALUES`` distinct values that hold the wanted ranks.

    A range is named by its smallest and largest value; ``__base`` counts the rows below it.
    """
    ranges = staged(sizes.withColumn("__base", F.lit(0).cast("long")), "ranges")
    while True:
        small, large = ranges.where(F.col("__values") <= RANGE_VALUES), ranges.where(F.col("__values") > RANGE_VALUES)
        if large.limit(1).count() == 0:
            return ranges
        # Pseudo-random distinct values cut a range into near-equal parts. The draw depends on the values alone, so any re-run yields the same cuts.
        rows = _inside(cells, large, keys, counted=False)
        slots = F.least(F.ceil(F.col("__values") / RANGE_VALUES) + 1, F.lit(ROUND_RANGES))
        salted = F.xxhash64("__x", "__values")
        draw = rows.groupBy(*keys, "__lo", F.pmod(salted, slots).alias("__slot")).agg(F.min_by("__x", F.xxhash64("__x", F.lit(1), "__values")).alias("__cut"))
        cuts = draw.groupBy(*keys, "__lo").agg(F.sort_array(F.collect_list("__cut")).alias("__cuts"))
        # Binary search of the sorted cuts by halving steps; reading past the end gives null, so no step.
        tagged = null_safe_merge(rows, cuts, [*keys, "__lo"]).withColumn("__at", F.lit(0))
        for step in (1 << i for i in reversed(range(ROUND_RANGES.bit_length()))):
            ahead = F.get("__cuts", F.col("__at") + step - 1) <= F.col("__x")
            tagged = tagged.withColumn("__at", F.col("__at") + F.when(ahead, step).otherwise(0))
        counted = tagged.groupBy(*keys, "__of", "__base", F.col("__lo").alias("__from"), "__at").agg(
            F.count(F.lit(1)).alias("__values"), F.sum("__n").alias("__in"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi")
        )
        # At most as many rows as a round makes ranges of one.
        before = Window.partitionBy(*keys, "__from").orderBy("__at")
        counted = counted.withColumn("__base", F.col("__base") + F.sum("__in").over(before) - F.col("__in"))
        held = F.exists(_wanted(probs), lambda rank: (rank >= F.col("__base")) & (rank < F.col("__base") + F.col("__in")))
        ranges = staged(small.unionByName(counted.where(held).select(*ranges.columns)), "ranges")


def _inside(cells: DataFrame, ranges: DataFrame, keys: list[str], counted: bool = True) -> DataFrame:
    """Cells in one of their group's ranges, with the range's columns; ``counted`` adds ``__to``, the rows up to and with each cell."""
    fields = [c for c in ranges.columns if c not in keys]
    lists = ranges.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("__ranges"))
    mine = F.filter("__ranges", lambda g: (F.col("__x") >= g["__lo"]) & (F.col("__x") <= g["__hi"]))
    rows = null_safe_merge(cells, lists, keys).withColumn("__r", F.get(mine, F.lit(0))).where("__r is not null")
    rows = rows.select(*keys, "__x", "__n", "__r.*")
    if not counted:
        return rows
    upto = Window.partitionBy(*keys, "__lo").orderBy("__x")
    return rows.withColumn("__to", F.col("__base") + F.sum("__n").over(upto))


def rounding_slack(x: Column) -> Column:
    """Allowance for comparing a value with a statistic of the same values.

    A column of summed doubles may differ in its last digits when Spark computes it a second time.
    """
    return F.abs(x) * 1e-12


def interval_index(x: str | Column, breaks: str | Column, clamp_top: bool = False) -> Column:
    """Number of breaks at or below ``x``; the maximum lands one above the last bin unless clamped."""
    x = F.col(x) if isinstance(x, str) else x
    breaks = F.col(breaks) if isinstance(breaks, str) else breaks
    index = F.size(F.filter(breaks, lambda b: b <= x))
    if clamp_top:
        index = F.least(index, F.size(breaks) - 1)
    return F.when(x.isNotNull(), index).cast("long")


def quantile_bins(
    df: DataFrame,
    x: str,
    bins: int,
    out: str,
    by: Sequence[str] = (),
    where: Column | None = None,
    clamp_top: bool = False,
) -> DataFrame:
    """Number the quantile bin of each row; with ``where`` only those rows are cut and numbered."""
    df = reused(df)
    sample = df if where is None else df.where(where)
    cut = exact_quantiles(sample, x, [i / bins for i in range(bins + 1)], by)
    if by:
        df = null_safe_merge(df, cut, by, "left")
    else:
        df = df.withColumn("quantiles", cut.select("quantiles").scalar())
    value = F.col(x).cast("double")
    index = interval_index(value + rounding_slack(value), "quantiles", clamp_top)
    return df.withColumn(out, index if where is None else F.when(where, index)).drop("quantiles")
