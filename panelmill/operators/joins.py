"""Equi-joins with explicit suffixes and null handling.

No broadcast hints are given: Spark broadcasts a side only when its size estimate, or its measured
size under adaptive execution, is below the session threshold; otherwise it shuffles and splits
skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions.safe import ratio
from panelmill.session import reused


def merge(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Equi-join on shared names; other shared names get the suffixes. Outer keys are coalesced."""
    keys = list(on)
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return left.join(right, keys, how)


def natural_merge(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on every column name the two frames share."""
    return left.join(right, [c for c in left.columns if c in right.columns], how)


def null_safe_merge(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which a null key matches a null key; keys come from the left side."""
    keys = list(on)
    hidden = {k: f"__right_{k}" for k in keys}
    right = right.withColumnsRenamed(hidden)
    test = reduce(Column.__and__, [left[k].eqNullSafe(right[h]) for k, h in hidden.items()])
    return left.join(right, test, how).drop(*hidden.values())


def members(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``other``."""
    return df.join(other.select(*on), list(on), "left_semi")


def non_members(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in ``other``."""
    return df.join(other.select(*on), list(on), "left_anti")


def with_role(dim: DataFrame, key: str, role_key: str, **columns: str) -> DataFrame:
    """Dimension renamed for one of several roles: ``columns`` maps new names to old ones."""
    return dim.select(F.col(key).alias(role_key), *[F.col(old).alias(new) for new, old in columns.items()])


def shift_key(df: DataFrame, key: str, by: int) -> DataFrame:
    """Move an integer period key, so that an ordinary join attaches another period's row."""
    return df.withColumn(key, F.col(key) + by)


def deflate(df: DataFrame, prices: DataFrame, on: str, value: str, index: str) -> DataFrame:
    """Divide ``value`` by the price index of its period; periods without an index are dropped."""
    return df.join(prices.select(on, index), on).withColumn(value, ratio(value, index)).drop(index)


def prefix_key(code: Column, length: int = 5, filler: str = "0") -> Column:
    return F.concat(F.left(code, F.lit(length)), F.lit(filler))


def crosswalk_scores(
    scores: DataFrame, links: DataFrame, code: str, score: str, target: str, length: int = 5
) -> DataFrame:
    """Mean score per target code.

    Codes present on both sides match exactly. What is left on either side is matched again on the
    code's leading characters, with the mean score of the left-over codes sharing them.
    """
    scores = reused(scores.groupBy(code).agg(F.avg(score).alias(score)))
    known = F.col(code).isNotNull() & F.col(target).isNotNull()
    # Repeated links become one row with their number, which then weighs in the mean.
    links = reused(links.where(known).groupBy(code, target).agg(F.count(F.lit(1)).alias("__times")))
    near = prefix_key(F.col(code), length)
    spare = non_members(scores, links, [code]).groupBy(near.alias("__near")).agg(F.avg(score).alias("__spare"))
    # Exact links and left-over ones are joined apart, so no row carries an empty key.
    usable = scores.where(F.col(score).isNotNull())
    exact = links.join(usable, code).select(target, "__times", score)
    rest = non_members(links, usable, [code]).withColumn("__near", near).join(spare, "__near")
    both = exact.unionByName(rest.select(target, "__times", F.col("__spare").alias(score)))
    mean = ratio(F.sum(F.col(score) * F.col("__times")), F.sum("__times"))
    return both.where(F.col(score).isNotNull()).groupBy(target).agg(mean.alias(score))
