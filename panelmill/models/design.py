"""Model designs: numeric terms, interactions, dummy-coded factors, complete cases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERCEPT = "(Intercept)"
ALL = "__all"


@dataclass(frozen=True)
class Factor:
    """A categorical regressor; the first level is the reference."""

    column: str
    levels: tuple


@dataclass(frozen=True)
class Design:
    outcome: str
    terms: tuple[str, ...]
    factors: tuple[Factor, ...] = ()
    weight: str | None = None

    @property
    def names(self) -> list[str]:
        dummies = [f"{f.column}={level}" for f in self.factors for level in f.levels[1:]]
        return [INTERCEPT, *self.terms, *dummies]

    @property
    def offsets(self) -> list[int]:
        """Position before each factor's first dummy, so that level ``l`` sits at offset + l."""
        at, out = len(self.terms), []
        for f in self.factors:
            out.append(at)
            at += len(f.levels) - 1
        return out


def design(
    outcome: str, *parts: str, factors: Mapping[str, Sequence] | None = None, weight: str | None = None
) -> Design:
    """``design("y", "a*b", "c")`` has the terms a, b, c and a:b; interactions come last."""
    mains: list[str] = []
    products: list[str] = []
    for part in parts:
        names = part.split("*")
        mains += [n for n in names if n not in mains]
        for size in range(2, len(names) + 1):
            products += [t for t in (":".join(c) for c in combinations(names, size)) if t not in products]
    made = tuple(Factor(c, tuple(levels)) for c, levels in (factors or {}).items())
    return Design(outcome, (*mains, *products), made, weight)


def design_all(df: DataFrame, outcome: str, exclude: Sequence[str] = ()) -> Design:
    """Every other column as a regressor."""
    return design(outcome, *[c for c in df.columns if c != outcome and c not in exclude])


def factor_levels(df: DataFrame, column: str, limit: int = 2000) -> list:
    """Sorted levels of a factor; only this bounded list reaches the driver."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"factor {column!r} has more than {limit} levels")
    return sorted(r[0] for r in rows)


def term_column(term: str) -> Column:
    return reduce(Column.__mul__, [F.col(n).cast("double") for n in term.split(":")])


def level_index(f: Factor) -> Column:
    """0 for the reference level, 1.. for the others, null for unknown values."""
    at = F.array_position(F.array(*[F.lit(v) for v in f.levels]), F.col(f.column)) - 1
    return F.when(at >= 0, at).cast("int")


def prepared(df: DataFrame, d: Design, by: Sequence[str], cluster: str | None, outcome: bool = True) -> DataFrame:
    """Only what a fit reads, rows with any missing part dropped; zero-weight rows do not count."""
    keys = [F.col(c) for c in by] or [F.lit(1).alias(ALL)]
    parts = [term_column(t).alias(f"__x{i}") for i, t in enumerate(d.terms)]
    parts += [level_index(f).alias(f"__f{i}") for i, f in enumerate(d.factors)]
    if outcome:
        parts.append(F.col(d.outcome).cast("double").alias("__y"))
    parts.append((F.col(d.weight).cast("double") if d.weight else F.lit(1.0)).alias("__w"))
    if cluster:
        parts.append(F.col(cluster).alias("__c"))
    out = df.select(*keys, *parts)
    return out.dropna(subset=[c for c in out.columns if c.startswith("__")]).where(F.col("__w") != 0)


def key_names(by: Sequence[str]) -> list[str]:
    return list(by) or [ALL]


def dense_columns(d: Design) -> list[Column]:
    return [F.lit(1.0), *[F.col(f"__x{i}") for i in range(len(d.terms))]]


def factor_columns(d: Design) -> list[str]:
    return [f"__f{i}" for i in range(len(d.factors))]


def linear_predictor(d: Design, beta: Column) -> Column:
    """Sum of coefficients times columns; a factor picks one array element."""
    total = reduce(Column.__add__, [beta[i] * x for i, x in enumerate(dense_columns(d))])
    for f, offset in zip(factor_columns(d), d.offsets):
        total = total + F.when(F.col(f) == 0, 0.0).otherwise(F.get(beta, F.col(f) + offset))
    return total
