"""Fits with absorbed factors: effects of millions of levels are taken out without dummies.

Rows are reduced once to cells, one per combination of levels met, with the weight and the weighted sums of all columns. One
factor's effects are the means of its levels. The effects of several solve the weighted normal equations of all levels, found by
conjugate gradients scaled by the weight of each level: a step joins each factor's current direction to the cells and sums the cells
by level again. What is kept between steps is one table of levels, staged in the shared folder; the driver sees two numbers per
column and step. All columns are solved at once.

The rows less their effects are then fitted like any others. Degrees of freedom count every level once, less the levels that another
factor explains: for two factors one for each set of levels that cells connect; a further factor is taken to explain one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.models.design import ALL, Design, prepared
from panelmill.models.family import fit_family
from panelmill.models.linear import LinearFit, centred_fit
from panelmill.session import reused, staged

#: A column counts as explained by the factors when this share of its spread, or less, is left of every value.
LEFT = 1e-10


@dataclass(frozen=True)
class Absorbed:
    """``effects[f]`` has (f, e): for each level the effect on every column."""

    effects: dict[str, DataFrame]
    rank: int
    rounds: int


@dataclass(frozen=True)
class WithinFit:
    fit: LinearFit
    absorbed: Absorbed
    shift: tuple[float, ...]

    def coefficients(self, level: float = 0.95, terms: Sequence[str] | None = None) -> DataFrame:
        """(term, estimate, std_error, statistic, p_value, conf_low, conf_high) of the slopes."""
        return self.fit.coefficients(level, list(self.fit.design.terms) if terms is None else terms)

    def summary(self) -> DataFrame:
        """(n, rank, df_residual, sigma, r_squared, ...): shares of variance are within levels."""
        return self.fit.summary()

    def effects(self, factor: str) -> DataFrame:
        """(factor, effect): a fitted value is the sum of its levels' effects and of slopes times columns.

        The constant is part of the first factor's effects.
        """
        beta = self.fit.solved.select("beta").scalar()
        terms = range(len(self.fit.design.terms))
        gap = lambda at: reduce(Column.__sub__, [F.col("e")[i] * beta[i + 1] for i in terms], F.col("e")[at])
        effect = gap(len(terms))
        if factor == next(iter(self.absorbed.effects)):
            *means, last = self.shift
            effect = effect + F.lit(last) - sum((beta[i + 1] * F.lit(m) for i, m in enumerate(means)), F.lit(0.0))
        return self.absorbed.effects[factor].select(factor, effect.alias("effect"))


def _cells(rows: DataFrame, columns: Sequence[str], factors: Sequence[str]) -> DataFrame:
    w = F.col("__w")
    sums = F.array(*[F.sum(w * F.col(c)) for c in columns])
    return rows.groupBy(*factors).agg(F.sum(w).alias("__sw"), sums.alias("__s"))


def _connected(pairs: DataFrame, one: str, other: str) -> int:
    """Number of sets of levels of two factors that cells connect: each level takes the smallest label in reach, and that one's label."""
    labels = pairs.select(one).distinct().withColumn("label", F.col(one))
    changed = True
    while changed:
        there = pairs.join(labels, one).groupBy(other).agg(F.min("label").alias("label"))
        back = staged(pairs.join(there, other).groupBy(one).agg(F.min("label").alias("near")), "labels")
        far = back.select(F.col(one).alias("near"), F.col("near").alias("next"))
        both = staged(labels.join(back, one).join(far, "near"), "labels")
        changed = both.where("next < label").limit(1).count() > 0
        labels = both.select(one, F.col("next").alias("label"))
    return labels.select("label").distinct().count()


def _dots(table: DataFrame, value, size: int) -> list[float]:
    return [float(x or 0.0) for x in table.agg(*[F.sum(value(i)) for i in range(size)]).first()]


def _solved(cells: DataFrame, ids: Sequence[str], size: int, tol: float, max_rounds: int) -> tuple[DataFrame, int]:
    """(id, e) of all levels, and the number of steps; ``cells`` are (ids, __sw, __s)."""
    each = lambda value: cells.select(F.explode(F.array(*ids)).alias("id"), *value).groupBy("id")
    sums = each(["__sw", "__s"]).agg(F.sum("__sw").alias("d"), F.array(*[F.sum(F.col("__s")[i]) for i in range(size)]).alias("r"))
    blank = F.array(*[F.lit(0.0)] * size)
    state = staged(sums.select("id", "d", blank.alias("x"), "r", F.transform("r", lambda r: r / F.col("d")).alias("p")), "levels")
    rz = start = _dots(state, lambda i: F.col("r")[i] * F.col("r")[i] / F.col("d"), size)
    for done in range(max_rounds + 1):
        if all(z <= tol * tol * s for z, s in zip(rz, start)):
            return state.select("id", F.col("x").alias("e")), done
        met = cells
        for k, name in enumerate(ids):
            met = met.join(state.select(F.col("id").alias(name), F.col("p").alias(f"__p{k}")), name)
        total = F.array(*[F.col("__sw") * reduce(Column.__add__, [F.col(f"__p{k}")[i] for k in range(len(ids))]) for i in range(size)])
        q = met.select(F.explode(F.array(*ids)).alias("id"), total.alias("t")).groupBy("id").agg(F.array(*[F.sum(F.col("t")[i]) for i in range(size)]).alias("q"))
        state = staged(state.join(q, "id"), "levels")
        pq = _dots(state, lambda i: F.col("p")[i] * F.col("q")[i], size)
        alpha = [z / v if v > 0 else 0.0 for z, v in zip(rz, pq)]
        go = lambda name, i, step, by: F.col(name)[i] + F.lit(step[i]) * F.col(by)[i]
        state = state.withColumn("x", F.array(*[go("x", i, alpha, "p") for i in range(size)]))
        state = state.withColumn("r", F.array(*[go("r", i, [-a for a in alpha], "q") for i in range(size)]))
        last, rz = rz, _dots(state, lambda i: F.col("r")[i] * F.col("r")[i] / F.col("d"), size)
        beta = [z / v if v > 0 else 0.0 for z, v in zip(rz, last)]
        state = state.select("id", "d", "x", "r", F.array(*[F.col("r")[i] / F.col("d") + F.lit(beta[i]) * F.col("p")[i] for i in range(size)]).alias("p"))
    raise ValueError(f"effects are not found in {max_rounds} steps")


def absorb(rows: DataFrame, columns: Sequence[str], factors: Sequence[str], tol: float = 1e-12, max_rounds: int = 500) -> Absorbed:
    """Effects of the levels of ``factors`` on ``columns``; steps end when no more than ``tol`` of what they began with is left."""
    size = len(columns)
    cells = staged(_cells(rows, columns, factors), "cells")
    first, *rest = factors
    if not rest:
        means = F.transform("__s", lambda s: s / F.col("__sw"))
        return Absorbed({first: cells.select(first, means.alias("e"))}, cells.count(), 0)
    counts, ids = {}, [f"__id{k}" for k in range(len(factors))]
    for k, (f, name) in enumerate(zip(factors, ids)):
        levels = staged(cells.select(f).distinct().withColumn(name, F.monotonically_increasing_id() * len(factors) + k), "level")
        counts[f] = (levels, levels.count())
        cells = cells.join(levels, f)
    cells = staged(cells.select(*ids, "__sw", "__s"), "cells")
    effects, rounds = _solved(cells, ids, size, tol, max_rounds)
    effects = staged(effects, "effects")
    rank = counts[first][1] + sum(counts[f][1] - 1 for f in rest) + 1 - _connected(cells, ids[0], ids[1])
    named = {f: counts[f][0].join(effects.withColumnRenamed("id", name), name).select(f, "e") for f, name in zip(factors, ids)}
    return Absorbed(named, rank, rounds)


def _cleaned(df: DataFrame, d: Design, factors: Sequence[str], cluster: str | None, tol: float) -> tuple[DataFrame, Absorbed, list[float]]:
    """Prepared rows less their effects, the effects, and the means taken off before."""
    if d.factors:
        raise ValueError("name factors to absorb, not in the design")
    rows = reused(prepared(df, d, list(factors), cluster), "within")
    rows = rows.dropna(subset=list(factors))
    columns = [*(f"__x{i}" for i in range(len(d.terms))), "__y"]
    w = F.col("__w")
    found = rows.agg(*[F.sum(w * F.col(c)) / F.sum(w) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    shift = [float(m or 0.0) for m in found[:len(columns)]]
    spread = [float(s or 0.0) for s in found[len(columns):]]
    rows = rows.withColumns({c: F.col(c) - F.lit(m) for c, m in zip(columns, shift)})
    taken = absorb(rows, columns, factors, tol)
    for f, table in taken.effects.items():
        rows = rows.join(table.withColumnRenamed("e", f"__e_{f}"), f)
    left = {c: reduce(Column.__sub__, [F.col(f"__e_{f}")[i] for f in factors], F.col(c)) for i, c in enumerate(columns)}
    limits = {c: F.when(F.abs(left[c]) > LEFT * s, left[c]).otherwise(0.0) for c, s in zip(columns, spread)}
    clean = rows.select(*[limits[c].alias(c) for c in columns], "__w", F.lit(1).alias(ALL), *(["__c"] if cluster else []))
    return clean, taken, shift


def fit_within(df: DataFrame, d: Design, factors: Sequence[str], cluster: str | None = None, tol: float = 1e-12) -> WithinFit:
    """Least squares with the effects of ``factors`` taken out; slopes and their inference are those of a fit with all dummies.

    Rows with a missing part, a missing level included, are left out. ``d`` has no factors of its own. A term that the factors explain is
    reported with null estimates.
    """
    clean, taken, shift = _cleaned(df, d, factors, cluster, tol)
    zero = F.array(*[F.lit(0.0)] * len(shift))
    return WithinFit(centred_fit(clean, d, (), cluster, zero, taken.rank), taken, tuple(shift))


def fit_within_family(df: DataFrame, designs: Mapping[str, Design], factors: Sequence[str], cluster: str | None = None, tol: float = 1e-12) -> DataFrame:
    """(model, term, estimate, std_error, ...) of several designs, the effects of all their columns being found at once.

    All models are fitted on the rows that lack none of their columns, under one weight.
    """
    first = next(iter(designs.values()))
    if len({d.weight for d in designs.values()}) > 1:
        raise ValueError("models with absorbed factors share one weight")
    columns = list(dict.fromkeys(c for d in designs.values() for c in (*d.terms, d.outcome)))
    clean, taken, _ = _cleaned(df, Design(columns[-1], tuple(columns[:-1]), weight=first.weight), factors, cluster, tol)
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    held = [F.col(f"__x{i}" if i < len(columns) - 1 else "__y").alias(n) for i, n in enumerate(names.values())]
    clean = staged(clean.select(*held, F.col("__w").alias("w"), *(["__c"] if cluster else [])), "clean")
    plain = {n: Design(names[d.outcome], tuple(names[t] for t in d.terms), weight="w") for n, d in designs.items()}
    table = fit_family(clean, plain, cluster="__c" if cluster else None, absorbed=taken.rank)
    back = F.create_map(*[F.lit(x) for pair in ((n, c) for c, n in names.items()) for x in pair])
    return table.where("term <> '(Intercept)'").withColumn("term", back[F.col("term")])
