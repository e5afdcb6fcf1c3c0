"""Logistic regression with inference, for the whole frame or for many groups at once.

Each Newton step is one Spark aggregation over a table staged in the shared folder. For the whole frame the gradient and Hessian
block reaches the driver. Of many groups nothing does: their coefficients are a table keyed by group, joined to the rows;
a step solves all groups in the tasks that hold their blocks, groups that have converged leave the table, and the driver sees how many are
left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.models import algebra
from panelmill.models.design import (
    Design, dense_columns, factor_columns, key_names, level_index, linear_predictor, prepared, term_column,
)
from panelmill.models.linear import NUMBERS
from panelmill.models.moments import cluster_meat, full_block, full_moments, moment_cells
from panelmill.operators.joins import null_safe_merge
from panelmill.session import staged


@dataclass
class GroupFit:
    beta: np.ndarray
    inverse: np.ndarray | None = None
    kept: np.ndarray | None = None
    deviance: float = math.inf
    n: float = 0.0
    iterations: int = 0
    converged: bool = False
    previous: np.ndarray | None = None
    meat: np.ndarray | None = None
    clusters: float = 0.0
    # The largest fitted log odds; huge values mean the outcome is separable.
    reach: float = 0.0


@dataclass(frozen=True)
class LogitFit:
    """Fit of the whole frame."""

    spark: SparkSession
    design: Design
    found: GroupFit
    # Taken off the terms during the fit; the coefficients are those of the centred terms.
    shift: np.ndarray

    def coefficients(self, level: float = 0.95, terms: Sequence[str] | None = None) -> DataFrame:
        """(term, estimate, std_error, statistic, p_value, conf_low, conf_high), normal tails."""
        g, names = self.found, self.design.names
        wanted = set(terms) if terms is not None else set(names)
        rows = [r for r in _coefficient_rows(names, vars(g), self.shift, level) if r[0] in wanted] if g.inverse is not None else []
        return self.spark.createDataFrame(rows, "term string, " + ", ".join(f"{c} double" for c in NUMBERS))

    def summary(self) -> DataFrame:
        g = self.found
        rows = [(g.n, int(g.kept.sum()), g.deviance, g.iterations, g.converged, g.reach > 30)] if g.inverse is not None else []
        return self.spark.createDataFrame(rows, "n double, rank int, deviance double, iterations int, converged boolean, separable boolean")

    def predict(self, df: DataFrame, out: str, link: bool = False) -> DataFrame:
        """Fitted probability (or log odds) of each row; null where a regressor is missing."""
        blank = np.zeros((len(self.design.names),) * 2)
        beta = algebra.uncentred(self.found.beta, blank, self.shift)[0]
        return _predicted(df.withColumn("__beta", F.array(*[F.lit(float(b)) for b in beta])), self.design, out, link)


@dataclass(frozen=True)
class GroupedLogitFit:
    """One row per group in ``state``: coefficients of terms centred at the group's own means."""

    state: DataFrame
    meat: DataFrame | None
    design: Design
    by: tuple[str, ...]

    def coefficients(self, level: float = 0.95, terms: Sequence[str] | None = None) -> DataFrame:
        """(by..., term, estimate, std_error, statistic, p_value, conf_low, conf_high), normal tails."""
        keys, names = list(self.by), self.design.names
        size = len(names)
        wanted = set(terms) if terms is not None else set(names)
        source, robust = self.state, self.meat is not None
        if robust:
            meat = self.meat.select(*keys, F.col("m").alias("meat"), F.col("n").alias("clusters"))
            source = null_safe_merge(source.drop("meat", "clusters"), meat, keys)
        schema = T.StructType([f for f in self.state.schema.fields if f.name in keys]).add("term", "string")
        for name in NUMBERS:
            schema = schema.add(name, "double")

        def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for row in pdf.to_dict("records"):
                    g = {**row, "beta": np.asarray(row["beta"]), "inverse": np.asarray(row["inverse"]).reshape(size, size), "kept": np.asarray(row["kept"]), "meat": None}
                    if robust:
                        g["meat"] = np.asarray(row["meat"]).reshape(size, size)
                    out += [(*(row[k] for k in keys), *r) for r in _coefficient_rows(names, g, np.asarray(row["shift"]), level) if r[0] in wanted]
                table = pd.DataFrame(out, columns=schema.names)
                for k in keys:
                    table[k] = table[k].astype(pdf[k].dtype)
                yield table

        return source.mapInPandas(report, schema)

    def summary(self) -> DataFrame:
        """(by..., n, rank, deviance, iterations, converged, separable)"""
        rank = F.size(F.filter("kept", lambda k: k))
        return self.state.select(*self.by, "n", rank.alias("rank"), "deviance", "iterations", "converged", (F.col("reach") > 30).alias("separable"))

    def predict(self, df: DataFrame, out: str, link: bool = False) -> DataFrame:
        """Fitted probability (or log odds) of each row; null where a regressor is missing."""
        raw = F.expr("transform(beta, (b, i) -> if(i = 0, b - aggregate(zip_with(slice(beta, 2, size(shift) - 1), slice(shift, 1, size(shift) - 1), (x, m) -> x * m), 0D, (a, v) -> a + v), b))")
        ready = null_safe_merge(df, self.state.select(*self.by, raw.alias("__beta")), list(self.by))
        return _predicted(ready, self.design, out, link)


def _coefficient_rows(names, g: dict, shift: np.ndarray, level: float) -> list[tuple]:
    covariance = g["inverse"]
    if g["meat"] is not None:
        covariance = algebra.clustered(g["inverse"], g["meat"], g["clusters"], g["n"], int(g["kept"].sum()))
    beta, covariance = algebra.uncentred(g["beta"], covariance, shift)
    return algebra.coefficient_rows(names, beta, covariance, g["kept"], None, level)


def _predicted(ready: DataFrame, d: Design, out: str, link: bool) -> DataFrame:
    ready = ready.withColumns({
        **{f"__x{i}": term_column(t) for i, t in enumerate(d.terms)}, **{f"__f{i}": level_index(f) for i, f in enumerate(d.factors)},
    })
    eta = linear_predictor(d, F.col("__beta"))
    scored = ready.withColumn(out, eta if link else 1.0 / (1.0 + F.exp(-eta)))
    return scored.drop("__beta", *[c for c in ready.columns if c.startswith(("__x", "__f"))])


def _patterns(rows: DataFrame, d: Design, keys: list[str], cluster: bool) -> DataFrame:
    """Rows with equal regressors as one row of trials and successes: the same likelihood."""
    same = [*keys, *[f"__x{i}" for i in range(len(d.terms))], *factor_columns(d), *(["__c"] if cluster else [])]
    return rows.groupBy(*same).agg(F.count(F.lit(1)).cast("double").alias("__n"), F.sum("__y").alias("__s"))


def fit_logit(
    df: DataFrame,
    d: Design,
    by: Sequence[str] = (),
    cluster: str | None = None,
    patterns: bool = False,
    max_iter: int = 30,
    eps: float = 1e-11,
) -> LogitFit | GroupedLogitFit:
    """Unpenalised maximum likelihood of a 0/1 outcome, for each group of ``by`` or for all rows.

    ``patterns=True`` first counts rows with equal regressors, which shrinks the staged table when
    regressors are codes or area-level values. ``cluster`` gives a cluster-robust covariance.
    """
    if d.weight:
        raise ValueError("weights are not supported for a 0/1 outcome")
    keys, by = key_names(by), list(by)
    rows = prepared(df, d, by, cluster).drop("__w")
    if patterns:
        rows = _patterns(rows, d, keys, cluster is not None)
    else:
        rows = rows.withColumn("__n", F.lit(1.0)).withColumnRenamed("__y", "__s")
    rows = staged(rows, "logit")
    if by:
        return _fit_groups(rows, d, by, cluster, max_iter, eps)
    numeric = [f"__x{i}" for i in range(len(d.terms))]
    means = rows.agg(*[F.avg(c) for c in numeric]).first() if numeric else []
    shift = np.array([*(m or 0.0 for m in means), 0.0])
    rows = rows.withColumns({c: F.col(c) - float(m) for c, m in zip(numeric, shift)}) if numeric else rows
    size, dense = len(d.names), dense_columns(d)
    g = GroupFit(np.zeros(size))
    beside = lambda: _scored(rows.withColumn("__beta", F.array(*[F.lit(float(b)) for b in g.beta])), d)
    for step in range(1, max_iter + 1):
        found = list(_collected(_step_cells(beside(), d, keys), d, keys))
        if not found:
            return LogitFit(df.sparkSession, d, g, shift)
        ((_, full, n_rows),) = found
        _newton(g, full, n_rows, step, eps)
        if g.converged:
            break
    g.reach = float(beside().agg(F.max(F.abs("__eta")).alias("r")).first()["r"] or 0.0)
    if cluster:
        scored = beside().withColumn("__u", F.col("__s") - F.col("__n") * F.col("__mu"))
        row = cluster_meat(scored, d, keys, F.col("__u"), dense).first()
        g.meat, g.clusters = np.asarray(row["m"], dtype=float).reshape(size, size), row["n"]
    return LogitFit(df.sparkSession, d, g, shift)


STATE = (
    "shift array<double>, beta array<double>, previous array<double>, inverse array<double>, kept array<boolean>,"
    " deviance double, n double, iterations int, converged boolean"
)


def _fit_groups(rows: DataFrame, d: Design, by: list[str], cluster: str | None, max_iter: int, eps: float) -> GroupedLogitFit:
    """Newton steps of all groups at once; the table of groups is staged after every step, and what has converged is set aside."""
    size, terms = len(d.names), len(d.terms)
    dense = dense_columns(d)
    fields = T.StructType([f for f in rows.schema.fields if f.name in by])
    schema = T.StructType([*fields.fields, *T._parse_datatype_string(STATE).fields])
    blank = F.array(*[F.lit(0.0)] * size)
    means = F.array(*[F.coalesce(F.avg(f"__x{i}"), F.lit(0.0)) for i in range(terms)], F.lit(0.0))
    active = rows.groupBy(*by).agg(means.alias("shift")).select(
        *by, "shift", blank.alias("beta"), F.lit(None).cast("array<double>").alias("previous"), F.lit(None).cast("array<double>").alias("inverse"),
        F.lit(None).cast("array<boolean>").alias("kept"), F.lit(float("inf")).alias("deviance"), F.lit(0.0).alias("n"),
        F.lit(0).alias("iterations"), F.lit(False).alias("converged"),
    )

    def beside(state: DataFrame) -> DataFrame:
        ready = null_safe_merge(rows, state.select(*by, F.col("beta").alias("__beta"), F.col("shift").alias("__shift")), by)
        ready = ready.withColumns({f"__x{i}": F.col(f"__x{i}") - F.col("__shift")[i] for i in range(terms)}) if terms else ready
        return _scored(ready, d)

    def newton(step: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for row in pdf.to_dict("records"):
                    g = GroupFit(np.asarray(row["beta"], dtype=float), deviance=row["deviance"], n=row["n"], iterations=row["iterations"])
                    g.previous = None if row["previous"] is None else np.asarray(row["previous"], dtype=float)
                    g.inverse = None if row["inverse"] is None else np.asarray(row["inverse"], dtype=float).reshape(size, size)
                    g.kept = None if row["kept"] is None else np.asarray(row["kept"])
                    _newton(g, np.asarray(row["m"], dtype=float).reshape(size + 1, size + 1), row["rows"], step, eps)
                    out.append({
                        **{k: row[k] for k in by}, "shift": row["shift"], "beta": g.beta, "previous": g.previous,
                        "inverse": None if g.inverse is None else g.inverse.ravel(), "kept": g.kept, "deviance": g.deviance, "n": g.n,
                        "iterations": g.iterations, "converged": g.converged,
                    })
                if out:
                    table = pd.DataFrame(out, columns=schema.names)
                    for k in by:
                        table[k] = table[k].astype(pdf[k].dtype)
                    yield table

        return run

    active = staged(active, "groups")
    finished: list[DataFrame] = []
    for step in range(1, max_iter + 1):
        blocks = full_moments(_step_cells(beside(active), d, by), d, by).withColumnRenamed("n", "rows")
        moved = staged(null_safe_merge(active, blocks, by).mapInPandas(newton(step), schema), "groups")
        finished.append(moved.where("converged"))
        active = moved.where("not converged")
        if active.limit(1).count() == 0:
            break
    else:
        finished.append(active)
    state = reduce(DataFrame.unionByName, finished)
    reach = beside(state).groupBy(*by).agg(F.max(F.abs("__eta")).alias("reach"))
    state = staged(null_safe_merge(state, reach, by), "groups")
    meat = None
    if cluster:
        scored = beside(state).withColumn("__u", F.col("__s") - F.col("__n") * F.col("__mu"))
        meat = cluster_meat(scored, d, by, F.col("__u"), dense)
    return GroupedLogitFit(state, meat, d, tuple(by))


def _collected(cells: DataFrame, d: Design, keys: list[str]):
    """(key, full matrix, row count); without factors there is one row already."""
    size = len(d.names) + 1
    if d.factors:
        for row in full_moments(cells, d, keys).collect():
            yield tuple(row[k] for k in keys), np.asarray(row["m"], dtype=float).reshape(size, size), row["n"]
        return
    for row in cells.collect():
        yield tuple(row[k] for k in keys), full_block(pd.DataFrame({"m": [row["m"]]}), d), row["n"]


def _scored(rows: DataFrame, d: Design) -> DataFrame:
    scored = rows.withColumn("__eta", linear_predictor(d, F.col("__beta")))
    return scored.withColumn("__mu", 1.0 / (1.0 + F.exp(-F.col("__eta"))))


def _step_cells(scored: DataFrame, d: Design, keys: Sequence[str]) -> DataFrame:
    """Hessian, gradient and deviance of scored rows, one cell per combination of factor levels."""
    mu, n, s = F.col("__mu"), F.col("__n"), F.col("__s")
    gap = s - n * mu
    dense = dense_columns(d)
    return moment_cells(scored, d, keys, dense, n * mu * (1 - mu), [gap * x for x in dense], _deviance(s, n, mu), n)


def _deviance(s: Column, n: Column, mu: Column) -> Column:
    """Minus twice the log likelihood; probabilities are kept off 0 and 1 for the logarithms."""
    p = F.least(F.greatest(mu, F.lit(1e-300)), F.lit(1 - 1e-16))
    return -2.0 * (s * F.log(p) + (n - s) * F.log1p(-p))


def _newton(g: GroupFit, full: np.ndarray, n: float, step: int, eps: float) -> None:
    """Move the coefficients one step, or mark the group as converged and leave them."""
    if g.converged:
        return
    deviance = float(full[-1, -1])
    if g.previous is not None and deviance > g.deviance + 1e-9 * (abs(g.deviance) + 0.1):
        g.beta = (g.beta + g.previous) / 2
        return
    move, g.inverse, _, g.kept = algebra.sweep(full)
    g.converged = abs(g.deviance - deviance) < eps * (abs(deviance) + 0.1)
    g.deviance, g.n, g.iterations = deviance, float(n), step
    if not g.converged:
        g.previous, g.beta = g.beta, g.beta + move
