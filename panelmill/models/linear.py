"""Least squares, plain or weighted, for the whole frame or per group in one job."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.functions.safe import ratio
from panelmill.models import algebra
from panelmill.models.design import ALL, Design, dense_columns, key_names, linear_predictor, prepared
from panelmill.models.moments import cluster_meat, full_moments, moment_cells
from panelmill.operators.joins import null_safe_merge

NUMBERS = ("estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high")
FIT_FIELDS = (
    "n double, rank int, df_residual double, sigma double, r_squared double, adj_r_squared double,"
    " f_statistic double, beta array<double>, inverse array<double>, kept array<boolean>, shift array<double>"
)


@dataclass(frozen=True)
class LinearFit:
    """One solved row per group; the tables below are read off it lazily."""

    solved: DataFrame
    meat: DataFrame | None
    design: Design
    by: tuple[str, ...]

    def summary(self) -> DataFrame:
        """(by..., n, rank, df_residual, sigma, r_squared, adj_r_squared, f_statistic)"""
        return self.solved.drop("beta", "inverse", "kept", "shift", ALL)

    def coefficients(self, level: float = 0.95, terms: Sequence[str] | None = None) -> DataFrame:
        """(by..., term, estimate, std_error, statistic, p_value, conf_low, conf_high)"""
        names = self.design.names
        wanted = set(terms) if terms is not None else set(names)
        return self._table(lambda *fit: [r for r in algebra.coefficient_rows(names, *fit, level) if r[0] in wanted])

    def combinations(self, combinations: Mapping[str, Mapping[str, float]], level: float = 0.95) -> DataFrame:
        """The same columns for sums of coefficients: ``{"name": {"term": weight}}``, such as an effect at a level of what it interacts with."""
        names = self.design.names
        parts = {n: dict(p) for n, p in combinations.items()}
        return self._table(lambda *fit: algebra.combination_rows(names, parts, *fit, level))

    def _table(self, rows_of) -> DataFrame:
        """``rows_of(beta, covariance, kept, df)`` of every group."""
        keys = key_names(self.by)
        size = len(self.design.names)
        source = self.solved.select(*keys, "n", "rank", "sigma", "beta", "inverse", "kept", "shift")
        robust = self.meat is not None
        if robust:
            meat = self.meat.select(*keys, F.col("m").alias("meat"), F.col("n").alias("clusters"))
            if self.by:
                source = null_safe_merge(source, meat, keys)
            else:
                # A subquery rather than a join: the optimizer need not relate the two deep plans.
                one = meat.select(F.struct("meat", "clusters")).scalar()
                source = source.withColumn("__one", one).select("*", "__one.*").drop("__one")
        schema = T.StructType([f for f in self.solved.schema.fields if f.name in keys])
        schema = schema.add("term", "string")
        for name in NUMBERS:
            schema = schema.add(name, "double")

        def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for _, row in pdf.iterrows():
                    inverse = np.asarray(row["inverse"], dtype=float).reshape(size, size)
                    n, rank = float(row["n"]), int(row["rank"])
                    if robust:
                        meat = np.asarray(row["meat"], dtype=float).reshape(size, size)
                        covariance = algebra.clustered(inverse, meat, float(row["clusters"]), n, rank)
                    else:
                        covariance = inverse * (row["sigma"] ** 2 if n > rank else np.nan)
                    beta, covariance = algebra.uncentred(np.asarray(row["beta"]), covariance, np.asarray(row["shift"]))
                    out = pd.DataFrame(rows_of(beta, covariance, row["kept"], n - rank), columns=["term", *NUMBERS])
                    for k in reversed(keys):
                        out.insert(0, k, pd.Series([row[k]] * len(out), dtype=pdf[k].dtype))
                    yield out

        return source.mapInPandas(report, schema).drop(ALL)


def fit_linear(df: DataFrame, d: Design, by: Sequence[str] = (), cluster: str | None = None) -> LinearFit:
    """Means, then one pass of sums over the rows less the means; with ``cluster`` a further pass for the robust covariance.

    Coefficients are kept for the centred columns and put back when they are read.
    """
    keys = key_names(by)
    rows = prepared(df, d, by, cluster)
    numeric = [f"__x{i}" for i in range(len(d.terms))] + ["__y"]
    means = rows.agg(F.array(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in numeric]).alias("s")).scalar()
    rows = rows.withColumn("__shift", means).withColumns({c: F.col(c) - F.col("__shift")[i] for i, c in enumerate(numeric)}).drop("__shift")
    return centred_fit(rows, d, tuple(by), cluster, means)


def centred_fit(rows: DataFrame, d: Design, by: tuple[str, ...], cluster: str | None, shift: Column, absorbed: int = 0) -> LinearFit:
    """Fit of prepared rows whose columns are less ``shift``; ``absorbed`` degrees of freedom went to factors taken out before.

    With absorbed factors the columns are means-free, so the intercept is zero; its place in the rank is part of ``absorbed``.
    """
    keys = key_names(by)
    dense, w, y = dense_columns(d), F.col("__w"), F.col("__y")
    cells = moment_cells(rows, d, keys, dense, w, [w * x * y for x in dense], w * y * y, F.lit(1))
    full = full_moments(cells, d, keys).withColumn("shift", shift)
    size = len(d.names)
    more = absorbed - 1 if absorbed else 0
    fields = T.StructType([f for f in full.schema.fields if f.name in keys])
    schema = T.StructType([*fields.fields, *T._parse_datatype_string(FIT_FIELDS).fields])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                m = np.asarray(row["m"], dtype=float).reshape(size + 1, size + 1)
                beta, inverse, rss, kept = algebra.sweep(m)
                n, rank = float(row["n"]), int(kept.sum()) + more
                tss = float(m[size, size] - m[0, size] ** 2 / m[0, 0])
                left = n - rank
                r2 = 1 - rss / tss if tss > 0 else np.nan
                out.append({
                    **{k: row[k] for k in keys},
                    "n": n, "rank": rank, "df_residual": left,
                    "sigma": np.sqrt(rss / left) if left > 0 else np.nan,
                    "r_squared": r2,
                    "adj_r_squared": 1 - (1 - r2) * (n - 1) / left if left > 0 else np.nan,
                    "f_statistic": (tss - rss) / (rank - 1) / (rss / left) if left > 0 and rank > 1 and rss > 0 else np.nan,
                    "beta": beta, "inverse": inverse.ravel(), "kept": kept, "shift": row["shift"],
                })
            if out:
                solved = pd.DataFrame(out)
                for k in keys:
                    solved[k] = solved[k].astype(pdf[k].dtype)
                yield solved

    solved = full.mapInPandas(solve, schema)
    meat = None
    if cluster:
        # As a column, the subquery is planned once, however many coefficients are read from it.
        if by:
            rows = null_safe_merge(rows, solved.select(*keys, "beta"), keys)
        else:
            rows = rows.withColumn("beta", solved.select("beta").scalar())
        # Inside the sums, not as a column: next to the renamed regressors, a column made of all of
        # them costs the optimizer time that doubles with every regressor.
        residual = w * (y - linear_predictor(d, F.col("beta")))
        meat = cluster_meat(rows, d, keys, residual, dense)
    return LinearFit(solved, meat, d, tuple(by))


def fit_lines(df: DataFrame, x: str, y: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by..., n, slope, intercept, slope_se): the straight line under a scatter, per group.

    A one-regressor fit in closed form over columns less their means, so it stays built-in aggregation.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), w.alias("w"))
    rows = rows.dropna(subset=["x", "y", "w"]).where(F.col("w") != 0)
    means = rows.agg(F.struct(F.avg("x").alias("x"), F.avg("y").alias("y")).alias("m")).scalar()
    rows = rows.withColumn("m", means).select(*by, (F.col("x") - F.col("m.x")).alias("x"), (F.col("y") - F.col("m.y")).alias("y"), "w")
    x_, y_, w_ = F.col("x"), F.col("y"), F.col("w")
    sums: dict[str, Column] = {
        "n": F.count(F.lit(1)), "sw": F.sum(w_), "sx": F.sum(w_ * x_), "sy": F.sum(w_ * y_),
        "sxx": F.sum(w_ * x_ * x_), "sxy": F.sum(w_ * x_ * y_), "syy": F.sum(w_ * y_ * y_),
    }
    s = rows.groupBy(*by).agg(*[v.alias(k) for k, v in sums.items()])
    sxx = F.col("sxx") - ratio(F.col("sx") * F.col("sx"), "sw")
    sxy = F.col("sxy") - ratio(F.col("sx") * F.col("sy"), "sw")
    syy = F.col("syy") - ratio(F.col("sy") * F.col("sy"), "sw")
    s = s.withColumn("m", means).withColumns({"sxx": sxx, "sxy": sxy, "syy": syy}).withColumn("slope", ratio("sxy", "sxx"))
    rss = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    left = F.when(F.col("n") > 2, F.col("n") - 2)
    return s.select(
        *by, "n", "slope",
        (ratio(F.col("sy") - F.col("slope") * F.col("sx"), "sw") + F.col("m.y") - F.col("slope") * F.col("m.x")).alias("intercept"),
        F.sqrt(ratio(ratio(rss, left), "sxx")).alias("slope_se"),
    )
