"""Least squares by a tall-skinny QR: digits that squared sums lose between nearly collinear columns are kept.

Every task reduces its rows, scaled by the root of their weight, to one triangle of the size of the design; triangles of tasks are stacked
and reduced again in two levels. The last one has the same column lengths and angles as all rows. Columns are taken up in order, and
one of which less than ``tol`` of its own length is left beside the earlier ones is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.models import algebra
from panelmill.models.design import ALL, Design, key_names, prepared
from panelmill.models.linear import NUMBERS

#: Triangles of tasks meet in this many places before the last one; rows reduced at a time.
PLACES = 64
ROWS = 65_536


def triangle(rows: np.ndarray) -> np.ndarray:
    """Upper triangle with the inner products of the columns of ``rows``."""
    width = rows.shape[1]
    if len(rows) < width:
        rows = np.concatenate([rows, np.zeros((width - len(rows), width))])
    return np.linalg.qr(rows, mode="r")


def solve_triangle(r: np.ndarray, tol: float = 1e-7) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(coefficients, inverse of the kept cross products, residual sum of squares, kept); the last column is the outcome."""
    k = r.shape[1] - 1
    length = np.sqrt((r * r).sum(axis=0))
    length[length == 0] = 1.0
    a = r / length
    basis: list[np.ndarray] = []
    kept = np.zeros(k, dtype=bool)
    for j in range(k):
        left = a[:, j].copy()
        # Twice is enough for the rest to stand at right angles to working precision.
        for _ in range(2):
            for q in basis:
                left -= q * (q @ left)
        size = np.sqrt(left @ left)
        if size > tol:
            kept[j] = True
            basis.append(left / size)
    at = np.flatnonzero(kept)
    if not len(at):
        return np.zeros(k), np.zeros((k, k)), float(length[k] ** 2 if r[:, k].any() else 0.0), kept
    q = np.stack(basis, axis=1)
    upper = np.triu(q.T @ a[:, at])
    y = r[:, k]
    goal = q.T @ y
    beta, inverse = np.zeros(k), np.zeros((k, k))
    beta[at] = np.linalg.solve(upper, goal) / length[at]
    back = np.linalg.inv(upper) / length[at][:, None]
    inverse[np.ix_(at, at)] = back @ back.T
    rest = y - q @ goal
    return beta, inverse, float(rest @ rest), kept


def fit_qr(df: DataFrame, d: Design, by: Sequence[str] = (), level: float = 0.95, tol: float = 1e-7) -> DataFrame:
    """(by..., term, estimate, std_error, statistic, p_value, conf_low, conf_high) of a design without factors."""
    if d.factors:
        raise ValueError("absorb factors, or use fit_linear")
    keys, width = key_names(by), len(d.terms) + 2
    rows = prepared(df, d, by, None)
    kept_fields = [f for f in rows.schema.fields if f.name in keys]
    part = T.StructType(list(kept_fields)).add("r", T.ArrayType(T.DoubleType())).add("n", "long")
    schema = T.StructType(list(kept_fields)).add("term", "string")
    for name in NUMBERS:
        schema = schema.add(name, "double")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, tuple[np.ndarray, int]] = {}
        for pdf in batches:
            x = pdf[[f"__x{i}" for i in range(len(d.terms))] + ["__y"]].to_numpy(dtype=float)
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1) * np.sqrt(pdf["__w"].to_numpy(dtype=float))[:, None]
            for key, at in pdf.groupby(keys, sort=False, dropna=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                key = tuple(None if v is None or v != v else v for v in key)
                for k in range(0, len(at), ROWS):
                    block = x[at[k:k + ROWS]]
                    if key in found:
                        block = np.concatenate([found[key][0], block])
                    found[key] = (triangle(block), found.get(key, (None, 0))[1] + len(at[k:k + ROWS]))
        if found:
            yield pd.DataFrame([(*key, r.ravel().tolist(), n) for key, (r, n) in found.items()], columns=part.names)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[keys].head(1).copy()
        out["r"] = [triangle(np.concatenate([np.asarray(r).reshape(width, width) for r in pdf["r"]])).ravel().tolist()]
        out["n"] = int(pdf["n"].sum())
        return out

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        r = triangle(np.concatenate([np.asarray(v).reshape(width, width) for v in pdf["r"]]))
        beta, inverse, rss, kept = solve_triangle(r, tol)
        left = int(pdf["n"].sum()) - int(kept.sum())
        covariance = inverse * (rss / left if left > 0 else np.nan)
        rows = algebra.coefficient_rows(d.names, beta, covariance, kept, left, level)
        out = pd.DataFrame(rows, columns=["term", *NUMBERS])
        for k in reversed(keys):
            out.insert(0, k, pd.Series([pdf[k].iloc[0]] * len(out), dtype=pdf[k].dtype))
        return out

    triangles = rows.mapInPandas(partial, part).withColumn("__place", F.spark_partition_id() % PLACES)
    triangles = triangles.groupBy(*keys, "__place").applyInPandas(merged, part)
    return triangles.groupBy(*keys).applyInPandas(report, schema).drop(ALL)
