"""Cross-product matrices as Spark aggregations.

Rows are reduced by built-in sums to one cell per combination of factor levels; a cell carries the
cross products of the numeric columns only. The dummy rows and columns of the full matrix follow
from the cells, so wide designs need no wide rows. Only cells reach Python.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.models.design import Design, factor_columns


def upper_pairs(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


def moment_cells(
    rows: DataFrame, d: Design, keys: Sequence[str], dense: Sequence[Column], weight: Column,
    against: Sequence[Column], last: Column, count: Column,
) -> DataFrame:
    """One row per (keys, factor levels): summed products of ``dense`` with each other under
    ``weight``, then with the outcome (``against``), then ``last`` for the outcome itself."""
    size = len(dense) + 1
    products = []
    for i, j in upper_pairs(size):
        if j < size - 1:
            products.append(F.sum(weight * dense[i] * dense[j]))
        else:
            products.append(F.sum(last if i == j else against[i]))
    return rows.groupBy(*keys, *factor_columns(d)).agg(F.array(*products).alias("m"), F.sum(count).alias("n"))


def block_schema(cells: DataFrame, keys: Sequence[str]) -> T.StructType:
    kept = [f for f in cells.schema.fields if f.name in keys]
    return T.StructType([*kept, T.StructField("m", T.ArrayType(T.DoubleType())), T.StructField("n", T.DoubleType())])


def full_block(part: pd.DataFrame, d: Design) -> np.ndarray:
    """Matrix over (intercept, terms, dummies, outcome) from the cells of one group."""
    dense = len(d.terms) + 1
    width = len(d.names) + 1
    values = np.stack([np.asarray(v, dtype=float) for v in part["m"]])
    cell = np.zeros((len(part), dense + 1, dense + 1))
    for p, (i, j) in enumerate(upper_pairs(dense + 1)):
        cell[:, i, j] = cell[:, j, i] = values[:, p]
    slots = np.array([*range(dense), width - 1])
    full = np.zeros((width, width))
    full[np.ix_(slots, slots)] = cell.sum(axis=0)
    # A dummy behaves as the constant within its cells: position 0 of the cell matrix.
    at = [part[f].to_numpy(dtype=int) + o for f, o in zip(factor_columns(d), d.offsets)]
    on = [part[f].to_numpy(dtype=int) > 0 for f in factor_columns(d)]
    for a in range(len(at)):
        for s_cell, s_full in enumerate(slots):
            np.add.at(full[:, s_full], at[a][on[a]], cell[on[a], 0, s_cell])
            np.add.at(full[s_full, :], at[a][on[a]], cell[on[a], 0, s_cell])
        for b in range(len(at)):
            both = on[a] & on[b]
            np.add.at(full, (at[a][both], at[b][both]), cell[both, 0, 0])
    return full


def _groups(pdf: pd.DataFrame, keys: Sequence[str]):
    return pdf.groupby(list(keys), sort=False, dropna=False)


def full_moments(cells: DataFrame, d: Design, keys: Sequence[str]) -> DataFrame:
    """One row per group with the flattened full matrix ``m`` and the row count ``n``."""
    keys = list(keys)
    schema = block_schema(cells, keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in _groups(pdf, keys):
                row = part[keys].head(1).copy()
                row["m"] = [full_block(part, d).ravel()]
                row["n"] = float(part["n"].sum())
                yield row

    def single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(d.terms) + 2
        at = np.zeros((size, size), dtype=int)
        for p, (i, j) in enumerate(upper_pairs(size)):
            at[i, j] = at[j, i] = p
        for pdf in batches:
            if len(pdf):
                out = pdf[keys].copy()
                out["m"] = list(np.stack(pdf["m"].to_list())[:, at.ravel()])
                out["n"] = pdf["n"].astype(float)
                yield out

    # Without factors a group is a single cell already.
    return sum_blocks(cells.mapInPandas(partial, schema), keys) if d.factors else cells.mapInPandas(single, schema)


def sum_blocks(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the partial matrices of each group entry by entry, so that no task holds many of them."""
    entries = blocks.select(*keys, F.posexplode(F.concat("m", F.array("n"))).alias("at", "v"))
    sums = entries.groupBy(*keys, "at").agg(F.sum("v").alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "v")))
    whole = sums.groupBy(*keys).agg(F.transform(ordered, lambda e: e["v"]).alias("m"))
    return whole.select(*keys, F.slice("m", F.lit(1), F.size("m") - 1).alias("m"), F.element_at("m", -1).alias("n"))


def cluster_scores(rows: DataFrame, d: Design, keys: Sequence[str], residual: Column, dense: Sequence[Column]) -> DataFrame:
    """(keys, __c, s): the summed scores of each cluster as (position, value), only of factor levels that it holds.

    Rows are reduced to cells of cluster and levels first (partial sums absorb large clusters); a cell's constant score is that of its
    levels' dummies.
    """
    keys = list(keys)
    cells = rows.groupBy(*keys, "__c", *factor_columns(d)).agg(F.array(*[F.sum(residual * x) for x in dense]).alias("s"))
    entry = lambda at, value: F.struct(at.cast("int").alias("at"), value.alias("v"))
    entries = F.array(*[entry(F.lit(i), F.col("s")[i]) for i in range(len(dense))])
    for f, offset in zip(factor_columns(d), d.offsets):
        own = F.array(entry(F.col(f) + offset, F.col("s")[0]))
        entries = F.concat(entries, F.when(F.col(f) > 0, own).otherwise(F.slice(own, 1, 0)))
    sums = cells.select(*keys, "__c", F.explode(entries).alias("e")).groupBy(*keys, "__c", F.col("e.at").alias("at")).agg(F.sum("e.v").alias("v"))
    return sums.groupBy(*keys, "__c").agg(F.collect_list(F.struct("at", "v")).alias("s"))


def cluster_meat(rows: DataFrame, d: Design, keys: Sequence[str], residual: Column, dense: Sequence[Column]) -> DataFrame:
    """Sum over clusters of the outer product of summed scores; ``n`` counts the clusters."""
    keys, size = list(keys), len(d.names)
    if d.factors:
        per_cluster = cluster_scores(rows, d, keys, residual, dense)
        schema = T.StructType([*[f for f in per_cluster.schema.fields if f.name in keys], T.StructField("m", T.ArrayType(T.DoubleType())), T.StructField("n", T.DoubleType())])
    else:
        per_cluster = rows.groupBy(*keys, "__c").agg(F.array(*[F.sum(residual * x) for x in dense]).alias("m"), F.lit(1.0).alias("n")).drop("__c")
        schema = block_schema(per_cluster, keys)

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in _groups(pdf, keys):
                row = part[keys].head(1).copy()
                if d.factors:
                    total = np.zeros((size, size))
                    for entries in part["s"]:
                        at = np.array([e["at"] for e in entries])
                        v = np.array([e["v"] for e in entries])
                        total[np.ix_(at, at)] += np.outer(v, v)
                else:
                    s = np.stack([np.asarray(v, dtype=float) for v in part["m"]])
                    total = s.T @ s
                row["m"] = [total.ravel()]
                row["n"] = float(len(part))
                yield row

    return sum_blocks(per_cluster.mapInPandas(outer, schema), keys)
