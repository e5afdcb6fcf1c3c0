"""Many least-squares models over one table in one scan.

Rows are told apart by which columns they lack. For each such pattern, each group and each weight, a task keeps the count, the weight, the
means and the centred cross products of all columns that any model uses; two such blocks add up to the block of both, so tasks' blocks
are merged in two levels, whatever their number. A model is the sub-matrix of its columns over the patterns that lack none of
them, centred at its own means. Clustered covariances of all models take one further scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.models import algebra
from panelmill.models.design import ALL, Design, key_names, term_column
from panelmill.models.linear import NUMBERS
from panelmill.models.moments import sum_blocks

#: Blocks of tasks meet in this many places before the last merge.
PLACES = 64


@dataclass
class Block:
    """Moments of rows with one pattern: ``mean[w]`` and ``cross[w]`` are over all columns under weight ``w``."""

    n: float
    weight: np.ndarray
    mean: np.ndarray
    cross: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, w: np.ndarray) -> Block:
        weight = w.sum(axis=0)
        safe = np.where(weight == 0, 1.0, weight)
        mean = (w.T @ x) / safe[:, None]
        cross = np.stack([(x - m).T @ ((x - m) * w[:, k:k + 1]) for k, m in enumerate(mean)])
        return cls(float(len(x)), weight, mean, cross)

    def plus(self, other: Block) -> Block:
        weight = self.weight + other.weight
        share = other.weight / np.where(weight == 0, 1.0, weight)
        gap = other.mean - self.mean
        mean = self.mean + gap * share[:, None]
        cross = self.cross + other.cross + gap[:, :, None] * gap[:, None, :] * (self.weight * share)[:, None, None]
        return Block(self.n + other.n, weight, mean, cross)

    def flat(self) -> list[float]:
        return np.concatenate([[self.n], self.weight, self.mean.ravel(), self.cross.ravel()]).tolist()

    @classmethod
    def from_flat(cls, values, columns: int, weights: int) -> Block:
        v = np.asarray(values, dtype=float)
        a, b = 1 + weights, 1 + weights + weights * columns
        return cls(float(v[0]), v[1:a], v[a:b].reshape(weights, columns), v[b:].reshape(weights, columns, columns))


@dataclass(frozen=True)
class Family:
    """What the models share: their columns, weights and designs."""

    designs: dict[str, Design]
    columns: tuple[str, ...]
    weights: tuple[str | None, ...]

    @classmethod
    def of(cls, designs: Mapping[str, Design]) -> Family:
        if any(d.factors for d in designs.values()):
            raise ValueError("absorb factors, or fit models with dummies one by one")
        columns = dict.fromkeys(c for d in designs.values() for c in (*d.terms, d.outcome))
        if len(columns) + len(designs) > 60:
            raise ValueError("a family has at most 60 columns and weights")
        return cls(dict(designs), tuple(columns), tuple(dict.fromkeys(d.weight for d in designs.values())))

    def rows(self, df: DataFrame, by: Sequence[str], cluster: str | None = None) -> DataFrame:
        keys = [F.col(c) for c in by] or [F.lit(1).alias(ALL)]
        parts = [term_column(c).alias(f"__x{i}") for i, c in enumerate(self.columns)]
        parts += [(F.col(w).cast("double") if w else F.lit(1.0)).alias(f"__w{k}") for k, w in enumerate(self.weights)]
        return df.select(*keys, *parts, *([F.col(cluster).alias("__c")] if cluster else []))

    def values(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, columns, weights): missing numbers are zeros, and bits of the pattern."""
        x = pdf[[f"__x{i}" for i in range(len(self.columns))]].to_numpy(dtype=float)
        w = pdf[[f"__w{k}" for k in range(len(self.weights))]].to_numpy(dtype=float)
        lacking = np.concatenate([np.isnan(x), np.isnan(w) | (w == 0)], axis=1)
        pattern = lacking @ (1 << np.arange(lacking.shape[1], dtype=np.int64))
        return pattern, np.nan_to_num(x, posinf=np.inf, neginf=-np.inf), np.nan_to_num(w)

    def needs(self, d: Design) -> int:
        """Bits of the columns and the weight that a model uses."""
        bits = [self.columns.index(c) for c in (*d.terms, d.outcome)] + [len(self.columns) + self.weights.index(d.weight)]
        return sum(1 << b for b in bits)

    def solved(self, d: Design, blocks: list[tuple[int, Block]], absorbed: int = 0) -> dict | None:
        """Fit of one model from the blocks of all patterns; None without a row. Absorbed factors have the intercept's place in the rank."""
        used = [b for pattern, b in blocks if not pattern & self.needs(d)]
        if not used:
            return None
        total = used[0]
        for b in used[1:]:
            total = total.plus(b)
        k, at = self.weights.index(d.weight), [self.columns.index(c) for c in (*d.terms, d.outcome)]
        full = np.zeros((len(at) + 1, len(at) + 1))
        full[0, 0] = total.weight[k]
        full[1:, 1:] = total.cross[k][np.ix_(at, at)]
        beta, inverse, rss, kept = algebra.sweep(full)
        n, rank = total.n, int(kept.sum()) + (absorbed - 1 if absorbed else 0)
        sigma = np.sqrt(rss / (n - rank)) if n > rank else np.nan
        return {"n": n, "rank": rank, "sigma": sigma, "beta": beta, "inverse": inverse, "kept": kept, "shift": total.mean[k][at]}


def family_blocks(df: DataFrame, family: Family, by: Sequence[str]) -> DataFrame:
    """(by..., pattern, b): one block for each group and pattern, from one scan."""
    keys, size, weights = key_names(by), len(family.columns), len(family.weights)
    rows = family.rows(df, by)
    schema = T.StructType([f for f in rows.schema.fields if f.name in keys]).add("pattern", "long").add("b", T.ArrayType(T.DoubleType()))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, Block] = {}
        for pdf in batches:
            pattern, x, w = family.values(pdf)
            groups = pdf[keys].assign(pattern=pattern).groupby([*keys, "pattern"], sort=False, dropna=False).indices
            for key, at in groups.items():
                key = tuple(None if v is None or v != v else v for v in key)
                block = Block.of(x[at], w[at])
                found[key] = found[key].plus(block) if key in found else block
        if found:
            yield pd.DataFrame([(*key, b.flat()) for key, b in found.items()], columns=[*keys, "pattern", "b"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for values in pdf["b"]:
            block = Block.from_flat(values, size, weights)
            total = block if total is None else total.plus(block)
        out = pdf[[*keys, "pattern"]].head(1).copy()
        out["b"] = [total.flat()]
        return out

    blocks = rows.mapInPandas(partial, schema).withColumn("__place", F.spark_partition_id() % PLACES)
    blocks = blocks.groupBy(*keys, "pattern", "__place").applyInPandas(merged, schema)
    return blocks.groupBy(*keys, "pattern").applyInPandas(merged, schema)


def fit_family(
    df: DataFrame, designs: Mapping[str, Design], by: Sequence[str] = (), cluster: str | None = None, level: float = 0.95, absorbed: int = 0,
    combinations: Mapping[str, Mapping[str, float]] | None = None,
) -> DataFrame:
    """(by..., model, term, estimate, std_error, statistic, p_value, conf_low, conf_high) of all models.

    ``absorbed`` degrees of freedom went to factors that were taken out of all columns before. With ``combinations`` there is a row for
    each named sum of coefficients, ``{"name": {"term": weight}}``, in place of the coefficients.
    """
    family, keys = Family.of(designs), key_names(by)
    if by and cluster:
        raise ValueError("clustered fits of many groups are those of fit_linear")
    blocks = family_blocks(df, family, by)
    schema = T.StructType([f for f in blocks.schema.fields if f.name in keys]).add("model", "string").add("term", "string")
    for name in NUMBERS:
        schema = schema.add(name, "double")

    def report(pdf: pd.DataFrame, meats: Mapping[str, tuple[np.ndarray, float]] | None = None) -> pd.DataFrame:
        out = []
        found = [(int(p), Block.from_flat(v, len(family.columns), len(family.weights))) for p, v in zip(pdf["pattern"], pdf["b"])]
        for name, d in family.designs.items():
            s = family.solved(d, found, absorbed)
            if s is None:
                continue
            if meats is None:
                covariance = s["inverse"] * (s["sigma"] ** 2)
            else:
                covariance = algebra.clustered(s["inverse"], *meats[name], s["n"], s["rank"])
            beta, covariance = algebra.uncentred(s["beta"], covariance, s["shift"])
            fit = (beta, covariance, s["kept"], s["n"] - s["rank"], level)
            rows = algebra.coefficient_rows(d.names, *fit) if combinations is None else algebra.combination_rows(d.names, combinations, *fit)
            out += [(*(pdf[k].iloc[0] for k in keys), name, *r) for r in rows]
        table = pd.DataFrame(out, columns=[*keys, "model", "term", *NUMBERS])
        for k in keys:
            table[k] = table[k].astype(pdf[k].dtype)
        return table

    if not cluster:
        return blocks.groupBy(*keys).applyInPandas(lambda pdf: report(pdf), schema).drop(ALL)
    # One small block for each pattern: bounded by the designs, not by the rows.
    held = blocks.toPandas()
    found = [(int(p), Block.from_flat(v, len(family.columns), len(family.weights))) for p, v in zip(held["pattern"], held["b"])]
    meats = _meats(df, family, found, cluster)
    ready = {r["model"]: (np.asarray(r["m"]).reshape(len(designs[r["model"]].names), -1), r["n"]) for r in meats.collect()}
    table = report(held, ready) if len(held) else pd.DataFrame(columns=schema.names)
    clean = [tuple(None if v is None or v != v else v for v in row) for row in table[schema.names].itertuples(index=False)]
    return df.sparkSession.createDataFrame(clean, schema).drop(ALL)


def _meats(df: DataFrame, family: Family, found: list[tuple[int, Block]], cluster: str) -> DataFrame:
    """(model, m, n): summed outer products of the clusters' scores, and the number of clusters, of all models from one scan."""
    fits = {name: s for name, d in family.designs.items() if (s := family.solved(d, found)) is not None}
    rows = family.rows(df, (), cluster).where(F.col("__c").isNotNull())
    kind = rows.schema["__c"].dataType
    schema = T.StructType().add("model", "string").add("__c", kind).add("u", T.ArrayType(T.DoubleType()))

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pattern, x, w = family.values(pdf)
            for name, s in fits.items():
                d = family.designs[name]
                use = np.flatnonzero((pattern & family.needs(d)) == 0)
                if not len(use):
                    continue
                at = [family.columns.index(c) for c in (*d.terms, d.outcome)]
                part = x[np.ix_(use, at)] - s["shift"]
                part = np.concatenate([np.ones((len(use), 1)), part], axis=1)
                gap = w[use, family.weights.index(d.weight)] * (part[:, -1] - part[:, :-1] @ s["beta"])
                code, names = pd.factorize(pdf["__c"].iloc[use])
                sums = np.zeros((len(names), part.shape[1] - 1))
                np.add.at(sums, code, gap[:, None] * part[:, :-1])
                yield pd.DataFrame({"model": name, "__c": names, "u": list(sums)})

    widest = max(len(d.names) for d in family.designs.values())
    sums = F.filter(F.array(*[F.sum(F.get("u", F.lit(i))) for i in range(widest)]), lambda v: v.isNotNull())
    each = rows.mapInPandas(scores, schema).groupBy("model", "__c").agg(sums.alias("u"))

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, part in pdf.groupby("model"):
                s = np.stack(part["u"].to_list())
                yield pd.DataFrame({"model": [name], "m": [(s.T @ s).ravel()], "n": [float(len(s))]})

    return sum_blocks(each.mapInPandas(outer, "model string, m array<double>, n double"), ["model"])
