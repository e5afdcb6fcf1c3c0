"""Occupation exposure scores, their transfer to persons, and score validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions.safe import as_col
from panelmill.models.design import design
from panelmill.models.logit import LogitFit, fit_logit
from panelmill.operators.joins import crosswalk_scores
from panelmill.operators.plotdata import auc, half_split, roc_points
from panelmill.operators.reshape import widen


def select_traits(sources: Sequence[tuple[DataFrame, Sequence[str]]], name: str) -> DataFrame:
    """Wanted traits of several rating tables under one set of columns, matched by name."""
    parts = [df.where(F.col(name).isin(list(wanted))) for df, wanted in sources]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def trait_table(traits: DataFrame, code: str, name: str, value: str, levels: Sequence[str]) -> DataFrame:
    """One row per code, one column per trait."""
    return widen(traits, [code], name, levels, [value])


def score_codes(
    occupations: DataFrame, traits: DataFrame, code: str, label: str, regressors: Sequence[str], primary: str = "00"
) -> tuple[LogitFit, DataFrame]:
    """Logit of the label over labelled primary codes; every code with traits gets a fitted score."""
    rows = occupations.join(traits, code)
    labelled = rows.where(F.col(code).endswith(primary) & F.col(label).isNotNull())
    fit = fit_logit(labelled, design(label, *regressors))
    return fit, fit.predict(rows, "score")


def scored_persons(
    persons: DataFrame, scores: DataFrame, links: DataFrame, code: str, target: str, fixed: Mapping | None = None,
    keep: Column | None = None,
) -> DataFrame:
    """Persons with the score of their occupation; ``fixed`` sets scores of given targets; unscored rows drop."""
    means = crosswalk_scores(scores, links, code, "score", target)
    rows = persons.join(means, target, "left")
    value = F.col("score")
    for of, score in (fixed or {}).items():
        value = F.when(F.col(target) == of, F.lit(score)).otherwise(value)
    rows = rows.withColumn("score", value).where(F.col("score").isNotNull())
    return rows if keep is None else rows.where(keep)


def share_scores(weights: DataFrame, occupation: str, major: str, frac: str, wanted: Sequence, out: str) -> DataFrame:
    """Share of an occupation's workers whose major is in the wanted list."""
    return weights.groupBy(occupation).agg(
        F.sum(F.when(as_col(major).isin(list(wanted)), F.col(frac)).otherwise(0.0)).alias(out)
    )


def validate_scores(
    labelled: DataFrame, key: str, label: str, regressors: Sequence[str], replicates: int = 100, steps: int = 1000, seed: int = 0
) -> DataFrame:
    """(replicate, auc): fit on half of each class, measure on the rest, all replicates in one job per step."""
    split = half_split(labelled, key, label, replicates, seed)
    fit = fit_logit(split.where("in_sample"), design(label, *regressors), by=["replicate"])
    held_out = fit.predict(split.where(~F.col("in_sample")), "score")
    return auc(roc_points(held_out, "score", label, steps, ["replicate"]), ["replicate"])
