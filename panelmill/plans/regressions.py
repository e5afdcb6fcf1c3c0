"""Families of fits: per bin, per period, over overlapping windows, and the standing model list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.models.design import Design, design
from panelmill.models.linear import fit_linear
from panelmill.models.logit import fit_logit
from panelmill.session import reused


def fit_many(df: DataFrame, designs: Mapping[str, Design], cluster: str | None = None) -> DataFrame:
    """Coefficient tables of several least-squares models, with a ``model`` column."""
    df = reused(df)
    tables = [
        fit_linear(df, d, cluster=cluster).coefficients().withColumn("model", F.lit(name)) for name, d in designs.items()
    ]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def effect_by_bin(df: DataFrame, d: Design, bin_column: str, bins: int, term: str, level: float = 0.95) -> DataFrame:
    """(bin, estimate, conf_low, conf_high) of one term for bins 1..``bins``: one grouped job, no loop."""
    rows = df.where(F.col(bin_column).between(1, bins))
    fitted = fit_linear(rows, d, by=[bin_column]).coefficients(level, [term])
    return fitted.select(bin_column, "estimate", "conf_low", "conf_high")


def sliding_windows(df: DataFrame, year: str, first: int, width: int, step: int, count: int, out: str = "window") -> DataFrame:
    """Rows repeated for each window of years that holds them, labelled by the window's first year."""
    starts = F.array(*[F.lit(first + i * step).cast("long") for i in range(count)])
    inside = F.filter(starts, lambda s: (F.col(year) >= s) & (F.col(year) < s + width))
    return df.withColumn(out, F.explode(inside))


def effect_by_window(
    df: DataFrame, d: Design, year: str, first: int, width: int, step: int, count: int, term: str,
    cluster: str | None = None, patterns: bool = True,
) -> DataFrame:
    """Logit coefficient of one term per overlapping window; all windows share every data pass."""
    rows = sliding_windows(df, year, first, width, step, count)
    return fit_logit(rows, d, by=["window"], cluster=cluster, patterns=patterns).coefficients(terms=[term])


def with_outcome(df: DataFrame, out: str, predicate: Column, where: Column | None = None) -> DataFrame:
    """A slice of the rows with a 0/1 outcome made from a predicate."""
    return (df if where is None else df.where(where)).withColumn(out, predicate.cast("double"))


INDUSTRY_SHARES = ("frac_man", "frac_trans", "frac_trade", "frac_public")
PANEL_CONTROLS = ("age", "w", "frac_col", *INDUSTRY_SHARES, "frac_young", "frac_old")


def growth_models(supply: str, size: str, extra: Sequence[str] = (), weight: str | None = None) -> dict[str, Design]:
    """Growth of employment, exposure, wages and college share on degree supply, weighted by size unless another weight is named."""
    right, weight = [supply, size, "exp", *extra], weight or size
    outcomes = ("exp_growth", "growth", "w_growth", "col_growth")
    return {"exp": design("exp", supply, size, weight=weight), **{y: design(y, *right, weight=weight) for y in outcomes}}


def wage_models(weight: str | None) -> dict[str, Design]:
    """Wage change on exposure: alone, with shares, with all controls."""
    return {
        "plain": design("del_w", "exp", weight=weight),
        "shares": design("del_w", "exp", "frac_col", *INDUSTRY_SHARES, weight=weight),
        "controls": design("del_w", "exp", *PANEL_CONTROLS, weight=weight),
    }


def within_models(weight: str | None) -> dict[str, Design]:
    """Those of the wage models that are fitted with area effects absorbed."""
    return {"area_effects": design("del_w", "exp", *PANEL_CONTROLS, weight=weight)}


def degree_models() -> dict[str, Design]:
    """Degree changes and cumulated degrees on exposure, base counts and their products."""
    return {
        "change": design("del_comp", "exp", "total"),
        "change_shares": design("del_comp", "exp", "total", *INDUSTRY_SHARES),
        "change_controls": design("del_comp", "exp", "total", *PANEL_CONTROLS),
        "comp": design("comp_int", "exp*comp_base"),
        "comp_total": design("comp_int", "exp*comp_base", "exp*total_base"),
        "comp_controls": design("comp_int", "exp*comp_base", *PANEL_CONTROLS),
        "total": design("total_int", "exp*total_base"),
        "total_controls": design("total_int", "exp*total_base", *PANEL_CONTROLS),
        "comp_plain": design("comp_int", "exp"),
        "total_plain": design("total_int", "exp"),
    }


def choice_models(outcome: str, exposure: str, factors: Mapping[str, Sequence], extra: Sequence[str] = ()) -> Design:
    """Individual choice on family background (factors) and area conditions."""
    return design(outcome, *extra, "w", "frac_col", exposure, factors=factors)


def condition_models(outcome: str, growth: str, share: str, overall: str, premium: str, extra: Sequence[str] = (), factors=None) -> Design:
    """Choice on wage growth and premium, each times the employment share."""
    return design(outcome, f"{growth}*{share}", overall, f"{premium}*{share}", *extra, factors=factors)
