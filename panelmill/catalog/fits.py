"""Families of fits: absorbed factors, clustered errors, several models over one scan (M and K ids)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.catalog.joins import EDGES, edges
from panelmill.catalog.registry import (
    FACTS, FACTS_FLOW, FACTS_JOB, FACTS_STATE, R, area_panel, areas, facts, facts_flow, facts_job, facts_state, query, rounded,
)
from panelmill.catalog.recipes import OCC_SCORED, parts
from panelmill.catalog.twins import ols, t_width
from panelmill.functions.safe import flag
from panelmill.models.design import design
from panelmill.models.family import fit_family
from panelmill.models.qr import fit_qr
from panelmill.models.within import fit_within, fit_within_family
from panelmill.operators import allocation
from panelmill.operators.panel import log_change_next
from panelmill.operators.quantiles import quantile_bins
from panelmill.operators.scaling import scale_by_sd, zscore
from panelmill.plans import concentration, decomposition, degrees, migration, panels, shocks
from panelmill.plans.regressions import INDUSTRY_SHARES, PANEL_CONTROLS, degree_models, growth_models, wage_models, within_models
from panelmill.session import reused

ENDS = (1995, 2001)
SHARES = {
    "frac_col": "coll", "frac_man": "flag = 'A'", "frac_trans": "flag = 'N'", "frac_trade": "wage < 30000", "frac_public": "wage > 80000",
    "frac_young": "wt <= 15", "frac_old": "wt >= 35",
}
SHOWN = ["estimate", "std_error", "statistic"]


def shown(table, *keys):
    """Estimates to six digits, their ratio to four."""
    rows = table.select(*keys, "term", *SHOWN)
    return rounded(rounded(rows, "estimate", "std_error"), "statistic", digits=4)


def listed(name: str, keys: str = "", model: str = "", where: str = "") -> str:
    lead = f"'{model}' AS model, " if model else ""
    return f"SELECT {keys}{lead}term, {R('estimate', 'estimate')}, {R('std_error', 'std_error')}, {R('statistic', 'statistic', 4)} FROM {name} {where}"


def union(names, keys: str = "") -> str:
    return " UNION ALL ".join(listed(n, keys, n) for n in names)


def same(names) -> dict[str, str]:
    return {n: n for n in names}


def demeaned(name: str, source: str, columns, weight: str, factor: str, keep: str = "") -> str:
    """CTE with the columns less their weighted means per level of ``factor``, over rows that lack none of them."""
    has = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    less = ", ".join(f"{c} - sum({weight} * {c}) OVER f / sum({weight}) OVER f AS {c}" for c in columns)
    return f"{name} AS (SELECT {keep}{less} FROM {source} WHERE {has} AND {factor} IS NOT NULL WINDOW f AS (PARTITION BY {factor}))"


# Units are areas, or industries of areas where a fit needs many of them --------------------------------------------


def _unit_sql(keys: str, entity: str, source: str = "persons") -> str:
    shares = ", ".join(f"sum(CASE WHEN {p} THEN wt ELSE 0 END) / sum(wt) AS {n}" for n, p in SHARES.items())
    return f"""cp AS (SELECT {keys}, yr, sum(wt * score) / sum(wt) AS exp, sum(wt * wage) / sum(wt) AS w, sum(wt * disc) / sum(wt) AS age, {shares}, sum(wt) AS emp
      FROM {source} WHERE yr IN (1995, 2001) GROUP BY {keys}, yr),
    cw AS (SELECT cp.* EXCLUDE (exp), exp / stddev_samp(exp) OVER (PARTITION BY yr) AS exp, lead(ln(w)) OVER (PARTITION BY {entity} ORDER BY yr) - ln(w) AS del_w FROM cp)"""


UNITS = f"""{FACTS_JOB}, {_unit_sql('area, ind', 'area, ind')}, cs AS (SELECT cw.*, CAST(s_nationkey AS BIGINT) AS state FROM cw JOIN supplier ON area = s_suppkey)"""
AREAS = f"""{FACTS}, {_unit_sql('area', 'area', 'facts')}, cs AS (SELECT cw.*, CAST(s_nationkey AS BIGINT) AS state FROM cw JOIN supplier ON area = s_suppkey)"""


def controlled(rows, by):
    shares = {n: F.expr(p) for n, p in SHARES.items()}
    return panels.weighted_panel(rows, [*by, "yr"], "wt", {"exp": "score", "w": "wage", "age": "disc"}, shares, {"emp": None})


def units(spark, sf):
    """Industries of areas at both ends, with the log wage change and the state."""
    panel = controlled(facts_job(spark, sf, ENDS), ["area", "ind"])
    return panels.wage_response(panel, ["area", "ind"], "yr", "w", "exp").join(areas(spark, sf), "area")


def area_units(spark, sf):
    return panels.wage_response(controlled(facts(spark, sf, ENDS), ["area"]), ["area"], "yr", "w", "exp").join(areas(spark, sf), "area")


# Absorbed factors --------------------------------------------------------------------------------------------------

CONTROLS = ["exp", *PANEL_CONTROLS]


def _within_twin(name: str, source: str, y: str, terms, weight: str, factor: str, cluster: str | None = None) -> str:
    kept = "".join(f"{c}, " for c in dict.fromkeys([c for c in (weight if weight != "1" else None, cluster) if c]))
    return demeaned(f"{name}_d", source, [*terms, y], weight, factor, kept) + ",\n    " + ols(
        name, f"{name}_d", y, same(terms), weight, cluster=cluster, intercept=False,
        lost=f"(SELECT count(DISTINCT {factor}) FROM {source} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in (*terms, y, factor))})",
    )


@query(
    "m4_absorbed_wage_units",
    f"""WITH {UNITS}, sc AS (SELECT * EXCLUDE (w, frac_col), w / stddev_samp(w) OVER (PARTITION BY yr) AS w, frac_col / stddev_samp(frac_col) OVER (PARTITION BY yr) AS frac_col FROM cs),
    {_within_twin('fit', 'sc', 'del_w', ['exp', 'w', 'frac_col', *INDUSTRY_SHARES], 'emp', 'state', 'state')} {listed('fit')}""",
)
def absorbed_wage_units(spark, sf):
    """Weighted wage change on scaled exposure, wage and college share with state effects, clustered by state."""
    rows = scale_by_sd(units(spark, sf), ["yr"], w="w", frac_col="frac_col")
    return shown(fit_within(rows, design("del_w", "exp", "w", "frac_col", *INDUSTRY_SHARES, weight="emp"), ["state"], cluster="state").coefficients())


@query("m4_absorbed_wage_unweighted", f"WITH {UNITS}, {_within_twin('fit', 'cs', 'del_w', CONTROLS, '1', 'state')} {listed('fit')}")
def absorbed_wage_unweighted(spark, sf):
    """Unweighted wage change with all controls and state effects."""
    return shown(fit_within(units(spark, sf), design("del_w", *CONTROLS), ["state"]).coefficients())


DEGREE_UNITS = f"""{UNITS}, dg AS (SELECT area, ind, yr, sum(CASE WHEN flag = 'R' THEN wt ELSE 0 END) AS comp, sum(wt) AS total FROM persons GROUP BY area, ind, yr),
    dc AS (SELECT *, lead(comp) OVER (PARTITION BY area, ind ORDER BY yr) - comp AS del_comp FROM dg),
    du AS (SELECT cs.*, total, del_comp FROM cs JOIN dc USING (area, ind, yr))"""


def degree_units(spark, sf):
    kinds = {"comp": F.col("flag") == "R", "total": F.lit(True)}
    counts = degrees.degree_counts(facts_job(spark, sf), ["area", "ind"], "yr", "wt", kinds)
    changes = degrees.degree_changes(counts, ["area", "ind"], "yr", "comp", "total").select("area", "ind", "yr", "total", F.col("del_count").alias("del_comp"))
    return units(spark, sf).join(changes, ["area", "ind", "yr"])


@query("m4_absorbed_degrees", f"WITH {DEGREE_UNITS}, {_within_twin('fit', 'du', 'del_comp', [*CONTROLS, 'total'], '1', 'state')} {listed('fit')}")
def absorbed_degrees(spark, sf):
    """Change of a degree count on exposure, the base count and all controls with state effects."""
    return shown(fit_within(degree_units(spark, sf), design("del_comp", *CONTROLS, "total"), ["state"]).coefficients())


_YEARS = [f"CASE WHEN yr = {y} THEN 1.0 ELSE 0.0 END AS y{y}" for y in range(1996, 2002)]
LINES = f"""{FACTS}, ln AS (SELECT area, wage / 1000 AS y, wt, score, {', '.join(_YEARS)} FROM facts)"""
_DUMMIES = [f"y{y}" for y in range(1996, 2002)]


@query(
    "m4_two_way_effects",
    f"""WITH {LINES}, {demeaned('dm', 'ln', ['y', 'wt', 'score', *_DUMMIES], '1', 'area', 'area, ')},
    {ols('fit', 'dm', 'y', same(['wt', 'score', *_DUMMIES]), cluster='area', intercept=False, lost='(SELECT count(DISTINCT area) FROM facts)')}
    {listed('fit', where="WHERE term IN ('wt', 'score')")}""",
)
def two_way_effects(spark, sf):
    """Wage of a line on quantity and score with area and year effects, clustered by area."""
    rows = facts(spark, sf).withColumn("y", F.col("wage") / 1000)
    return shown(fit_within(rows, design("y", "wt", "score"), ["area", "yr"], cluster="area").coefficients())


# Several models over one scan -----------------------------------------------------------------------------------------


@query(
    "m2_wage_models",
    f"""WITH {AREAS}, {ols('plain', 'cs', 'del_w', same(['exp']), 'emp', cluster='state')},
    {ols('shares', 'cs', 'del_w', same(['exp', 'frac_col', *INDUSTRY_SHARES]), 'emp', cluster='state')},
    {ols('controls', 'cs', 'del_w', same(CONTROLS), 'emp', cluster='state')},
    {_within_twin('area_effects', 'cs', 'del_w', CONTROLS, 'emp', 'state', 'state')} {union(['plain', 'shares', 'controls', 'area_effects'])}""",
)
def wage_models_fit(spark, sf):
    """Wage change on exposure: plain, with controls, and with state effects absorbed; clustered by state."""
    panel = reused(area_units(spark, sf))
    table = fit_family(panel, wage_models("emp"), cluster="state")
    effects = fit_within(panel, within_models("emp")["area_effects"], ["state"], cluster="state").coefficients()
    return shown(table.unionByName(effects.withColumn("model", F.lit("area_effects"))), "model")


def _design_terms(d) -> dict[str, str]:
    return {t: t.replace(":", " * ") for t in d.terms}


DEGREE_PANEL = f"""{AREAS}, dg AS (SELECT area, yr, sum(CASE WHEN flag = 'R' THEN wt ELSE 0 END) AS comp, sum(wt) AS total FROM facts GROUP BY area, yr),
    dc AS (SELECT area, yr, total, lead(comp) OVER (PARTITION BY area ORDER BY yr) - comp AS del_comp FROM dg),
    dl AS (SELECT area, max(CASE WHEN yr = 1995 THEN ln(comp + 1) END) AS comp_base, max(CASE WHEN yr = 1995 THEN ln(total + 1) END) AS total_base,
      sum(CASE WHEN yr > 1995 THEN ln(comp + 1) END) AS comp_int, sum(CASE WHEN yr > 1995 THEN ln(total + 1) END) AS total_int FROM dg GROUP BY area),
    dz AS (SELECT cp.* EXCLUDE (exp), (exp - avg(exp) OVER ()) / stddev_samp(exp) OVER () AS exp FROM cp WHERE yr = 1995),
    dp AS (SELECT * EXCLUDE (yr) FROM dz JOIN dl USING (area) JOIN (SELECT area, total, del_comp FROM dc WHERE yr = 1995) USING (area) WHERE comp_base IS NOT NULL AND comp_int IS NOT NULL)"""


@query(
    "m5_degree_models",
    f"WITH {DEGREE_PANEL}, " + ",\n    ".join(ols(n, "dp", d.outcome, _design_terms(d)) for n, d in degree_models().items()) + " " + union(degree_models()),
)
def degree_models_fit(spark, sf):
    """Degree changes and cumulated degrees on exposure, base counts and their products: ten models, one scan."""
    kinds = {"comp": F.col("flag") == "R", "total": F.col("flag").isNotNull()}
    counts = reused(degrees.degree_counts(facts(spark, sf), ["area"], "yr", "wt", kinds))
    changes = degrees.degree_changes(counts, ["area"], "yr", "comp", "total").where("yr = 1995")
    changes = changes.select("area", "total", F.col("del_count").alias("del_comp"))
    logs = degrees.cumulated_logs(counts, ["area"], "yr", 1995, ["comp", "total"])
    base = zscore(controlled(facts(spark, sf, [1995]), ["area"]), exp="exp")
    return shown(fit_family(base.join(logs, "area").join(changes, "area"), degree_models()), "model")


SHOCKS = """ic AS (SELECT yr, area, ind, sum(wt) AS emp FROM persons WHERE yr IN (1995, 2001) GROUP BY yr, area, ind),
    it AS (SELECT *, sum(emp) OVER (PARTITION BY yr, area) AS area_emp, sum(emp) OVER (PARTITION BY yr, ind) AS ind_emp, sum(emp) OVER (PARTITION BY yr) AS all_emp FROM ic),
    il AS (SELECT *, (ind_emp - emp) / all_emp AS loo FROM it),
    ig AS (SELECT *, (loo - lag(loo) OVER w) / nullif(lag(loo) OVER w, 0) AS growth FROM il WINDOW w AS (PARTITION BY ind, area ORDER BY yr)),
    sh AS (SELECT area, yr, sum(growth * share) AS shocks FROM ig JOIN (SELECT ind, area, emp / area_emp AS share FROM it WHERE yr = 1995) USING (ind, area)
      GROUP BY area, yr HAVING coalesce(sum(growth * share), 0) <> 0)"""
GROWTH = f"""{FACTS_JOB}, {EDGES}, {SHOCKS}, gp AS (SELECT area, yr, sum(wt * score) / sum(wt) AS exp, sum(wt * wage) / sum(wt) AS w, sum(wt) AS emp,
      sum(CASE WHEN coll THEN wt ELSE 0 END) / sum(wt) AS frac_col FROM facts WHERE yr IN (1995, 2001) GROUP BY area, yr),
    gg AS (SELECT *, lead(ln(emp)) OVER a - ln(emp) AS growth, lead(ln(exp)) OVER a - ln(exp) AS exp_growth, lead(ln(w)) OVER a - ln(w) AS w_growth,
      lead(ln(frac_col)) OVER a - ln(frac_col) AS col_growth FROM gp WINDOW a AS (PARTITION BY area ORDER BY yr)),
    su AS (SELECT area, sum(CASE WHEN flag = 'R' THEN wt END) AS num, sum(wt) AS pop FROM facts GROUP BY area HAVING sum(CASE WHEN flag = 'R' THEN wt END) IS NOT NULL),
    ne AS (SELECT e.area, sum(num) AS num_adj, sum(pop) AS pop_adj FROM edges e JOIN su ON e.adj = su.area GROUP BY e.area),
    gr AS (SELECT gg.*, num_adj, pop_adj, num_adj / pop_adj AS num_per_pop, pop, shocks, CAST(s_nationkey AS BIGINT) AS state FROM gg JOIN ne USING (area)
      JOIN su USING (area) JOIN (SELECT area, shocks FROM sh) USING (area) JOIN supplier ON area = s_suppkey WHERE yr = 1995)"""


def growth_rows(spark, sf):
    """Areas in the first year: growth to the last one, supply and size of the neighbours, own size, shocks, state."""
    f = facts(spark, sf)
    supply = f.where(F.col("flag") == "R").groupBy("area").agg(F.sum("wt").alias("num"))
    pops = f.groupBy("area").agg(F.sum("wt").alias("pop"))
    own = reused(supply.join(pops, "area"))
    near = allocation.neighbour_totals(
        own.withColumn("kind", F.lit("R")), edges(spark, sf), ["area"], ["adj"], "kind", "num", "pop", distinct_sizes=False, complete=False
    ).where(F.col("kind").isNotNull())
    panel = panels.long_difference(
        area_panel(spark, sf, ENDS), ["area"], "yr", [1995, 2001], growth="emp", exp_growth="exp", w_growth="w", col_growth="frac_col"
    )
    shock = shocks.shift_share(facts_job(spark, sf, ENDS), ["area"], "ind", "yr", "wt", 1995)
    rows = panel.where("yr = 1995").join(near, "area").join(shock.drop("yr"), "area").join(own.select("area", "pop"), "area")
    return rows.join(areas(spark, sf), "area")


#: Degree supply of the neighbours, without and with shocks; the local college share as supply; the area's own size as control.
GROWTH_FORMS = {
    "": ("num_per_pop", "pop_adj", ["shocks"], "pop_adj"), "plain_": ("num_per_pop", "pop_adj", [], "pop_adj"),
    "census_": ("frac_col", "pop_adj", [], "pop_adj"), "own_": ("num_per_pop", "pop", [], "pop_adj"),
}


def growth_designs():
    made = {}
    for lead, (supply, size, extra, weight) in GROWTH_FORMS.items():
        for name, d in growth_models(supply, size, extra, weight).items():
            made[lead + name] = d
    return made


@query(
    "m13_growth_models",
    f"WITH {GROWTH}, " + ",\n    ".join(ols(n, "gr", d.outcome, _design_terms(d), d.weight) for n, d in growth_designs().items()) + " " + union(growth_designs()),
)
def growth_family(spark, sf):
    """Weighted growth regressions on degree supply, twenty models, one scan."""
    return shown(fit_family(growth_rows(spark, sf), growth_designs()), "model")


CI = f"{R('estimate', 'estimate')}, {R(f'estimate - {t_width('df')} * std_error', 'conf_low')}, {R(f'estimate + {t_width('df')} * std_error', 'conf_high')}"


def interval(table, *keys):
    return rounded(table.select(*keys, "estimate", "conf_low", "conf_high"), "estimate", "conf_low", "conf_high")


def _bins(source: str, x: str, n: int = 4) -> str:
    cuts = ", ".join(f"quantile_cont({x}, CAST({i / n} AS DOUBLE))" for i in range(n + 1))
    return f"""br AS (SELECT * EXCLUDE ({x}), round({x}, 9) AS {x} FROM {source}), bq AS (SELECT [{cuts}] AS cuts FROM br),
    bb AS (SELECT br.*, CAST(len(list_filter(cuts, lambda c: c <= {x})) AS BIGINT) AS bin FROM br, bq)"""


def _binned(rows):
    return quantile_bins(rows.withColumn("exp", F.round("exp", 9)), "exp", 4, "bin").where(F.col("bin").between(1, 4))


@query(
    "k5_effect_per_bin",
    f"""WITH {FACTS}, pp AS (SELECT area, yr, sum(wt * score) / sum(wt) AS exp, sum(wt) AS emp, sum(CASE WHEN coll THEN wt ELSE 0 END) / sum(wt) AS frac_col FROM facts GROUP BY area, yr),
    pg AS (SELECT *, lead(ln(emp)) OVER (PARTITION BY area ORDER BY yr) - ln(emp) AS growth FROM pp), {_bins('pg', 'exp')},
    {ols('fit', '(SELECT * FROM bb WHERE bin <= 4)', 'growth', same(['frac_col']), 'emp', keys=['bin'])} SELECT bin, {CI} FROM fit WHERE term = 'frac_col'""",
)
def effect_per_bin(spark, sf):
    panel = log_change_next(area_panel(spark, sf), ["area"], "yr", growth="emp")
    table = fit_family(_binned(panel), {"m": design("growth", "frac_col", weight="emp")}, by=["bin"]).where("term = 'frac_col'")
    return interval(table, "bin")


@query(
    "k5_supply_effect_per_bin",
    f"""WITH {GROWTH}, {_bins('gr', 'exp')}, kb AS (SELECT * FROM bb WHERE bin <= 4 AND growth IS NOT NULL AND state <> 3),
    {ols('growth', 'kb', 'growth', same(['pop_adj', 'num_per_pop']), 'pop_adj', keys=['bin'])},
    {ols('col_growth', 'kb', 'col_growth', same(['pop_adj', 'num_per_pop', 'shocks']), 'pop_adj', keys=['bin'])}
    SELECT bin, 'growth' AS model, {CI} FROM growth WHERE term = 'num_per_pop' UNION ALL SELECT bin, 'col_growth', {CI} FROM col_growth WHERE term = 'num_per_pop'""",
)
def supply_effect_per_bin(spark, sf):
    """Degree supply per bin of exposure, one state left out: employment growth, and college growth with shocks."""
    rows = _binned(growth_rows(spark, sf)).where("growth is not null and state <> 3")
    models = {
        "growth": design("growth", "pop_adj", "num_per_pop", weight="pop_adj"),
        "col_growth": design("col_growth", "pop_adj", "num_per_pop", "shocks", weight="pop_adj"),
    }
    return interval(fit_family(rows, models, by=["bin"]).where("term = 'num_per_pop'"), "bin", "model")


@query(
    "k5_interaction_by_year",
    f"""WITH {AREAS}, yl AS (SELECT area, yr, ln(sum(CASE WHEN flag = 'R' THEN wt ELSE 0 END) + 1) AS comp FROM facts GROUP BY area, yr),
    yb AS (SELECT a.area, a.yr, a.comp, b.comp AS comp_base, e.exp FROM yl a JOIN yl b ON a.area = b.area AND b.yr = 1995
      JOIN (SELECT area, exp / stddev_samp(exp) OVER () AS exp FROM cp WHERE yr = 1995) e ON a.area = e.area WHERE a.yr > 1995),
    {ols('fit', 'yb', 'comp', {'comp_base': 'comp_base', 'exp': 'exp', 'comp_base:exp': 'comp_base * exp'}, keys=['yr'])}
    SELECT yr, {CI} FROM fit WHERE term = 'comp_base:exp'""",
)
def interaction_by_year(spark, sf):
    """Interval of one interaction in every year: one scan for all years."""
    counts = degrees.degree_counts(facts(spark, sf), ["area"], "yr", "wt", {"comp": F.col("flag") == "R"})
    logs = degrees.yearly_logs(counts, ["area"], "yr", 1995, ["comp"]).where("yr > 1995")
    base = scale_by_sd(controlled(facts(spark, sf, [1995]), ["area"]), exp="exp").select("area", "exp")
    table = fit_family(logs.join(base, "area"), {"m": design("comp", "comp_base*exp")}, by=["yr"])
    return interval(table.where("term = 'comp_base:exp'"), "yr")


_LEVELS = {"low": -1.0, "middle": 0.0, "high": 1.0}
_SHIFTED = {n: {"comp_base": "comp_base", "exp": f"exp - ({v})", "comp_base:exp": f"comp_base * (exp - ({v}))"} for n, v in _LEVELS.items()}


@query(
    "m10_effect_at_level",
    f"""WITH {AREAS}, yl AS (SELECT area, yr, ln(sum(CASE WHEN flag = 'R' THEN wt ELSE 0 END) + 1) AS comp FROM facts GROUP BY area, yr),
    yb AS (SELECT a.area, a.yr, a.comp, b.comp AS comp_base, e.exp FROM yl a JOIN yl b ON a.area = b.area AND b.yr = 1995
      JOIN (SELECT area, (exp - avg(exp) OVER ()) / stddev_samp(exp) OVER () AS exp FROM cp WHERE yr = 1995) e ON a.area = e.area WHERE a.yr > 1995),
    {", ".join(ols(n, 'yb', 'comp', t, keys=['yr']) for n, t in _SHIFTED.items())}
    {" UNION ALL ".join(f"SELECT yr, '{n}' AS at, {CI} FROM {n} WHERE term = 'comp_base'" for n in _LEVELS)}""",
)
def effect_at_level(spark, sf):
    """Effect of the base count in every year at low, middle and high exposure, with intervals from the joint covariance."""
    counts = degrees.degree_counts(facts(spark, sf), ["area"], "yr", "wt", {"comp": F.col("flag") == "R"})
    logs = degrees.yearly_logs(counts, ["area"], "yr", 1995, ["comp"]).where("yr > 1995")
    base = zscore(controlled(facts(spark, sf, [1995]), ["area"]), exp="exp").select("area", "exp")
    effects = {n: {"comp_base": 1.0, "comp_base:exp": v} for n, v in _LEVELS.items()}
    table = fit_family(logs.join(base, "area"), {"m": design("comp", "comp_base*exp")}, by=["yr"], combinations=effects)
    return interval(table.withColumnRenamed("term", "at"), "yr", "at")


@query(
    "k5_youth_effect_by_bin",
    f"""WITH {FACTS}, yp AS (SELECT area, yr, CASE WHEN disc <= 0.03::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS youth, sum(wt * score) / sum(wt) AS score, sum(wt) AS pop FROM facts GROUP BY 1, 2, 3),
    ya AS (SELECT area, yr, youth, sum(score * pop) OVER a / sum(pop) OVER a AS exp, lead(ln(score)) OVER (PARTITION BY area, youth ORDER BY yr) - ln(score) AS del_score FROM yp WINDOW a AS (PARTITION BY area, yr)),
    {_bins('ya', 'exp')}, yk AS (SELECT *, 1 - youth AS old FROM bb WHERE bin <= 4),
    {ols('fit', 'yk', 'del_score', {'exp': 'exp', 'old': 'old', 'exp:old': 'exp * old'}, keys=['bin'])} SELECT bin, {CI} FROM fit WHERE term = 'exp'""",
)
def youth_effect_by_bin(spark, sf):
    """Effect of the area's exposure on the young, base plus interaction, per bin of exposure."""
    rows = panels.age_panel(facts(spark, sf), ["area"], "yr", F.col("disc") <= 0.03, "score", "wt")
    binned = _binned(rows.withColumn("exp", F.col("area_score")))
    table = fit_family(binned, {"m": design("del_score", "exp*youth")}, by=["bin"], combinations={"young": {"exp": 1.0, "exp:youth": 1.0}})
    return interval(table, "bin")


# The twin takes the nearly equal regressors apart row by row, twice, as squared sums would lose the answer.
NEAR = f"""{FACTS}, a0 AS (SELECT CAST(wt AS DOUBLE) AS x1, wt + score / 1000 AS x2, wage / 1000 AS y FROM facts),
    a1 AS (SELECT x1 - avg(x1) OVER () AS x1, x2 - avg(x2) OVER () AS x2, y - avg(y) OVER () AS y FROM a0),
    a2 AS (SELECT x1, x2, x2 - x1 * (sum(x1 * x2) OVER () / sum(x1 * x1) OVER ()) AS r, y FROM a1),
    a3 AS (SELECT x1, x2, r - x1 * (sum(x1 * r) OVER () / sum(x1 * x1) OVER ()) AS r, y FROM a2),
    a4 AS (SELECT any_value(n) AS n, sum(r * y) / sum(r * r) AS b2, sum(r * r) AS rr, sum(x1 * y) / sum(x1 * x1) AS c, sum(x1 * x2) / sum(x1 * x1) AS g FROM a3, (SELECT count(*) AS n FROM a0)),
    a5 AS (SELECT b2, rr, n, sum((y - c * x1 - b2 * r) * (y - c * x1 - b2 * r)) AS rss FROM a3, a4 GROUP BY b2, rr, n)"""


@query("m1_near_collinear", f"WITH {NEAR} SELECT 'x2' AS term, {R('b2 / 1000', 'estimate')}, {R('sqrt(rss / (n - 3) / rr) / 1000', 'std_error')}, {R('b2 / sqrt(rss / (n - 3) / rr)', 'statistic', 4)} FROM a5")
def near_collinear(spark, sf):
    """Two regressors that differ by a millionth of their spread: their squared sums cannot tell them apart, a QR can."""
    rows = facts(spark, sf).select(F.col("wt").cast("double").alias("x1"), (F.col("wt") + F.col("score") / 1000).alias("x2"), (F.col("wage") / 1000).alias("y"))
    table = fit_qr(rows, design("y", "x1", "x2")).where("term = 'x2'")
    return shown(table.withColumns({"estimate": F.col("estimate") / 1000, "std_error": F.col("std_error") / 1000}))


YOUTH = f"""{FACTS}, yp AS (SELECT area, yr, CASE WHEN disc <= 0.03::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS youth, sum(wt * score) / sum(wt) AS score, sum(wt) AS pop,
      sum(wt * wage) / sum(wt) AS w, {", ".join(f"sum(CASE WHEN {SHARES[n]} THEN wt ELSE 0 END) / sum(wt) AS {n}" for n in ("frac_col", *INDUSTRY_SHARES))} FROM facts WHERE yr IN (1995, 2001) GROUP BY 1, 2, 3),
    ya AS (SELECT *, sum(score * pop) OVER a / sum(pop) OVER a AS area_score, lead(ln(score)) OVER (PARTITION BY area, youth ORDER BY yr) - ln(score) AS del_score FROM yp WINDOW a AS (PARTITION BY area, yr))"""
YOUTH_MODELS = {"plain": design("del_score", "area_score*youth"), "controls": design("del_score", "area_score*youth", "w", "frac_col", *INDUSTRY_SHARES)}


@query("m5_youth_interaction", f"WITH {YOUTH}, " + ",\n    ".join(ols(n, "ya", "del_score", _design_terms(d)) for n, d in YOUTH_MODELS.items()) + " " + union(YOUTH_MODELS))
def youth_interaction(spark, sf):
    """Change in a group's exposure on the area's exposure times youth, without and with controls."""
    shares = {n: F.expr(SHARES[n]) for n in ("frac_col", *INDUSTRY_SHARES)}
    rows = panels.age_panel(facts(spark, sf, ENDS), ["area"], "yr", F.col("disc") <= 0.03, "score", "wt", shares, {"w": "wage"})
    return shown(fit_family(rows, YOUTH_MODELS), "model")


@query(
    "m5_two_flags",
    f"""WITH {FACTS_JOB}, c AS (SELECT yr, area, ind, sum(wt) AS num, sum(wt * score) / sum(wt) AS score, sum(CASE WHEN coll THEN wt ELSE 0 END) / sum(wt) AS frac_col
      FROM persons WHERE emp AND yr IN (1995, 2001) GROUP BY yr, area, ind),
    f AS (SELECT num, CAST(round(frac_col, 9) > median(round(frac_col, 9)) OVER y AS DOUBLE) AS col_int, CAST(round(score, 9) > median(round(score, 9)) OVER y AS DOUBLE) AS comp_int,
      lead(ln(num)) OVER (PARTITION BY area, ind ORDER BY yr) - ln(num) AS del_emp FROM c WINDOW y AS (PARTITION BY yr)),
    {ols('fit', 'f', 'del_emp', {'comp_int': 'comp_int', 'col_int': 'col_int', 'comp_int:col_int': 'comp_int * col_int'}, 'num')} {listed('fit')}""",
)
def two_flags(spark, sf):
    """Employment growth of industry cells on two median flags and their product, weighted by size."""
    cells = panels.weighted_panel(facts_job(spark, sf, ENDS).where("emp"), ["yr", "area", "ind"], "wt", {"score": "score"}, {"frac_col": F.col("coll")}, {"num": None})
    cells = cells.withColumns({"score": F.round("score", 9), "frac_col": F.round("frac_col", 9)})
    cells = panels.above_median(panels.above_median(cells, "frac_col", "col_int", ["yr"]), "score", "comp_int", ["yr"])
    cells = log_change_next(cells, ["area", "ind"], "yr", del_emp="num").withColumns({"col_int": flag(F.col("col_int")), "comp_int": flag(F.col("comp_int"))})
    return shown(fit_family(cells, {"m": design("del_emp", "comp_int*col_int", weight="num")}))


@query(
    "m2_migration_models",
    f"""WITH {FACTS_FLOW}, f AS (SELECT yr, state, origin, sum(CASE WHEN state <> origin THEN wt ELSE 0 END) AS moved, sum(wt) AS num, sum(wt * score) / sum(wt) AS score FROM persons GROUP BY yr, state, origin),
    o AS (SELECT yr, origin AS place, sum(moved) AS outflow FROM f GROUP BY 1, 2),
    i AS (SELECT yr, state AS place, sum(moved) AS inflow, sum(num) AS num, sum(num * score) / sum(num) AS score FROM f GROUP BY 1, 2),
    x AS (SELECT yr, inflow, inflow - outflow AS net, max(CASE WHEN yr = 1995 THEN score END) OVER p AS score_base, max(CASE WHEN yr = 1995 THEN num END) OVER p AS pop_base
      FROM i JOIN o USING (yr, place) WINDOW p AS (PARTITION BY place)), z AS (SELECT * FROM x WHERE yr <> 1995),
    {ols('inflow', 'z', 'inflow', same(['score_base', 'pop_base']))}, {ols('net', 'z', 'net', same(['score_base', 'pop_base']))} {union(['inflow', 'net'])}""",
)
def migration_models(spark, sf):
    """Inflow and net flow of a place on its exposure and size in the first year."""
    rows = migration.net_migration(facts_flow(spark, sf), "yr", "state", "origin", "wt", "score", 1995).where("yr <> 1995")
    return shown(fit_family(rows, {y: design(y, "score_base", "pop_base") for y in ("inflow", "net")}), "model")


@query(
    "m2_decomposition_models",
    f"""WITH {OCC_SCORED}, c AS (SELECT yr, (b - lag(b) OVER w) * 1000 AS del_between, (w - lag(w) OVER w) * 1000 AS del_within, (t - lag(t) OVER w) * 1000 AS del_total FROM parts
      WHERE yr IN (1995, 2001) WINDOW w AS (PARTITION BY area ORDER BY yr)),
    {ols('two', 'c', 'del_total', same(['del_within', 'del_between']))}, {ols('within', 'c', 'del_total', same(['del_within']))}, {ols('between', 'c', 'del_total', same(['del_between']))}
    SELECT 'both' AS model, term, {R('estimate', 'estimate')}, CAST(NULL AS DOUBLE) AS std_error FROM two
    UNION ALL SELECT 'within', term, {R('estimate')}, {R('std_error')} FROM within UNION ALL SELECT 'between', term, {R('estimate')}, {R('std_error')} FROM between""",
)
def decomposition_models(spark, sf):
    """Change in exposure (in thousandths) on its within and between parts; with both the fit is exact and has no error to show."""
    changes = decomposition.decomposition_changes(parts(spark, sf).where(F.col("yr").isin(*ENDS)), ["area"], "yr")
    changes = changes.select(*[(F.col(c) * 1000).alias(c) for c in ("del_total", "del_within", "del_between")])
    models = {"both": ["del_within", "del_between"], "within": ["del_within"], "between": ["del_between"]}
    table = fit_family(changes, {n: design("del_total", *x) for n, x in models.items()})
    error = F.when(F.col("model") != "both", F.col("std_error"))
    return rounded(table.select("model", "term", "estimate", error.alias("std_error")), "estimate", "std_error")


# Clustered fits ---------------------------------------------------------------------------------------------------------


@query(
    "m8_concentration",
    f"""WITH {FACTS_JOB}, mc AS (SELECT area, yr, occ, count(*) AS n FROM persons WHERE occ <> 'PROMO' GROUP BY area, yr, occ),
    ms AS (SELECT *, n / sum(n) OVER (PARTITION BY area, yr) AS share, sum(n) OVER (PARTITION BY area, yr) AS total FROM mc),
    mh AS (SELECT area, yr, sum(share * share) AS hh_maj FROM ms WHERE total > 30 GROUP BY area, yr),
    ic AS (SELECT area, yr, ind, sum(wt) AS emp FROM persons WHERE ind NOT IN ('Brand#1', 'Brand#2') GROUP BY area, yr, ind),
    ih AS (SELECT area, yr, sum(share * share) AS hh FROM (SELECT *, emp / sum(emp) OVER (PARTITION BY area, yr) AS share FROM ic) WHERE emp > 0 GROUP BY area, yr),
    hm AS (SELECT hh_maj, hh, CAST(s_nationkey AS BIGINT) AS state FROM mh JOIN ih USING (area, yr) JOIN supplier ON area = s_suppkey),
    {ols('fit', 'hm', 'hh_maj', same(['hh']), cluster='state')} {listed('fit')}""",
)
def concentration_fit(spark, sf):
    """Concentration of occupations on that of industries, clustered by state."""
    rows = facts_job(spark, sf)
    major = concentration.count_concentration(rows, ["area", "yr"], "occ", 30, ["PROMO"]).withColumnRenamed("hh", "hh_maj")
    index = concentration.industry_concentration(rows, ["area", "yr"], "ind", "wt", "score", drop=["Brand#1", "Brand#2"]).select("area", "yr", "hh")
    return shown(fit_family(major.join(index, ["area", "yr"]).join(areas(spark, sf), "area"), {"m": design("hh_maj", "hh")}, cluster="state"))


@query(
    "m8_mover_exposure",
    f"""WITH {FACTS_FLOW}, ps AS (SELECT state AS place, yr, sum(wt * score) / sum(wt) AS x FROM persons GROUP BY 1, 2),
    zs AS (SELECT place, yr, (x - avg(x) OVER (PARTITION BY yr)) / stddev_samp(x) OVER (PARTITION BY yr) AS z FROM ps),
    mv AS (SELECT origin, z, CASE WHEN state <> origin THEN 1.0 ELSE 0.0 END AS mig, CASE WHEN coll THEN 1.0 ELSE 0.0 END AS col FROM persons p JOIN zs ON p.state = place AND p.yr = zs.yr),
    {ols('fit', 'mv', 'z', {'mig': 'mig', 'col': 'col', 'mig:col': 'mig * col'}, cluster='origin')} {listed('fit')}""",
)
def mover_exposure(spark, sf):
    """Exposure of the place reached on moving times college, clustered by the place left."""
    persons = facts_flow(spark, sf)
    scores = migration.place_scores(persons, "state", "yr", "score", "wt")
    rows = migration.mover_rows(persons, scores, "state", "yr", "state", "origin", "post", F.col("coll"))
    return shown(fit_family(rows, {"m": design("post_exposure", "mig*col")}, cluster="origin"))


_DISC = [f"d{k}" for k in range(1, 11)]
SCORES = f"""{FACTS_STATE}, pr AS (SELECT *, CASE WHEN flag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ret FROM persons),
    an AS (SELECT area, sum(wt * score) / sum(wt) AS exp, sum(CASE WHEN coll THEN wt ELSE 0 END) / sum(wt) AS frac_col FROM facts WHERE yr = 1995 GROUP BY area),
    az AS (SELECT area, frac_col, (exp - avg(exp) OVER ()) / stddev_samp(exp) OVER () AS exp_norm FROM an),
    ap AS (SELECT area, avg(ret) AS pre FROM pr WHERE yr < 1997 GROUP BY area),
    sr AS (SELECT p.area, p.state, p.wage / 1000 AS sat, p.score AS gpa, p.wt, pre, frac_col, exp_norm, {", ".join(f"CASE WHEN round(p.disc * 100) = {k} THEN 1.0 ELSE 0.0 END AS d{k}" for k in range(1, 11))}
      FROM pr p JOIN az USING (area) JOIN ap USING (area) WHERE p.yr >= 1997)"""
SCORE_MODELS = {
    "sat": ("sat", ["wt", "frac_col", "exp_norm"]), "sat_pre": ("sat", ["wt", "pre", "frac_col", "exp_norm"]), "gpa": ("gpa", ["wt", "frac_col", "exp_norm"]),
    "gpa_pre": ("gpa", ["wt", "pre", "frac_col", "exp_norm"]), "sat_gpa": ("sat", ["gpa", "wt", "pre", "frac_col", "exp_norm"]),
}


def _score_twin(name: str, y: str, terms) -> str:
    columns = [*terms, *_DISC]
    where = "sr" if not name.startswith("sat") else "(SELECT * FROM sr WHERE sat >= 20)"
    return demeaned(f"{name}_d", where, [y, *columns], "1", "state", "area, ") + ",\n    " + ols(
        name, f"{name}_d", y, same(columns), cluster="area", intercept=False, lost=f"(SELECT count(DISTINCT state) FROM {where})"
    )


@query(
    "m8_score_models",
    f"WITH {SCORES}, " + ",\n    ".join(_score_twin(n, y, x) for n, (y, x) in SCORE_MODELS.items())
    + " " + " UNION ALL ".join(listed(n, model=n, where="WHERE NOT regexp_matches(term, '^d[0-9]+$')") for n in SCORE_MODELS),
)
def score_models(spark, sf):
    """Two outcomes on area conditions with two factors absorbed, clustered by area; one outcome only where it is large enough."""
    rows = facts_state(spark, sf).withColumns({"ret": flag(F.col("flag") == "R"), "sat": F.col("wage") / 1000, "gpa": F.col("score"), "level": F.round(F.col("disc") * 100).cast("int")})
    pre = rows.where("yr < 1997").groupBy("area").agg(F.avg("ret").alias("pre"))
    now = zscore(area_panel(spark, sf, [1995]).select("area", "exp", "frac_col"), exp_norm="exp").drop("exp")
    data = rows.where("yr >= 1997").join(now.join(pre, "area"), "area")
    large = {n: design(y, *x) for n, (y, x) in SCORE_MODELS.items() if y == "sat"}
    every = {n: design(y, *x) for n, (y, x) in SCORE_MODELS.items() if y != "sat"}
    table = fit_within_family(data.where("sat >= 20"), large, ["state", "level"], cluster="area")
    return shown(table.unionByName(fit_within_family(data, every, ["state", "level"], cluster="area")), "model")
