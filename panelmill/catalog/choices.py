"""Choices of persons: clustered logits with factors, slices, windows and conditions of an earlier cohort (M, D and K ids)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.catalog.registry import FACTS_FLOW, R, area_panel, facts_flow, query, rounded, table
from panelmill.catalog.twins import logit, normal_p
from panelmill.functions.codes import period_start
from panelmill.functions.safe import flag
from panelmill.models.design import design, factor_levels
from panelmill.models.logit import fit_logit
from panelmill.operators.scaling import zscore
from panelmill.plans import cohorts, did, exposure, migration
from panelmill.plans.regressions import choice_models, condition_models, sliding_windows, with_outcome
from panelmill.sources.tables import year_bins

COHORT_KINDS = ["A", "N", "R"]
_DISC = {f"disc={k / 100}": f"CASE WHEN disc = {k / 100}::DOUBLE THEN 1.0 ELSE 0.0 END" for k in range(1, 11)}
_YR = {f"yr={y}": f"CASE WHEN yr = {y} THEN 1.0 ELSE 0.0 END" for y in range(1996, 2002)}


def _states(column: str = "state", first: str = "(SELECT min(s_nationkey) FROM supplier)") -> dict[str, str]:
    return {f"state={s}": f"CASE WHEN {column} = {s} AND {s} > {first} THEN 1.0 ELSE 0.0 END" for s in range(1, 25)}


#: Only levels that occur have a coefficient.
KNOWN = "(term NOT LIKE 'state=%' OR estimate IS NOT NULL)"


def _listed(name: str, keys: str = "", model: str = "", where: str = "TRUE") -> str:
    lead = f"'{model}' AS model, " if model else ""
    return (
        f"SELECT {keys}{lead}term, {R('estimate', 'estimate')}, {R('std_error', 'std_error')}, {R('statistic', 'statistic', 4)}, "
        f"{R(normal_p('statistic'), 'p_value')} FROM {name} WHERE {KNOWN} AND {where}"
    )


def _shown(rows, *keys):
    rows = rows.select(*keys, "term", "estimate", "std_error", "statistic", "p_value")
    return rounded(rounded(rows, "estimate", "std_error", "p_value"), "statistic", digits=4)


PERSONS = f"""{FACTS_FLOW}, pr AS (SELECT *, CASE WHEN flag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ret, CAST(floor(yr / 2) * 2 AS BIGINT) AS period FROM persons),
    pt AS (SELECT area, period, avg(ret) AS rate FROM pr GROUP BY area, period),
    pz AS (SELECT area, period, (rate - avg(rate) OVER p) / stddev_samp(rate) OVER p AS pre_z FROM pt WINDOW p AS (PARTITION BY period)),
    an AS (SELECT area, sum(wt * score) / sum(wt) AS exp, sum(CASE WHEN coll THEN wt ELSE 0 END) / sum(wt) AS frac_col FROM facts WHERE yr = 1995 GROUP BY area),
    az AS (SELECT area, frac_col, (exp - avg(exp) OVER ()) / stddev_samp(exp) OVER () AS exp_norm FROM an),
    ch AS (SELECT pr.*, pre_z, frac_col, exp_norm FROM pr JOIN az USING (area) JOIN (SELECT area, pre_z FROM pz WHERE period = 1994) USING (area))"""


def persons(spark, sf):
    """Persons with the outcome, their area's standardised base rate, college share and exposure."""
    rows = facts_flow(spark, sf).withColumn("ret", flag(F.col("flag") == "R")).withColumn("period", period_start("yr", 2))
    rates = did.base_rates(rows, ["area"], "period", "ret")
    conditions = zscore(area_panel(spark, sf, [1995]).select("area", "exp", "frac_col"), exp_norm="exp").drop("exp")
    return did.with_base_rate(rows, rates, ["area"], "period", 1994).join(conditions, "area")


@query("m9_choice_models", f"WITH {PERSONS}, {logit('fit', 'ch', 'ret', {'pre_z': 'pre_z', 'frac_col': 'frac_col', 'exp_norm': 'exp_norm', **_YR, **_DISC}, cluster='area')} {_listed('fit')}")
def choice_fit(spark, sf):
    """Clustered logit with factors, z-scored exposure and the area's base rate."""
    rows = persons(spark, sf)
    factors = {"yr": factor_levels(rows, "yr"), "disc": factor_levels(rows, "disc")}
    return _shown(fit_logit(rows, design("ret", "pre_z", "frac_col", "exp_norm", factors=factors), cluster="area", patterns=True).coefficients())


#: Persons at large and three slices of them; a person can be in several.
SLICES = {"all": "TRUE", "dear": "wage > 50000", "cheap": "wage < 20000", "far": "state <> origin"}
CHOICE_TERMS = {"w": "wt", "frac_col": "frac_col", "exp_norm": "exp_norm"}


@query(
    "m9_choice_slices",
    f"""WITH {PERSONS}, sl AS ({" UNION ALL ".join(f"SELECT '{n}' AS slice, * FROM ch WHERE {p}" for n, p in SLICES.items())}),
    {logit('fit', 'sl', 'ret', {**CHOICE_TERMS, **_states(), **_DISC}, keys=['slice'], cluster='area')} {_listed('fit', 'slice, ')}""",
)
def choice_slices(spark, sf):
    """Choice on area conditions and background with state effects, for all persons and in three slices at once, clustered by area."""
    rows = persons(spark, sf).withColumn("w", F.col("wt"))
    named = F.array(*[F.when(F.expr(p), F.lit(n)) for n, p in SLICES.items()])
    rows = rows.withColumn("slice", F.explode(F.array_compact(named)))
    d = choice_models("ret", "exp_norm", {"state": factor_levels(rows, "state"), "disc": factor_levels(rows, "disc")})
    return _shown(fit_logit(rows, d, by=["slice"], cluster="area", patterns=True).coefficients(), "slice")


OUTCOMES = {"far": "state <> origin", "dear": "wage > 50000", "ret": "flag = 'R'"}


@query(
    "m15_outcome_models",
    f"""WITH {PERSONS}, ou AS ({" UNION ALL ".join(f"SELECT '{n}' AS model, CASE WHEN {p} THEN 1.0 ELSE 0.0 END AS picked, * FROM ch WHERE yr >= 1996" for n, p in OUTCOMES.items())}),
    {logit('fit', 'ou', 'picked', {'pre_z': 'pre_z', **CHOICE_TERMS, **_states()}, keys=['model'], cluster='area')} {_listed('fit', 'model, ')}""",
)
def outcome_models(spark, sf):
    """Several yes/no outcomes on the same right side with base rate and state effects, all in one job, clustered by area."""
    rows = persons(spark, sf).withColumn("w", F.col("wt")).where("yr >= 1996")
    named = F.array(*[F.struct(F.lit(n).alias("model"), F.expr(p).alias("hit")) for n, p in OUTCOMES.items()])
    rows = with_outcome(rows.withColumn("o", F.explode(named)).withColumn("model", F.col("o.model")), "picked", F.col("o.hit"))
    d = choice_models("picked", "exp_norm", {"state": factor_levels(rows, "state")}, extra=["pre_z"])
    return _shown(fit_logit(rows, d, by=["model"], cluster="area", patterns=True).coefficients(), "model")


@query(
    "m14_choice_windows",
    f"""WITH {PERSONS}, wi AS (SELECT ch.*, w AS window_start FROM ch JOIN (SELECT CAST(unnest([1995, 1996, 1997, 1998]) AS BIGINT) AS w) ON yr >= w AND yr < w + 4),
    {logit('fit', 'wi', 'ret', {**CHOICE_TERMS, **_states(), **_DISC}, keys=['window_start'], cluster='area')}
    {_listed('fit', 'window_start AS window, ', where="term = 'exp_norm'")}""",
)
def choice_windows(spark, sf):
    """Effect of exposure in four overlapping windows, with factors, clustered by area."""
    rows = sliding_windows(persons(spark, sf).withColumn("w", F.col("wt")), "yr", 1995, 4, 1, 4)
    d = choice_models("ret", "exp_norm", {"state": factor_levels(rows, "state"), "disc": factor_levels(rows, "disc")})
    return _shown(fit_logit(rows, d, by=["window"], cluster="area", patterns=True).coefficients(terms=["exp_norm"]), "window")


CONDITIONS = f"""{FACTS_FLOW}, b AS (SELECT *, CAST((yr - 1995) // 3 + 1 AS BIGINT) AS grp, (yr - 1995) % 3 + 1 AS rank FROM persons),
    e AS (SELECT * FROM b WHERE yr <= 2000),
    c AS (SELECT state, flag, grp + 1 AS grp, avg(wage) FILTER (WHERE rank = 3) / avg(wage) FILTER (WHERE rank = 1) - 1 AS growth,
      sum(wt * wage) / sum(wt) AS mean_wage, sum(wt) AS emp FROM e GROUP BY 1, 2, 3),
    s AS (SELECT *, emp / sum(emp) OVER (PARTITION BY state, grp) AS frac FROM c),
    wd AS (SELECT state AS origin, grp, max(growth) FILTER (WHERE flag = 'R') AS g, max(frac) FILTER (WHERE flag = 'R') AS f,
      max(mean_wage) FILTER (WHERE flag = 'R') / max(mean_wage) FILTER (WHERE flag = 'N') AS p FROM s GROUP BY state, grp),
    ov AS (SELECT state AS origin, grp + 1 AS grp, avg(wage) FILTER (WHERE rank = 3) / avg(wage) FILTER (WHERE rank = 1) - 1 AS sg FROM e GROUP BY 1, 2),
    jn AS (SELECT b.state, b.origin, CASE WHEN flag = 'R' THEN 1.0 ELSE 0.0 END AS pick, g, f, p, sg FROM b JOIN wd USING (origin, grp) JOIN ov USING (origin, grp)),
    cd AS (SELECT state, origin, pick, sg AS state_growth, (g - avg(g) OVER ()) / stddev_samp(g) OVER () AS growth, (f - avg(f) OVER ()) / stddev_samp(f) OVER () AS share,
      (p - avg(p) OVER ()) / stddev_samp(p) OVER () AS prem FROM jn),
    cm AS (SELECT 'all' AS model, * FROM cd UNION ALL SELECT 'movers', * FROM cd WHERE state <> origin)"""
CONDITION_TERMS = {
    "growth": "growth", "share": "share", "state_growth": "state_growth", "prem": "prem", "growth:share": "growth * share", "prem:share": "prem * share",
}


@query("m3_condition_models", f"WITH {CONDITIONS}, {logit('fit', 'cm', 'pick', {**CONDITION_TERMS, **_states()}, keys=['model'])} {_listed('fit', 'model, ')}")
def condition_fit(spark, sf):
    """Choice on the growth and premium that the place of origin showed one cohort earlier, with effects of the state lived in.

    All persons of the later cohorts, and those who moved.
    """
    bins = year_bins(spark, 1995, 3, 3).withColumnRenamed("year", "yr")
    rows = facts_flow(spark, sf).join(bins, "yr")
    earlier = rows.where("yr <= 2000")
    wide = cohorts.cohort_conditions(earlier, ["state"], "flag", "grp", "rank", 1, 3, "wage", "wt", COHORT_KINDS, ("R", "N"))
    overall = cohorts.wage_growth(earlier, ["state", "grp"], "rank", 1, 3, "wage", "state_growth").withColumn("grp", F.col("grp") + 1)
    seen = wide.join(overall, ["state", "grp"]).select(F.col("state").alias("origin"), "grp", "state_growth", "wage_growth_R", "frac_emp_R", "premium")
    # Equal conditions are counted before the fit, so persons meet them only in the join.
    data = rows.withColumn("pick", flag(F.col("flag") == "R")).select("state", "origin", "grp", "pick").join(seen, ["origin", "grp"])
    scaled = zscore(data, growth="wage_growth_R", share="frac_emp_R", prem="premium")
    named = F.array_compact(F.array(F.lit("all"), F.when(F.expr("state <> origin"), F.lit("movers"))))
    scaled = scaled.withColumn("model", F.explode(named))
    d = condition_models("pick", "growth", "share", "state_growth", "prem", factors={"state": factor_levels(scaled, "state")})
    return _shown(fit_logit(scaled, d, by=["model"], patterns=True).coefficients(), "model")


MOVES = f"""{FACTS_FLOW}, ps AS (SELECT state AS place, yr, sum(wt * score) / sum(wt) AS x FROM persons GROUP BY 1, 2),
    zs AS (SELECT place, yr, (x - avg(x) OVER (PARTITION BY yr)) / stddev_samp(x) OVER (PARTITION BY yr) AS z FROM ps),
    mb AS (SELECT p.yr, p.state, p.origin, p.wt, floor(p.wage / 5000) AS inc, CASE WHEN coll THEN 1.0 ELSE 0.0 END AS col, CASE WHEN p.state <> p.origin THEN 1.0 ELSE 0.0 END AS mig,
      a.z AS prev, b.z AS post FROM persons p JOIN zs a ON p.origin = a.place AND p.yr = a.yr JOIN zs b ON p.state = b.place AND p.yr = b.yr),
    mm AS (SELECT 'prev' AS model, prev AS exposure, * FROM mb UNION ALL SELECT 'prev_last', prev, * FROM mb WHERE yr = 2001 UNION ALL SELECT 'post', post, * FROM mb)"""


@query(
    "d19_move_propensity",
    f"""WITH {MOVES}, {logit('fit', 'mm', 'mig', {'age': 'wt', 'inc': 'inc', 'exposure': 'exposure', 'col': 'col', 'exposure:col': 'exposure * col', **_states()}, keys=['model'], cluster='origin')}
    {_listed('fit', 'model, ')}""",
)
def move_propensity(spark, sf):
    """Moving on age, income class, effects of the state lived in, and exposure times college, clustered by the place left.

    Exposure of the place left, the same in the last year only, and exposure of the place reached.
    """
    rows = facts_flow(spark, sf)
    scores = migration.place_scores(rows, "state", "yr", "score", "wt")
    both = migration.mover_rows(rows, scores, "state", "yr", "state", "origin", "prev", F.col("coll"))
    reached = scores.select(F.col("state"), "yr", F.col("exposure_z").alias("post_exposure"))
    both = both.join(reached, ["state", "yr"]).withColumns({"age": F.col("wt"), "inc": F.floor(F.col("wage") / 5000)})
    models = F.array(
        F.struct(F.lit("prev").alias("model"), F.col("prev_exposure").alias("exposure")),
        F.struct(F.when(F.col("yr") == 2001, F.lit("prev_last")).alias("model"), F.col("prev_exposure").alias("exposure")),
        F.struct(F.lit("post").alias("model"), F.col("post_exposure").alias("exposure")),
    )
    both = both.withColumn("m", F.explode(models)).select("*", "m.*").where("model is not null")
    fit = migration.move_propensity(both, "exposure", ["age", "inc"], "origin", {"state": factor_levels(both, "state")}, by=["model"])
    return _shown(fit.coefficients(), "model")


@query(
    "k10_validated_scores",
    f"""WITH d AS (SELECT doc_id, CAST(quality AS DOUBLE) AS y, quality, ln(1 + n_chars) AS size FROM labels JOIN documents USING (doc_id)),
    r AS (SELECT d.*, CAST(i AS BIGINT) AS replicate, CAST(CAST(('0x' || left(md5(concat_ws('-', doc_id, i, 0)), 13)) AS BIGINT) AS DOUBLE) AS draw FROM d, range(1, 101) t(i)),
    n AS (SELECT *, row_number() OVER (PARTITION BY replicate, quality ORDER BY draw) AS pos, count(*) OVER (PARTITION BY replicate, quality) AS n FROM r),
    h AS (SELECT *, pos <= CASE WHEN n % 2 = 0 THEN n // 2 WHEN (n // 2) % 2 = 0 THEN n // 2 ELSE n // 2 + 1 END AS inside FROM n),
    {logit('fit', '(SELECT * FROM h WHERE inside)', 'y', {'size': 'size'}, keys=['replicate'])},
    b AS (SELECT replicate, max(estimate) FILTER (WHERE term = 'size') AS b1, max(estimate) FILTER (WHERE term <> 'size') AS b0 FROM fit GROUP BY replicate),
    p AS (SELECT replicate, y, least(floor(1000 / (1 + exp(-b0 - b1 * size))), 1000) AS cell FROM h JOIN b USING (replicate) WHERE NOT inside),
    g AS (SELECT replicate, CAST(c AS DOUBLE) AS c FROM b, range(1001) t(c)),
    k AS (SELECT g.replicate, c, count(*) FILTER (WHERE y = 1 AND cell >= c)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND cell >= c)::DOUBLE AS fp FROM g LEFT JOIN p USING (replicate) GROUP BY g.replicate, c),
    q AS (SELECT replicate, tp / max(tp) OVER (PARTITION BY replicate) AS tpr, fp / max(fp) OVER (PARTITION BY replicate) AS fpr FROM k),
    best AS (SELECT replicate, fpr, max(tpr) AS tpr FROM q GROUP BY replicate, fpr),
    t AS (SELECT replicate, (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS a FROM best WINDOW w AS (PARTITION BY replicate ORDER BY fpr))
    SELECT replicate, {R('sum(a)', 'auc')} FROM t GROUP BY replicate""",
)
def validated(spark, sf):
    """Scores fitted on half of each class and measured on the rest, a hundred times."""
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    docs = table(spark, sf, "documents").select("doc_id", F.log1p("n_chars").alias("size"))
    return rounded(exposure.validate_scores(labels.join(docs, "doc_id"), "doc_id", "quality", ["size"], replicates=100), "auc")
