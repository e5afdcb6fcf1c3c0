"""Regressions (M ids); twins are closed forms over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.catalog.registry import FACTS, PANEL, R, area_panel, facts, query, r, rounded
from panelmill.models.design import design, design_all, factor_levels
from panelmill.models.linear import fit_linear, fit_lines
from panelmill.models.logit import fit_logit
from panelmill.operators.panel import log_change_next
from panelmill.operators.quantiles import quantile_bins
from panelmill.plans.regressions import effect_by_window, fit_many, with_outcome

ROWS = FACTS + ", f AS (SELECT *, wage / 1000 AS y, CASE WHEN flag = 'R' THEN 1 ELSE 0 END AS ret FROM facts)"


def rows(spark, sf):
    """Order lines with the wage in thousands and a 0/1 outcome."""
    return facts(spark, sf).withColumns({
        "y": F.col("wage") / 1000, "ret": (F.col("flag") == "R").cast("double"),
        "coll": F.col("coll").cast("double"), "emp": F.col("emp").cast("double"),
    })


def _line(x: str, w: str = "1", source: str = "f", keys: str = "", y: str = "y") -> str:
    """CTEs of a one-regressor fit: coefficients a and b with their standard errors, sigma, sums."""
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""s AS (SELECT {lead}CAST(count(*) AS DOUBLE) AS n, sum({w}) AS sw, sum({w} * {x}) / sum({w}) AS mx,
      sum({w} * {y}) / sum({w}) AS my, sum({w} * {x} * {x}) AS xx, sum({w} * {x} * {y}) AS xy, sum({w} * {y} * {y}) AS yy
      FROM {source} {group}),
    d AS (SELECT *, xx - sw * mx * mx AS sxx, xy - sw * mx * my AS sxy, yy - sw * my * my AS syy FROM s),
    c AS (SELECT *, sxy / sxx AS b, my - sxy / sxx * mx AS a, sqrt((syy - sxy * sxy / sxx) / (n - 2)) AS sigma FROM d),
    e AS (SELECT *, sigma / sqrt(sxx) AS se_b, sigma * sqrt(1 / sw + mx * mx / sxx) AS se_a FROM c)"""


def _two_terms(x: str, extra: str = "") -> str:
    return f"""SELECT '(Intercept)' AS term, {R('a', 'estimate')}, {R('se_a', 'std_error')}, {R('a / se_a', 'statistic')}{extra.format(b='a')} FROM e
    UNION ALL SELECT '{x}', {R('b')}, {R('se_b')}, {R('b / se_b')}{extra.format(b='b')} FROM e"""


SHOWN = ["estimate", "std_error", "statistic"]


@query("m1_least_squares", f"WITH {ROWS}, {_line('wt')} {_two_terms('wt')}")
def m1(spark, sf):
    table = fit_linear(rows(spark, sf), design("y", "wt")).coefficients()
    return rounded(table.select("term", *SHOWN), *SHOWN)


@query("m2_weighted_least_squares", f"WITH {ROWS}, {_line('score', 'wt')} {_two_terms('score')}")
def m2(spark, sf):
    table = fit_linear(rows(spark, sf), design("y", "score", weight="wt")).coefficients()
    return rounded(table.select("term", *SHOWN), *SHOWN)


def _odds(source: str, x: str, y: str, keys: str = "") -> str:
    """CTE of a logit on one 0/1 regressor: log odds and their standard errors."""
    lead = f"{keys}, " if keys else ""
    cell = lambda a, b: f"CAST(sum(CASE WHEN {x} = {a} AND {y} = {b} THEN 1 ELSE 0 END) AS DOUBLE) AS n{a}{b}"
    return f"""o AS (SELECT {lead}{cell(0, 0)}, {cell(0, 1)}, {cell(1, 0)}, {cell(1, 1)} FROM {source} {f'GROUP BY {keys}' if keys else ''}),
    e AS (SELECT *, ln(n01 / n00) AS a, sqrt(1 / n01 + 1 / n00) AS se_a, ln(n11 * n00 / (n10 * n01)) AS b,
      sqrt(1 / n11 + 1 / n10 + 1 / n01 + 1 / n00) AS se_b FROM o)"""


NUM = ROWS + ", g AS (SELECT area, yr, wt, score, disc, y, ret, CAST(emp AS INTEGER) AS emp, CAST(coll AS INTEGER) AS coll FROM f)"


@query("m3_logit", f"WITH {NUM}, {_odds('g', 'emp', 'ret')} {_two_terms('emp')}")
def m3(spark, sf):
    fit = fit_logit(rows(spark, sf), design("ret", "emp"), patterns=True)
    return rounded(fit.coefficients().select("term", *SHOWN), *SHOWN)


@query(
    "m4_factor",
    f"""WITH {ROWS}, m AS (SELECT yr, avg(wt) AS mx, avg(y) AS my FROM f GROUP BY yr),
    b AS (SELECT sum((wt - mx) * (y - my)) / sum((wt - mx) * (wt - mx)) AS b FROM f JOIN m USING (yr)),
    base AS (SELECT mx, my FROM m WHERE yr = (SELECT min(yr) FROM m))
    SELECT 'wt' AS term, {R('b', 'estimate')} FROM b
    UNION ALL SELECT '(Intercept)', {R('my - b * mx')} FROM base, b
    UNION ALL SELECT concat('yr=', CAST(yr AS VARCHAR)), {R('m.my - b * m.mx - (base.my - b * base.mx)')} FROM m, base, b
      WHERE yr > (SELECT min(yr) FROM m)""",
)
def m4(spark, sf):
    data = rows(spark, sf)
    fit = fit_linear(data, design("y", "wt", factors={"yr": factor_levels(data, "yr")}))
    return rounded(fit.coefficients().select("term", "estimate"), "estimate")


@query(
    "m5_interaction",
    f"""WITH {NUM}, m AS (SELECT avg(y) FILTER (WHERE coll = 0 AND emp = 0) AS m00, avg(y) FILTER (WHERE coll = 1 AND emp = 0) AS m10,
      avg(y) FILTER (WHERE coll = 0 AND emp = 1) AS m01, avg(y) FILTER (WHERE coll = 1 AND emp = 1) AS m11 FROM g)
    SELECT '(Intercept)' AS term, {R('m00', 'estimate')} FROM m UNION ALL SELECT 'coll', {R('m10 - m00')} FROM m
    UNION ALL SELECT 'emp', {R('m01 - m00')} FROM m UNION ALL SELECT 'coll:emp', {R('m11 - m10 - m01 + m00')} FROM m""",
)
def m5(spark, sf):
    fit = fit_linear(rows(spark, sf), design("y", "coll*emp"))
    return rounded(fit.coefficients().select("term", "estimate"), "estimate")


@query(
    "m6_all_other_columns",
    f"""WITH {ROWS}, s AS (SELECT covar_pop(wt, wt) AS s11, covar_pop(score, score) AS s22, covar_pop(wt, score) AS s12,
      covar_pop(wt, y) AS s1y, covar_pop(score, y) AS s2y, avg(wt) AS m1, avg(score) AS m2, avg(y) AS my FROM f),
    b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM s)
    SELECT '(Intercept)' AS term, {R('my - b1 * m1 - b2 * m2', 'estimate')} FROM b
    UNION ALL SELECT 'wt', {R('b1')} FROM b UNION ALL SELECT 'score', {R('b2')} FROM b""",
)
def m6(spark, sf):
    data = rows(spark, sf).select("y", "wt", "score")
    return rounded(fit_linear(data, design_all(data, "y")).coefficients().select("term", "estimate"), "estimate")


@query("m7_predict", f"WITH {NUM} SELECT CAST(coll AS DOUBLE) AS coll, {R('avg(ret)', 'p')}, count(*) AS n FROM g GROUP BY coll")
def m7(spark, sf):
    data = rows(spark, sf)
    scored = fit_logit(data, design("ret", "coll"), patterns=True).predict(data, "p")
    return scored.groupBy("coll", r("p").alias("p")).agg(F.count(F.lit(1)).alias("n"))


CLUSTERED = f"""{_line('wt')}, u AS (SELECT area, sum(y - a - b * wt) AS u0, sum((y - a - b * wt) * wt) AS u1 FROM f, e GROUP BY area),
    m AS (SELECT count(*) AS g, sum(u0 * u0) AS m00, sum(u0 * u1) AS m01, sum(u1 * u1) AS m11 FROM u),
    v AS (SELECT b, n / (n * xx - n * mx * n * mx) AS b11, -n * mx / (n * xx - n * mx * n * mx) AS b01, xx / (n * xx - n * mx * n * mx) AS b00,
      m00, m01, m11, g / (g - 1) * (n - 1) / (n - 2) AS k, a FROM e, m),
    t AS (SELECT a, b, sqrt(k * (b01 * b01 * m00 + 2 * b01 * b11 * m01 + b11 * b11 * m11)) AS se_b,
      sqrt(k * (b00 * b00 * m00 + 2 * b00 * b01 * m01 + b01 * b01 * m11)) AS se_a FROM v)"""


@query("m8_cluster_robust", f"WITH {ROWS}, {CLUSTERED} {_two_terms('wt').replace('FROM e', 'FROM t')}")
def m8(spark, sf):
    table = fit_linear(rows(spark, sf), design("y", "wt"), cluster="area").coefficients()
    return rounded(table.select("term", *SHOWN), *SHOWN)


@query(
    "m9_clustered_logit_test",
    f"""WITH {NUM}, {_odds('g', 'emp', 'ret')},
    w AS (SELECT *, n01 / (n01 + n00) AS p0, n11 / (n11 + n10) AS p1, n01 * n00 / (n01 + n00) AS w0, n11 * n10 / (n11 + n10) AS w1,
      n00 + n01 + n10 + n11 AS n FROM e),
    u AS (SELECT area, sum(ret - CASE WHEN emp = 1 THEN p1 ELSE p0 END) AS u0, sum((ret - p1) * emp) AS u1 FROM g, w GROUP BY area),
    m AS (SELECT CAST(count(*) AS DOUBLE) AS g, sum(u0 * u0) AS m00, sum(u0 * u1) AS m01, sum(u1 * u1) AS m11 FROM u),
    t AS (SELECT b, sqrt(g / (g - 1) * (n - 1) / (n - 2) * (m00 / w0 / w0 - 2 / w0 * (1 / w0 + 1 / w1) * m01
      + (1 / w0 + 1 / w1) * (1 / w0 + 1 / w1) * m11)) AS se_b FROM w, m)
    SELECT 'emp' AS term, {R('b', 'estimate')}, {R('se_b', 'std_error')}, {R('b / se_b', 'statistic')} FROM t""",
)
def m9(spark, sf):
    fit = fit_logit(rows(spark, sf), design("ret", "emp"), cluster="area", patterns=True)
    return rounded(fit.coefficients(terms=["emp"]).select("term", *SHOWN), *SHOWN)


# Expansion of the t quantile around the normal one; exact to nine digits for these sample sizes.
Z = "1.959963984540054::DOUBLE"
T975 = f"({Z} + (pow({Z}, 3) + {Z}) / (4 * (n - 2)) + (5 * pow({Z}, 5) + 16 * pow({Z}, 3) + 3 * {Z}) / (96 * (n - 2) * (n - 2)))"


@query(
    "m10_confidence_interval",
    f"WITH {ROWS}, {_line('wt')} SELECT 'wt' AS term, {R('b', 'estimate')}, {R(f'b - {T975} * se_b', 'conf_low')}, {R(f'b + {T975} * se_b', 'conf_high')} FROM e",
)
def m10(spark, sf):
    table = fit_linear(rows(spark, sf), design("y", "wt")).coefficients(0.95, ["wt"])
    return rounded(table.select("term", "estimate", "conf_low", "conf_high"), "estimate", "conf_low", "conf_high")


@query(
    "m11_tidy_models",
    f"""WITH {ROWS} SELECT 'qty' AS model, 'wt' AS term, {R('regr_slope(y, wt)', 'estimate')} FROM f
    UNION ALL SELECT 'qty', '(Intercept)', {R('regr_intercept(y, wt)')} FROM f
    UNION ALL SELECT 'tax', 'score', {R('regr_slope(y, score)')} FROM f
    UNION ALL SELECT 'tax', '(Intercept)', {R('regr_intercept(y, score)')} FROM f""",
)
def m11(spark, sf):
    table = fit_many(rows(spark, sf), {"qty": design("y", "wt"), "tax": design("y", "score")})
    return rounded(table.select("model", "term", "estimate"), "estimate")


@query(
    "m12_model_summary",
    f"""WITH {ROWS}, {_line('score', 'wt')}, q AS (SELECT *, 1 - (syy - sxy * sxy / sxx) / syy AS r2 FROM e)
    SELECT n, CAST(2 AS INTEGER) AS rank, n - 2 AS df_residual, {R('sigma', 'sigma')}, {R('r2', 'r_squared', 8)},
    {R('1 - (1 - r2) * (n - 1) / (n - 2)', 'adj_r_squared', 8)}, {R('r2 / (1 - r2) * (n - 2)', 'f_statistic')} FROM q""",
)
def m12(spark, sf):
    s = fit_linear(rows(spark, sf), design("y", "score", weight="wt")).summary()
    return rounded(rounded(s, "sigma", "f_statistic"), "r_squared", "adj_r_squared", digits=8)


@query(
    "m13_fit_per_bin",
    f"""WITH {PANEL}, p AS (SELECT area, yr, emp, frac_col, round(exp, 9) AS exp FROM panel),
    q AS (SELECT [{", ".join(f"quantile_cont(exp, CAST({i / 4} AS DOUBLE))" for i in range(5))}] AS cuts FROM p),
    f AS (SELECT emp AS wt, frac_col, lead(ln(emp)) OVER (PARTITION BY area ORDER BY yr) - ln(emp) AS y,
      CAST(len(list_filter(cuts, lambda c: c <= exp)) AS BIGINT) AS bin FROM p, q),
    {_line('frac_col', 'wt', '(SELECT * FROM f WHERE y IS NOT NULL AND bin <= 4)', 'bin')}
    SELECT bin, 'frac_col' AS term, {R('b', 'estimate')}, {R('se_b', 'std_error')} FROM e""",
)
def m13(spark, sf):
    panel = log_change_next(rounded(area_panel(spark, sf), "exp", digits=9), ["area"], "yr", growth="emp")
    binned = quantile_bins(panel, "exp", 4, "bin").where(F.col("bin").between(1, 4))
    fit = fit_linear(binned, design("growth", "frac_col", weight="emp"), by=["bin"])
    return rounded(fit.coefficients(terms=["frac_col"]).select("bin", "term", "estimate", "std_error"), "estimate", "std_error")


@query(
    "m14_fit_per_window",
    f"""WITH {NUM}, h AS (SELECT g.*, w AS window_start FROM g JOIN (SELECT CAST(unnest([1995, 1997, 1999]) AS BIGINT) AS w) v ON yr >= w AND yr < w + 3),
    {_odds('h', 'emp', 'ret', 'window_start')} SELECT window_start AS window, 'emp' AS term, {R('b', 'estimate')}, {R('se_b', 'std_error')} FROM e""",
)
def m14(spark, sf):
    table = effect_by_window(rows(spark, sf), design("ret", "emp"), "yr", 1995, 3, 2, 3, "emp")
    return rounded(table.select("window", "term", "estimate", "std_error"), "estimate", "std_error")


@query(
    "m15_outcome_variant",
    f"""WITH {NUM}, h AS (SELECT emp, CASE WHEN score > 0.04 THEN 1 ELSE 0 END AS hi FROM g WHERE disc >= 0.03 AND yr BETWEEN 1996 AND 2000),
    {_odds('h', 'emp', 'hi')} {_two_terms('emp')}""",
)
def m15(spark, sf):
    keep = (F.col("disc") >= 0.03) & F.col("yr").between(1996, 2000)
    data = with_outcome(rows(spark, sf), "hi", F.col("score") > 0.04, keep)
    fit = fit_logit(data, design("hi", "emp"), patterns=True)
    return rounded(fit.coefficients().select("term", *SHOWN), *SHOWN)


@query(
    "m16_implied_line",
    f"""WITH {ROWS}, {_line('disc', 'wt', 'f', 'flag')} SELECT flag, CAST(n AS BIGINT) AS n, {R('b', 'slope')}, {R('a', 'intercept')}, {R('se_b', 'slope_se')} FROM e""",
)
def m16(spark, sf):
    lines = fit_lines(rows(spark, sf), "disc", "y", ["flag"], "wt")
    return rounded(lines, "slope", "intercept", "slope_se")
