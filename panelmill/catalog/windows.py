"""Window-type results (W ids), all over panels with one row per key and period."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.catalog.registry import PANEL, R, Rs, area_panel, query, rounded, table
from panelmill.operators import panel as pn
from panelmill.operators import scaling as sc
from panelmill.operators.quantiles import quantile_bins


@query(
    "w1_partition_total",
    f"""WITH {PANEL} SELECT area, yr, {R('emp', 'emp')}, {R('sum(emp) OVER (PARTITION BY yr)', 'total')},
    count(*) OVER (PARTITION BY yr) AS n FROM panel""",
)
def w1(spark, sf):
    rows = sc.attach_stats(area_panel(spark, sf), ["yr"], {"total": F.sum("emp"), "n": F.count(F.lit(1))})
    return rounded(rows.select("area", "yr", "emp", "total", "n"), "emp", "total")


@query("w2_share_of_total", f"WITH {PANEL} SELECT area, yr, {R('emp / sum(emp) OVER (PARTITION BY yr)', 'share')} FROM panel")
def w2(spark, sf):
    return rounded(sc.share_of_total(area_panel(spark, sf), "emp", ["yr"], "share").select("area", "yr", "share"), "share")


def _lead(x: str) -> str:
    return f"lead({x}) OVER (PARTITION BY area ORDER BY yr)"


def _lag(x: str) -> str:
    return f"lag({x}) OVER (PARTITION BY area ORDER BY yr)"


@query(
    "w3_log_change",
    f"""WITH {PANEL} SELECT area, yr, {R(_lead('ln(emp)') + ' - ln(emp)', 'growth')}, {R(_lead('ln(exp)') + ' - ln(exp)', 'exp_growth')},
    {R(_lead('ln(w)') + ' - ln(w)', 'w_growth')}, {R(_lead('ln(frac_col)') + ' - ln(frac_col)', 'col_growth')} FROM panel""",
)
def w3(spark, sf):
    rows = pn.log_change_next(
        area_panel(spark, sf), ["area"], "yr", growth="emp", exp_growth="exp", w_growth="w", col_growth="frac_col"
    )
    names = ["growth", "exp_growth", "w_growth", "col_growth"]
    return rounded(rows.select("area", "yr", *names), *names)


@query(
    "w4_level_change",
    f"WITH {PANEL} SELECT area, yr, {R(_lead('emp') + ' - emp', 'd_emp')}, {R(_lead('w / emp') + ' - w / emp', 'd_ratio')} FROM panel",
)
def w4(spark, sf):
    rows = pn.change_next(area_panel(spark, sf), ["area"], "yr", {"d_emp": "emp", "d_ratio": F.col("w") / F.col("emp")})
    return rounded(rows.select("area", "yr", "d_emp", "d_ratio"), "d_emp", "d_ratio")


@query(
    "w5_change_from_previous",
    f"WITH {PANEL} SELECT area, yr, {R('exp - ' + _lag('exp'), 'd_exp')}, {R('ln(w) - ' + _lag('ln(w)'), 'd_log_w')} FROM panel",
)
def w5(spark, sf):
    rows = pn.change_prev(area_panel(spark, sf), ["area"], "yr", {"d_exp": "exp", "d_log_w": F.log("w")})
    return rounded(rows.select("area", "yr", "d_exp", "d_log_w"), "d_exp", "d_log_w")


@query("w6_relative_growth", f"WITH {PANEL} SELECT area, yr, {R(f'(emp - {_lag("emp")}) / {_lag("emp")}', 'growth')} FROM panel")
def w6(spark, sf):
    return rounded(pn.growth_prev(area_panel(spark, sf), ["area"], "yr", growth="emp").select("area", "yr", "growth"), "growth")


@query("w7_scale_by_sd", f"WITH {PANEL} SELECT area, yr, {R('exp / stddev_samp(exp) OVER (PARTITION BY yr)', 'exp_sd')} FROM panel")
def w7(spark, sf):
    return rounded(sc.scale_by_sd(area_panel(spark, sf), ["yr"], exp_sd="exp").select("area", "yr", "exp_sd"), "exp_sd")


@query(
    "w8_zscore_by_group",
    f"WITH {PANEL} SELECT area, yr, {R('(exp - avg(exp) OVER (PARTITION BY yr)) / stddev_samp(exp) OVER (PARTITION BY yr)', 'z')} FROM panel",
)
def w8(spark, sf):
    return rounded(sc.zscore(area_panel(spark, sf), ["yr"], z="exp").select("area", "yr", "z"), "z")


@query(
    "w9_zscore_whole_table",
    f"WITH {PANEL} SELECT area, yr, {R('(exp - avg(exp) OVER ()) / stddev_samp(exp) OVER ()', 'z')} FROM panel",
)
def w9(spark, sf):
    return rounded(sc.zscore(area_panel(spark, sf), z="exp").select("area", "yr", "z"), "z")


@query(
    "w10_median_split",
    f"""WITH {PANEL}, p AS (SELECT area, yr, {Rs('exp frac_col', 9)} FROM panel)
    SELECT area, yr, exp > median(exp) OVER (PARTITION BY yr) AS high, frac_col > median(frac_col) OVER () AS high_all FROM p""",
)
def w10(spark, sf):
    p = rounded(area_panel(spark, sf), "exp", "frac_col", digits=9)
    rows = sc.above_median(sc.above_median(p, "exp", "high", ["yr"]), "frac_col", "high_all")
    return rows.select("area", "yr", "high", "high_all")


@query(
    "w11_quantile_flag",
    f"""WITH {PANEL}, p AS (SELECT area, yr, {Rs('frac_col', 9)} FROM panel)
    SELECT area, yr, frac_col > quantile_cont(frac_col, 0.75::DOUBLE) OVER (PARTITION BY yr) AS high FROM p""",
)
def w11(spark, sf):
    p = rounded(area_panel(spark, sf), "frac_col", digits=9)
    return sc.above_quantile(p, "frac_col", 0.75, "high", ["yr"]).select("area", "yr", "high")


def _bins(x: str, source: str, bins: int) -> str:
    cuts = ", ".join(f"quantile_cont({x}, CAST({i}.0 / {bins} AS DOUBLE))" for i in range(bins + 1))
    return f"(SELECT [{cuts}] FROM {source})"


@query(
    "w12_quantile_bin",
    f"""WITH {PANEL}, p AS (SELECT area, yr, {Rs('exp', 9)} FROM panel), b AS (SELECT {_bins('exp', 'p WHERE yr = 1995', 4)} AS cuts)
    SELECT area, yr, CASE WHEN yr = 1995 THEN CAST(len(list_filter(cuts, lambda c: c <= exp)) AS BIGINT) END AS bin,
    CASE WHEN yr = 1995 THEN CAST(least(len(list_filter(cuts, lambda c: c <= exp)), 4) AS BIGINT) END AS clamped FROM p, b""",
)
def w12(spark, sf):
    p = rounded(area_panel(spark, sf), "exp", digits=9)
    base = F.col("yr") == 1995
    rows = quantile_bins(p, "exp", 4, "bin", where=base)
    return quantile_bins(rows, "exp", 4, "clamped", where=base, clamp_top=True).select("area", "yr", "bin", "clamped")


@query(
    "w13_argmax_rows",
    f"""WITH {PANEL}, p AS (SELECT area, yr, {Rs('emp')} FROM panel)
    SELECT area, yr, emp FROM (SELECT *, max(emp) OVER (PARTITION BY area) AS top FROM p) WHERE emp = top""",
)
def w13(spark, sf):
    return sc.keep_max(rounded(area_panel(spark, sf), "emp"), "emp", ["area"]).select("area", "yr", "emp")


@query(
    "w14_base_period_broadcast",
    f"""WITH {PANEL} SELECT area, yr, {R('max(CASE WHEN yr = 1995 THEN exp END) OVER (PARTITION BY area)', 'exp_1995')},
    {R('max(CASE WHEN yr = 1990 THEN exp END) OVER (PARTITION BY area)', 'exp_1990')} FROM panel""",
)
def w14(spark, sf):
    rows = pn.attach_base(area_panel(spark, sf), ["area"], "yr", 1995, exp_1995="exp")
    rows = pn.attach_base(rows, ["area"], "yr", 1990, exp_1990="exp")
    return rounded(rows.select("area", "yr", "exp_1995", "exp_1990"), "exp_1995", "exp_1990")


@query("w15_mean_centre", f"WITH {PANEL} SELECT area, yr, {R('w - avg(w) OVER ()', 'w_c', 4)} FROM panel")
def w15(spark, sf):
    return rounded(sc.centre(area_panel(spark, sf), w_c="w").select("area", "yr", "w_c"), "w_c", digits=4)


@query(
    "w16_occurrence",
    "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS occurrence FROM orders",
)
def w16(spark, sf):
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    rows = pn.occurrence(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "occurrence", month)
    return rows.select("o_orderkey", "o_custkey", "occurrence")


@query(
    "w17_interpolate",
    f"""WITH sums AS (SELECT event_type, CAST(day(ts) AS BIGINT) AS d, sum(value) AS x FROM events GROUP BY 1, 2),
    daily AS (SELECT event_type, d, CASE WHEN d % 4 NOT IN (1, 2) THEN x END AS x FROM sums),
    w AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS x0, last_value(CASE WHEN x IS NOT NULL THEN d END IGNORE NULLS) OVER b AS t0,
      first_value(x IGNORE NULLS) OVER a AS x1, first_value(CASE WHEN x IS NOT NULL THEN d END IGNORE NULLS) OVER a AS t1 FROM daily
      WINDOW b AS (PARTITION BY event_type ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             a AS (PARTITION BY event_type ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_type, d, {R('coalesce(x, x0 + (x1 - x0) * (d - t0) / nullif(t1 - t0, 0))', 'x')} FROM w""",
)
def w17(spark, sf):
    day = F.dayofmonth("ts").cast("long")
    daily = table(spark, sf, "events").groupBy("event_type", day.alias("d")).agg(F.sum("value").alias("x"))
    daily = daily.withColumn("x", F.when(~(F.col("d") % 4).isin(1, 2), F.col("x")))
    return rounded(pn.interpolate(daily, ["event_type"], "d", x="x"), "x")
