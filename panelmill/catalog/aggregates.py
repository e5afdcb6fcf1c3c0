"""Aggregations (A ids)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.catalog.registry import FACTS, FACTS_JOB, PANEL, R, area_panel, facts, facts_job, query, r, rounded, table
from panelmill.functions.safe import ln1p, ratio, strict
from panelmill.functions.weighted import endpoint_growth, mean_if, wcount, wmean, wmean_if, wshare
from panelmill.operators.quantiles import exact_quantiles
from panelmill.operators.scaling import attach_stats, keep_max, profile
from panelmill.operators.shares import herfindahl


@query("a1_sum", f"WITH {FACTS} SELECT area, yr, {R('sum(wt)', 'emp')} FROM facts GROUP BY area, yr")
def a1(spark, sf):
    return facts(spark, sf).groupBy("area", "yr").agg(r(F.sum("wt")).alias("emp"))


@query("a2_mean", f"WITH {FACTS} SELECT area, yr, {R('avg(wage)', 'w')} FROM facts GROUP BY area, yr")
def a2(spark, sf):
    return facts(spark, sf).groupBy("area", "yr").agg(r(F.avg("wage")).alias("w"))


@query(
    "a3_weighted_mean",
    f"WITH {FACTS} SELECT area, yr, {R('sum(wt * wage) / sum(wt)', 'w')}, {R('sum(wt * score) / sum(wt)', 'exp')} FROM facts GROUP BY area, yr",
)
def a3(spark, sf):
    return facts(spark, sf).groupBy("area", "yr").agg(r(wmean("wage", "wt")).alias("w"), r(wmean("score", "wt")).alias("exp"))


@query(
    "a4_weighted_share",
    f"""WITH {FACTS} SELECT area, yr, {R("sum(CASE WHEN coll THEN wt ELSE 0 END) / sum(wt)", 'frac_col')},
    {R("sum(CASE WHEN wage >= 50000 AND wage < 80000 THEN wt ELSE 0 END) / sum(wt)", 'frac_mid')} FROM facts GROUP BY area, yr""",
)
def a4(spark, sf):
    mid = (F.col("wage") >= 50000) & (F.col("wage") < 80000)
    return facts(spark, sf).groupBy("area", "yr").agg(
        r(wshare(F.col("coll"), "wt")).alias("frac_col"), r(wshare(mid, "wt")).alias("frac_mid")
    )


@query(
    "a5_conditional_weighted_mean",
    f"WITH {FACTS} SELECT area, yr, {R('sum(wt * wage) FILTER (WHERE coll) / sum(wt) FILTER (WHERE coll)', 'w_col')} FROM facts GROUP BY area, yr",
)
def a5(spark, sf):
    return facts(spark, sf).groupBy("area", "yr").agg(r(wmean_if("wage", "wt", F.col("coll"))).alias("w_col"))


@query(
    "a6_weighted_count",
    f"WITH {FACTS} SELECT area, yr, {R('sum(wt)', 'pop')}, {R('sum(CASE WHEN emp THEN wt ELSE 0 END)', 'emp')} FROM facts GROUP BY area, yr",
)
def a6(spark, sf):
    return facts(spark, sf).groupBy("area", "yr").agg(r(wcount("wt")).alias("pop"), r(wcount("wt", F.col("emp"))).alias("emp"))


@query(
    "a7_row_count",
    f"WITH {FACTS} SELECT yr, flag, count(*) AS n, {R('sum(CAST(coll AS INTEGER)) / count(*)', 'frac')} FROM facts GROUP BY yr, flag",
)
def a7(spark, sf):
    return facts(spark, sf).groupBy("yr", "flag").agg(
        F.count(F.lit(1)).alias("n"), r(ratio(F.count(F.when(F.col("coll"), 1)), F.count(F.lit(1)))).alias("frac")
    )


@query("a8_standard_deviation", f"WITH {FACTS} SELECT area, {R('stddev_samp(wage)', 's')}, {R('stddev_samp(ln(wage))', 's_log')} FROM facts GROUP BY area")
def a8(spark, sf):
    return facts(spark, sf).groupBy("area").agg(r(F.stddev_samp("wage")).alias("s"), r(F.stddev_samp(F.log("wage"))).alias("s_log"))


@query("a9_variance", f"WITH {PANEL} SELECT {R('var_samp(exp)', 'v_exp', 9)}, {R('var_samp(frac_col)', 'v_col', 9)} FROM panel WHERE yr = 1995")
def a9(spark, sf):
    panel = area_panel(spark, sf, [1995])
    return panel.agg(r(F.var_samp("exp"), 9).alias("v_exp"), r(F.var_samp("frac_col"), 9).alias("v_col"))


@query(
    "a10_covariance",
    f"""WITH {PANEL} SELECT {R('covar_samp(exp, exp)', 'c_ee', 9)}, {R('covar_samp(exp, frac_col)', 'c_ec', 9)},
    {R('covar_samp(frac_col, frac_col)', 'c_cc', 9)} FROM panel""",
)
def a10(spark, sf):
    return area_panel(spark, sf).agg(
        r(F.covar_samp("exp", "exp"), 9).alias("c_ee"), r(F.covar_samp("exp", "frac_col"), 9).alias("c_ec"),
        r(F.covar_samp("frac_col", "frac_col"), 9).alias("c_cc"),
    )


@query("a11_median", f"WITH {PANEL} SELECT yr, {R('median(frac_col)', 'med')} FROM panel GROUP BY yr")
def a11(spark, sf):
    med = exact_quantiles(area_panel(spark, sf), "frac_col", [0.5], ["yr"])
    return med.select("yr", r(F.col("quantiles")[0]).alias("med"))


@query(
    "a12_quantiles",
    f"WITH {FACTS} SELECT yr, {', '.join(R(f'quantile_cont(wage, CAST({q} AS DOUBLE))', f'q{int(q * 100)}') for q in (0, 0.25, 0.5, 0.75, 0.9, 1))} FROM facts GROUP BY yr",
)
def a12(spark, sf):
    probs = [0, 0.25, 0.5, 0.75, 0.9, 1]
    q = exact_quantiles(facts(spark, sf), "wage", probs, ["yr"])
    return q.select("yr", *[r(F.col("quantiles")[i]).alias(f"q{int(p * 100)}") for i, p in enumerate(probs)])


@query(
    "a13_max_flag",
    "SELECT s_suppkey, s_nationkey, s_acctbal = max(s_acctbal) OVER (PARTITION BY s_nationkey) AS main_row FROM supplier",
)
def a13(spark, sf):
    rows = attach_stats(table(spark, sf, "supplier"), ["s_nationkey"], {"top": F.max("s_acctbal")})
    return rows.select("s_suppkey", "s_nationkey", (F.col("s_acctbal") == F.col("top")).alias("main_row"))


@query(
    "a14_distinct_sum",
    f"WITH {FACTS} SELECT area, yr, {R('sum(DISTINCT wt)', 'distinct_wt')}, {R('sum(wt)', 'wt')} FROM facts GROUP BY area, yr",
)
def a14(spark, sf):
    return facts(spark, sf).groupBy("area", "yr").agg(r(F.sum_distinct("wt")).alias("distinct_wt"), r(F.sum("wt")).alias("wt"))


@query(
    "a15_distinct_count",
    "SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber)) AS keys FROM lineitem",
)
def a15(spark, sf):
    return table(spark, sf, "lineitem").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey", "l_linenumber").alias("keys")
    )


@query(
    "a16_computed_key",
    f"WITH {FACTS} SELECT wage > 50000 AS high, CAST(floor(yr / 5) * 5 AS BIGINT) AS period, {R('avg(score)', 'exp')} FROM facts GROUP BY 1, 2",
)
def a16(spark, sf):
    period = (F.floor(F.col("yr") / 5) * 5).cast("long").alias("period")
    return facts(spark, sf).groupBy((F.col("wage") > 50000).alias("high"), period).agg(r(F.avg("score")).alias("exp"))


@query(
    "a17_filtered_mean",
    f"WITH {FACTS} SELECT area, {R('avg(wage) FILTER (WHERE yr = 1999)', 'w_1999')}, {R('avg(wage) FILTER (WHERE yr = 1995)', 'w_1995')} FROM facts GROUP BY area",
)
def a17(spark, sf):
    return facts(spark, sf).groupBy("area").agg(
        r(mean_if("wage", F.col("yr") == 1999)).alias("w_1999"), r(mean_if("wage", F.col("yr") == 1995)).alias("w_1995")
    )


@query(
    "a18_endpoint_growth",
    f"""WITH {FACTS} SELECT area, {R('(avg(wage) FILTER (WHERE yr = 1999) - avg(wage) FILTER (WHERE yr = 1995)) / avg(wage) FILTER (WHERE yr = 1995)', 'growth')}
    FROM facts GROUP BY area""",
)
def a18(spark, sf):
    return facts(spark, sf).groupBy("area").agg(r(endpoint_growth("wage", "yr", 1995, 1999)).alias("growth"))


@query(
    "a19_strict_and_skipping",
    f"""WITH {FACTS}, masked AS (SELECT area, yr, CASE WHEN NOT (disc = 0 AND score = 0) THEN wage END AS x FROM facts)
    SELECT area, yr, {R('sum(x)', 'skipping', 2)}, {R('CASE WHEN count(x) = count(*) THEN sum(x) END', 'strict', 2)}
    FROM masked GROUP BY area, yr""",
)
def a19(spark, sf):
    x = F.when(~((F.col("disc") == 0) & (F.col("score") == 0)), F.col("wage"))
    rows = facts(spark, sf).select("area", "yr", x.alias("x"))
    return rows.groupBy("area", "yr").agg(r(F.sum("x"), 2).alias("skipping"), r(strict(F.sum, "x"), 2).alias("strict"))


@query("a20_global", f"WITH {FACTS} SELECT {R('avg(CAST(emp AS DOUBLE))', 'emp')}, count(*) AS n FROM facts")
def a20(spark, sf):
    return facts(spark, sf).agg(r(F.avg(F.col("emp").cast("double"))).alias("emp"), F.count(F.lit(1)).alias("n"))


@query(
    "a21_aggregate_of_aggregates",
    f"WITH {PANEL} SELECT area, {R('sum(emp * exp) / sum(emp)', 'exp')}, {R('sum(emp)', 'emp')} FROM panel GROUP BY area",
)
def a21(spark, sf):
    return area_panel(spark, sf).groupBy("area").agg(r(wmean("exp", "emp")).alias("exp"), r(F.sum("emp")).alias("emp"))


@query(
    "a22_sum_of_logs",
    f"WITH {PANEL} SELECT area, {R('sum(ln(emp + 1))', 'sum_log')}, {R('ln(sum(emp) + 1)', 'log_sum')} FROM panel GROUP BY area",
)
def a22(spark, sf):
    return area_panel(spark, sf).groupBy("area").agg(r(F.sum(ln1p("emp"))).alias("sum_log"), r(ln1p(F.sum("emp"))).alias("log_sum"))


@query(
    "a23_herfindahl",
    f"""WITH {FACTS_JOB}, cells AS (SELECT area, yr, ind, sum(wt) AS emp FROM persons GROUP BY area, yr, ind),
    shares AS (SELECT area, yr, emp / sum(emp) OVER (PARTITION BY area, yr) AS share FROM cells)
    SELECT area, yr, {R('sum(share * share)', 'hh', 9)} FROM shares GROUP BY area, yr""",
)
def a23(spark, sf):
    cells = facts_job(spark, sf).groupBy("area", "yr", "ind").agg(F.sum("wt").alias("emp"))
    return rounded(herfindahl(cells, "emp", ["area", "yr"]), "hh", digits=9)


def _profile_sql(column: str) -> str:
    return f"""SELECT '{column}' AS variable, count({column}) AS n, count(*) - count({column}) AS nulls, {R(f'avg({column})', 'mean')},
    {R(f'min({column})', 'low')}, {R(f'quantile_cont(CAST({column} AS DOUBLE), 0.25::DOUBLE)', 'q1')},
    {R(f'median({column})', 'median')}, {R(f'quantile_cont(CAST({column} AS DOUBLE), 0.75::DOUBLE)', 'q3')}, {R(f'max({column})', 'high')} FROM lineitem"""


@query("a24_profile", " UNION ALL ".join(_profile_sql(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def a24(spark, sf):
    rows = profile(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(rows, "mean", "low", "q1", "median", "q3", "high")


@query(
    "a25_top_row",
    f"""WITH {PANEL}, m AS (SELECT area, {R('avg(w)', 'w')} FROM panel GROUP BY area)
    SELECT area, w, 'top' AS which FROM m WHERE w = (SELECT max(w) FROM m) UNION ALL
    SELECT area, w, 'bottom' FROM m WHERE w = (SELECT min(w) FROM m)""",
)
def a25(spark, sf):
    means = area_panel(spark, sf).groupBy("area").agg(r(F.avg("w")).alias("w"))
    top = keep_max(means, "w").withColumn("which", F.lit("top"))
    low = keep_max(means.withColumn("__neg", -F.col("w")), "__neg").drop("__neg").withColumn("which", F.lit("bottom"))
    return top.unionByName(low)
