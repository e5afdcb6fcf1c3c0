"""Figure tables (K ids)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.catalog.registry import FACTS, PANEL, R, Rs, area_panel, areas, facts, query, r, rounded, table
from panelmill.models.design import design
from panelmill.models.linear import fit_linear
from panelmill.operators import plotdata as pd_

BOX = f"""{PANEL}, p AS (SELECT area, yr, {Rs('w')} FROM panel),
  q AS (SELECT yr, quantile_cont(w, 0.25::DOUBLE) AS q1, quantile_cont(w, 0.5::DOUBLE) AS med, quantile_cont(w, 0.75::DOUBLE) AS q3 FROM p GROUP BY yr),
  b AS (SELECT p.*, q1, med, q3, w >= q1 - 1.5 * (q3 - q1) AND w <= q3 + 1.5 * (q3 - q1) AS inside FROM p JOIN q USING (yr))"""


@query(
    "k1_box_stats",
    f"""WITH {BOX} SELECT yr, {R('min(w) FILTER (WHERE inside)', 'low')}, {R('any_value(q1)', 'q1')}, {R('any_value(med)', 'median')},
    {R('any_value(q3)', 'q3')}, {R('max(w) FILTER (WHERE inside)', 'high')}, count(*) FILTER (WHERE NOT inside) AS outliers, count(*) AS n
    FROM b GROUP BY yr""",
)
def k1(spark, sf):
    box = pd_.box_stats(rounded(area_panel(spark, sf), "w"), "w", ["yr"])
    return rounded(box, "low", "q1", "median", "q3", "high")


@query(
    "k1_box_outliers",
    """WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25::DOUBLE) AS q1, quantile_cont(o_totalprice, 0.75::DOUBLE) AS q3
      FROM (SELECT o_orderpriority, ln(o_totalprice) AS o_totalprice FROM orders) GROUP BY 1)
    SELECT o_orderkey, o_orderpriority FROM orders JOIN q USING (o_orderpriority)
    WHERE ln(o_totalprice) < q1 - 1.5 * (q3 - q1) OR ln(o_totalprice) > q3 + 1.5 * (q3 - q1)""",
)
def k1_outliers(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.log("o_totalprice").alias("x"))
    return pd_.box_outliers(rows, "x", ["o_orderpriority"]).drop("x")


@query(
    "k2_density",
    f"""WITH v AS (SELECT o_orderstatus AS s, o_totalprice AS v FROM orders), span AS (SELECT min(v) AS lo, (max(v) - min(v)) / 511 AS step FROM v),
    h AS (SELECT s, count(*) AS n, 0.9::DOUBLE * least(stddev_samp(v), (quantile_cont(v, 0.75::DOUBLE) - quantile_cont(v, 0.25::DOUBLE)) / 1.34::DOUBLE)
      * pow(count(*), -0.2::DOUBLE) AS bw FROM v GROUP BY s),
    a AS (SELECT s, (v - lo) / step AS pos, least(floor((v - lo) / step), 510) AS i FROM v, span),
    m AS (SELECT s, i, sum(m) AS mass FROM (SELECT s, i, 1 - (pos - i) AS m FROM a UNION ALL SELECT s, i + 1, pos - i FROM a) GROUP BY s, i)
    SELECT s, CAST(g AS INTEGER) AS g, {R('sum(mass * exp(-0.5 * pow((g - i) * step / bw, 2)) / sqrt(2 * pi())) / any_value(n) / any_value(bw)', 'density', 12)}
    FROM m JOIN h USING (s), span, range(512) t(g) GROUP BY s, g""",
)
def k2(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("v"))
    d = pd_.density(rows, "v", ["s"], points=512)
    span = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).select(F.struct("lo", "hi")).scalar()
    g = F.round((F.col("x") - span["lo"]) / ((span["hi"] - span["lo"]) / 511)).cast("int")
    return d.select("s", g.alias("g"), r("density", 12).alias("density"))


@query(
    "k3_map_table",
    f"""WITH {PANEL} SELECT concat(lpad(CAST(s_nationkey AS VARCHAR), CAST(greatest(length(CAST(s_nationkey AS VARCHAR)), 2) AS INTEGER), '0'), lpad(CAST(area AS VARCHAR), CAST(greatest(length(CAST(area AS VARCHAR)), 3) AS INTEGER), '0')) AS fips,
    {R('exp', 'value')} FROM panel JOIN supplier ON area = s_suppkey WHERE yr = 1995""",
)
def k3(spark, sf):
    panel = area_panel(spark, sf).join(areas(spark, sf), "area")
    return rounded(pd_.map_table(panel, "exp", "state", "area", where=F.col("yr") == 1995), "value")


@query("k4_mean_bars", f"WITH {FACTS} SELECT yr, flag, {R('avg(wage)', 'height')} FROM facts GROUP BY yr, flag")
def k4(spark, sf):
    return rounded(pd_.mean_bars(facts(spark, sf), "wage", ["yr", "flag"]), "height")


@query(
    "k5_error_bars",
    f"""WITH {FACTS}, f AS (SELECT yr, wage / 1000 AS y, wt FROM facts),
    s AS (SELECT yr, count(*) AS n, regr_slope(y, wt) AS b, regr_sxx(y, wt) AS sxx, regr_syy(y, wt) AS syy, regr_sxy(y, wt) AS sxy FROM f GROUP BY yr),
    e AS (SELECT yr, b, sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS se FROM s)
    SELECT yr, {R('b', 'estimate')}, {R('b - 2 * se', 'bar_low')}, {R('b + 2 * se', 'bar_high')} FROM e""",
)
def k5(spark, sf):
    rows = facts(spark, sf).withColumn("y", F.col("wage") / 1000)
    table_ = fit_linear(rows, design("y", "wt"), by=["yr"]).coefficients(terms=["wt"])
    return rounded(pd_.error_bars(table_).select("yr", "estimate", "bar_low", "bar_high"), "estimate", "bar_low", "bar_high")


@query("k6_scatter", f"WITH {PANEL} SELECT {R('exp', 'x')}, {R('w', 'y')}, {R('emp', 'size')}, yr AS facet FROM panel")
def k6(spark, sf):
    return rounded(pd_.scatter(area_panel(spark, sf), "exp", "w", size="emp", facet="yr"), "x", "y", "size")


@query(
    "k7_histogram",
    f"""WITH {FACTS}, b AS (SELECT flag, CAST(floor((wage - (SELECT min(wage) FROM facts)) / 5000.0::DOUBLE) AS BIGINT) AS bin FROM facts)
    SELECT flag, bin, count(*) AS n, {R('count(*) / sum(count(*)) OVER (PARTITION BY flag)', 'share')} FROM b GROUP BY flag, bin""",
)
def k7(spark, sf):
    return rounded(pd_.histogram(facts(spark, sf), "wage", 5000.0, ["flag"]), "share")


def scored(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 500.0)).alias("s"))
    return d.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


ROC = """sc AS (SELECT n_chars / (n_chars + 500.0::DOUBLE) AS s, quality FROM documents JOIN labels USING (doc_id)),
  roc AS (SELECT CAST(c AS DOUBLE) / 1000 AS cutoff, count(*) FILTER (WHERE quality = 1 AND s > CAST(c AS DOUBLE) / 1000)::DOUBLE / nullif(count(*) FILTER (WHERE quality = 1), 0) AS tpr,
    count(*) FILTER (WHERE quality = 0 AND s > CAST(c AS DOUBLE) / 1000)::DOUBLE / nullif(count(*) FILTER (WHERE quality = 0), 0) AS fpr
    FROM sc, range(1001) t(c) GROUP BY c)"""


@query("k8_roc", f"WITH {ROC} SELECT {R('cutoff', 'cutoff')}, {R('tpr', 'tpr')}, {R('fpr', 'fpr')} FROM roc")
def k8(spark, sf):
    return rounded(pd_.roc_points(scored(spark, sf), "s", "quality"), "cutoff", "tpr", "fpr")


@query(
    "k9_auc",
    f"""WITH {ROC}, best AS (SELECT fpr, max(tpr) AS tpr FROM roc GROUP BY fpr),
    t AS (SELECT (fpr - lag(fpr) OVER (ORDER BY fpr)) * (tpr + lag(tpr) OVER (ORDER BY fpr)) / 2 AS a FROM best)
    SELECT {R('sum(a)', 'auc')} FROM t""",
)
def k9(spark, sf):
    return rounded(pd_.auc(pd_.roc_points(scored(spark, sf), "s", "quality")), "auc")


@query(
    "k10_half_split",
    """WITH r AS (SELECT doc_id, quality, CAST(i AS BIGINT) AS replicate,
      CAST(CAST(('0x' || left(md5(concat_ws('-', doc_id, i, 0)), 13)) AS BIGINT) AS DOUBLE) AS draw FROM labels, range(1, 4) t(i)),
    n AS (SELECT *, row_number() OVER (PARTITION BY replicate, quality ORDER BY draw) AS pos, count(*) OVER (PARTITION BY replicate, quality) AS n FROM r)
    SELECT replicate, quality, doc_id, pos <= CASE WHEN n % 2 = 0 THEN n // 2 WHEN (n // 2) % 2 = 0 THEN n // 2 ELSE n // 2 + 1 END AS in_sample FROM n""",
)
def k10(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", "quality")
    return pd_.half_split(rows, "doc_id", "quality", replicates=3).select("replicate", "quality", "doc_id", "in_sample")
