"""Sources, sinks, sorts and limits (S and O ids)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.catalog.registry import FACTS, PANEL, R, area_panel, facts, query, r, rounded, table
from panelmill.functions.codes import threshold_ladder
from panelmill.functions.weighted import wmean
from panelmill.operators.scaling import keep_max
from panelmill.sources import tables as src
from panelmill.session import fresh_path


def _csv_copy(df, label):
    path = fresh_path(df.sparkSession, label)
    src.export_csv(df, path)
    return path


@query("s1_csv_plain_names", "SELECT c_custkey AS cust_key, c_acctbal AS acct_bal, c_mktsegment AS segment FROM customer")
def s1(spark, sf):
    raw = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("cust key"), F.col("c_acctbal").alias("acct*bal"), F.col("c_mktsegment").alias("segment")
    )
    path = _csv_copy(raw, "customer")
    back = src.read_csv(spark, path, raw.schema, plain_names=True)
    return back.select(F.col("`cust.key`").alias("cust_key"), F.col("`acct.bal`").alias("acct_bal"), "segment")


@query("s2_csv_all_columns", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def s2(spark, sf):
    part = table(spark, sf, "part")
    return src.read_csv(spark, _csv_copy(part, "part"), part.schema)


@query("s3_csv_projected", "SELECT s_suppkey, s_nationkey FROM supplier")
def s3(spark, sf):
    supplier = table(spark, sf, "supplier")
    return src.read_csv(spark, _csv_copy(supplier, "supplier"), supplier.schema, select=["s_suppkey", "s_nationkey"])


@query("s4_peek", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 1")
def s4(spark, sf):
    return src.peek(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").orderBy("o_orderkey"))


@query(
    "s5_read_table",
    f"SELECT c_nationkey, count(*) AS n, {R('avg(c_acctbal)', 'bal')} FROM customer GROUP BY c_nationkey",
)
def s5(spark, sf):
    rows = src.read_table(spark, f"{sf}/customer.parquet", ["c_nationkey", "c_acctbal"])
    return rows.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), r(F.avg("c_acctbal")).alias("bal"))


@query(
    "s6_materialise",
    f"WITH {PANEL} SELECT area, {R('exp', 'exp')}, {R('w', 'w')}, yr FROM panel WHERE yr IN (1995, 2001)",
)
def s6(spark, sf):
    panel = area_panel(spark, sf).select("area", "exp", "w", "yr")
    path = fresh_path(spark, "panel")
    src.write_table(panel, path, partition_by=["yr"])
    back = src.read_table(spark, path, ["area", "exp", "w", "yr"]).where(F.col("yr").isin(1995, 2001))
    return rounded(back.withColumn("yr", F.col("yr").cast("long")), "exp", "w")


@query("s7_export_csv", f"WITH {PANEL} SELECT area, yr, {R('emp', 'emp')} FROM panel")
def s7(spark, sf):
    panel = area_panel(spark, sf).select("area", "yr", "emp")
    return rounded(src.read_csv(spark, _csv_copy(panel, "export"), "area long, yr long, emp double"), "emp")


@query(
    "s8_literal_lookup",
    f"""WITH {FACTS},
    bins AS (SELECT 1995 + i AS yr, CAST(i // 4 + 1 AS BIGINT) AS grp, CAST(i % 4 + 1 AS BIGINT) AS rank FROM range(8) t(i)),
    grades AS (SELECT * FROM (VALUES ('A', 4.0), ('N', 3.0), ('R', 2.0)) g(flag, points))
    SELECT grp, rank, {R('avg(CAST(points AS DOUBLE))', 'points')}, count(*) AS n
    FROM facts JOIN bins USING (yr) LEFT JOIN grades USING (flag) GROUP BY grp, rank""",
)
def s8(spark, sf):
    grades = src.literal_table(spark, [("A", 4.0), ("N", 3.0), ("R", 2.0)], "flag string, points double")
    bins = src.year_bins(spark, 1995, 2, 4)
    rows = facts(spark, sf).join(bins, F.col("yr") == F.col("year")).join(grades, "flag", "left")
    return rows.groupBy("grp", "rank").agg(r(F.avg("points")).alias("points"), F.count(F.lit(1)).alias("n"))


@query(
    "s9_distinct_lookup",
    """SELECT DISTINCT p_size, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'medium' ELSE 'large' END AS class
    FROM part""",
)
def s9(spark, sf):
    sizes = src.distinct_lookup(table(spark, sf, "part"), "p_size")
    return sizes.withColumn("class", threshold_ladder("p_size", [(10, "small"), (30, "medium")], "large"))


@query(
    "s10_reused_panel",
    f"""WITH {PANEL} SELECT yr, {R('sum(emp * w) / sum(emp)', 'w')}, {R('sum(emp * exp) / sum(emp)', 'exp')}
    FROM panel GROUP BY yr""",
)
def s10(spark, sf):
    # Another recipe's table, taken as a function result; no file or global state in between.
    panel = area_panel(spark, sf)
    return panel.groupBy("yr").agg(r(wmean("w", "emp")).alias("w"), r(wmean("exp", "emp")).alias("exp"))


@query("o1_sort", f"WITH {FACTS} SELECT yr, {R('sum(wt)', 'emp')} FROM facts GROUP BY yr ORDER BY yr")
def o1(spark, sf):
    return facts(spark, sf).groupBy("yr").agg(r(F.sum("wt")).alias("emp")).orderBy("yr")


@query(
    "o2_sort_keys",
    f"WITH {FACTS} SELECT emp, yr, {R('avg(wage)', 'w')} FROM facts GROUP BY emp, yr ORDER BY emp, yr",
)
def o2(spark, sf):
    return facts(spark, sf).groupBy("emp", "yr").agg(r(F.avg("wage")).alias("w")).orderBy("emp", "yr")


@query(
    "o3_order_for_shift",
    f"""WITH {PANEL} SELECT area, yr, {R('w', 'w')}, {R('lag(w) OVER (PARTITION BY area ORDER BY yr)', 'w_before')} FROM panel""",
)
def o3(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("area").orderBy("yr")
    return rounded(area_panel(spark, sf).select("area", "yr", "w", F.lag("w").over(w).alias("w_before")), "w", "w_before")


@query(
    "o4_top_per_group",
    """SELECT c_nationkey, c_custkey, c_acctbal FROM customer c
    WHERE c_acctbal = (SELECT max(c_acctbal) FROM customer d WHERE d.c_nationkey = c.c_nationkey)""",
)
def o4(spark, sf):
    rows = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return keep_max(rows, "c_acctbal", ["c_nationkey"])
