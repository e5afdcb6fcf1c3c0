"""Projections, filters and scalar functions (P and F ids)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.catalog.registry import FACTS, FACTS_FLOW, R, facts, facts_flow, in_years, query, r, table
from panelmill.functions import codes
from panelmill.functions.safe import flag, is_finite, ln, ln1p, not_in, number, ratio
from panelmill.operators.scaling import attach_quantile


@query("p1_project", "SELECT c_custkey AS unit, c_nationkey AS place, c_acctbal AS balance FROM customer")
def p1(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("unit"), F.col("c_nationkey").alias("place"), F.col("c_acctbal").alias("balance"))


@query(
    "p2_derived",
    f"SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS yr, {R('o_totalprice / 1000', 'price_k')} FROM orders",
)
def p2(spark, sf):
    o = table(spark, sf, "orders")
    made = o.withColumn("yr", F.year("o_orderdate").cast("long")).withColumn("price_k", r(F.col("o_totalprice") / 1000))
    return made.select("o_orderkey", "yr", "price_k")


@query(
    "p3_several_columns",
    """SELECT p_partkey, p_size >= 1 AND p_size < 10 AS light, p_size >= 10 AND p_size < 30 AS middle,
    p_size >= 30 AND p_size < 45 AS heavy FROM part""",
)
def p3(spark, sf):
    size = F.col("p_size")
    made = table(spark, sf, "part").withColumns({
        "light": (size >= 1) & (size < 10), "middle": (size >= 10) & (size < 30), "heavy": (size >= 30) & (size < 45),
    })
    return made.select("p_partkey", "light", "middle", "heavy")


@query(
    "p4_conditional_update",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS bal,
    CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END AS building_bal FROM customer""",
)
def p4(spark, sf):
    bal = F.col("c_acctbal")
    return table(spark, sf, "customer").select(
        "c_custkey", F.when(bal < 0, 0.0).otherwise(bal).alias("bal"),
        F.when(F.col("c_mktsegment") == "BUILDING", bal).alias("building_bal"),
    )


@query("p5_rename", "SELECT s_suppkey AS birthplace, s_nationkey FROM supplier")
def p5(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", "s_nationkey").withColumnRenamed("s_suppkey", "birthplace")


@query("p6_drop", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def p6(spark, sf):
    return table(spark, sf, "supplier").drop("s_name")


@query("p7_append", f"SELECT p_partkey, p_size, {R('1 / (1 + exp(-(p_size - 25) / 10))', 'fitted')} FROM part")
def p7(spark, sf):
    fitted = 1 / (1 + F.exp(-(F.col("p_size") - 25) / 10))
    return table(spark, sf, "part").select("p_partkey", "p_size").withColumn("fitted", r(fitted))


@query(
    "p8_range_filter",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 15 AND l_discount > 0.06",
)
def p8(spark, sf):
    rows = table(spark, sf, "lineitem").where(F.col("l_quantity").between(10, 15) & (F.col("l_discount") > 0.06))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(
    "p9_in_list",
    """SELECT o_orderkey, o_orderpriority FROM orders
    WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND year(o_orderdate) BETWEEN 1996 AND 1998""",
)
def p9(spark, sf):
    rows = table(spark, sf, "orders").where(
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & in_years("o_orderdate", [1996, 1997, 1998])
    )
    return rows.select("o_orderkey", "o_orderpriority")


@query(
    "p10_not_in_list",
    """SELECT c_custkey, seg FROM (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS seg FROM customer)
    WHERE seg IS NULL OR seg NOT IN ('MACHINERY', 'FURNITURE')""",
)
def p10(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("seg"))
    return rows.where(not_in("seg", ["MACHINERY", "FURNITURE"]))


@query(
    "p11_null_tests",
    """SELECT c_nationkey, count(*) FILTER (WHERE b IS NULL) AS missing, count(*) FILTER (WHERE b IS NOT NULL) AS known
    FROM (SELECT c_nationkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS b FROM customer) GROUP BY c_nationkey""",
)
def p11(spark, sf):
    b = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    rows = table(spark, sf, "customer").select("c_nationkey", b.alias("b"))
    return rows.groupBy("c_nationkey").agg(
        F.count(F.when(F.col("b").isNull(), 1)).alias("missing"), F.count(F.when(F.col("b").isNotNull(), 1)).alias("known")
    )


@query("p12_finite", f"SELECT c_custkey, {R('ln(c_acctbal)', 'log_bal')} FROM customer WHERE c_acctbal > 0")
def p12(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", ln("c_acctbal").alias("log_bal"))
    return rows.where(is_finite("log_bal")).withColumn("log_bal", r("log_bal"))


@query("p13_regex", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'ring|bolt')")
def p13(spark, sf):
    return table(spark, sf, "part").where(F.col("p_name").rlike("ring|bolt")).select("p_partkey", "p_name")


@query(
    "p14_column_inequality",
    f"WITH {FACTS_FLOW} SELECT state, count(*) AS moved FROM persons WHERE state <> origin GROUP BY state",
)
def p14(spark, sf):
    rows = facts_flow(spark, sf).where(F.col("state") != F.col("origin"))
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("moved"))


@query(
    "p15_above_global_quantile",
    """SELECT c_custkey, c_acctbal FROM customer
    WHERE c_acctbal > (SELECT quantile_cont(c_acctbal, 0.95) FROM customer)""",
)
def p15(spark, sf):
    rows = attach_quantile(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 0.95, "cut")
    return rows.where(F.col("c_acctbal") > F.col("cut")).drop("cut")


@query("p16_suffix_test", "SELECT c_custkey, c_name FROM customer WHERE right(c_name, 2) = '00'")
def p16(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_name").endswith("00")).select("c_custkey", "c_name")


@query(
    "p17_null_fill",
    f"""SELECT c_custkey, coalesce(n, 0) AS n, {R('coalesce(total, 0)', 'total', 2)} FROM customer LEFT JOIN
    (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""",
)
def p17(spark, sf):
    totals = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")
    )
    rows = table(spark, sf, "customer").select("c_custkey").join(totals, "c_custkey", "left")
    return rows.fillna(0, subset=["n", "total"]).withColumn("total", r("total", 2))


@query(
    "p18_complete_cases",
    f"""WITH {FACTS} SELECT yr, count(*) AS n, {R('avg(x)', 'x')}, {R('avg(y)', 'y')} FROM
    (SELECT yr, CASE WHEN emp THEN wage END AS x, CASE WHEN coll THEN score END AS y FROM facts)
    WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY yr""",
)
def p18(spark, sf):
    f = facts(spark, sf)
    rows = f.select("yr", F.when(F.col("emp"), F.col("wage")).alias("x"), F.when(F.col("coll"), F.col("score")).alias("y"))
    return rows.dropna(subset=["x", "y"]).groupBy("yr").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("x")).alias("x"), r(F.avg("y")).alias("y")
    )


@query(
    "f1_prefix",
    """SELECT c_custkey, left(c_name, 8) AS head, left(c_name, length(c_name) - 3) AS stem FROM customer""",
)
def f1(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", codes.prefix("c_name", 8).alias("head"), codes.drop_suffix("c_name", 3).alias("stem"))


@query(
    "f2_suffix",
    """SELECT o_orderkey, right(CAST(o_orderkey + 1000 AS VARCHAR), 3) AS tail,
    CAST(right(CAST(o_orderkey + 1000 AS VARCHAR), 3) AS INTEGER) AS area_no FROM orders""",
)
def f2(spark, sf):
    code = F.col("o_orderkey") + 1000
    return table(spark, sf, "orders").select(
        "o_orderkey", codes.suffix(code, 3).alias("tail"), codes.area_part(code).alias("area_no")
    )


@query("f3_length", "SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS len FROM part")
def f3(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.length("p_name").cast("long").alias("len"))


@query("f4_replace", "SELECT o_orderkey, replace(o_orderpriority, '-', '') AS pri FROM orders")
def f4(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.replace("o_orderpriority", F.lit("-"), F.lit("")).alias("pri"))


@query("f5_strip_class", "SELECT c_custkey, regexp_replace(c_name, '[$,a-zA-Z/'']', '', 'g') AS bare FROM customer")
def f5(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.regexp_replace("c_name", "[$,a-zA-Z/']", "").alias("bare"))


@query("f6_split", "SELECT o_orderkey, string_split(o_orderpriority, '-')[1] AS num, string_split(o_orderpriority, '-')[2] AS word FROM orders")
def f6(spark, sf):
    parts = F.split("o_orderpriority", "-")
    return table(spark, sf, "orders").select("o_orderkey", parts[0].alias("num"), parts[1].alias("word"))


@query("f7_concat", "SELECT p_partkey, concat('Edu_', p_brand, '/', p_type) AS tag FROM part")
def f7(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit("Edu_"), "p_brand", F.lit("/"), "p_type").alias("tag"))


@query(
    "f8_zero_pad",
    "SELECT s_suppkey, concat(lpad(CAST(s_nationkey AS VARCHAR), CAST(greatest(length(CAST(s_nationkey AS VARCHAR)), 2) AS INTEGER), '0'), lpad(CAST(s_suppkey + 900 AS VARCHAR), CAST(greatest(length(CAST(s_suppkey + 900 AS VARCHAR)), 3) AS INTEGER), '0')) AS fips FROM supplier",
)
def f8(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", codes.padded_area("s_nationkey", F.col("s_suppkey") + 900).alias("fips"))


@query("f9_contains", "SELECT p_partkey, contains(p_name, 'more') OR contains(p_name, 'red') AS hit FROM part")
def f9(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_name").rlike("more|red").alias("hit"))


@query(
    "f10_casts",
    """SELECT c_custkey, TRY_CAST(c_mktsegment AS DOUBLE) AS bad, TRY_CAST(right(c_name, 9) AS DOUBLE) AS num,
    CAST(c_nationkey AS VARCHAR) AS txt, CAST(c_acctbal > 0 AS DOUBLE) AS pos FROM customer""",
)
def f10(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        "c_custkey", number("c_mktsegment").alias("bad"), number(codes.suffix("c_name", 9)).alias("num"),
        F.col("c_nationkey").cast("string").alias("txt"), flag(F.col("c_acctbal") > 0).alias("pos"),
    )


@query("f11_if_else", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' ELSE 'low' END AS level FROM orders")
def f11(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_totalprice") > 200000, "high").otherwise("low").alias("level")
    )


@query(
    "f12_ladder",
    """SELECT p_partkey, CASE WHEN p_size <= 5 THEN 'a' WHEN p_size <= 12 THEN 'b' WHEN p_size <= 20 THEN 'c'
    WHEN p_size <= 33 THEN 'd' ELSE 'e' END AS class,
    CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 1995 WHEN p_type IN ('SMALL', 'MEDIUM') THEN 2000 ELSE 2005 END AS era FROM part""",
)
def f12(spark, sf):
    kind = F.col("p_type")
    return table(spark, sf, "part").select(
        "p_partkey", codes.threshold_ladder("p_size", [(5, "a"), (12, "b"), (20, "c"), (33, "d")], "e").alias("class"),
        codes.ladder([(kind.isin("ECONOMY", "PROMO"), 1995), (kind.isin("SMALL", "MEDIUM"), 2000)], 2005).alias("era"),
    )


@query(
    "f13_logs",
    f"""SELECT c_custkey, {R('CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END', 'l')},
    {R('CASE WHEN c_acctbal > -1 THEN ln(c_acctbal + 1) END', 'l1')} FROM customer""",
)
def f13(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", r(ln("c_acctbal")).alias("l"), r(ln1p("c_acctbal")).alias("l1"))


@query(
    "f14_floor_codes",
    """SELECT o_orderkey, CAST(floor((o_orderkey + 5000) / 1000) AS BIGINT) AS state,
    CAST(floor((o_orderkey + 123450000) / 10000) AS BIGINT) AS zip,
    CAST(floor(o_totalprice) AS BIGINT) AS whole FROM orders""",
)
def f14(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", codes.state_part(k + 5000).cast("long").alias("state"), codes.zip5(k + 123450000).alias("zip"),
        codes.major_part(F.col("o_totalprice").cast("string")).alias("whole"),
    )


@query("f15_time_bucket", "SELECT o_orderkey, CAST(floor(year(o_orderdate) / 5) * 5 AS BIGINT) AS period FROM orders")
def f15(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", codes.period_start(F.year("o_orderdate"), 5).alias("period"))


@query(
    "f16_arithmetic",
    f"""SELECT c_custkey, abs(c_acctbal) AS a, {R('c_acctbal * c_acctbal', 'sq', 4)}, {R('c_acctbal / nullif(c_nationkey, 0)', 'per')},
    c_acctbal > 0 AND NOT (c_nationkey = 3 OR c_nationkey = 4) AS ok FROM customer""",
)
def f16(spark, sf):
    bal, nation = F.col("c_acctbal"), F.col("c_nationkey")
    return table(spark, sf, "customer").select(
        "c_custkey", F.abs(bal).alias("a"), r(bal * bal, 4).alias("sq"), r(ratio(bal, nation)).alias("per"),
        ((bal > 0) & ~((nation == 3) | (nation == 4))).alias("ok"),
    )


@query(
    "f17_ranges",
    "SELECT s_suppkey, CAST(i AS INTEGER) AS step, s_suppkey * 10 + i AS code FROM (SELECT s_suppkey, unnest(range(1, 6)) AS i FROM supplier)",
)
def f17(spark, sf):
    steps = F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step")
    return table(spark, sf, "supplier").select("s_suppkey", steps).withColumn("code", F.col("s_suppkey") * 10 + F.col("step"))


@query("f18_membership_value", "SELECT p_partkey, CAST(p_brand IN ('Brand#1', 'Brand#7', 'Brand#12') AS DOUBLE) AS stem FROM part")
def f18(spark, sf):
    return table(spark, sf, "part").select("p_partkey", flag(F.col("p_brand").isin("Brand#1", "Brand#7", "Brand#12")).alias("stem"))
