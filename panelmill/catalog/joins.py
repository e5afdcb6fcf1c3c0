"""Joins, set operations and reshapes (J, U and R ids)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.catalog.registry import (
    FACTS, FACTS_FLOW, PANEL, R, Rs, area_panel, facts, facts_flow, in_years, query, r, rounded, table,
)
from panelmill.functions.codes import range_mean
from panelmill.functions.safe import ratio
from panelmill.models.linear import fit_lines
from panelmill.operators import joins as ops
from panelmill.operators.reshape import melt, widen
from panelmill.operators.scaling import attach_stats
from panelmill.session import reused
from panelmill.sources.tables import literal_table


def crosswalk(spark, sf):
    """(zip, county): every nation number as a postal code lying in one to three counties."""
    n = F.col("n_nationkey").cast("long")
    rows = table(spark, sf, "nation").select(n.alias("zip"), F.explode(F.sequence(F.lit(0).cast("long"), n % 3)).alias("i"))
    return rows.select("zip", ((F.col("zip") + 7 * F.col("i")) % 25).alias("county"))


CROSSWALK = """crosswalk AS (SELECT zip, (zip + 7 * i) % 25 AS county FROM
  (SELECT CAST(n_nationkey AS BIGINT) AS zip, unnest(generate_series(0, n_nationkey % 3)) AS i FROM nation))"""


def edges(spark, sf):
    """(area, adj): each area borders on the areas numbered next to it; the ends border on nothing known."""
    area = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(area.alias("area"), F.explode(F.array(area - 1, area + 1)).alias("adj"))


EDGES = "edges AS (SELECT s_suppkey AS area, unnest([s_suppkey - 1, s_suppkey + 1]) AS adj FROM supplier)"


@query(
    "j1_inner_one_key",
    f"""SELECT c_mktsegment, count(*) AS n, {R('avg(o_totalprice)', 'price')}
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""",
)
def j1(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_totalprice")
    return ops.merge(o, c, ["k"]).groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("o_totalprice")).alias("price")
    )


@query(
    "j2_inner_composite_key",
    f"""WITH {PANEL}, mx AS (SELECT area, yr, max(wage) AS top FROM facts WHERE emp GROUP BY area, yr)
    SELECT area, yr, {R('panel.w', 'w')}, top FROM panel JOIN mx USING (area, yr)""",
)
def j2(spark, sf):
    top = facts(spark, sf).where("emp").groupBy("area", "yr").agg(F.max("wage").alias("top"))
    return rounded(ops.merge(area_panel(spark, sf).select("area", "yr", "w"), top, ["area", "yr"]), "w")


@query(
    "j3_natural",
    """SELECT c_custkey, nationkey, n FROM (SELECT c_custkey, c_nationkey AS nationkey FROM customer)
    NATURAL JOIN (SELECT s_nationkey AS nationkey, count(*) AS n FROM supplier GROUP BY 1)""",
)
def j3(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nationkey"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return ops.natural_merge(c, s)


@query(
    "j4_left",
    """SELECT c_custkey, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders
    WHERE year(o_orderdate) = 1995 GROUP BY o_custkey) ON c_custkey = o_custkey""",
)
def j4(spark, sf):
    n = table(spark, sf, "orders").where(in_years("o_orderdate", [1995])).groupBy(F.col("o_custkey").alias("c_custkey"))
    return ops.merge(table(spark, sf, "customer").select("c_custkey"), n.agg(F.count(F.lit(1)).alias("n")), ["c_custkey"], "left")


@query(
    "j5_right",
    """SELECT c_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders
    WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) RIGHT JOIN customer ON c_custkey = o_custkey""",
)
def j5(spark, sf):
    n = table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT").groupBy(F.col("o_custkey").alias("c_custkey"))
    return ops.merge(n.agg(F.count(F.lit(1)).alias("n")), table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], "right")


@query(
    "j6_full",
    f"""WITH {PANEL}, a AS (SELECT area, w AS w_1995 FROM panel WHERE yr = 1995 AND w > 53000),
    b AS (SELECT area, w AS w_2001 FROM panel WHERE yr = 2001 AND w > 53000)
    SELECT area, {Rs('w_1995 w_2001')} FROM a FULL JOIN b USING (area)""",
)
def j6(spark, sf):
    # Each side reads its own year only.
    a, b = (area_panel(spark, sf, [y]).where(F.col("w") > 53000).select("area", F.col("w").alias(f"w_{y}")) for y in (1995, 2001))
    return rounded(ops.merge(a, b, ["area"], "full"), "w_1995", "w_2001")


@query(
    "j7_many_to_many",
    f"""WITH {CROSSWALK} SELECT county, count(*) AS n, {R('sum(c_acctbal)', 'bal', 2)}
    FROM customer JOIN crosswalk ON c_nationkey = zip GROUP BY county""",
)
def j7(spark, sf):
    # A postal code lies in at most three counties, so rows grow by a bounded factor.
    c = table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("zip"), "c_acctbal")
    return ops.merge(c, crosswalk(spark, sf), ["zip"]).groupBy("county").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("c_acctbal"), 2).alias("bal")
    )


@query(
    "j8_semi",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 8000)",
)
def j8(spark, sf):
    rich = table(spark, sf, "customer").where(F.col("c_acctbal") > 8000).select(F.col("c_custkey").alias("o_custkey"))
    return ops.members(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), rich, ["o_custkey"])


@query(
    "j9_anti",
    """SELECT c_custkey FROM customer WHERE NOT EXISTS
    (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1995)""",
)
def j9(spark, sf):
    seen = table(spark, sf, "orders").where(in_years("o_orderdate", [1995])).select(F.col("o_custkey").alias("c_custkey"))
    return ops.non_members(table(spark, sf, "customer").select("c_custkey"), seen, ["c_custkey"])


@query(
    "j10_self_join_suffixes",
    f"""WITH {PANEL} SELECT area, {R('a.w', 'w_1995')}, {R('b.w', 'w_2001')}, {R('b.w - a.w', 'd')}
    FROM panel a JOIN panel b USING (area) WHERE a.yr = 1995 AND b.yr = 2001""",
)
def j10(spark, sf):
    first, last = (area_panel(spark, sf, [y]).select("area", "w") for y in (1995, 2001))
    both = ops.merge(first, last, ["area"], suffixes=("_1995", "_2001"))
    return rounded(both.withColumn("d", F.col("w_2001") - F.col("w_1995")), "w_1995", "w_2001", "d")


@query(
    "j11_base_period",
    f"""WITH {PANEL} SELECT area, yr, {R('p.w', 'w')}, {R('b.w', 'w_base')} FROM panel p
    JOIN (SELECT area, w FROM panel WHERE yr = 1995) b USING (area)""",
)
def j11(spark, sf):
    panel = area_panel(spark, sf).select("area", "yr", "w")
    base = area_panel(spark, sf, [1995]).select("area", F.col("w").alias("w_base"))
    return rounded(ops.merge(panel, base, ["area"]), "w", "w_base")


@query(
    "j12_shifted_key",
    f"""WITH {PANEL} SELECT p.area, p.yr, {R('p.w', 'w')}, {R('q.w', 'w_later')} FROM panel p
    JOIN panel q ON p.area = q.area AND p.yr = q.yr - 1""",
)
def j12(spark, sf):
    panel = reused(area_panel(spark, sf).select("area", "yr", "w"))
    later = ops.shift_key(panel, "yr", -1).withColumnRenamed("w", "w_later")
    return rounded(ops.merge(panel, later, ["area", "yr"]), "w", "w_later")


@query(
    "j13_role_playing",
    f"""WITH {FACTS_FLOW} SELECT a.n_regionkey AS region_to, b.n_regionkey AS region_from, {R('sum(wt)', 'wt')}
    FROM persons JOIN nation a ON state = a.n_nationkey JOIN nation b ON origin = b.n_nationkey GROUP BY 1, 2""",
)
def j13(spark, sf):
    # Flows first: the two dimension joins then run over pairs of states.
    flows = facts_flow(spark, sf).groupBy("state", "origin").agg(F.sum("wt").alias("wt"))
    n = table(spark, sf, "nation")
    to = ops.with_role(n, "n_nationkey", "state", region_to="n_regionkey")
    origin = ops.with_role(n, "n_nationkey", "origin", region_from="n_regionkey")
    rows = flows.join(to, "state").join(origin, "origin")
    return rows.groupBy("region_to", "region_from").agg(r(F.sum("wt")).alias("wt"))


@query(
    "j14_adjacency",
    f"""WITH {PANEL}, {EDGES} SELECT e.area, e.adj, {R('emp', 'emp')} FROM edges e
    LEFT JOIN (SELECT area AS adj, emp FROM panel WHERE yr = 1995) USING (adj)""",
)
def j14(spark, sf):
    size = area_panel(spark, sf, [1995]).select(F.col("area").alias("adj"), "emp")
    return rounded(ops.merge(edges(spark, sf), size, ["adj"], "left"), "emp")


CODES = """codes AS (SELECT p_partkey, concat(lpad(CAST(p_size AS VARCHAR), 2, '0'),
    lpad(CAST(p_partkey % 500 AS VARCHAR), 3, '0'), CAST(p_partkey % 2 AS VARCHAR)) AS code,
  concat(lpad(CAST(p_size AS VARCHAR), 2, '0'), lpad(CAST(p_partkey % 500 AS VARCHAR), 3, '0'),
    CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 2 AS VARCHAR) ELSE '5' END) AS old_code, p_retailprice AS score FROM part)"""
CROSSED = f"""{CODES}, sc AS (SELECT code, avg(score) AS score FROM codes GROUP BY code),
  links AS (SELECT old_code AS code, l_suppkey AS target FROM lineitem JOIN codes ON l_partkey = p_partkey),
  near_sc AS (SELECT concat(left(code, 5), '0') AS code, avg(score) AS score FROM sc
    WHERE code NOT IN (SELECT code FROM links) GROUP BY 1),
  near_links AS (SELECT concat(left(code, 5), '0') AS code, target FROM links WHERE code NOT IN (SELECT code FROM sc)),
  crossed AS (SELECT target, avg(score) AS score FROM (
    SELECT target, score FROM sc JOIN links USING (code) UNION ALL
    SELECT target, score FROM near_sc JOIN near_links USING (code)) GROUP BY target)"""


def code_tables(spark, sf):
    """Scores by six-character code, and links whose last character differs for two parts in three."""
    part = table(spark, sf, "part")
    key = F.col("p_partkey")
    head = F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lpad((key % 500).cast("string"), 3, "0"))
    last = (key % 2).cast("string")
    codes = part.select(
        key.alias("part_id"), F.concat(head, last).alias("code"),
        F.concat(head, F.when(key % 3 == 0, last).otherwise("5")).alias("old_code"), F.col("p_retailprice").alias("score"),
    )
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("target"))
    links = lines.join(codes.select("part_id", F.col("old_code").alias("code")), "part_id").select("code", "target")
    return codes.select("code", "score"), links


@query("j15_prefix_fallback", f"WITH {CROSSED} SELECT target, {R('score', 'score')} FROM crossed")
def j15(spark, sf):
    scores, links = code_tables(spark, sf)
    return rounded(ops.crosswalk_scores(scores, links, "code", "score", "target"), "score")


PRICES = [(1995, 1.0), (1996, 1.03), (1997, 1.05), (1998, 1.07), (1999, 1.09), (2000, 1.13), (2001, 1.16)]


@query(
    "j16_deflate",
    f"""WITH {PANEL}, prices AS (SELECT * FROM (VALUES {", ".join(f"({y}, CAST({p} AS DOUBLE))" for y, p in PRICES)}) v(yr, idx))
    SELECT area, yr, {R('panel.w / idx', 'w')} FROM panel JOIN prices USING (yr)""",
)
def j16(spark, sf):
    prices = literal_table(spark, PRICES, "yr long, idx double")
    return rounded(ops.deflate(area_panel(spark, sf).select("area", "yr", "w"), prices, "yr", "w", "idx"), "w")


@query(
    "j17_scalar_beside_rows",
    f"WITH {PANEL} SELECT area, yr, {R('exp / (SELECT stddev_samp(exp) FROM panel)', 'exp_sd')} FROM panel",
)
def j17(spark, sf):
    panel = attach_stats(area_panel(spark, sf), [], {"sd": F.stddev_samp("exp")})
    return panel.select("area", "yr", r(ratio("exp", "sd")).alias("exp_sd"))


@query(
    "u1_union_by_name",
    f"""WITH {PANEL} SELECT area, yr, {R('w', 'w')} FROM panel WHERE yr = 1995
    UNION ALL BY NAME SELECT {R('w', 'w')}, yr, area FROM panel WHERE yr = 2001""",
)
def u1(spark, sf):
    a = area_panel(spark, sf, [1995]).select("area", "yr", "w")
    return rounded(a.unionByName(area_panel(spark, sf, [2001]).select("w", "yr", "area")), "w")


@query(
    "u2_results_per_year",
    f"""WITH {FACTS} SELECT yr, count(*) AS n, {R('regr_slope(wage, wt)', 'slope')}, {R('regr_intercept(wage, wt)', 'intercept')}
    FROM facts GROUP BY yr""",
)
def u2(spark, sf):
    # One grouped job in place of appending one result per loop turn.
    return rounded(fit_lines(facts(spark, sf), "wt", "wage", ["yr"]).drop("slope_se"), "slope", "intercept")


@query("u3_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem")
def u3(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey").distinct()


@query(
    "r1_unpivot",
    f"""SELECT s, variable, {R('sum(value)', 'total')}, count(*) AS n FROM (
    SELECT l_suppkey AS s, 'disc' AS variable, l_discount AS value FROM lineitem UNION ALL
    SELECT l_suppkey, 'tax', l_tax FROM lineitem) GROUP BY s, variable""",
)
def r1(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("s"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax")
    )
    long = melt(rows, ["s"], ["disc", "tax"])
    return long.groupBy("s", "variable").agg(r(F.sum("value")).alias("total"), F.count(F.lit(1)).alias("n"))


YEARS = list(range(1995, 2002))


@query(
    "r2_pivot",
    f"""WITH {PANEL} SELECT area, {", ".join(R(f"max(w) FILTER (WHERE yr = {y})", f"y{y}") for y in YEARS)}
    FROM panel GROUP BY area""",
)
def r2(spark, sf):
    wide = widen(area_panel(spark, sf).select("area", "yr", "w"), ["area"], "yr", YEARS, ["w"])
    wide = wide.withColumnsRenamed({str(y): f"y{y}" for y in YEARS})
    return rounded(wide, *[f"y{y}" for y in YEARS])


@query(
    "r3_pivot_values",
    f"""WITH {PANEL} SELECT area, {", ".join(R(f"max({v}) FILTER (WHERE yr = {y})", f"{v}_{y}") for y in (1995, 2001) for v in ("exp", "w"))}
    FROM panel WHERE yr IN (1995, 2001) GROUP BY area""",
)
def r3(spark, sf):
    panel = area_panel(spark, sf, [1995, 2001])
    wide = widen(panel, ["area"], "yr", [1995, 2001], ["exp", "w"])
    return rounded(wide, "exp_1995", "exp_2001", "w_1995", "w_2001")


@query(
    "r4_split_numbers",
    f"""SELECT p_partkey, {R('CASE WHEN p_size > 45 THEN NULL WHEN p_size > 40 THEN p_size * 1000.0 ELSE (p_size * 1000.0 + p_size * 1000.0 + 4999) / 2 END', 'mid')}
    FROM part""",
)
def r4(spark, sf):
    size = F.col("p_size")
    low, high = (size * 1000).cast("string"), (size * 1000 + 4999).cast("string")
    text = (
        F.when(size > 45, F.lit("not given-")).when(size > 40, F.concat(F.lit("$"), low, F.lit(" or so")))
        .otherwise(F.concat(F.lit("$"), low, F.lit("-"), high))
    )
    return table(spark, sf, "part").select("p_partkey", r(range_mean(text)).alias("mid"))
