"""Whole analyses (D ids) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.catalog.joins import CROSSED, CROSSWALK, EDGES, code_tables, crosswalk, edges
from panelmill.catalog.registry import (
    FACTS, FACTS_FLOW, FACTS_JOB, FACTS_STATE, PANEL, R, Rs, area_panel, areas, facts, facts_flow, facts_job, facts_state,
    jobs, query, r, rounded, table,
)
from panelmill.functions.codes import ladder, open_range_mean, period_start
from panelmill.functions.safe import flag, ln, ratio
from panelmill.functions.weighted import wmean
from panelmill.models.design import design
from panelmill.models.linear import fit_linear
from panelmill.operators import allocation
from panelmill.operators.scaling import above_median, share_of_total
from panelmill.plans import cohorts, concentration, decomposition, degrees, did, exposure, migration, panels, shocks
from panelmill.sources.tables import literal_table, year_bins

ENDS = (1995, 2001)


@query(
    "entry_wage_response",
    f"""WITH {FACTS}, panel AS (SELECT area, yr, sum(wt * score) / sum(wt) AS exp, sum(wt * wage) / sum(wt) AS w, sum(wt) AS emp
      FROM facts WHERE emp AND yr IN (1995, 2001) GROUP BY area, yr)
    SELECT area, yr, {R('exp / stddev_samp(exp) OVER (PARTITION BY yr)', 'exp')}, {R('w', 'w')}, {R('emp', 'emp')},
    {R('lead(ln(w)) OVER (PARTITION BY area ORDER BY yr) - ln(w)', 'del_w')} FROM panel""",
)
def entry_wage_response(spark, sf):
    working = facts(spark, sf, ENDS).where("emp")
    panel = panels.weighted_panel(working, ["area", "yr"], "wt", {"exp": "score", "w": "wage"}, counts={"emp": None})
    out = panels.wage_response(panel, ["area"], "yr", "w", "exp").select("area", "yr", "exp", "w", "emp", "del_w")
    return rounded(out, "exp", "w", "emp", "del_w")


@query(
    "entry_wage_slope",
    f"""WITH {FACTS}, panel AS (SELECT area, yr, sum(wt * score) / sum(wt) AS exp, sum(wt * wage) / sum(wt) AS w, sum(wt) AS emp
      FROM facts WHERE emp AND yr IN (1995, 2001) GROUP BY area, yr),
    p AS (SELECT exp / stddev_samp(exp) OVER (PARTITION BY yr) AS x, emp AS wt,
      lead(ln(w)) OVER (PARTITION BY area ORDER BY yr) - ln(w) AS y FROM panel),
    s AS (SELECT count(*) AS n, sum(wt) AS sw, sum(wt * x) / sum(wt) AS mx, sum(wt * y) / sum(wt) AS my FROM p WHERE y IS NOT NULL),
    d AS (SELECT any_value(n) AS n, sum(wt * (x - mx) * (x - mx)) AS sxx, sum(wt * (x - mx) * (y - my)) AS sxy, sum(wt * (y - my) * (y - my)) AS syy
      FROM p, s WHERE y IS NOT NULL)
    SELECT 'exp' AS term, {R('sxy / sxx', 'estimate')}, {R('sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx)', 'std_error')} FROM d""",
)
def entry_wage_slope(spark, sf):
    working = facts(spark, sf, ENDS).where("emp")
    panel = panels.weighted_panel(working, ["area", "yr"], "wt", {"exp": "score", "w": "wage"}, counts={"emp": None})
    panel = panels.wage_response(panel, ["area"], "yr", "w", "exp")
    table_ = fit_linear(panel, design("del_w", "exp", weight="emp")).coefficients(terms=["exp"])
    return rounded(table_.select("term", "estimate", "std_error"), "estimate", "std_error")


# Traits of parts: mean quantity and mean tax from the order lines, brand membership as a third source.
TRAITS = """traits AS (
    SELECT l_partkey AS part, 'quantity' AS element, CAST(round(avg(l_quantity), 9) > 25 AS DOUBLE) AS value FROM lineitem GROUP BY 1
    UNION ALL SELECT l_partkey, 'tax', CAST(round(avg(l_tax), 9) > 0.04::DOUBLE AS DOUBLE) FROM lineitem GROUP BY 1
    UNION ALL SELECT p_partkey, 'unused', 1.0::DOUBLE FROM part),
  wide AS (SELECT concat(CAST(part AS VARCHAR), CASE WHEN part % 3 = 0 THEN '.01' ELSE '.00' END) AS code,
    max(value) FILTER (WHERE element = 'quantity') AS quantity, max(value) FILTER (WHERE element = 'tax') AS tax
    FROM traits WHERE element IN ('quantity', 'tax') GROUP BY 1),
  occ AS (SELECT concat(CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 3 = 0 THEN '.01' ELSE '.00' END) AS code,
    CASE WHEN p_size <= 40 THEN CASE WHEN p_size > 15 THEN 1 ELSE 0 END END AS label FROM part)"""


def trait_frames(spark, sf):
    code = lambda k: F.concat(F.col(k).cast("string"), F.when(F.col(k) % 3 == 0, ".01").otherwise(".00")).alias("code")
    lines = table(spark, sf, "lineitem").groupBy("l_partkey").agg(r(F.avg("l_quantity"), 9).alias("q"), r(F.avg("l_tax"), 9).alias("t"))
    row = lambda name, x: (code("l_partkey"), F.lit(name).alias("element"), x.alias("value"))
    quantity = lines.select(*row("quantity", flag(F.col("q") > 25)))
    tax = lines.select(*row("tax", flag(F.col("t") > 0.04)))
    part = table(spark, sf, "part")
    unused = part.select(F.lit(1.0).alias("value"), F.lit("unused").alias("element"), code("p_partkey"))
    traits = exposure.select_traits([(quantity, ["quantity"]), (tax, ["tax"]), (unused, ["quantity", "tax"])], "element")
    label = F.when(F.col("p_size") <= 40, (F.col("p_size") > 15).cast("int"))
    return exposure.trait_table(traits, "code", "element", "value", ["quantity", "tax"]), part.select(code("p_partkey"), label.alias("label"))


@query("d1_trait_table", f"WITH {TRAITS} SELECT code, quantity, tax, label FROM wide JOIN occ USING (code)")
def d1_traits(spark, sf):
    wide, occ = trait_frames(spark, sf)
    return wide.join(occ, "code").select("code", "quantity", "tax", "label")


@query(
    "d1_exposure_scores",
    f"""WITH {TRAITS}, j AS (SELECT * FROM wide JOIN occ USING (code)),
    p AS (SELECT quantity, avg(label) AS score FROM j WHERE right(code, 2) = '00' AND label IS NOT NULL GROUP BY quantity)
    SELECT code, {R('score', 'score')} FROM j JOIN p USING (quantity)""",
)
def d1(spark, sf):
    wide, occ = trait_frames(spark, sf)
    _, scored = exposure.score_codes(occ, wide, "code", "label", ["quantity"])
    return rounded(scored.select("code", "score"), "score")


@query(
    "d2_crosswalk_to_persons",
    f"""WITH {CROSSED}, {FACTS}, p AS (SELECT yr, wt, coll, CASE WHEN area = 0 THEN 0 ELSE score END AS sc
      FROM (SELECT f.yr, f.wt, f.coll, f.area, c.score FROM facts f LEFT JOIN crossed c ON f.area = c.target))
    SELECT yr, {R('sum(wt * sc) / sum(wt)', 'exp')}, count(*) AS n FROM p WHERE sc IS NOT NULL AND NOT coll GROUP BY yr""",
)
def d2(spark, sf):
    scores, links = code_tables(spark, sf)
    persons = facts(spark, sf).drop("score").withColumnRenamed("area", "target")
    rows = exposure.scored_persons(persons, scores, links, "code", "target", {0: 0.0}, keep=~F.col("coll"))
    return rows.groupBy("yr").agg(r(wmean("score", "wt")).alias("exp"), F.count(F.lit(1)).alias("n"))


ALLOCATED = f"""{CROSSWALK}, spread AS (SELECT county, o_orderpriority AS kind, o_totalprice
      / count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS part
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN crosswalk ON c_nationkey = zip),
  counties AS (SELECT county, kind, sum(part) AS num FROM spread GROUP BY county, kind)"""


def allocated(spark, sf):
    measures = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("unit"), F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("num")
    )
    units = table(spark, sf, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_nationkey").cast("long").alias("zip"))
    places = units.join(crosswalk(spark, sf), "zip").select("unit", "county")
    return allocation.allocate(measures, places, "unit", "num", ["county"], ["kind"])


@query(
    "d3_allocation",
    f"""WITH {ALLOCATED} SELECT county, kind, {R('num / 1e6::DOUBLE', 'num', 3)}, {R('num / sum(num) OVER (PARTITION BY county)', 'share', 9)}
    FROM counties""",
)
def d3(spark, sf):
    spread = share_of_total(allocated(spark, sf), "num", ["county"], "share")
    return spread.select("county", "kind", r(F.col("num") / 1e6, 3).alias("num"), r("share", 9).alias("share"))


@query(
    "d4_adjacent_totals",
    f"""WITH {FACTS}, {EDGES}, pops AS (SELECT area, sum(wt) AS pop FROM facts WHERE yr = 1995 GROUP BY area),
    m AS (SELECT area, flag, sum(wt) AS num FROM facts GROUP BY area, flag),
    j AS (SELECT e.area, e.adj, flag, num, pop FROM edges e LEFT JOIN (SELECT area AS adj, flag, num, pop FROM m JOIN pops USING (area)) USING (adj)),
    p AS (SELECT area, CASE WHEN count(pop) = count(*) THEN sum(DISTINCT pop) END AS pop_adj FROM j GROUP BY area),
    n AS (SELECT area, flag, CASE WHEN count(num) = count(*) THEN sum(num) END AS num_adj FROM j GROUP BY area, flag)
    SELECT area, flag, {Rs('pop_adj num_adj')}, {R('num_adj / nullif(pop_adj, 0)', 'num_per_pop')} FROM n JOIN p USING (area)""",
)
def d4(spark, sf):
    f = facts(spark, sf)
    pops = facts(spark, sf, [1995]).groupBy("area").agg(F.sum("wt").alias("pop"))
    measures = f.groupBy("area", "flag").agg(F.sum("wt").alias("num")).join(pops, "area")
    out = allocation.neighbour_totals(measures, edges(spark, sf), ["area"], ["adj"], "flag", "num", "pop")
    return rounded(out, "num_adj", "pop_adj", "num_per_pop")


@query("d5_area_panel", f"WITH {PANEL} SELECT area, yr, {Rs('exp w emp frac_col')} FROM panel")
def d5(spark, sf):
    return rounded(area_panel(spark, sf), "exp", "w", "emp", "frac_col")


@query(
    "d6_long_difference",
    f"""WITH {PANEL}, p AS (SELECT * FROM panel WHERE yr IN (1995, 2001))
    SELECT area, yr, {", ".join(R(f"lead(ln({x})) OVER (PARTITION BY area ORDER BY yr) - ln({x})", n) for n, x in (("growth", "emp"), ("exp_growth", "exp"), ("w_growth", "w"), ("col_growth", "frac_col")))} FROM p""",
)
def d6(spark, sf):
    names = {"growth": "emp", "exp_growth": "exp", "w_growth": "w", "col_growth": "frac_col"}
    rows = panels.long_difference(area_panel(spark, sf, ENDS), ["area"], "yr", [1995, 2001], **names)
    return rounded(rows.select("area", "yr", *names), *names)


@query(
    "d7_shift_share",
    f"""WITH {FACTS_JOB}, c AS (SELECT yr, area, ind, sum(wt) AS emp FROM persons WHERE yr IN (1995, 2001) GROUP BY yr, area, ind),
    t AS (SELECT *, sum(emp) OVER (PARTITION BY yr, area) AS area_emp, sum(emp) OVER (PARTITION BY yr, ind) AS ind_emp,
      sum(emp) OVER (PARTITION BY yr) AS all_emp FROM c),
    l AS (SELECT *, (ind_emp - emp) / all_emp AS loo FROM t),
    g AS (SELECT *, (loo - lag(loo) OVER w) / nullif(lag(loo) OVER w, 0) AS growth FROM l WINDOW w AS (PARTITION BY ind, area ORDER BY yr)),
    s AS (SELECT ind, area, emp / area_emp AS share FROM t WHERE yr = 1995)
    SELECT area, yr, {R('sum(growth * share)', 'shocks')} FROM g JOIN s USING (ind, area) GROUP BY area, yr HAVING coalesce(sum(growth * share), 0) <> 0""",
)
def d7(spark, sf):
    rows = facts_job(spark, sf, ENDS)
    return rounded(shocks.shift_share(rows, ["area"], "ind", "yr", "wt", 1995), "shocks")


def _hh_sql(where: str) -> str:
    return f"""WITH {FACTS_JOB}, c AS (SELECT area, yr, ind, sum(wt) AS emp, sum(wt * score) / sum(wt) AS score FROM persons {where} GROUP BY area, yr, ind),
    s AS (SELECT *, emp / sum(emp) OVER (PARTITION BY area, yr) AS share FROM c),
    h AS (SELECT area, yr, sum(share * share) AS hh, sum(emp * score) / sum(emp) AS score FROM s WHERE emp > 0 GROUP BY area, yr)
    SELECT area, yr, {R('hh', 'hh', 9)}, {R('ln(score)', 'log_score', 9)}, score > (SELECT median(score) FROM h) * (1 + 1e-12::DOUBLE) AS above FROM h"""


def _hh_rounded(index):
    # The log has no short decimal expansion, so rounding never meets a tie.
    return index.select("area", "yr", r("hh", 9).alias("hh"), r(ln("score"), 9).alias("log_score"), "above")


@query("d8_herfindahl", _hh_sql(""))
def d8(spark, sf):
    return _hh_rounded(concentration.industry_concentration(facts_job(spark, sf), ["area", "yr"], "ind", "wt", "score"))


@query("d8_herfindahl_without", _hh_sql("WHERE ind NOT IN ('Brand#1', 'Brand#2')"))
def d8_without(spark, sf):
    index = concentration.industry_concentration(
        facts_job(spark, sf), ["area", "yr"], "ind", "wt", "score", drop=["Brand#1", "Brand#2"]
    )
    return _hh_rounded(index)


@query(
    "d8_herfindahl_broad",
    _hh_sql("").replace("p_type AS occ, p_brand AS ind", "p_type AS occ, CASE WHEN p_size <= 10 THEN 'a' WHEN p_size <= 25 THEN 'b' ELSE 'c' END AS ind"),
)
def d8_broad(spark, sf):
    size = F.col("p_size")
    broad = table(spark, sf, "part").select(
        F.col("p_partkey").alias("part_id"), ladder([(size <= 10, "a"), (size <= 25, "b")], "c").alias("ind")
    )
    rows = facts(spark, sf).join(broad, "part_id")
    return _hh_rounded(concentration.industry_concentration(rows, ["area", "yr"], "ind", "wt", "score"))


@query(
    "d8_herfindahl_counts",
    f"""WITH {FACTS_JOB}, c AS (SELECT area, yr, occ, count(*) AS n FROM persons WHERE occ <> 'PROMO' GROUP BY area, yr, occ),
    s AS (SELECT *, n / sum(n) OVER (PARTITION BY area, yr) AS share, sum(n) OVER (PARTITION BY area, yr) AS total FROM c)
    SELECT area, yr, {R('sum(share * share)', 'hh', 9)} FROM s WHERE total > 70 GROUP BY area, yr""",
)
def d8_counts(spark, sf):
    return rounded(concentration.count_concentration(facts_job(spark, sf), ["area", "yr"], "occ", 70, ["PROMO"]), "hh", digits=9)


@query(
    "d8_herfindahl_majors",
    f"""WITH {FACTS_JOB}, k AS (SELECT area, CAST(floor(yr / 3) * 3 AS BIGINT) AS period, occ FROM persons WHERE occ <> 'PROMO'),
    c AS (SELECT area, period, occ, count(*) AS n FROM k GROUP BY area, period, occ),
    s AS (SELECT *, n / sum(n) OVER (PARTITION BY area, period) AS share, sum(n) OVER (PARTITION BY area, period) AS total FROM c),
    h AS (SELECT area, period, sum(share * share) AS hh FROM s WHERE total > 20 GROUP BY area, period),
    e AS (SELECT area, round(sum(wt * score) / sum(wt), 9) AS exp FROM facts WHERE yr = 1995 GROUP BY area)
    SELECT area, period, {R('hh', 'hh', 9)}, exp, exp > median(exp) OVER () AS exp_med FROM h JOIN e USING (area)""",
)
def d8_majors(spark, sf):
    """Concentration over row counts beside the area's exposure, split at its median over areas and periods."""
    rows = facts_job(spark, sf).withColumn("period", period_start("yr", 3))
    index = concentration.count_concentration(rows, ["area", "period"], "occ", 20, ["PROMO"])
    exposed = area_panel(spark, sf, [1995]).select("area", F.round("exp", 9).alias("exp"))
    return rounded(above_median(index.join(exposed, "area"), "exp", "exp_med"), "hh", digits=9)


OCC_SCORED = f"""{FACTS_JOB}, os AS (SELECT occ, avg(score) AS x FROM persons GROUP BY occ),
  sp AS (SELECT p.area, p.yr, p.ind, p.occ, p.wt, os.x FROM persons p JOIN os USING (occ)),
  cells AS (SELECT area, yr, ind, occ, any_value(x) AS x, sum(wt) AS own FROM sp GROUP BY area, yr, ind, occ),
  mixes AS (SELECT yr, ind, occ, sum(own) / any_value(tot) AS share FROM
    (SELECT *, sum(own) OVER (PARTITION BY yr, ind) AS tot FROM cells) GROUP BY yr, ind, occ),
  ex AS (SELECT c.*, share * sum(own) OVER (PARTITION BY area, yr, ind) AS expected FROM cells c JOIN mixes USING (yr, ind, occ)),
  parts AS (SELECT area, yr, sum(expected * x) / sum(own) AS b, sum((own - expected) * x) / sum(own) AS w, sum(own * x) / sum(own) AS t
    FROM ex GROUP BY area, yr)"""


def occ_scored(spark, sf):
    """Persons whose score is the mean of their occupation."""
    rows = facts_job(spark, sf)
    means = rows.groupBy("occ").agg(F.avg("score").alias("x"))
    return rows.drop("score").join(means, "occ")


def parts(spark, sf):
    return decomposition.between_within(occ_scored(spark, sf), ["area"], "yr", "ind", "occ", "x", "wt")


@query("d9_between_within", f"WITH {OCC_SCORED} SELECT area, yr, {R('b', 'between', 9)}, {R('w', 'within', 9)}, {R('t', 'total', 9)} FROM parts")
def d9(spark, sf):
    return rounded(parts(spark, sf), "between", "within", "total", digits=9)


@query(
    "d9_decomposition_changes",
    f"""WITH {OCC_SCORED}, c AS (SELECT area, yr, b - lag(b) OVER w AS b, w - lag(w) OVER w AS w, t - lag(t) OVER w AS t FROM parts
      WHERE yr IN (1995, 2001) WINDOW w AS (PARTITION BY area ORDER BY yr))
    SELECT {R('var_samp(t) * 1e6', 'total', 3)}, {R('var_samp(w) * 1e6', 'within', 3)}, {R('var_samp(b) * 1e6', 'between', 3)}
    FROM c WHERE yr = 2001 AND t IS NOT NULL""",
)
def d9_changes(spark, sf):
    two = parts(spark, sf).where(F.col("yr").isin(1995, 2001))
    changes = decomposition.decomposition_changes(two, ["area"], "yr").where("yr = 2001")
    v = decomposition.variances(changes, "del_")
    return v.select(*[r(F.col(c) * 1e6, 3).alias(c) for c in ("total", "within", "between")])


@query(
    "d10_share_change_by_bin",
    f"""WITH {FACTS_JOB}, k AS (SELECT * FROM persons WHERE score <> 0),
    e AS (SELECT ind, sum(wt * score) / sum(wt) AS x FROM k GROUP BY ind),
    q AS (SELECT [{", ".join(f"quantile_cont(x, CAST({i / 10} AS DOUBLE))" for i in range(11))}] AS cuts FROM e),
    b AS (SELECT ind, CAST(len(list_filter(cuts, lambda c: c <= x)) AS BIGINT) AS bin FROM e, q),
    s AS (SELECT area, yr, bin, sum(wt) AS emp FROM k JOIN b USING (ind) GROUP BY area, yr, bin),
    h AS (SELECT area, yr, bin, emp / sum(emp) OVER (PARTITION BY area, yr) AS share FROM s)
    SELECT area, yr, bin, {R('share', 'share', 9)}, {R('share - lag(share) OVER (PARTITION BY area, bin ORDER BY yr)', 'del_share', 9)} FROM h""",
)
def d10(spark, sf):
    rows = decomposition.industry_share_changes(facts_job(spark, sf), ["area"], "yr", "ind", "score", "wt")
    return rounded(rows.select("area", "yr", "bin", "share", "del_share"), "share", "del_share", digits=9)


@query(
    "d11_net_migration",
    f"""WITH {FACTS_FLOW}, f AS (SELECT yr, state, origin, sum(CASE WHEN state <> origin THEN wt ELSE 0 END) AS moved, sum(wt) AS num,
      sum(wt * score) / sum(wt) AS score FROM persons GROUP BY yr, state, origin),
    o AS (SELECT yr, origin AS place, sum(moved) AS outflow FROM f GROUP BY 1, 2),
    i AS (SELECT yr, state AS place, sum(moved) AS inflow, sum(num) AS num, sum(num * score) / sum(num) AS score FROM f GROUP BY 1, 2),
    b AS (SELECT *, inflow - outflow AS net FROM i JOIN o USING (yr, place)),
    x AS (SELECT *, CASE WHEN net > 0 THEN ln(net) END AS ln_net FROM b)
    SELECT yr, place, {Rs('inflow outflow net')}, {R('max(CASE WHEN yr = 1995 THEN score END) OVER (PARTITION BY place)', 'score_base')},
    {R('max(CASE WHEN yr = 1995 THEN num END) OVER (PARTITION BY place)', 'pop_base')},
    {R('ln_net - lag(ln_net) OVER (PARTITION BY place ORDER BY yr)', 'del_net')} FROM x""",
)
def d11(spark, sf):
    names = ["inflow", "outflow", "net", "score_base", "pop_base", "del_net"]
    rows = migration.net_migration(facts_flow(spark, sf), "yr", "state", "origin", "wt", "score", 1995)
    return rounded(rows.select("yr", "place", *names), *names)


HUBS = f"""{FACTS_FLOW}, fr AS (SELECT state, yr, sum(CASE WHEN coll THEN wt ELSE 0 END) / sum(wt) AS frac FROM persons GROUP BY state, yr),
  hubs AS (SELECT state, yr, CASE WHEN frac > median(frac) OVER (PARTITION BY yr) THEN 'Skill Hub' ELSE 'Not' END AS hub FROM fr)"""


def hubs(spark, sf):
    return migration.hub_classes(facts_state(spark, sf), "state", "yr", "wt", F.col("coll"))


@query(
    "d12_hub_flows",
    f"""WITH {HUBS}, s AS (SELECT p.yr, a.hub AS source, b.hub AS sink, wt FROM persons p JOIN hubs b ON p.state = b.state AND p.yr = b.yr
      JOIN hubs a ON p.origin = a.state AND p.yr = a.yr - 1 WHERE p.state <> p.origin),
    c AS (SELECT yr, source, sink, sum(wt) AS weight FROM s GROUP BY yr, source, sink)
    SELECT yr, source, sink, {R('weight', 'weight')}, {R('weight / sum(weight) OVER (PARTITION BY yr)', 'frac')} FROM c""",
)
def d12(spark, sf):
    flows = migration.hub_flows(facts_flow(spark, sf), hubs(spark, sf), "state", "yr", "state", "origin", "wt")
    return rounded(flows, "weight", "frac")


@query(
    "d12_hub_flows_by_education",
    f"""WITH {HUBS}, s AS (SELECT p.yr, a.hub AS source, b.hub AS sink, coll, wt FROM persons p JOIN hubs b ON p.state = b.state AND p.yr = b.yr
      JOIN hubs a ON p.origin = a.state AND p.yr = a.yr - 1 WHERE p.state <> p.origin AND p.origin NOT IN (0, 24)),
    c AS (SELECT yr, source, sink, coll, sum(wt) AS weight FROM s GROUP BY ALL)
    SELECT yr, source, sink, coll, {R('weight', 'weight')}, {R('weight / sum(weight) OVER (PARTITION BY yr, coll)', 'frac')} FROM c""",
)
def d12_by_education(spark, sf):
    flows = migration.hub_flows(
        facts_flow(spark, sf), hubs(spark, sf), "state", "yr", "state", "origin", "wt", extra=["coll"],
        share_within=["coll"], where=~F.col("origin").isin(0, 24),
    )
    return rounded(flows, "weight", "frac")


@query(
    "d12_place_shares",
    f"""WITH {HUBS}, c AS (SELECT p.yr, hub, coll, sum(wt) AS weight FROM persons p JOIN hubs h ON p.state = h.state AND p.yr = h.yr GROUP BY ALL)
    SELECT yr, hub, coll, {R('weight', 'weight')}, {R('weight / sum(weight) OVER (PARTITION BY yr)', 'frac')} FROM c""",
)
def d12_places(spark, sf):
    shares = migration.place_shares(facts_state(spark, sf), hubs(spark, sf), "state", "yr", "wt", ["coll"])
    return rounded(shares, "weight", "frac")


@query(
    "d12_mover_classes",
    f"""WITH {HUBS}, c AS (SELECT p.yr, hub, coll, sum(wt) AS weight FROM persons p JOIN hubs h ON p.state = h.state AND p.yr = h.yr WHERE p.state <> p.origin GROUP BY ALL)
    SELECT yr, hub, coll, {R('weight', 'weight')}, {R('weight / sum(weight) OVER (PARTITION BY yr)', 'frac')} FROM c""",
)
def d12_mover_classes(spark, sf):
    """Movers by education and the class of the place they live in."""
    movers = facts_flow(spark, sf).where(F.col("state") != F.col("origin"))
    return rounded(migration.place_shares(movers, hubs(spark, sf), "state", "yr", "wt", ["coll"]), "weight", "frac")


@query(
    "d12_flows_by_education_only",
    f"""WITH {HUBS}, s AS (SELECT p.yr, coll, wt FROM persons p JOIN hubs b ON p.state = b.state AND p.yr = b.yr
      JOIN hubs a ON p.origin = a.state AND p.yr = a.yr - 1 WHERE p.state <> p.origin AND p.origin NOT IN (0, 24)),
    c AS (SELECT yr, coll, sum(wt) AS weight FROM s GROUP BY ALL)
    SELECT yr, coll, {R('weight', 'weight')}, {R('weight / sum(weight) OVER (PARTITION BY yr)', 'frac')} FROM c""",
)
def d12_education_only(spark, sf):
    """Movers between classed places by education alone."""
    flows = migration.hub_flows(
        facts_flow(spark, sf), hubs(spark, sf), "state", "yr", "state", "origin", "wt", extra=["coll"], keys=(), where=~F.col("origin").isin(0, 24)
    )
    return rounded(flows, "weight", "frac")


COHORT_KINDS = ["A", "N", "R"]


@query(
    "d13_cohort_conditions",
    f"""WITH {FACTS_STATE}, b AS (SELECT p.*, CAST((yr - 1995) // 3 + 1 AS BIGINT) AS grp, (yr - 1995) % 3 + 1 AS rank FROM persons p WHERE yr <= 2000),
    c AS (SELECT state, flag, grp + 1 AS grp, avg(wage) FILTER (WHERE rank = 3) / avg(wage) FILTER (WHERE rank = 1) - 1 AS growth,
      sum(wt * wage) / sum(wt) AS mean_wage, sum(wt) AS emp FROM b GROUP BY 1, 2, 3),
    s AS (SELECT *, emp / sum(emp) OVER (PARTITION BY state, grp) AS frac FROM c)
    SELECT state, grp, {", ".join(R(f"max({c}) FILTER (WHERE flag = '{k}')", f"{n}_{k}") for k in COHORT_KINDS for n, c in (("wage_growth", "growth"), ("frac_emp", "frac"), ("mean_wage", "mean_wage")))},
    {R("max(mean_wage) FILTER (WHERE flag = 'R') / max(mean_wage) FILTER (WHERE flag = 'N')", 'premium')} FROM s GROUP BY state, grp""",
)
def d13(spark, sf):
    bins = year_bins(spark, 1995, 2, 3).withColumnRenamed("year", "yr")
    rows = facts_state(spark, sf).join(bins, "yr")
    wide = cohorts.cohort_conditions(
        rows, ["state"], "flag", "grp", "rank", 1, 3, "wage", "wt", COHORT_KINDS, ("R", "N")
    )
    return rounded(wide, *[c for c in wide.columns if c not in ("state", "grp")])


RATES = f"""{FACTS_STATE}, v AS (SELECT state, area, CAST(floor(yr / 2) * 2 AS BIGINT) AS period, CASE WHEN flag = 'R' THEN 1 ELSE 0 END AS ret, score FROM persons),
  rates AS (SELECT area, period, avg(ret) AS rate FROM v GROUP BY area, period),
  pre AS (SELECT area, rate AS pre FROM rates WHERE period = 1994),
  ex AS (SELECT area, avg(score) AS x FROM v GROUP BY area),
  w AS (SELECT v.*, pre, x > (SELECT median(x) FROM ex) * (1 + 1e-12::DOUBLE) AS above FROM v JOIN pre USING (area) JOIN ex USING (area))"""


def did_rows(spark, sf):
    """Rows with the 0/1 outcome, the area's base rate, and whether the area is above median exposure."""
    rows = facts_state(spark, sf).select(
        "state", "area", period_start("yr", 2).alias("period"), flag(F.col("flag") == "R").alias("ret"), "score"
    )
    rates = did.base_rates(rows, ["area"], "period", "ret")
    upper = above_median(rows.groupBy("area").agg(F.avg("score").alias("x")), "x", "high").select("area", "high")
    return did.with_base_rate(rows, rates, ["area"], "period", 1994).join(upper, "area")


@query(
    "d14_diff_in_diff",
    f"""WITH {RATES}, g AS (SELECT above, period, avg(ret) - avg(pre) AS d FROM w GROUP BY above, period)
    SELECT a.period, {R('a.d', 'diff_upper')}, {R('b.d', 'diff_lower')}, {R('a.d - b.d', 'diff_diff')}
    FROM g a JOIN g b USING (period) WHERE a.above AND NOT b.above""",
)
def d14(spark, sf):
    diffs = did.group_differences(did_rows(spark, sf), F.col("high"), "period", "ret", "pre")
    return rounded(did.difference_in_differences(diffs, "period"), "diff_upper", "diff_lower", "diff_diff")


@query("d15_area_changes", f"WITH {RATES} SELECT area, period, {R('avg(ret) - avg(pre)', 'diffs')} FROM w GROUP BY area, period")
def d15(spark, sf):
    return rounded(did.area_changes(did_rows(spark, sf), ["area"], "period", "ret", "pre"), "diffs")


@query(
    "d16_quartile_changes",
    f"""WITH {PANEL}, b AS (SELECT area, w AS w0, exp AS e0 FROM panel WHERE yr = 1995),
    q AS (SELECT [{", ".join(f"quantile_cont(e0, CAST({i / 4} AS DOUBLE))" for i in range(5))}] AS cuts FROM b),
    f AS (SELECT area, w0, e0, CAST(least(len(list_filter(cuts, lambda c: c <= e0)), 4) AS BIGINT) AS quartile FROM b, q)
    SELECT yr, quartile, {R('avg(ln(w) - ln(w0))', 'd_wage')}, {R('avg(exp - e0)', 'd_exposure', 9)} FROM panel JOIN f USING (area) GROUP BY yr, quartile""",
)
def d16(spark, sf):
    changes = panels.quartile_changes(area_panel(spark, sf), "area", "yr", 1995, "exp", "w")
    return rounded(rounded(panels.quartile_means(changes, "yr"), "d_wage"), "d_exposure", digits=9)


@query(
    "d17_income_recode",
    f"""WITH t AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal > 9000 THEN 150000 * 1.5 WHEN c_acctbal < 0 THEN 6000 * 0.5
      ELSE (floor(c_acctbal / 1000) * 10000 + floor(c_acctbal / 1000) * 10000 + 4999) / 2 END AS inc,
      CASE c_mktsegment WHEN 'BUILDING' THEN 4 WHEN 'MACHINERY' THEN 3.7 WHEN 'FURNITURE' THEN 3.3 END AS points FROM customer)
    SELECT c_custkey, {R('inc', 'inc')}, {R('points', 'points')} FROM t""",
)
def d17(spark, sf):
    bal = F.col("c_acctbal")
    low = (F.floor(bal / 1000) * 10000).cast("long")
    text = (
        F.when(bal > 9000, F.lit("$150,000 or more")).when(bal < 0, F.lit("Less than $6,000"))
        .otherwise(F.concat(F.lit("$"), F.format_number(low, 0), F.lit("-"), F.format_number(low + 4999, 0)))
    )
    points = literal_table(spark, [("BUILDING", 4.0), ("MACHINERY", 3.7), ("FURNITURE", 3.3)], "c_mktsegment string, points double")
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", open_range_mean(text).alias("inc"))
    return rounded(rows.join(points, "c_mktsegment", "left").select("c_custkey", "inc", "points"), "inc", "points")


DEGREES = f"""{FACTS_STATE}, deg AS (SELECT area, state, yr, sum(CASE WHEN flag = 'R' THEN wt ELSE 0 END) AS comp, sum(wt) AS total FROM persons GROUP BY area, state, yr)"""


def degree_rows(spark, sf):
    kinds = {"comp": F.col("flag") == "R", "total": F.col("flag").isNotNull()}
    # Counted per unit before the state is attached, so that the join meets aggregates only.
    counts = degrees.degree_counts(facts(spark, sf), ["area"], "yr", "wt", kinds)
    return counts.join(areas(spark, sf), "area")


@query(
    "d18_degree_changes",
    f"""WITH {DEGREES} SELECT area, yr, {R('comp', 'comp')}, {R('total', 'total')}, {R('lead(comp) OVER w - comp', 'del_count')},
    {R('lead(comp / total) OVER w - comp / total', 'del_share')} FROM deg WINDOW w AS (PARTITION BY area, state ORDER BY yr)""",
)
def d18(spark, sf):
    rows = degrees.degree_changes(degree_rows(spark, sf), ["area", "state"], "yr", "comp", "total").drop("state")
    return rounded(rows, "comp", "total", "del_count", "del_share")


@query(
    "d18_cumulated_logs",
    f"""WITH {DEGREES}, y AS (SELECT state, yr, sum(comp) AS comp, sum(total) AS total FROM deg GROUP BY state, yr)
    SELECT state, {R('ln(b.comp + 1)', 'comp_base')}, {R('ln(b.total + 1)', 'total_base')}, {R('ci', 'comp_int')}, {R('ti', 'total_int')} FROM y b
    JOIN (SELECT state, sum(ln(comp + 1)) AS ci, sum(ln(total + 1)) AS ti FROM y WHERE yr > 1995 GROUP BY state) USING (state) WHERE b.yr = 1995""",
)
def d18_logs(spark, sf):
    rows = degrees.cumulated_logs(degree_rows(spark, sf), ["state"], "yr", 1995, ["comp", "total"])
    return rounded(rows, "comp_base", "total_base", "comp_int", "total_int")


@query(
    "d18_yearly_logs",
    f"""WITH {DEGREES}, y AS (SELECT state, yr, ln(sum(comp) + 1) AS comp, ln(sum(total) + 1) AS total FROM deg GROUP BY state, yr)
    SELECT state, y.yr, {R('y.comp', 'comp')}, {R('y.total', 'total')}, {R('b.comp', 'comp_base')}, {R('b.total', 'total_base')}
    FROM y JOIN (SELECT state, comp, total FROM y WHERE yr = 1995) b USING (state)""",
)
def d18_yearly(spark, sf):
    rows = degrees.yearly_logs(degree_rows(spark, sf), ["state"], "yr", 1995, ["comp", "total"])
    return rounded(rows, "comp", "total", "comp_base", "total_base")


MOVERS = f"""{FACTS_FLOW}, ps AS (SELECT state AS place, yr, sum(wt * score) / sum(wt) AS x FROM persons GROUP BY 1, 2),
  zs AS (SELECT place, yr, (x - avg(x) OVER (PARTITION BY yr)) / stddev_samp(x) OVER (PARTITION BY yr) AS z FROM ps),
  mv AS (SELECT p.yr, p.origin, p.wage, p.coll, CASE WHEN p.state <> p.origin THEN 1 ELSE 0 END AS mig, z FROM persons p JOIN zs ON p.origin = place AND p.yr = zs.yr)"""


def movers(spark, sf, role="prev"):
    persons = facts_flow(spark, sf)
    scores = migration.place_scores(persons, "state", "yr", "score", "wt")
    return migration.mover_rows(persons, scores, "state", "yr", "state", "origin", role, F.col("coll"))


@query(
    "d19_move_rates",
    f"WITH {MOVERS} SELECT yr, origin, {R('any_value(z)', 'prev_exposure')}, {R('avg(mig)', 'mig')} FROM mv GROUP BY yr, origin",
)
def d19_rates(spark, sf):
    rates = migration.move_rates(movers(spark, sf), ["yr", "origin", "prev_exposure"])
    return rounded(rates, "prev_exposure", "mig")


@query(
    "d20_risk_return",
    f"""WITH {FACTS_JOB}, c AS (SELECT ind, avg(ln(wage)) AS m, stddev_samp(ln(wage)) AS s, sum(wt) AS total FROM persons WHERE wage > 0 GROUP BY ind)
    SELECT ind, {Rs('m s total')}, {R('m - avg(m) OVER ()', 'm_norm')} FROM c""",
)
def d20(spark, sf):
    return rounded(panels.risk_return(facts_job(spark, sf), "ind", "wage", "wt"), "m", "s", "total", "m_norm")


@query(
    "d20_mean_ratio",
    f"WITH {FACTS} SELECT {R('avg(wage) FILTER (WHERE coll) / avg(wage) FILTER (WHERE NOT coll)', 'mean_ratio')} FROM facts WHERE wage > 0",
)
def d20_ratio(spark, sf):
    classes = panels.risk_return(facts(spark, sf), "coll", "wage", "wt", logs=False)
    return rounded(panels.mean_ratio(classes, "coll", True, False), "mean_ratio")


METRICS = f"""{FACTS_JOB}, mw AS (SELECT p_brand AS ind, p_type AS major, count(*) AS n FROM part GROUP BY 1, 2),
  fr AS (SELECT ind, major, n / sum(n) OVER (PARTITION BY ind) AS frac FROM mw),
  alt AS (SELECT ind, sum(CASE WHEN major IN ('ECONOMY', 'PROMO') THEN frac ELSE 0 END) AS exp_alt FROM fr GROUP BY ind),
  metrics AS (SELECT area, yr, sum(wt * score) / sum(wt) AS exp, sum(wt * exp_alt) / sum(wt) AS exp_alt,
    sum(wt * wage) FILTER (WHERE coll) / sum(wt) FILTER (WHERE coll) AS w_col, sum(wt) AS working_age_pop,
    sum(CASE WHEN emp THEN wt ELSE 0 END) AS emp, sum(CASE WHEN disc <= 0.03::DOUBLE THEN wt ELSE 0 END) AS youth
    FROM persons JOIN alt USING (ind) WHERE yr IN (1995, 2001) GROUP BY area, yr)"""


def metrics(spark, sf):
    part_jobs = jobs(spark, sf)
    weights = part_jobs.groupBy("ind", F.col("occ").alias("major")).agg(F.count(F.lit(1)).alias("n"))
    totals = part_jobs.groupBy("ind").agg(F.count(F.lit(1)).alias("all"))
    weights = weights.join(totals, "ind").withColumn("frac", ratio("n", "all"))
    alt = exposure.share_scores(weights, "ind", "major", "frac", ["ECONOMY", "PROMO"], "exp_alt")
    persons = facts_job(spark, sf, ENDS).join(alt, "ind")
    return panels.two_period_metrics(
        persons, ["area", "yr"], "wt", "wage", {"exp": "score", "exp_alt": "exp_alt"}, F.col("coll"), F.col("emp"), F.col("disc") <= 0.03
    )


@query("d21_alternative_exposure", f"WITH {METRICS} SELECT area, yr, {Rs('exp exp_alt w_col working_age_pop emp youth')} FROM metrics")
def d21(spark, sf):
    names = ["exp", "exp_alt", "w_col", "working_age_pop", "emp", "youth"]
    return rounded(metrics(spark, sf).select("area", "yr", *names), *names)


@query(
    "d22_two_period_wide",
    f"""WITH {METRICS}, w AS (SELECT area, {", ".join(f"max({m}) FILTER (WHERE yr = {y}) AS {m}_{y}" for m in ("exp", "exp_alt", "w_col") for y in (1995, 2001))} FROM metrics GROUP BY area)
    SELECT area, {R('ln(w_col_2001) - ln(w_col_1995 * 172 / 82.4::DOUBLE)', 'del_w_col')}, {R('exp_2001 - exp_1995', 'del_exp')},
    {R('exp_alt_2001 - exp_alt_1995', 'del_exp_alt')} FROM w WHERE exp_1995 IS NOT NULL AND exp_2001 IS NOT NULL""",
)
def d22(spark, sf):
    wide = panels.two_period_wide(metrics(spark, sf), ["area"], "yr", 1995, 2001, ["exp", "exp_alt", "w_col"])
    return wide.select(
        "area", r(panels.real_log_change(wide, "w_col", 1995, 2001, 172 / 82.4)).alias("del_w_col"),
        r(F.col("exp_2001") - F.col("exp_1995")).alias("del_exp"), r(F.col("exp_alt_2001") - F.col("exp_alt_1995")).alias("del_exp_alt"),
    )


@query(
    "d23_age_panel",
    f"""WITH {FACTS}, p AS (SELECT area, yr, CASE WHEN disc <= 0.03::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS youth, sum(wt * score) / sum(wt) AS score, sum(wt) AS pop,
      sum(CASE WHEN emp THEN wt ELSE 0 END) / sum(wt) AS frac_emp FROM facts WHERE yr IN (1995, 2001) GROUP BY 1, 2, 3)
    SELECT area, yr, youth, {Rs('score pop frac_emp')}, {R('sum(score * pop) OVER a / sum(pop) OVER a', 'area_score')}, {R('sum(pop) OVER a', 'area_pop')},
    {R('lead(ln(score)) OVER (PARTITION BY area, youth ORDER BY yr) - ln(score)', 'del_score')} FROM p WINDOW a AS (PARTITION BY area, yr)""",
)
def d23(spark, sf):
    rows = facts(spark, sf, ENDS)
    out = panels.age_panel(rows, ["area"], "yr", F.col("disc") <= 0.03, "score", "wt", {"frac_emp": F.col("emp")})
    return rounded(out, "score", "pop", "frac_emp", "area_score", "area_pop", "del_score")


@query(
    "d24_industry_cells",
    f"""WITH {FACTS_JOB}, c AS (SELECT yr, area, ind, sum(wt) AS num, sum(wt * score) / sum(wt) AS score, sum(CASE WHEN coll THEN wt ELSE 0 END) / sum(wt) AS frac_col
      FROM persons WHERE emp AND yr IN (1995, 2001) GROUP BY yr, area, ind)
    SELECT yr, area, ind, frac_col > median(frac_col) OVER y + 1e-12 AS col_int, {R('num', 'num')},
    {R('lead(ln(num)) OVER (PARTITION BY area, ind ORDER BY yr) - ln(num)', 'del_emp')} FROM c WINDOW y AS (PARTITION BY yr)""",
)
def d24(spark, sf):
    rows = facts_job(spark, sf, ENDS).where("emp")
    cells = panels.industry_cells(rows, ["area"], "yr", "ind", "score", "wage", F.col("coll"), "wt")
    return rounded(cells.select("yr", "area", "ind", "col_int", "num", "del_emp"), "num", "del_emp")


@query(
    "a4_outcome_rates",
    f"""WITH {FACTS}, f AS (SELECT area, wt, CASE WHEN flag = 'R' THEN 1 WHEN flag = 'A' THEN 0 END AS o FROM facts)
    SELECT area, {R('sum(wt * o) / sum(wt)', 'rate')}, {R('sum(wt)', 'total')}, {R('sum(wt * o)', 'positive')} FROM f GROUP BY area""",
)
def outcome_rates(spark, sf):
    o = F.when(F.col("flag") == "R", 1.0).when(F.col("flag") == "A", 0.0)
    rows = facts(spark, sf).withColumn("o", o)
    return rounded(panels.outcome_rates(rows, ["area"], "o", "wt"), "rate", "total", "positive")


@query(
    "a6_mover_share",
    f"WITH {FACTS_FLOW} SELECT yr, {R('sum(CASE WHEN state <> origin THEN wt ELSE 0 END) / sum(wt)', 'mig_frac')} FROM persons GROUP BY yr",
)
def mover_share(spark, sf):
    moved = F.col("state") != F.col("origin")
    return rounded(migration.mover_share(facts_flow(spark, sf), "yr", "wt", moved), "mig_frac")
