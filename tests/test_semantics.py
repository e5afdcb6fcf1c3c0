"""Null, infinity, tie and edge behaviour on hand-made frames."""

import math

import pytest
from pyspark.sql import functions as F

from panelmill import session
from panelmill.functions import classes, codes, safe, weighted
from panelmill.operators import allocation, joins, panel, scaling
from panelmill.operators.quantiles import exact_quantiles, interval_index, quantile_bins
from panelmill.operators.reshape import melt, widen
from panelmill.plans import did, migration, panels
from panelmill.sources import tables


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_strict_and_skipping_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", None, 3.0), ("b", 4.0, 5.0)], "g string, x double, w double")
    out = df.groupBy("g").agg(
        F.sum("x").alias("skip"), safe.strict(F.sum, "x").alias("strict"),
        weighted.wmean("x", "w").alias("m"), weighted.wmean("x", "w", strict=True).alias("ms"),
    )
    assert rows(out, "g") == [("a", 1.0, None, 2.0 / 5.0, None), ("b", 4.0, 4.0, 4.0, 4.0)]


def test_logs_outside_the_reals_are_null(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (1, 2, math.e), (1, 3, -1.0), (1, 4, 1.0)], "k int, t int, x double")
    out = panel.log_change_next(df, ["k"], "t", d="x")
    assert [r["d"] for r in out.orderBy("t").collect()] == [None, None, None, None]
    out = panel.log_change_next(df.where("x > 0"), ["k"], "t", d="x")
    assert [r["d"] for r in out.orderBy("t").collect()] == [-1.0, None]


def test_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (2, 1.0, 2.0), (3, 0.0, 0.0)], "k int, num double, den double")
    assert rows(df.select("k", safe.ratio("num", "den")), "k") == [(1, None), (2, 0.5), (3, None)]
    grown = panel.growth_prev(df.withColumn("e", F.lit(1)), ["e"], "k", g="den")
    assert [r["g"] for r in grown.orderBy("k").collect()] == [None, None, -1.0]


def test_postal_codes(spark):
    df = spark.createDataFrame([(1, "12345"), (2, "123456789"), (3, "abc"), (4, None), (5, "00501")], "k int, z string")
    assert rows(df.select("k", codes.zip5("z")), "k") == [(1, 12345), (2, 12345), (3, None), (4, None), (5, 501)]


def test_area_codes(spark):
    df = spark.createDataFrame([(1001,), (56045,)], "c int")
    out = df.select("c", codes.state_part("c"), codes.area_part("c"), codes.padded_area(codes.state_part("c"), codes.area_part("c")))
    assert rows(out, "c") == [(1001, 1, 1, "01001"), (56045, 56, 45, "56045")]


def test_income_text(spark):
    text = ["$10,000-14,999", "$150,000 or more", "Less than $6,000", "refused", None]
    df = spark.createDataFrame(list(enumerate(text)), "k int, t string")
    got = [v for _, v in rows(df.select("k", codes.open_range_mean("t")), "k")]
    assert got == [12499.5, 225000.0, 3000.0, None, None]


def test_ladder_first_rule_wins_and_null_stays_null(spark):
    df = spark.createDataFrame([(5,), (32,), (33,), (999,), (None,)], "x int")
    out = df.select("x", codes.threshold_ladder("x", [(32, "a"), (50, "b")], "c"))
    assert set(map(tuple, out.collect())) == {(5, "a"), (32, "a"), (33, "b"), (999, "c"), (None, None)}


def test_not_in_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert {r[0] for r in df.where(safe.not_in("x", ["a"])).collect()} == {"b", None}


def test_bin_edges_with_and_without_clamp(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "x double")
    assert rows(quantile_bins(df, "x", 4, "b"), "x") == [(1.0, 1), (2.0, 2), (4.0, 3), (8.0, 5)]
    assert rows(quantile_bins(df, "x", 4, "b", clamp_top=True), "x")[-1] == (8.0, 4)
    tie = df.select("x", interval_index("x", F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0), F.lit(8.0))).alias("i"))
    assert rows(tie, "x") == [(1.0, 1), (2.0, 3), (4.0, 3), (8.0, 4)]


def test_single_row_group_has_no_deviation(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0)], "g string, x double")
    z = {(r["g"], r["x"]): r["z"] for r in scaling.zscore(df, ["g"], z="x").collect()}
    assert z[("a", 1.0)] is None and abs(z[("b", 4.0)] - 1 / math.sqrt(2)) < 1e-12


def test_group_statistics_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, x double")
    out = scaling.share_of_total(df, "x", ["g"], "s")
    assert {(r["g"], r["x"], r["s"]) for r in out.collect()} == {(None, 1.0, 0.25), (None, 3.0, 0.75), ("a", 5.0, 1.0)}


def test_null_keys(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, u int")
    b = spark.createDataFrame([(None, 3), ("x", 4)], "k string, v int")
    assert joins.merge(a, b, ["k"]).count() == 1
    assert joins.null_safe_merge(a, b, ["k"]).count() == 2


def test_merge_suffixes_and_full_keys(spark):
    a = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    b = spark.createDataFrame([(2, 30), (3, 40)], "k int, v int")
    out = joins.merge(a, b, ["k"], "full", ("_1980", "_2000"))
    assert out.columns == ["k", "v_1980", "v_2000"]
    assert rows(out, "k") == [(1, 10, None), (2, 20, 30), (3, None, 40)]


def test_missing_base_period_is_null(spark):
    df = spark.createDataFrame([("a", 1980, 1.0), ("a", 2000, 2.0), ("b", 2000, 3.0)], "e string, t int, x double")
    out = panel.attach_base(df, ["e"], "t", 1980, b="x")
    assert rows(out, "e", "t") == [("a", 1980, 1.0, 1.0), ("a", 2000, 2.0, 1.0), ("b", 2000, 3.0, None)]


def test_equal_neighbour_sizes_count_once(spark):
    m = spark.createDataFrame([(2, "k", 5.0, 100.0), (3, "k", 7.0, 100.0)], "area int, kind string, num double, pop double")
    e = spark.createDataFrame([(1, 2), (1, 3)], "area int, adj int")
    run = lambda **kw: allocation.neighbour_totals(m, e, ["area"], ["adj"], "kind", "num", "pop", **kw).first()
    assert run()["pop_adj"] == 100.0 and run()["num_adj"] == 12.0
    assert run(distinct_sizes=False)["pop_adj"] == 200.0
    open_end = e.union(spark.createDataFrame([(1, 9)], e.schema))
    strict = allocation.neighbour_totals(m, open_end, ["area"], ["adj"], "kind", "num", "pop")
    assert {r["pop_adj"] for r in strict.collect()} == {None}


def test_allocation_keeps_totals_of_placed_units(spark):
    m = spark.createDataFrame([(1, "x", 6.0), (1, "x", 3.0), (2, "x", 5.0), (3, "x", 9.0)], "unit int, kind string, num double")
    places = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 10)], "unit int, county int")
    out = allocation.allocate(m, places, "unit", "num", ["county"], ["kind"])
    # The row count of unit 1 is 2 measures x 3 counties, as in a division after the join.
    assert rows(out, "county") == [(10, "x", 9.0 * 1 / 6 + 5.0), (11, "x", 1.5), (12, "x", 1.5)]
    once = m.groupBy("unit", "kind").agg(F.sum("num").alias("num"))
    total = allocation.allocate(once, places, "unit", "num", ["county"], ["kind"]).agg(F.sum("num")).first()[0]
    assert abs(total - 14.0) < 1e-12


def test_prefix_fallback(spark):
    scores = spark.createDataFrame([("111111", 1.0), ("222221", 2.0), ("222222", 4.0)], "code string, score double")
    links = spark.createDataFrame([("111111", 7), ("222229", 8), ("333330", 9), (None, 1)], "code string, target int")
    out = joins.crosswalk_scores(scores, links, "code", "score", "target")
    assert rows(out, "target") == [(7, 1.0), (8, 3.0)]


def test_ties_at_the_maximum_stay(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 4), ("b", 4, 1)], "g string, k int, x int")
    assert [r["k"] for r in scaling.keep_max(df, "x", ["g"]).orderBy("k").collect()] == [1, 2, 4]


def test_pivot_names_and_unpivot(spark):
    df = spark.createDataFrame([(1, 1980, 1.0, 2.0), (1, 2000, 3.0, 4.0)], "k int, t int, u double, v double")
    wide = widen(df, ["k"], "t", [1980, 2000], ["u", "v"])
    assert set(wide.columns) == {"k", "u_1980", "v_1980", "u_2000", "v_2000"}
    assert wide.first()["v_2000"] == 4.0
    assert melt(df, ["k", "t"], ["u", "v"]).count() == 4


def test_interpolation_fills_gaps_only(spark):
    df = spark.createDataFrame([(1, None), (2, 2.0), (3, None), (5, 8.0), (6, None)], "t int, x double").withColumn("e", F.lit(1))
    out = panel.interpolate(df, ["e"], "t", y="x")
    assert [r["y"] for r in out.orderBy("t").collect()] == [None, 2.0, 4.0, 8.0, None]


def test_occurrence_numbers_span_slices(spark):
    df = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 3)], "k string, t int")
    out = panel.occurrence(df, ["k"], ["t"], "n", F.floor(F.col("t") / 7))
    assert [r["n"] for r in out.where("k = 'a'").orderBy("t").collect()] == list(range(1, 21))


def test_net_migration_sums_to_zero(spark):
    data = [(1980, d, o, 1.0 + d + 2 * o, 0.1 * d) for d in range(4) for o in range(4)]
    df = spark.createDataFrame(data, "t int, d int, o int, w double, s double")
    out = migration.net_migration(df, "t", "d", "o", "w", "s", 1980)
    assert abs(out.agg(F.sum("net")).first()[0]) < 1e-9


def test_difference_in_differences(spark):
    data = [(a, p, y, 0.5) for a in (True, False) for p in (0, 1) for y in ([1.0, 0.0] if a and p else [0.0, 0.0])]
    df = spark.createDataFrame(data, "a boolean, p int, y double, pre double")
    out = did.difference_in_differences(did.group_differences(df, F.col("a"), "p", "y", "pre"), "p")
    assert rows(out.select("p", "diff_diff"), "p") == [(0, 0.0), (1, 0.5)]


def test_year_bins_and_names(spark):
    assert rows(tables.year_bins(spark, 2009, 2, 5), "year")[4:6] == [(2013, 1, 5), (2014, 2, 1)]
    assert tables.plain_name("Scale ID*x") == "Scale.ID.x" and tables.plain_name("2a") == "X2a"


def test_csv_round_trip_with_missing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "k int, s string, x double")
    path = str(tmp_path / "out")
    tables.export_csv(df, path)
    assert rows(tables.read_csv(spark, path, df.schema), "k") == [(1, "a", 1.5), (2, None, None)]


def test_panel_weighted_shares_match_means(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (1, 1.0, 0.0), (2, 3.0, 1.0)], "g int, w double, f double")
    out = panels.weighted_panel(df, ["g"], "w", {"m": "f"}, {"s": F.col("f") == 1}, {"n": None})
    assert rows(out, "g") == [(1, 2 / 3, 2 / 3, 3.0), (2, 1.0, 1.0, 3.0)]


def test_quantile_of_empty_and_null_groups(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("b", 2.0)], "g string, x double")
    ranked = exact_quantiles(df, "x", [0.5], ["g"])
    assert {r["g"]: r["quantiles"] for r in ranked.collect()} == {"b": [1.5]}


def test_standing_classes(spark):
    df = spark.createDataFrame([(10,), (391,), (392,), (393,), (940,), (0,), (999,), (None,)], "i int")
    got = {r[0]: r[1] for r in df.select("i", classes.broad_industry("i")).collect()}
    assert got == {10: "Agg", 391: "MANUFACTURING", 392: "MANUFACTURING", 393: "Transportation", 940: "Military", 0: None, 999: None, None: None}
    flags = df.where("i = 391").withColumns(classes.sector_flags("i")).first()
    assert (flags["man_con"], flags["trade"]) == (1.0, 0.0)
    school = spark.createDataFrame([(73,), (100,), (111,)], "e int").select("e", classes.schooling("e"))
    assert rows(school, "e") == [(73, "No College"), (100, "Some College"), (111, "College")]
    degree = spark.createDataFrame([(6, 24), (10, 0), (10, 24), (10, 60)], "e int, f int")
    assert rows(degree.select("f", "e", classes.degree_type("e", "f")), "f", "e")[1:] == [(24, 6, "no_college"), (24, 10, "STEM"), (60, 10, "not_STEM")]
    assert classes.grade_points(spark).count() == 11
    years = spark.createDataFrame([(1975,), (1990,), (2000,), (2005,)], "p int").select("p", classes.census_year("p"))
    assert rows(years, "p") == [(1975, 1980), (1990, 1990), (2000, 2000), (2005, 2010)]
    moved = spark.createDataFrame([(1, 2), (1, 1), (99, 2)], "o int, r int").where(classes.moved_between_states("o", "r"))
    assert moved.count() == 1


def test_package_is_sent_to_workers(spark):
    import zipfile

    from panelmill.session import ship

    names = zipfile.ZipFile(ship(spark)).namelist()
    assert "panelmill/models/linear.py" in names and "panelmill/session.py" in names


def test_staged_tables_can_be_cleared(spark):
    import os

    from panelmill.session import clear_staged, shared_folder, staged

    assert staged(spark.range(3)).count() == 3
    folder = f"{shared_folder(spark)}/panelmill/{spark.sparkContext.applicationId}".removeprefix("file:")
    assert os.listdir(folder)
    clear_staged(spark)
    assert not os.path.exists(folder)


def test_staged_tables_leave_no_shuffle_and_can_be_discarded(spark, tmp_path):
    before = spark.conf.get(session.SHUFFLE_CLEANUP, "false")
    one = session.staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert spark.conf.get(session.SHUFFLE_CLEANUP, "false") == before
    two = session.staged(one.orderBy("k"))
    session.discard(one)
    assert two.count() == 7 and sum(r["count"] for r in two.collect()) == 1000
    spark.range(3).write.parquet(str(tmp_path / "kept"))
    with pytest.raises(ValueError):
        session.discard(spark.read.parquet(str(tmp_path / "kept")))
    session.discard(session.staged(spark.range(0)))
