"""Absorbed factors, families of models, many grouped logits and sparse cluster scores against dense fits."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.catalog import QUERIES, load_all
from panelmill.catalog.fits import degree_models, growth_designs
from panelmill.models.design import design, factor_levels
from panelmill.models.family import Block, fit_family
from panelmill.models.linear import fit_linear
from panelmill.models.logit import fit_logit
from panelmill.models.qr import fit_qr
from panelmill.models.within import fit_within, fit_within_family

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    n = 600
    x1, x2 = rng.normal(50, 10, n), rng.normal(0, 1, n)
    f = rng.integers(0, 12, n)
    g = (f + rng.integers(0, 5, n)) % 12
    c, k, w = rng.integers(0, 25, n), rng.integers(0, 3, n), rng.uniform(0.5, 3, n)
    y = 2 + 0.3 * x1 - 1.5 * x2 + 0.7 * f - 0.3 * g + rng.normal(0, 2, n)
    lost = lambda v, p: None if rng.uniform() < p else float(v)
    rows = [(lost(a, 0.05), lost(b, 0.05), float(2 * ff), lost(ww, 0.05), float(yy), float(yy + a), int(ff), lost(gg, 0.02), int(cc), int(kk))
            for a, b, ff, ww, yy, gg, cc, kk in zip(x1, x2, f, w, y, g, c, k)]
    return spark.createDataFrame(rows, "x1 double, x2 double, z double, w double, y double, y2 double, f long, g double, c long, k long").repartition(5).cache()


def close(a, b, tol=1e-8):
    return (a is None and b is None) or math.isclose(a, b, rel_tol=tol, abs_tol=1e-12)


def same_rows(got, want, keys, tol=1e-8):
    want = {tuple(r[k] for k in keys): r for r in want}
    assert want
    for r in got:
        other = want.pop(tuple(r[k] for k in keys))
        for name in ("estimate", "std_error", "p_value", "conf_low", "conf_high"):
            assert close(r[name], other[name], tol), (r, other)
    return want


@pytest.mark.parametrize("factors, cluster", [(["f"], None), (["f"], "c"), (["f", "g"], "c"), (["g", "c", "k"], None)])
def test_absorbed_factors_equal_dummies(frame, factors, cluster):
    d = design("y", "x1", "x2", weight="w")
    fit = fit_within(frame, d, factors, cluster=cluster)
    levels = {f: factor_levels(frame, f) for f in factors}
    dense = fit_linear(frame, design("y", "x1", "x2", weight="w", factors=levels), cluster=cluster)
    same_rows(fit.coefficients().collect(), dense.coefficients(terms=["x1", "x2"]).collect(), ["term"])
    assert fit.summary().first()["rank"] == dense.summary().first()["rank"]


def test_effects_of_levels_equal_dummies(frame):
    fit = fit_within(frame, design("y", "x1", "x2"), ["f"])
    dense = {r.term: r.estimate for r in fit_linear(frame, design("y", "x1", "x2", factors={"f": factor_levels(frame, "f")})).coefficients().collect()}
    for r in fit.effects("f").collect():
        assert close(r.effect, dense["(Intercept)"] + dense.get(f"f={r.f}", 0.0))
    two = fit_within(frame, design("y", "x1", "x2"), ["f", "g"])
    beta = {r.term: r.estimate for r in two.coefficients().collect()}
    rows = frame.dropna(subset=["x1", "x2", "g"]).join(two.effects("f").withColumnRenamed("effect", "ef"), "f").join(two.effects("g").withColumnRenamed("effect", "eg"), "g")
    gap = F.col("y") - F.col("ef") - F.col("eg") - F.col("x1") * beta["x1"] - F.col("x2") * beta["x2"]
    row = rows.agg(F.sum(gap).alias("a"), F.sum(gap * F.col("x1")).alias("b")).first()
    assert abs(row["a"]) < 1e-6 and abs(row["b"]) < 1e-4


def test_terms_that_factors_explain_are_reported_empty(frame):
    got = {r.term: r.estimate for r in fit_within(frame, design("y", "x1", "z"), ["f"]).coefficients().collect()}
    assert got["z"] is None and got["x1"] is not None


def test_unconnected_levels_cost_a_degree_each(spark):
    rows = [(float(i), float(i % 5), i % 4, 10 * (i % 4 // 2) + i % 3) for i in range(48)]
    df = spark.createDataFrame(rows, "y double, x double, f long, g long")
    # Two sets of levels: (0, 1) with (0, 1, 2) and (2, 3) with (10, 11, 12).
    assert fit_within(df, design("y", "x"), ["f", "g"]).absorbed.rank == 4 + 6 - 2


def test_two_factors_of_ten_thousand_levels(spark):
    rng = np.random.default_rng(11)
    n, size = 60_000, 10_000
    f, g, c = rng.integers(0, size, n), rng.integers(0, size, n), rng.integers(0, 200, n)
    x = rng.normal(0, 1, n) + 0.01 * (f % 7)
    y = 1.5 * x + 0.1 * (f % 11) - 0.2 * (g % 5) + rng.normal(0, 1, n)
    v = np.stack([x, y])
    for _ in range(200):
        for at in (f, g):
            counts = np.maximum(np.bincount(at, minlength=size), 1)
            v = v - np.stack([np.bincount(at, weights=col, minlength=size) / counts for col in v])[:, at]
    beta = (v[0] @ v[1]) / (v[0] @ v[0])
    u = np.bincount(c, weights=v[0] * (v[1] - beta * v[0]))
    df = spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "f": f, "g": g, "c": c}))
    fit = fit_within(df, design("y", "x"), ["f", "g"], cluster="c")
    row = fit.coefficients().first()
    rank = 1 + fit.absorbed.rank
    error = math.sqrt(len(u) / (len(u) - 1) * (n - 1) / (n - rank) * (u @ u)) / (v[0] @ v[0])
    assert close(row["estimate"], beta, 1e-9) and close(row["std_error"], error, 1e-8)
    root = list(range(2 * size))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in zip(f.tolist(), g.tolist()):
        root[find(a)] = find(size + b)
    sets = len({find(a) for a in f.tolist()})
    assert fit.absorbed.rank == len(set(f.tolist())) + len(set(g.tolist())) - sets


def test_absorbed_family_equals_single_fits(frame):
    rows = frame.dropna(subset=["x1", "x2", "g"])
    models = {"a": design("y", "x1"), "b": design("y2", "x1", "x2")}
    got = fit_within_family(rows, models, ["f", "g"], cluster="c").collect()
    for name, d in models.items():
        single = fit_within(rows, d, ["f", "g"], cluster="c").coefficients().collect()
        assert not same_rows([r for r in got if r.model == name], single, ["term"])


MODELS = {"a": design("y", "x1", "x2", weight="w"), "b": design("y2", "x1*x2"), "c": design("y", "x1"), "d": design("y2", "x2", "w", "z", weight="w")}


@pytest.mark.parametrize("how", [{}, {"cluster": "c"}, {"by": ["k"]}])
def test_family_equals_single_fits(frame, how):
    got = fit_family(frame, MODELS, **how).collect()
    keys = [*how.get("by", []), "term"]
    for name, d in MODELS.items():
        assert not same_rows([r for r in got if r.model == name], fit_linear(frame, d, **how).coefficients().collect(), keys)


def test_combinations_use_the_joint_covariance(frame):
    d = design("y", "x1*x2", weight="w")
    sums = {"at two": {"x1": 1.0, "x1:x2": 2.0}, "gap": {"x1": 1.0, "x2": -1.0}}
    moved = frame.withColumn("x2", F.col("x2") - 2)
    for how in ({}, {"cluster": "c"}, {"by": ["k"]}):
        got = fit_linear(frame, d, **how).combinations(sums).collect()
        keys = [*how.get("by", []), "term"]
        assert not same_rows(got, fit_family(frame, {"m": d}, combinations=sums, **how).collect(), keys)
        # At a shifted regressor the effect is a plain coefficient.
        plain = {tuple(r[k] for k in keys[:-1]): r for r in fit_linear(moved, d, **how).coefficients(terms=["x1"]).collect()}
        for r in got:
            if r.term == "at two":
                other = plain[tuple(r[k] for k in keys[:-1])]
                assert close(r.estimate, other.estimate, 1e-7) and close(r.std_error, other.std_error, 1e-7) and close(r.conf_high, other.conf_high, 1e-6)


def test_family_keeps_digits_far_from_zero(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 300)
    rows = [(float(v + 1e8), float(3 * v + rng.normal(0, 0.1))) for v in x]
    df = spark.createDataFrame(rows, "x double, y double").repartition(7)
    got = {r.term: r.estimate for r in fit_family(df, {"m": design("y", "x")}).collect()}
    a = np.array(rows)
    shifted = a[:, 0] - 1e8
    assert close(got["x"], np.polyfit(shifted, a[:, 1], 1)[0], 1e-7)


@pytest.mark.parametrize("how", [{}, {"by": ["k"]}])
def test_qr_equals_squared_sums_where_these_can(frame, how):
    d = design("y", "x1*x2", weight="w")
    keys = [*how.get("by", []), "term"]
    assert not same_rows(fit_qr(frame, d, **how).collect(), fit_linear(frame, d, **how).coefficients().collect(), keys)


def test_qr_keeps_nearly_collinear_columns(spark):
    rng = np.random.default_rng(9)
    x1, gap = rng.normal(0, 1, 2000), rng.normal(0, 1, 2000)
    x2 = x1 + 1e-6 * gap
    y = 1 + 2 * x1 + 3e5 * (x2 - x1) + rng.normal(0, 1e-3, 2000)
    df = spark.createDataFrame(pd.DataFrame({"x1": x1, "x2": x2, "z": x1 + 1e-10 * gap, "y": y})).repartition(9)
    got = {r.term: r for r in fit_qr(df, design("y", "x1", "x2", "z")).collect()}
    x = np.column_stack([np.ones(2000), x1, x2 - x1])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    assert got["z"].estimate is None
    assert close(got["x2"].estimate, beta[2], 1e-7) and close(got["x1"].estimate, beta[1] - beta[2], 1e-7)
    rest = y - x @ beta
    assert close(got["x2"].std_error, math.sqrt(rest @ rest / 1997 * np.linalg.inv(x.T @ x / np.outer([1, 1, 1e-6], [1, 1, 1e-6]))[2, 2]) * 1e6, 1e-5)


def test_blocks_add_up():
    rng = np.random.default_rng(3)
    x, w = rng.normal(5, 2, (100, 4)), rng.uniform(0, 1, (100, 2))
    whole, halves = Block.of(x, w), Block.of(x[:31], w[:31]).plus(Block.of(x[31:], w[31:]))
    assert np.allclose(whole.cross, halves.cross) and np.allclose(whole.mean, halves.mean) and whole.n == halves.n
    again = Block.from_flat(whole.flat(), 4, 2)
    assert np.array_equal(again.cross, whole.cross) and np.array_equal(again.weight, whole.weight)


def test_families_of_many_models_scan_once(spark, frame):
    plan = fit_family(frame.where("x1 is not null"), MODELS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1
    assert len(degree_models()) == 10 and len(growth_designs()) == 20


def test_empty_family_gives_no_rows(spark, frame):
    assert fit_family(frame.where("1 = 0"), MODELS).count() == 0


def test_twenty_thousand_logits(spark):
    groups, each = 20_000, 12
    df = spark.range(groups * each).select(
        (F.col("id") % groups).alias("k"), (F.floor(F.col("id") / groups) % 2).cast("double").alias("x"),
        F.when(F.pmod(F.xxhash64("id"), F.lit(3)) == 0, 1.0).otherwise(0.0).alias("b"),
    )
    fit = fit_logit(df, design("b", "x"), by=["k"], patterns=True, max_iter=12)
    cells = df.groupBy("k").agg(*[F.sum(((F.col("x") == i) & (F.col("b") == j)).cast("double")).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)])
    slope = F.log(F.col("n11") * F.col("n00") / (F.col("n10") * F.col("n01")))
    inner = cells.where("n00 > 0 and n01 > 0 and n10 > 0 and n11 > 0").select("k", slope.alias("b"), F.sqrt(1 / F.col("n00") + 1 / F.col("n01") + 1 / F.col("n10") + 1 / F.col("n11")).alias("s"))
    both = fit.coefficients(terms=["x"]).join(inner, "k")
    row = both.agg(F.count("*").alias("n"), F.max(F.abs(F.col("estimate") - F.col("b"))).alias("a"), F.max(F.abs(F.col("std_error") - F.col("s"))).alias("e")).first()
    assert row["n"] > 10_000 and row["a"] < 1e-8 and row["e"] < 1e-8
    summary = fit.summary()
    assert summary.count() == groups
    assert summary.join(inner, "k").where("not converged or separable").count() == 0


def test_grouped_logit_equals_single_ones(frame):
    rows = frame.withColumn("b", (F.col("y") > 17).cast("double"))
    d = design("b", "x1", "x2", factors={"c5": [0, 1, 2]})
    rows = rows.withColumn("c5", F.col("c") % 3)
    grouped = fit_logit(rows, d, by=["k"], cluster="c")
    got = grouped.coefficients().collect()
    scored = grouped.predict(rows, "p")
    for level in (0, 1, 2):
        one = rows.where(F.col("k") == level)
        single = fit_logit(one, d, cluster="c")
        same_rows([r for r in got if r.k == level], single.coefficients().collect(), ["term"], 1e-7)
        a = scored.where(F.col("k") == level).agg(F.sum("p").alias("s")).first()["s"]
        assert close(a, single.predict(one, "p").agg(F.sum("p").alias("s")).first()["s"], 1e-8)


def test_null_group_is_fitted_too(spark):
    rows = [(None if i % 2 else 1, float(i % 3), float((i * 7) % 5 > 2)) for i in range(120)]
    fit = fit_logit(spark.createDataFrame(rows, "k int, x double, b double"), design("b", "x"), by=["k"])
    assert {r.k for r in fit.coefficients().collect()} == {None, 1}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
def test_registered_families_scan_their_rows_once(spark):
    load_all()
    text = QUERIES["m5_degree_models"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInPandas") == 1
