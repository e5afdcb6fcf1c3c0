"""Regressions against numpy, Spark ML, closed forms and published quantiles."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from panelmill.models import algebra
from panelmill.models.design import design, design_all, factor_levels
from panelmill.models.linear import fit_linear, fit_lines
from panelmill.models.logit import fit_logit
from panelmill.plans import exposure
from panelmill.plans.regressions import effect_by_bin, sliding_windows


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    n = 600
    x1, x2 = rng.normal(50, 10, n), rng.normal(0, 1, n)
    f, c = rng.integers(0, 4, n), rng.integers(0, 25, n)
    w = rng.uniform(0.5, 3, n)
    y = 2 + 0.3 * x1 - 1.5 * x2 + 0.05 * x1 * x2 + 0.7 * f + rng.normal(0, 2, n)
    b = (rng.uniform(size=n) < 1 / (1 + np.exp(-(-2 + 0.04 * x1 - 0.6 * x2 + 0.2 * f)))).astype(float)
    return {"x1": x1, "x2": x2, "f": f, "c": c, "w": w, "y": y, "b": b}


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [tuple(float(data[k][i]) if k not in "fc" else int(data[k][i]) for k in data) for i in range(len(data["y"]))]
    return spark.createDataFrame(rows, "x1 double, x2 double, f long, c long, w double, y double, b double").repartition(5).cache()


def matrix(data, factor=True):
    cols = [np.ones_like(data["x1"]), data["x1"], data["x2"], data["x1"] * data["x2"]]
    if factor:
        cols += [(data["f"] == level).astype(float) for level in (1, 2, 3)]
    return np.column_stack(cols)


def table(df):
    return {r["term"]: r for r in df.collect()}


def test_weighted_factor_interaction_fit_with_clusters(frame, data):
    d = design("y", "x1*x2", factors={"f": factor_levels(frame, "f")}, weight="w")
    fit = fit_linear(frame, d, cluster="c")
    got = table(fit.coefficients())
    x, w, y = matrix(data), data["w"], data["y"]
    inv = np.linalg.inv(x.T @ (x * w[:, None]))
    beta = inv @ (x.T @ (w * y))
    u = (w * (y - x @ beta))[:, None] * x
    s = np.array([u[data["c"] == g].sum(axis=0) for g in np.unique(data["c"])])
    n, k, g = len(y), x.shape[1], len(s)
    cov = g / (g - 1) * (n - 1) / (n - k) * inv @ (s.T @ s) @ inv
    names = ["(Intercept)", "x1", "x2", "x1:x2", "f=1", "f=2", "f=3"]
    assert np.allclose([got[t]["estimate"] for t in names], beta, rtol=1e-8)
    assert np.allclose([got[t]["std_error"] for t in names], np.sqrt(np.diag(cov)), rtol=1e-7)
    summary = fit.summary().first()
    rss = (w * (y - x @ beta) ** 2).sum()
    tss = (w * (y - np.average(y, weights=w)) ** 2).sum()
    assert summary["n"] == n and summary["rank"] == k
    assert math.isclose(summary["sigma"], math.sqrt(rss / (n - k)), rel_tol=1e-8)
    assert math.isclose(summary["r_squared"], 1 - rss / tss, rel_tol=1e-8)


def test_grouped_fit_equals_separate_fits(frame):
    d = design("y", "x1", "x2")
    grouped = {(r["f"], r["term"]): r for r in fit_linear(frame, d, by=["f"], cluster="c").coefficients().collect()}
    for level in (0, 3):
        single = table(fit_linear(frame.where(F.col("f") == level), d, cluster="c").coefficients())
        for term, row in single.items():
            assert math.isclose(row["estimate"], grouped[(level, term)]["estimate"], rel_tol=1e-9)
            assert math.isclose(row["std_error"], grouped[(level, term)]["std_error"], rel_tol=1e-9)


def test_collinear_terms_are_dropped(frame):
    df = frame.withColumn("x3", 2 * F.col("x1"))
    got = table(fit_linear(df, design("y", "x1", "x3", "x2")).coefficients())
    plain = table(fit_linear(frame, design("y", "x1", "x2")).coefficients())
    assert got["x3"]["estimate"] is None and got["x3"]["std_error"] is None
    assert math.isclose(got["x1"]["estimate"], plain["x1"]["estimate"], rel_tol=1e-9)
    assert fit_linear(df, design("y", "x1", "x3", "x2")).summary().first()["rank"] == 3


def test_missing_rows_and_zero_weights_do_not_count(spark):
    rows = [(1.0, 1.0, 1.0), (2.0, 2.5, 1.0), (3.0, 2.9, 1.0), (None, 9.0, 1.0), (4.0, None, 1.0), (5.0, 50.0, 0.0)]
    df = spark.createDataFrame(rows, "x double, y double, w double")
    assert fit_linear(df, design("y", "x", weight="w")).summary().first()["n"] == 3
    assert fit_lines(df, "x", "y", weight="w").first()["n"] == 3


def test_small_fit_without_residual_freedom(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0)], "x double, y double")
    row = table(fit_linear(df, design("y", "x")).coefficients())["x"]
    assert math.isclose(row["estimate"], 2.0, rel_tol=1e-9) and row["std_error"] is None


def test_two_coefficient_cluster_sandwich(spark):
    rows = [(0, 1.0, 1.2), (0, 2.0, 1.9), (1, 3.0, 3.5), (1, 4.0, 3.6), (2, 5.0, 5.4), (2, 6.0, 5.5)]
    df = spark.createDataFrame(rows, "c int, x double, y double")
    x = np.column_stack([np.ones(6), [r[1] for r in rows]])
    y = np.array([r[2] for r in rows])
    inv = np.linalg.inv(x.T @ x)
    u = (y - x @ (inv @ x.T @ y))[:, None] * x
    s = np.array([u[0:2].sum(0), u[2:4].sum(0), u[4:6].sum(0)])
    cov = 3 / 2 * 5 / 4 * inv @ s.T @ s @ inv
    got = table(fit_linear(df, design("y", "x"), cluster="c").coefficients())["x"]
    assert math.isclose(got["std_error"], math.sqrt(cov[1, 1]), rel_tol=1e-9)
    assert math.isclose(got["p_value"], algebra.two_sided_p(got["statistic"], 4), rel_tol=1e-12)


def test_logit_equals_spark_ml(frame):
    got = table(fit_logit(frame, design("b", "x1", "x2", factors={"f": [0, 1, 2, 3]})).coefficients())
    dummies = frame.select("x1", "x2", "b", *[(F.col("f") == i).cast("double").alias(f"f{i}") for i in (1, 2, 3)])
    cols = ["x1", "x2", "f1", "f2", "f3"]
    ml = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="b", tol=1e-12, maxIter=50).fit(
        VectorAssembler(inputCols=cols, outputCol="features").transform(dummies)
    )
    names = ["x1", "x2", "f=1", "f=2", "f=3", "(Intercept)"]
    assert np.allclose([got[t]["estimate"] for t in names], [*ml.coefficients, ml.intercept], rtol=1e-6)
    assert np.allclose([got[t]["std_error"] for t in names], ml.summary.coefficientStandardErrors, rtol=1e-5)
    assert np.allclose([got[t]["p_value"] for t in names], ml.summary.pValues, atol=1e-6)


def test_logit_patterns_give_the_same_fit(frame):
    df = frame.withColumn("hi", (F.col("x1") > 50).cast("double"))
    d = design("b", "hi", factors={"f": [0, 1, 2, 3]})
    a = table(fit_logit(df, d, cluster="c").coefficients())
    b = table(fit_logit(df, d, cluster="c", patterns=True).coefficients())
    for term in a:
        assert math.isclose(a[term]["estimate"], b[term]["estimate"], rel_tol=1e-8)
        assert math.isclose(a[term]["std_error"], b[term]["std_error"], rel_tol=1e-8)


def test_grouped_logit_equals_separate_fits(frame):
    d = design("b", "x1")
    grouped = {(r["f"], r["term"]): r["estimate"] for r in fit_logit(frame, d, by=["f"]).coefficients().collect()}
    single = table(fit_logit(frame.where("f = 2"), d).coefficients())
    assert math.isclose(grouped[(2, "x1")], single["x1"]["estimate"], rel_tol=1e-8)


def test_separable_outcome_is_reported(spark):
    df = spark.createDataFrame([(float(i), float(i >= 5)) for i in range(10)], "x double, y double")
    row = fit_logit(df, design("y", "x")).summary().first()
    assert row["separable"] or not row["converged"]


def test_prediction_is_null_where_a_regressor_is_missing(spark, frame):
    fit = fit_logit(frame, design("b", "x2"))
    new = spark.createDataFrame([(0.0,), (None,)], "x2 double")
    p = {r["x2"]: r["p"] for r in fit.predict(new, "p").collect()}
    intercept = table(fit.coefficients())["(Intercept)"]["estimate"]
    assert p[None] is None and math.isclose(p[0.0], 1 / (1 + math.exp(-intercept)), rel_tol=1e-9)


def test_t_tails_match_published_values():
    for df, q in ((1, 12.7062), (4, 2.7764), (10, 2.2281), (30, 2.0423), (1000, 1.9623)):
        assert abs(algebra.critical_value(0.95, df) - q) < 1e-4
        assert abs(algebra.two_sided_p(q, df) - 0.05) < 1e-5
    assert abs(algebra.critical_value(0.95, None) - 1.959963984540054) < 1e-12
    assert abs(algebra.two_sided_p(1.0, 1) - 0.5) < 1e-12


def test_design_terms_and_dot_formula(frame):
    assert design("y", "a*b", "c", "b*c").names == ["(Intercept)", "a", "b", "c", "a:b", "b:c"]
    assert design_all(frame.select("y", "x1", "x2"), "y").terms == ("x1", "x2")


def test_factor_levels_are_bounded(frame):
    assert factor_levels(frame, "f") == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        factor_levels(frame, "c", limit=5)


def test_effect_by_bin_covers_only_numbered_bins(frame):
    df = frame.withColumn("bin", F.col("f") + 2)
    out = effect_by_bin(df, design("y", "x1"), "bin", 4, "x1")
    assert [r["bin"] for r in out.orderBy("bin").collect()] == [2, 3, 4]
    assert all(r["conf_low"] < r["estimate"] < r["conf_high"] for r in out.collect())


def test_boundary_years_fall_in_two_windows(spark):
    df = spark.createDataFrame([(y,) for y in range(1980, 2001)], "year int")
    got = {}
    for r in sliding_windows(df, "year", 1980, 6, 5, 4).collect():
        got.setdefault(r["year"], set()).add(r["window"])
    assert got[1985] == {1980, 1985} and got[1984] == {1980} and got[2000] == {1995}


def test_validation_replicates(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(i % 2), float(rng.normal(i % 2, 1))) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, y double, x double")
    out = exposure.validate_scores(df, "k", "y", ["x"], replicates=3, steps=200).collect()
    assert len(out) == 3 and all(0.6 < r["auc"] < 0.95 for r in out)


@pytest.mark.parametrize("base", [3e5, 1e6, 1e9])
def test_regressors_far_from_zero_are_kept(spark, base):
    y = [3.0, 5.5, 9.0, 13.2, 15.0, 18.9, 21.0, 25.5, 28.0, 31.1]
    near = spark.createDataFrame([(float(i), v, i % 2) for i, v in enumerate(y)], "x double, y double, g int")
    far = near.withColumn("x", F.col("x") + base)
    for cluster in (None, "g"):
        a, b = (fit_linear(df, design("y", "x"), cluster=cluster).coefficients(terms=["x"]).first() for df in (near, far))
        assert b.estimate == pytest.approx(a.estimate, rel=1e-9) and b.std_error == pytest.approx(a.std_error, rel=1e-6)
    line = fit_lines(far, "x", "y").first()
    assert line.slope == pytest.approx(fit_lines(near, "x", "y").first().slope, rel=1e-9)
    hit = near.withColumn("hit", (F.col("y") + 9 * F.col("g") > 17).cast("double"))
    a, b = (fit_logit(df, design("hit", "x")).coefficients(terms=["x"]).first() for df in (hit, hit.withColumn("x", F.col("x") + base)))
    assert b.estimate == pytest.approx(a.estimate, rel=1e-6)


def test_map_keys_are_padded_and_never_cut(spark):
    from panelmill.functions.codes import padded_area

    df = spark.createDataFrame([(1, 7), (12, 345), (101, 1234), (101, 1239)], "s int, a int")
    assert [r[0] for r in df.select(padded_area("s", "a")).collect()] == ["01007", "12345", "1011234", "1011239"]
