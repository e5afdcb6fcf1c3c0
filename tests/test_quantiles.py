"""Exact quantiles against numpy, on random and awkward data."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from panelmill.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.951, 1.0]


@pytest.mark.parametrize("size", [20, 10_000])
@pytest.mark.parametrize("kind", ["normal", "ties", "constant", "heavy"])
def test_matches_numpy(spark, monkeypatch, size, kind):
    monkeypatch.setattr("panelmill.operators.quantiles.RANGE_VALUES", size)
    rng = np.random.default_rng(1)
    x = {
        "normal": rng.normal(size=3000), "ties": rng.integers(0, 5, 3000).astype(float), "constant": np.full(500, 3.25),
        "heavy": np.exp(rng.normal(0, 4, 3000)),
    }[kind]
    g = np.where(rng.uniform(size=len(x)) < 0.7, 0, rng.integers(1, 6, len(x)))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x)], "g int, x double")
    got = {r["g"]: r["quantiles"] for r in exact_quantiles(df, "x", PROBS, ["g"]).collect()}
    for key in np.unique(g):
        assert np.allclose(got[key], np.quantile(x[g == key], PROBS), rtol=1e-12)
    whole = exact_quantiles(df, "x", PROBS).first()[0]
    assert np.allclose(whole, np.quantile(x, PROBS), rtol=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60))
def test_ranked_route_on_random_lists(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = exact_quantiles(df, "x", PROBS).first()[0]
    assert np.allclose(got, np.quantile(values, PROBS), rtol=1e-9, atol=1e-9)
