"""Moments and triangular factors against numpy, and fits of features that nearly agree."""

import numpy as np
import pandas as pd
import pytest

from moundworks.operators import factors, learn


def test_moments_of_many_columns_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1_200, 500)) * rng.uniform(0.1, 9, 500) + 1e4
    names = [f"c{i}" for i in range(500)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(7)
    found = factors.moments(df, names)[0]
    assert found[0, 0] == 1_200 and np.allclose(found[0, 1:], x.mean(0), rtol=1e-13)
    assert np.allclose(found[1:, 1:], np.cov(x.T, ddof=0) * 1_200, atol=1e-7)
    r = factors.factors(df, names)[0]
    whole = np.column_stack([np.ones(1_200), x])
    assert r.shape == (501, 501) and np.allclose(r.T @ r, whole.T @ whole, rtol=1e-11)


def test_groups_nulls_and_empty_tables(spark):
    rows = [(1, 1.0, 2), (1, 3.0, 4), (2, 5.0, 1), (1, None, 7), (2, float("nan"), 3), (None, 1.0, 1),
            (2, float("inf"), 2)]
    df = spark.createDataFrame(rows, "g int, x double, y int")
    found = factors.moments(df, ["x", "y"], by="g")
    assert set(found) == {1, 2}
    assert found[1].tolist() == [[2, 2, 3], [0, 2, 2], [0, 2, 2]] and found[2][0].tolist() == [1, 5, 1]
    nothing = df.where("false")
    assert factors.moments(nothing, ["x"]) == {} and factors.correlations(nothing, ["x", "y"]).count() == 0
    assert factors.least_squares(nothing, ["x"], "y").alpha is None
    assert factors.ridge_cv(nothing, ["x"], "y", ["g"]).alpha is None
    assert factors.principal_components(nothing, ["x", "y"], 1) is None


def test_components_equal_those_of_one_aggregation(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd"))).selectExpr("*", "0.1D AS flat")
    flat = factors.principal_components(df, [*"abcd", "flat"], 3)
    assert flat.deviations[4] == 0 and np.abs(flat.axes[4]).max() < 1e-12
    assert {r["correlation"] for r in factors.correlations(df, ["a", "flat", "b"]).collect() if "flat" in r[:2]} == {None}
    mine, other = (f(df, [*"abcd"], 3) for f in (factors.principal_components, learn.principal_components))
    assert np.allclose(mine.means, other.means) and np.allclose(mine.deviations, other.deviations)
    assert np.allclose(np.abs(mine.axes), np.abs(other.axes), atol=1e-9)


def test_features_that_nearly_agree_keep_their_digits(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=2_000)
    x = np.column_stack([a, a + 1e-7 * rng.normal(size=2_000)])
    y = x @ [2.0, 1.0] + 5
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y})).repartition(5)
    model = factors.least_squares(df, ["a", "b"], "y")
    best = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)[0]
    mine = np.abs(np.array(model.coefficients) - best).max()
    centred = np.column_stack([x, y]) - np.column_stack([x, y]).mean(0)
    normal, _ = learn._Moments(2_000.0, np.zeros(3), centred.T @ centred).solve(0.0)
    assert mine < 1e-5 < 1e-3 < np.abs(normal - best).max()
    assert model.intercept == pytest.approx(5, abs=1e-6)


def test_ridge_equals_that_of_normal_equations(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(503, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=503) * 3
    df = spark.createDataFrame(pd.DataFrame({"k": range(503), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}))
    df = df.selectExpr("k", "CASE WHEN k % 50 > 0 THEN a END AS a", "b", "c", "y").repartition(3)
    mine, other = (f(df, ["a", "b", "c"], "y", ["k"]) for f in (factors.ridge_cv, learn.ridge_cv))
    assert mine.alpha == other.alpha and mine.intercept == pytest.approx(other.intercept)
    assert mine.coefficients == pytest.approx(other.coefficients, rel=1e-9)
