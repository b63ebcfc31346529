"""Fits of more cells than the driver takes equal the others, and dense references."""

import math

import numpy as np
import pytest

from ratecraft.functions.splines import basis
from ratecraft.operators import cells
from ratecraft.plans.plan import Plan


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(21)
    rows = []
    for i in range(1200):
        a, b, x = int(rng.integers(0, 4)), int(rng.integers(0, 3)), float(rng.uniform(0, 10))
        mu = math.exp(0.2 * a - 0.3 * b + 0.1 * math.sin(x))
        rows.append((f"a{a}", f"b{b}", x, float(rng.poisson(mu)), float(rng.gamma(2, mu / 2)) + 1e-3, float(rng.random() < mu / (1 + mu)), float(rng.uniform(0.5, 2)), i % 40))
    return spark.createDataFrame(rows, "a string, b string, x double, n double, g double, z double, w double, c int").repartition(5)


CASES = [
    (lambda: Plan("poisson", "w", "weight"), "n", {}), (lambda: Plan("poisson", "w", "offset"), "n", {}), (lambda: Plan("gamma", "w", "weight"), "g", {}), (lambda: Plan("tweedie", "w", "weight"), "n", {}),
    (lambda: Plan("gaussian", "w", "weight"), "g", {}), (lambda: Plan("binomial", "w", "weight"), "z", {}), (lambda: Plan("poisson", "w", "weight"), "n", {"alpha": 0.05, "l1_ratio": 0.5}),
    (lambda: Plan("poisson", "w", "weight"), "n", {"normalization": "weighted_mean"}), (lambda: Plan("poisson", "w", "weight"), "n", {"covariance": "robust"}),
]


@pytest.mark.parametrize("plan,target,options", CASES)
def test_partitions_equal_cells(df, monkeypatch, plan, target, options):
    plan = plan().categorical("a").categorical("b").banded("x", breaks=[2, 5, 8])
    one = plan.fit(df, target, check=False, **options)
    monkeypatch.setattr(cells, "MAX_CELLS", 3)
    two = plan.fit(df, target, check=False, **options)
    assert one.converged and two.converged and two.solver_used == "partitions"
    for i, (s, t) in enumerate(zip(one.model.tables, two.model.tables)):
        np.testing.assert_allclose(s.factors, t.factors, atol=1e-8)
        np.testing.assert_allclose(one.inference.errors[i], two.inference.errors[i], rtol=1e-6, equal_nan=True)


def test_terms_of_every_kind(df, monkeypatch):
    monkeypatch.setattr(cells, "MAX_CELLS", 3)
    first = Plan.frequency("w").categorical("b").fit(df, "n", check=False, compute_standard_errors=False)
    plan = Plan.frequency("w").offset_model(first).categorical("a").variate("x", breaks=list(range(1, 10)), degree=2)
    two = plan.fit(df, "n", check=False)
    monkeypatch.setattr(cells, "MAX_CELLS", 10**6)
    one = plan.fit(df, "n", check=False)
    steps = Plan.frequency("w").categorical("a").monotone("x", "increasing", breaks=[2, 4, 6, 8])
    three = steps.fit(df, "n", check=False, compute_standard_errors=False)
    monkeypatch.setattr(cells, "MAX_CELLS", 3)
    four = steps.fit(df, "n", check=False, compute_standard_errors=False)
    for p, q in ((one, two), (three, four)):
        for s, t in zip(p.model.tables, q.model.tables):
            np.testing.assert_allclose(s.factors, t.factors, atol=1e-7)


def dense(df, knots, link):
    """Newton on whole rows for a spline and a factor."""
    rows = df.collect()
    x = np.array([r.x for r in rows])
    design = np.hstack([np.ones((len(rows), 1)), basis(np.array(knots), x)[:, 1:]])
    w = np.array([r.w for r in rows])
    beta = np.zeros(design.shape[1])
    for _ in range(60):
        if link == "log":
            y, mu = np.array([r.n for r in rows]), np.exp(design @ beta)
            score, weight = w * (y - mu), w * mu
        else:  # logit with log w as its offset
            y, eta = np.array([r.z for r in rows]), design @ beta + np.log(w)
            mu = 1 / (1 + np.exp(-eta))
            score, weight = y - mu, mu * (1 - mu)
        beta = beta + np.linalg.solve(design.T @ (weight[:, None] * design), design.T @ score)
    return beta


def test_continuous_splines_equal_dense_fits(df, monkeypatch):
    monkeypatch.setattr(cells, "MAX_CELLS", 100)
    knots = [0.5, 3.0, 6.0, 9.5]
    fitted = Plan.frequency("w").spline("x", knots=knots).fit(df, "n", check=False, tolerance=1e-13)
    assert fitted.solver_used == "partitions"
    got = np.r_[fitted.model.tables[0].factors, fitted.model.tables[1].factors[1:]]
    np.testing.assert_allclose(got, dense(df, knots, "log"), atol=1e-9)
    assert np.isfinite(fitted.inference.errors[1]).all()
    logit = Plan("binomial", "w", "offset").spline("x", knots=knots).fit(df, "z", check=False, tolerance=1e-13, compute_standard_errors=False)
    got = np.r_[logit.model.tables[0].factors, logit.model.tables[1].factors[1:]]
    np.testing.assert_allclose(got, dense(df, knots, "logit"), atol=1e-9)


def test_faults_are_found_in_many_cells(spark, df, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(cells, "MAX_CELLS", 3)
    plan = Plan.frequency("w").categorical("a").banded("x", breaks=[2, 5, 8])
    with pytest.raises(ValueError, match="null or not finite"):
        plan.fit(df.withColumn("n", F.when(F.col("n") > 0, F.col("n"))), "n", check=False)
    with pytest.raises(ValueError, match="match no row"):
        plan.fit(df.withColumn("x", F.when(F.col("c") > 0, F.col("x"))), "n", check=False)
