"""The table solver reaches the joint solver's optimum, in every family and with every kind of term."""

import numpy as np
import pytest

from ratecraft.operators import solve
from ratecraft.plans.plan import Plan


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(1500):
        a = int(rng.integers(0, 4))
        b = a if rng.random() < 0.93 else int(rng.integers(0, 4))  # nearly aliased with a
        c, x = int(rng.integers(0, 3)), float(rng.integers(1, 13))
        mu = np.exp(0.3 * a - 0.2 * c + 0.05 * x)
        rows.append((f"a{a}", f"b{b}", f"c{c}", x, float(rng.poisson(mu)), float(rng.gamma(2, mu / 2)) + 1e-3, float(rng.random() < mu / (1 + mu)), float(rng.uniform(0.5, 2))))
    return spark.createDataFrame(rows, "a string, b string, c string, x double, n double, g double, z double, w double")


PLANS = {
    "poisson": (lambda: Plan("poisson", "w", "weight"), "n"), "gamma": (lambda: Plan("gamma", "w", "weight"), "g"), "tweedie": (lambda: Plan("tweedie", "w", "weight"), "n"),
    "gaussian": (lambda: Plan("gaussian", "w", "weight"), "g"), "binomial": (lambda: Plan("binomial", "w", "weight"), "z"), "offset": (lambda: Plan("poisson", "w", "offset"), "n"),
}


@pytest.mark.parametrize("kind", PLANS)
@pytest.mark.parametrize("jointly,accelerate", [(True, True), (False, True), (True, False)])
def test_sweeps_equal_joint_steps(df, kind, jointly, accelerate):
    plan, target = PLANS[kind][0]().categorical("a").categorical("b").categorical("c").banded("x", breaks=[3, 6, 9]), PLANS[kind][1]
    options = dict(check=False, compute_standard_errors=False, max_iterations=2000)
    one = plan.fit(df, target, **options)
    two = plan.fit(df, target, solver="table", solve_aliased_pairs_jointly=jointly, accelerate=accelerate, **options)
    assert one.converged and two.converged and one.solver_used == "global" and two.solver_used == "table"
    for s, t in zip(one.model.tables, two.model.tables):
        np.testing.assert_allclose(s.factors, t.factors, atol=2e-6)


def test_sweeps_take_curves_bounds_and_penalties(df):
    options = dict(check=False, compute_standard_errors=False, max_iterations=500)
    for plan, more in (
        (Plan.frequency("w").categorical("c").variate("x", breaks=list(range(1, 12)), degree=2), {}),
        (Plan.frequency("w").categorical("c").monotone("x", "increasing", breaks=[2, 4, 6, 8]), {}),
        (Plan.frequency("w").categorical("c").spline("x", quantile=4), {}),
        (Plan.frequency("w").categorical("a").categorical("c"), {"alpha": 0.05, "l1_ratio": 0.5}),
        (Plan.frequency("w").categorical("a").categorical("c"), {"alpha": 0.05}),
    ):
        one, two = plan.fit(df, "n", **options, **more), plan.fit(df, "n", solver="table", **options, **more)
        assert two.converged and two.solver_used == "table"
        for s, t in zip(one.model.tables, two.model.tables):
            np.testing.assert_allclose(s.factors, t.factors, atol=5e-6)


def test_many_parameters_go_table_by_table(df, monkeypatch):
    plan = Plan.frequency("w").categorical("a").categorical("c")
    assert plan.fit(df, "n", check=False, compute_standard_errors=False).solver_used == "global"
    monkeypatch.setattr(solve, "MOST_JOINT", 2)
    assert plan.fit(df, "n", check=False, compute_standard_errors=False).solver_used == "table"


def test_rows_without_claims_step_down(df):
    from pyspark.sql import functions as F

    none = df.withColumn("n", F.when(F.col("c") == "c1", 0.0).otherwise(F.col("n")))
    fitted = Plan.frequency("w").categorical("c", base="c0").fit(none, "n", check=False, compute_standard_errors=False, solver="table", max_iterations=4)
    t = fitted.rating_tables_by_name()["c"].set_index("c_Level")
    assert t.loc["c1", "Coefficient"] <= solve.EMPTY_STEP + 3 and np.isfinite(t["Coefficient"]).all()
