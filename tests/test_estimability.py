"""Contrasts that data can't tell apart, variate terms, reference rows and column statistics."""

import math

import numpy as np
import pytest

from ratecraft.functions import bands
from ratecraft.operators import scoring
from ratecraft.operators.inference import chi_square_tail
from ratecraft.plans.plan import Plan


def frame(spark, rows, names):
    kinds = {"y": "double", "w": "double", "x": "double"}
    return spark.createDataFrame(rows, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names.split()))


def two_factors(spark, seed=3, n=400):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        a, c = rng.choice(list("pqr")), rng.choice(list("st"))
        rows.append((float(rng.poisson(1.5)), 1.0, a, {"p": "k", "q": "l", "r": "m"}[a], c))
    return frame(spark, rows, "y w a b c")


def test_identical_tables_have_no_errors_and_no_tests(spark):
    df = two_factors(spark)
    fitted = Plan.frequency("w").categorical("a").categorical("b").categorical("c").fit(df, "y", check=False)
    status = dict(zip(fitted.table_names, fitted.inference.status))
    for name in "ab":
        assert status[name][0] == "reference" and status[name][1:] == ["aliased"] * 2
        assert np.isnan(fitted.rating_tables_by_name()[name]["Standard_Error"][1:]).all()
    assert status["c"] == ["reference", "estimated"] and status["intercept"] == ["estimated"]
    tests = fitted.term_tests().set_index("term")
    assert list(tests.loc[["a", "b"], "reason"]) == ["aliased"] * 2 and tests.loc["c", "reason"] is None
    alone = Plan.frequency("w").categorical("a").categorical("c").fit(df, "y", check=False)
    same = alone.term_tests().set_index("term")
    assert tests.loc["c", "statistic"] == pytest.approx(same.loc["c", "statistic"], rel=1e-8)
    spans = fitted.coefficient_intervals().set_index(["table", "row"])
    assert spans.loc[("a", 1), "status"] == "unavailable" and spans.loc[("c", 1), "status"] == "wald"


def test_part_of_a_table_can_be_estimable(spark):
    """r occurs with u only and u with r only; p and q are apart."""
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(300):
        a = rng.choice(list("pqr"))
        b = "u" if a == "r" else rng.choice(["v", "w"])
        rows.append((float(rng.poisson(2.0)), 1.0, a, b))
    fitted = Plan.frequency("w").categorical("a", base="p").categorical("b", base="v").fit(frame(spark, rows, "y w a b"), "y", check=False)
    status = dict(zip(fitted.table_names, fitted.inference.status))
    assert status["a"] == ["reference", "estimated", "aliased"] and status["b"] == ["reference", "aliased", "estimated"]


def test_weighted_means_of_aliased_tables_have_no_errors(spark):
    fitted = Plan.frequency("w").categorical("a").categorical("b").categorical("c").fit(two_factors(spark), "y", check=False, normalization="weighted_mean")
    t = fitted.rating_tables_by_name()
    assert np.isnan(t["a"]["Standard_Error"]).all() and np.isfinite(t["c"]["Standard_Error"]).all() and np.isfinite(t["intercept"]["Standard_Error"]).all()


def test_reference_is_the_first_row_with_exposure(spark):
    rows = [(1.0, 0.0, "p"), (2.0, 1.0, "q"), (4.0, 1.0, "q"), (5.0, 1.0, "r"), (7.0, 1.0, "r")]
    df = frame(spark, rows, "y w a")
    fitted = Plan("gaussian", "w", "weight").categorical("a", base="p").fit(df, "y", check=False)
    t = fitted.rating_tables_by_name()
    assert list(t["a"]["Status"]) == ["no_data", "reference", "estimated"]
    assert t["a"]["Coefficient"][1] == 0 and t["a"]["Coefficient"][2] == pytest.approx(3.0) and t["intercept"]["Coefficient"][0] == pytest.approx(3.0)


def test_unconverged_fits_have_no_tests(spark):
    fitted = Plan.frequency("w").categorical("a").categorical("c").fit(two_factors(spark), "y", check=False, max_iterations=1)
    assert not fitted.converged and set(fitted.term_tests()["reason"]) == {"not converged"}


def test_variate_terms_equal_least_squares(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(1, 6, 200).astype(float)
    y = 3 - 0.5 * x + 0.2 * x * x + rng.normal(0, 0.3, 200)
    df = frame(spark, [(float(a), 1.0, float(b)) for a, b in zip(y, x)], "y w x")
    fitted = Plan("gaussian", "w", "weight").variate("x", breaks=[1, 2, 3, 4], degree=2, values=[1, 2, 3, 4, 5]).fit(df, "y", check=False)
    got = fitted.variate_terms()
    z = (x - 3) / 2
    design = np.stack([np.ones(200), z, z * z], 1)
    beta, rss = np.linalg.lstsq(design, y, rcond=None)[:2]
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss[0] / 197)
    raw = np.linalg.lstsq(np.stack([np.ones(200), x, x * x], 1), y, rcond=None)[0]
    assert np.allclose(got["scaled_coefficient"], beta[1:]) and np.allclose(got["standard_error"], se[1:]) and np.allclose(got["coefficient"], raw[1:])
    assert math.isnan(got["top_z"][0]) and got["top_z"][1] == pytest.approx(beta[2] / se[2])


def test_expected_counts_take_any_exposure(spark):
    df = two_factors(spark)
    fitted = Plan.frequency("w").categorical("a").fit(df, "y", check=False)
    from pyspark.sql import functions as F

    got = fitted.predict_expected(df.withColumn("years", F.lit(2.5)), "years").agg(F.sum("expected")).first()[0]
    assert got == pytest.approx(2.5 * sum(r.y for r in df.collect()))
    with pytest.raises(ValueError):
        fitted.predict_expected(df, "a")
    with pytest.raises(ValueError):
        scoring.predict_expected(df, Plan("gaussian", "w", "weight").categorical("a").fit(df, "y", check=False).model, "w")
    with pytest.raises(Exception, match="is null"):
        fitted.predict_expected(df.withColumn("years", F.lit(None).cast("double")), "years").collect()


def test_counts_that_make_no_bands_are_refused(spark):
    df = frame(spark, [(1.0, 1.0, 2.0), (2.0, 1.0, 3.0)], "y w x")
    for plan in (Plan.frequency("w").banded("x", quantile=0), Plan.frequency("w").spline("x", equal_width=1), Plan.frequency("w").spline("x", quantile=1), Plan.frequency("w").banded("x", equal_width=0)):
        with pytest.raises(ValueError):
            plan.build(df)
    empty = frame(spark, [(1.0, 1.0, None), (2.0, 1.0, None)], "y w x")
    with pytest.raises(ValueError, match="finite"):
        Plan.frequency("w").banded("x", quantile=4).build(empty)
    assert "bands_cannot_be_cut" in [i.code for i in Plan.frequency("w").banded("x", quantile=4).check(empty, "y").issues]


def test_quantiles_are_exact_at_every_scale(spark, monkeypatch):
    rng = np.random.default_rng(1)
    columns = {
        "a": rng.normal(0, 1, 3000), "b": np.exp(rng.normal(0, 40, 3000)), "c": np.repeat([1.0, 2.0, 2.0, 5e307, -1.7e308], 600), "d": rng.integers(0, 4, 3000).astype(float),
        "e": np.r_[np.full(2999, 5e-324), 1e300],
    }
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values())], ", ".join(f"{c} double" for c in columns))
    df = df.unionByName(spark.createDataFrame([(math.nan, math.inf, None, -math.inf, None)], df.schema))
    for slices in (4096, 2, 7):
        monkeypatch.setattr(bands, "SLICES", slices)
        got = bands.quantiles_at(df, {c: [1, 2, 3, 7] for c in columns}, lambda total, i: max(1, math.ceil(i / 7 * total)))
        for c, v in columns.items():
            assert got[c] == [np.sort(v)[math.ceil(i / 7 * 3000) - 1] for i in (1, 2, 3, 7)], (c, slices)


@pytest.mark.parametrize("x,df,p", [(3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (124.34211340400407, 100, 0.05), (0.0, 3, 1.0), (5.0, 0, 1.0), (2.0, 2, math.exp(-1)), (30.0, 4, math.exp(-15) * 16)])
def test_chi_square_tail(x, df, p):
    assert chi_square_tail(x, df) == pytest.approx(p, rel=1e-12)
