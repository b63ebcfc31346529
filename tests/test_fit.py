"""Fits against dense row-level references and closed forms."""

import math

import numpy as np
import pandas as pd
import pytest

from ratecraft.functions.splines import basis, curvature, evaluate
from ratecraft.operators.inference import chi_square_tail, normal_quantile
from ratecraft.plans.plan import Plan
from ratecraft.plans.tables import Axis, Table


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    n = 600
    d = pd.DataFrame({"x": rng.uniform(0, 10, n).round(1), "a": rng.choice(list("pqr"), n), "b": rng.choice([1, 2], n), "w": rng.uniform(0.5, 2, n), "g": rng.integers(0, 40, n)})
    mu = np.exp(-1 + 0.1 * d.x + 0.3 * (d.a == "q") - 0.2 * (d.b == 2))
    d["n"] = rng.poisson(mu * d.w).astype(float)
    d["rate"] = d.n / d.w
    d["size"] = rng.gamma(3, mu)
    d["yes"] = (rng.uniform(size=n) < mu / 3).astype(float)
    d["loss"] = np.where(rng.uniform(size=n) < 0.5, 0.0, d["size"])
    return d


def dense(d):
    """Bands of x at 3 and 6, levels of a and b, against the rows that the plan takes as bases."""
    return np.stack([np.ones(len(d)), (d.x > 3) & (d.x <= 6), d.x > 6, d.a == "q", d.a == "r", d.b == 2], 1).astype(float)


def plan(family, **kw):
    return Plan(family, **kw).banded("x", breaks=[3, 6]).categorical("a", base="p").categorical("b", base="1")


def irls(X, y, w, offset, family, p, steps=60):
    beta = np.zeros(X.shape[1])
    if family != "gaussian":
        m = (w * y).sum() / w.sum()
        beta[0] = np.log(m / (1 - m)) if family == "binomial" else np.log(m) - offset.mean()
    for _ in range(steps):
        eta = X @ beta + offset
        if family == "gaussian":
            mu, work = eta, w
            s = w * (y - mu)
        elif family == "binomial":
            mu = 1 / (1 + np.exp(-eta))
            work, s = w * mu * (1 - mu), w * (y - mu)
        else:
            mu = np.exp(eta)
            work, s = w * mu ** (2 - p), w * (y - mu) * mu ** (1 - p)
        beta = beta + np.linalg.solve(X.T @ (work[:, None] * X), X.T @ s)
    return beta, X.T @ (work[:, None] * X), X * s[:, None], mu


CASES = [("poisson", "rate", 1.0), ("gaussian", "rate", 0.0), ("gamma", "size", 2.0), ("tweedie", "loss", 1.5), ("binomial", "yes", math.nan)]


def flat(model):
    t = model.tables
    return np.concatenate([t[0].factors, *[x.factors[1:] for x in t[1:]]])


@pytest.mark.parametrize("family,target,p", CASES)
def test_families(spark, data, family, target, p):
    m = plan(family, exposure="w", exposure_role="weight").fit(spark.createDataFrame(data), target, check=False)
    X = dense(data)
    beta, h, s, mu = irls(X, data[target].to_numpy(), data.w.to_numpy(), np.zeros(len(data)), family, p)
    assert m.converged
    np.testing.assert_allclose(flat(m.model), beta, rtol=1e-7, atol=1e-8)
    v = {"gaussian": 1.0, "binomial": mu * (1 - mu)}.get(family, mu**p if p == p else 1.0)
    chi = (data.w * (data[target] - mu) ** 2 / v).sum()
    scale = 1.0 if family in ("poisson", "binomial") else chi / (len(data) - 6)
    assert m.inference.pearson == pytest.approx(chi, rel=1e-8)
    se = np.sqrt(np.diag(np.linalg.inv(h)) * scale)
    got = np.concatenate([m.inference.errors[0], *[e[1:] for e in m.inference.errors[1:]]])
    np.testing.assert_allclose(got, se, rtol=1e-6)
    assert m.inference.df_residual == len(data) - 6
    assert m.inference.null_deviance > m.inference.deviance > 0


def test_offset(spark, data):
    m = plan("poisson", exposure="w").fit(spark.createDataFrame(data), "n", check=False)
    beta, *_ = irls(dense(data), data.n.to_numpy(), np.ones(len(data)), np.log(data.w.to_numpy()), "poisson", 1.0)
    np.testing.assert_allclose(flat(m.model), beta, rtol=1e-7, atol=1e-8)


@pytest.mark.parametrize("kind", ["robust", "cluster"])
def test_sandwich(spark, data, kind):
    m = plan("poisson", exposure="w", exposure_role="weight").fit(spark.createDataFrame(data), "rate", check=False, covariance=kind, cluster="g" if kind == "cluster" else None)
    X = dense(data)
    _, h, s, _ = irls(X, data.rate.to_numpy(), data.w.to_numpy(), np.zeros(len(data)), "poisson", 1.0)
    if kind == "cluster":
        s = pd.DataFrame(s).groupby(data.g).sum().to_numpy()
    cov = np.linalg.inv(h) @ (s.T @ s) @ np.linalg.inv(h)
    got = np.concatenate([m.inference.errors[0], *[e[1:] for e in m.inference.errors[1:]]])
    np.testing.assert_allclose(got, np.sqrt(np.diag(cov)), rtol=1e-6)


def test_robust_wald_uses_the_covariance(spark, data):
    m = plan("poisson", exposure="w", exposure_role="weight").fit(spark.createDataFrame(data), "rate", check=False)
    t = m.term_tests()
    X = dense(data)
    beta, h, *_ = irls(X, data.rate.to_numpy(), data.w.to_numpy(), np.zeros(len(data)), "poisson", 1.0)
    cov = np.linalg.inv(h)
    want = beta[1:3] @ np.linalg.solve(cov[1:3, 1:3], beta[1:3])
    assert t.statistic[0] == pytest.approx(want, rel=1e-6)


def test_ridge_and_lasso_meet_their_conditions(spark, data):
    df, X = spark.createDataFrame(data), dense(data)
    for alpha, ratio in ((0.02, 0.0), (0.03, 1.0), (0.02, 0.5)):
        m = plan("poisson", exposure="w", exposure_role="weight").fit(df, "rate", check=False, alpha=alpha, l1_ratio=ratio)
        beta = flat(m.model)
        g = X.T @ (data.w * (data.rate - np.exp(X @ beta)))
        l1, l2 = data.w.sum() * alpha * ratio, data.w.sum() * alpha * (1 - ratio)
        assert abs(g[0]) < 1e-5
        for j in range(1, 6):
            r = g[j] - l2 * beta[j]
            assert abs(r - l1 * np.sign(beta[j])) < 1e-5 if beta[j] else abs(r) <= l1 + 1e-5
        assert all(np.isnan(e).all() for e in m.inference.errors)


def test_monotone_is_pooled_means(spark):
    x, y = np.arange(6.0), np.array([1.0, 3.0, 2.0, 2.5, 2.0, 6.0])
    m = Plan("poisson").monotone("x", "increasing", breaks=list(x[:-1])).fit(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "y", check=False)
    got = np.exp(m.model.tables[0].factors[0] + m.model.tables[1].factors)
    np.testing.assert_allclose(got, [1, 2.375, 2.375, 2.375, 2.375, 6], rtol=1e-6)


def test_variate_and_spline(spark, data):
    df = spark.createDataFrame(data)
    m = Plan("gaussian").variate("x", breaks=[2, 4, 6, 8], degree=2).fit(df, "size", check=False)
    v = m.model.tables[1].values
    z = v[np.searchsorted([2, 4, 6, 8], data.x)]
    c = np.polyfit(z, data["size"], 2)
    np.testing.assert_allclose(m.model.tables[0].factors + m.model.tables[1].factors, np.polyval(c, v), rtol=1e-7)
    m = Plan("gaussian").spline("x", knots=[1, 4, 7, 9]).fit(df, "size", check=False)
    k = np.array([1.0, 4, 7, 9])
    beta = np.linalg.lstsq(basis(k, data.x.to_numpy()), data["size"], rcond=None)[0]
    np.testing.assert_allclose(m.model.tables[0].factors + m.model.tables[1].factors, beta, rtol=1e-6)
    got = m.predict(df).select("x", "predictions").toPandas()
    np.testing.assert_allclose(got.predictions, evaluate(k, beta, got.x.to_numpy()), rtol=1e-6)


def test_spline_properties():
    k, y = np.array([0.0, 1, 3, 4]), np.array([1.0, 0, 2, 5])
    np.testing.assert_allclose(evaluate(k, y, k), y, atol=1e-12)
    tail = evaluate(k, y, np.array([5.0, 6, 7]))
    assert tail[2] - tail[1] == pytest.approx(tail[1] - tail[0])
    x = np.linspace(0, 4, 40_001)
    bend = np.gradient(np.gradient(evaluate(k, y, x), x), x)
    assert y @ curvature(k) @ y == pytest.approx(np.trapezoid(bend[2:-2] ** 2, x[2:-2]), rel=1e-3)


def test_start_and_partitions_do_not_matter(spark, data):
    p = plan("poisson", exposure="w", exposure_role="weight")
    a = p.fit(spark.createDataFrame(data).repartition(1), "rate", check=False)
    b = p.fit(spark.createDataFrame(data.sample(frac=1, random_state=1)).repartition(7), "rate", check=False)
    np.testing.assert_allclose(flat(a.model), flat(b.model), rtol=1e-10)


def test_weights_are_replication(spark):
    d = pd.DataFrame({"a": list("ppqqq"), "y": [1.0, 2, 3, 0, 4], "w": [2.0, 1, 3, 1, 2]})
    long = d.loc[d.index.repeat(d.w.astype(int))]
    a = Plan("poisson", "w", "weight").categorical("a", base="p").fit(spark.createDataFrame(d), "y", check=False)
    b = Plan("poisson").categorical("a", base="p").fit(spark.createDataFrame(long), "y", check=False)
    np.testing.assert_allclose(flat(a.model), flat(b.model), rtol=1e-10)


def test_normalization(spark, data):
    m = plan("poisson", exposure="w", exposure_role="weight").fit(spark.createDataFrame(data), "rate", check=False, normalization="weighted_mean")
    for t, e in zip(m.model.tables[1:], m.fit.exposure[1:]):
        assert t.factors @ e == pytest.approx(0, abs=1e-8)


def test_given_and_locked(spark, data):
    t = Table("f", "given", (Axis("x", "band"),), [(5.0,), (math.inf,)], np.array([0.0, 0.4]), np.array([True, True]))
    m = Plan("poisson", "w", "weight").given("f", t).categorical("a").fit(spark.createDataFrame(data), "rate", check=False)
    np.testing.assert_array_equal(m.model.table("f").factors, [0.0, 0.4])


BAD = [
    (dict(alpha=-1.0), "alpha"), (dict(l1_ratio=2.0), "l1_ratio"), (dict(solver="x"), "solver"), (dict(covariance="cluster"), "cluster column"), (dict(alpha=0.1, covariance="robust"), "penalised"),
    (dict(alpha=0.1, normalization="none"), "base_level"), (dict(covariance="robust", compute_standard_errors=False), "standard errors"), (dict(covariance="robust", normalization="none"), "normalization"),
]


@pytest.mark.parametrize("options,why", BAD)
def test_rejected_options(spark, data, options, why):
    with pytest.raises(ValueError, match=why):
        plan("poisson").fit(spark.createDataFrame(data.head(20)), "n", check=False, **options)


def test_rejected_tables(spark, data):
    df = spark.createDataFrame(data.head(50))
    with pytest.raises(ValueError, match="spline"):
        Plan("poisson").spline("x").fit(df, "n", check=False, alpha=0.1)
    with pytest.raises(ValueError, match="monotone"):
        Plan("poisson").monotone("x", "increasing", breaks=[5]).fit(df, "n", check=False, solver="global")
    with pytest.raises(ValueError, match="monotone"):
        Plan("binomial").monotone("x", "increasing", breaks=[5])
    with pytest.raises(ValueError, match="already"):
        Plan("poisson").banded("x", breaks=[1]).banded("x", breaks=[2])


def test_unusable_data(spark):
    make = lambda rows: spark.createDataFrame(rows, "a string, y double, e double")
    p = Plan("poisson", "e", "weight").categorical("a")
    for rows, why in (([("p", None, 1.0)], "null"), ([("p", -1.0, 1.0)], "negative"), ([("p", 1.0, -1.0)], "negative"), ([("p", 1.0, None)], "null"), ([("p", 1.0, 0.0)], "weight is zero")):
        with pytest.raises(ValueError, match=why):
            p.fit(make(rows), "y", check=False)
    with pytest.raises(ValueError, match="match no row"):
        Plan("poisson").given("t", Table("t", "banded", (Axis("e", "band"),), [(1.0,), (2.0,)])).fit(make([("p", 1.0, 5.0), ("p", 1.0, 1.0)]), "y", check=False)


def test_tails():
    assert chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-10)
    assert chi_square_tail(9.487729036781154, 4) == pytest.approx(0.05, rel=1e-10)
    assert chi_square_tail(7.814727903251179, 3) == pytest.approx(0.05, rel=1e-10)
    assert chi_square_tail(0.0, 3) == 1.0
    assert normal_quantile(0.975) == pytest.approx(1.959963984540054, abs=1e-12)
