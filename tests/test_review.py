"""Scoring, validation, audits, workbooks, algebra, boosting and streams."""

import json
import math

import numpy as np
import pandas as pd
import pytest

from ratecraft.catalog import TREES, tariff
from ratecraft.operators import algebra, boosting, scoring, validation
from ratecraft.operators.audit import canonical, check_table
from ratecraft.operators.fitted import FittedModel
from ratecraft.operators.oneway import one_way
from ratecraft.plans.plan import Plan
from ratecraft.plans.tables import WILDCARD, Axis, Model, Table
from ratecraft.sources.frames import from_pandas
from ratecraft.sources.workbook import Workbook


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(2)
    n = 400
    return pd.DataFrame({"id": range(n), "o_totalprice": rng.uniform(5e4, 4e5, n).round(2), "o_orderpriority": rng.choice(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], n), "exposure": rng.integers(1, 5, n).astype(float), "claims": rng.poisson(1.0, n).astype(float)}).assign(frequency=lambda d: d.claims / d.exposure)


def test_scores_equal_one_by_one(spark, small):
    m = FittedModel(tariff())
    got = m.predict(spark.createDataFrame(small)).toPandas().set_index("id")
    for r in small.head(40).to_dict("records"):
        assert got.predictions[r["id"]] == pytest.approx(m.predict_one(r), rel=1e-14)


def test_unmatched_rows(spark, small):
    m = tariff()
    m.tables[1].keys = m.tables[1].keys[:3]
    m.tables[1].factors = m.tables[1].factors[:3]
    df = spark.createDataFrame(small)
    got = scoring.predict_diagnostics(df, m).toPandas()
    lost = got.o_totalprice > 300000
    assert (got.status == np.where(lost, "unmatched", "ok")).all() and got.predictions.isna().eq(lost).all()
    assert set(got.unmatched_tables) == {"", "o_totalprice"}
    with pytest.raises(Exception, match="can't be scored"):
        scoring.predict(df, m).collect()
    assert scoring.predict(df, m, strict=False).where("predictions is null").count() == lost.sum()


def test_rates_and_counts(spark, small):
    df = spark.createDataFrame(small)
    weight, offset = FittedModel(tariff()), FittedModel(tariff("offset"))
    assert (weight.prediction_kind, offset.prediction_kind) == ("rate", "count")
    a, b = weight.predict_rate(df).toPandas(), offset.predict(df).toPandas()
    np.testing.assert_allclose(a.rate * a.exposure, b.predictions)
    np.testing.assert_allclose(offset.predict_count(df).toPandas().expected_count, b.predictions)
    assert offset.input_schema()["columns"] == ["o_totalprice", "o_orderpriority", "exposure"]


def test_explained_terms_add_up(spark, small):
    m = FittedModel(tariff("offset"))
    s, c = m.explain(spark.createDataFrame(small), "id")
    total = c.groupBy("id").sum("coefficient").toPandas().set_index("id")["sum(coefficient)"]
    s = s.toPandas().set_index("id")
    np.testing.assert_allclose(s.linear_predictor, total[s.index], rtol=1e-12)
    np.testing.assert_allclose(np.exp(s.linear_predictor), s.predictions, rtol=1e-12)


def gini(mu, y, w):
    d = pd.DataFrame({"mu": mu, "w": w, "wy": w * y}).groupby("mu").sum()
    x, v = np.r_[0, d.w.cumsum() / d.w.sum()], np.r_[0, d.wy.cumsum() / d.wy.sum()]
    return 1 - (np.diff(x) * (v[1:] + v[:-1])).sum()


@pytest.mark.parametrize("few", [10, 200_000])
def test_validation(spark, small, few, monkeypatch):
    monkeypatch.setattr(validation, "FEW", few)
    df = spark.createDataFrame(small)
    v = FittedModel(tariff()).validate(df, bins=4)
    mu = FittedModel(tariff()).predict(df).toPandas().predictions
    assert v.gini == pytest.approx(gini(mu, small.frequency, small.exposure), rel=1e-9)
    assert v.total_actual == pytest.approx(small.claims.sum()) and v.total_expected == pytest.approx((mu * small.exposure).sum())
    assert v.calibration.n.sum() == len(small) and v.calibration.weight.sum() == pytest.approx(small.exposure.sum())
    for t in v.actual_vs_expected.values():
        assert t.Actual.sum() == pytest.approx(v.total_actual) and t.Expected.sum() == pytest.approx(v.total_expected)


def test_constant_model_has_no_gini(spark, small):
    m = tariff()
    for t in m.tables[1:]:
        t.factors = t.factors * 0
    v = FittedModel(m).validate(spark.createDataFrame(small))
    assert v.gini == pytest.approx(0, abs=1e-12) and math.isnan(v.lift)
    assert "no_discrimination" in [f.code for f in v.warnings] and not v.is_usable


def test_one_way(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (1.0, 4.0, 3.0), (9.0, None, 1.0)], "x double, y double, w double")
    t = Table("x", "banded", (Axis("x", "band"),), [(5.0,), (10.0,), (math.inf,)])
    got = {r.row: (r.y_avg, r.weight) for r in one_way(df, t, "y", "w").collect()}
    assert got == {0: (3.5, 4.0), 1: (0.0, 1.0), 2: (0.0, 0.0)}
    with pytest.raises(Exception, match="matches no row"):
        one_way(df, Table("x", "banded", (Axis("x", "band"),), [(5.0,)]), "y").collect()


def test_plan_check_codes(spark, small):
    df = spark.createDataFrame(small.assign(same=1.0, twin=small.o_totalprice, text="t"))
    base = Plan.frequency("exposure")
    codes = lambda p, y="frequency", d=df: [i.code for i in p.check(d, y).issues]
    assert codes(base.banded("o_totalprice", quantile=4)) == []
    assert "missing_target" in codes(base, "nothing") and "target_not_numeric" in codes(base, "text")
    assert "plan_cannot_prepare" in codes(base.banded("nothing", breaks=[1]))
    assert "constant_feature" in codes(base.banded("same", breaks=[0.5, 2]))
    assert "near_aliased_tables" in codes(base.banded("o_totalprice", breaks=[1e5, 2e5]).banded("twin", breaks=[1e5, 2e5]))
    assert "empty_levels" in codes(base.banded("o_totalprice", breaks=[1.0, 2e5]))
    assert "negative_target" in codes(base, "bad", df.selectExpr("*", "-frequency - 1 as bad"))
    assert "more_parameters_than_rows" in codes(base.banded("o_totalprice", breaks=list(range(50_000, 400_000, 10_000))), d=df.limit(5))
    with pytest.raises(ValueError, match="near_aliased"):
        base.banded("o_totalprice", breaks=[1e5]).banded("twin", breaks=[1e5]).fit(df, "frequency")


def test_canonical_correlation():
    assert canonical(np.diag([3.0, 5, 2])) == pytest.approx(1)
    assert canonical(np.outer([1.0, 2], [3.0, 4, 5])) == pytest.approx(0, abs=1e-8)


def test_plan_json():
    p = Plan.pure_premium("e").banded("x", breaks=[1, 2]).categorical("c", base="b").spline("z").variate("v", quantile=4, degree=2).interaction(["x", "c"], [[1, 2], None]).monotone("m", "increasing", equal_width=3).given("g", tariff().tables[1])
    assert Plan.from_json(p.to_json()) == p


def test_workbook_round_trips(spark, small, tmp_path):
    m = FittedModel(tariff())
    w = m.to_workbook()
    w.save_json(str(tmp_path / "w.json"))
    w.save_csv_dir(str(tmp_path / "csv"))
    for back in (Workbook.load_json(str(tmp_path / "w.json")), Workbook.load_csv_dir(str(tmp_path / "csv"))):
        again = back.to_model()
        for a, b in zip(m.model.tables, again.model.tables):
            assert a.keys == b.keys
            np.testing.assert_allclose(a.factors, b.factors, atol=1e-15)


def test_workbook_faults_come_together(tmp_path):
    w = FittedModel(tariff()).to_workbook()
    w.tables[1][2][0][-1] = -1.0
    w.tables[2][2][0][0] = "nobody"
    w.tables[1][2][3][0] = 300000.0
    with pytest.raises(ValueError) as e:
        w.to_model()
    for code in ("non_positive_relativity", "unknown_level", "no_unbounded_band", "duplicate_bound"):
        assert code in str(e.value)


def test_foreign_tariff():
    w = Workbook.from_tables({"area": pd.DataFrame({"area": ["n", "s", "*"], "rel": [1.0, 1.2, 0.9]}), "age": pd.DataFrame({"age": [30.0, math.inf], "rel": [1.5, 1.0]})}, family="poisson", base_value=0.1)
    m = w.to_model()
    assert m.predict_one({"area": "s", "age": 20}) == pytest.approx(0.18)
    assert m.predict_one({"area": "x", "age": 40}) == pytest.approx(0.09)


def test_table_faults():
    codes = lambda t, **k: [i.code for i in check_table(t, **k)]
    x = Axis("x", "band")
    assert codes(Table("t", "banded", (x,), [(1.0,), (math.inf,)])) == []
    assert codes(Table("t", "banded", (x,), [(2.0,), (1.0,), (math.inf,)])) == ["bounds_not_ascending"]
    assert "duplicate_row" in codes(Table("t", "given", (x, Axis("c", "category")), [(math.inf, 1), (math.inf, 1)]))
    assert codes(Table("t", "banded", (x,), [(math.inf,)], np.array([math.nan]))) == ["non_finite_factor"]
    assert codes(Table("t", "intercept", (), [(), ()]), intercept=True) == ["intercept_not_single_row"]
    assert codes(pd.DataFrame({"x": [1.0]})) == ["missing_factor_column"]
    assert codes(pd.DataFrame({"x": ["a"], "Rating_Factor": [1.0]})) == ["unreadable_dtype"]


def test_combining_adds_linear_predictors(spark, small):
    a = tariff()
    b = Model([Table("intercept", "intercept", factors=np.array([0.3])), Table("p", "categorical", (Axis("o_orderpriority", "category"),), [(0,), (WILDCARD,)], np.array([0.5, -0.5]))], encodings={"o_orderpriority": ["5-LOW", "1-URGENT"]})
    both = algebra.combine(a, b)
    df = spark.createDataFrame(small)
    for m in (both, algebra.consolidate(both, "analysis"), algebra.consolidate(both, "max")):
        got = scoring.predict_linear(df, m).toPandas()
        want = scoring.predict_linear(df, a).toPandas().linear_predictor + 0.3 + np.where(small.o_orderpriority == "5-LOW", 0.5, -0.5)
        np.testing.assert_allclose(got.linear_predictor, want, atol=1e-12)
    assert len(algebra.consolidate(both, "analysis").tables) == 3
    with pytest.raises(ValueError, match="links"):
        algebra.combine(a, Model([Table("intercept", "intercept")], link="identity"))


def tree_value(node, row):
    while "leaf_value" not in node:
        v = row[node["split_feature"]]
        if node["decision_type"] == "==":
            left = v is not None and str(int(v)) in node["threshold"].split("||")
        elif v is None or math.isnan(v):
            left = node["default_left"] if node["missing_type"] == "NaN" else 0 <= node["threshold"]
        else:
            left = v <= node["threshold"]
        node = node["left_child" if left else "right_child"]
    return node["leaf_value"]


@pytest.mark.parametrize("mode", ["max", "analysis"])
def test_random_trees_convert_exactly(spark, mode):
    rng = np.random.default_rng(8)

    def grow(depth):
        if depth == 0 or rng.uniform() < 0.2:
            return {"leaf_value": float(rng.normal())}
        f = int(rng.integers(0, 3))
        node = {"split_feature": f, "internal_value": float(rng.normal()), "default_left": bool(rng.integers(0, 2)), "missing_type": str(rng.choice(["None", "NaN"]))}
        node |= {"decision_type": "==", "threshold": "||".join(map(str, sorted(rng.choice(5, 2, replace=False).tolist()))), "missing_type": "None"} if f == 2 else {"decision_type": "<=", "threshold": float(rng.choice([-1.0, 0.0, 1.5, 3.0]))}
        return node | {"left_child": grow(depth - 1), "right_child": grow(depth - 1)}

    dump = {"objective": "regression", "feature_names": ["u", "v", "k"], "tree_info": [{"tree_structure": grow(3)} for _ in range(4)]}
    rows = [(float(rng.choice([-2, -1, 0, 1.5, 2, 9])) if rng.uniform() > 0.1 else None, float(rng.choice([-2, -1, 0, 1.5, 2, math.nan])), int(rng.integers(0, 7))) for _ in range(300)]
    want = [sum(tree_value(t["tree_structure"], r) for t in dump["tree_info"]) for r in rows]
    df = spark.createDataFrame([(*r, w) for r, w in zip(rows, want)], "u double, v double, k int, want double")
    got = boosting.from_booster(dump, df, expected="want", consolidation=mode, atol=1e-9)
    assert got.rows_checked == 300 and got.largest_difference < 1e-9


def test_conversion_gate():
    for change, why in (({"objective": "multiclass"}, "objective"), ({"num_class": 3}, "multiclass"), ({"average_output": True}, "averaged"), ({"objective": "binary sigmoid:2"}, "sigmoid")):
        with pytest.raises(ValueError, match=why):
            boosting.from_lightgbm(json.dumps(TREES | change))
    zero = json.loads(json.dumps(TREES).replace('"NaN"', '"Zero"'))
    with pytest.raises(ValueError, match="zero_as_missing"):
        boosting.from_lightgbm(json.dumps(zero))
    assert boosting.estimate_num_tables(json.dumps(TREES)) == 3


def test_tuning_frontier():
    seen = []

    def trainer(params):
        seen.append(params)
        return abs(params["depth"] - 3) + params["noise"], [json.dumps(TREES)] * 2

    r = boosting.tune(trainer, {"depth": [1, 2, 3, 4], "noise": [0.0, 1.0]}, trials=30)
    assert len(seen) == 30 and r.best_cv.loss == 0 and r.select(3).loss == 0
    with pytest.raises(ValueError):
        r.select(1)
    t = [boosting.Trial({}, 1.0, 5), boosting.Trial({}, 2.0, 3), boosting.Trial({}, 2.0, 4), boosting.Trial({}, math.nan, 1)]
    assert [x.tables for x in boosting.TuningResult(t).frontier] == [3, 5]


def test_report(spark, small):
    df = spark.createDataFrame(small)
    m = Plan.frequency("exposure").banded("o_totalprice", quantile=3).categorical("o_orderpriority").fit(df, "frequency")
    r = m.report(df)
    assert r.verdict in ("usable", "usable_with_caveats", "not_usable") and len(r.fingerprint) == 12
    for part in ("# Model report", "## Findings", "## Fit", "## Validation", "## Table o_totalprice", "## Plan"):
        assert part in r.markdown()
    late = m.refit(df.where("id % 2 = 0"))
    assert late.converged and late.table_names == m.table_names


def test_pandas_input(spark):
    d = pd.DataFrame({"a": pd.Categorical(["x", None, "y"]), "v": [1.0, 2.0, 3.0]}, index=[5, 6, 7])
    got = from_pandas(spark, d, index_column="i").collect()
    assert [(r.i, r.a) for r in got] == [(5, "x"), (6, None), (7, "y")]
    with pytest.raises(ValueError, match="floats"):
        from_pandas(spark, pd.DataFrame({"a": pd.Categorical([1.5, 2.5])}))
    with pytest.raises(ValueError, match="distinct"):
        from_pandas(spark, pd.DataFrame([[1, 2]], columns=["a", "a"]))


def test_stream_scores_as_batch(spark, small, tmp_path):
    from ratecraft.streaming.scoring import score_stream, write_scores

    spark.createDataFrame(small).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    write_scores(stream, tariff(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("id").toPandas()
    want = scoring.predict_diagnostics(batch, tariff()).orderBy("id").toPandas()
    pd.testing.assert_frame_equal(got[sorted(got)], want[sorted(want)])
    with pytest.raises(ValueError, match="stream"):
        score_stream(batch, tariff())
