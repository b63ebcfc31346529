"""More registered queries: results of the rating engine that a closed form, or plain SQL, gives too."""

from __future__ import annotations

import json
import math
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _BAND_F, _GROUPS, _LEVEL_SQL, _PRIO_F, _RATE, _TREES_SQL, BAND_FACTORS, EDGES, PRIORITIES, PRIORITY_FACTORS, TREES, query, tariff
from .functions import bands
from .operators import audit, boosting, scoring, validation
from .operators.fitted import FittedModel
from .operators.inference import gamma_upper
from .plans.plan import Plan
from .plans.tables import WILDCARD, Axis, Model, Table, scan
from .sources.frames import from_pandas, policies
from .sources.workbook import Workbook

FAST = {"check": False, "compute_standard_errors": False}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _levels_of(fitted: FittedModel, column: str) -> list[str]:
    table = fitted.model.table(column)
    return [fitted.model.encodings[column][k[0]] for k in table.keys]


# Tables of a fit.


@query("""WITH {policies}, l AS (SELECT o_orderpriority AS level, sum(claims) / sum(exposure) AS m, sum(exposure) AS e FROM policies GROUP BY 1),
b AS (SELECT * FROM l ORDER BY e DESC, level DESC LIMIT 1)
SELECT l.level, round(ln(l.m) - ln(b.m), 7) + 0.0 AS coefficient, round(l.m / b.m, 7) AS relativity, CASE WHEN l.level = b.level THEN 'reference' ELSE 'estimated' END AS status FROM l, b""")
def saturated_rating_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rating table of a one-factor frequency model, with decoded labels and statuses."""
    fitted = Plan.frequency("exposure").categorical("o_orderpriority").fit(policies(spark, sf_dir), "frequency", tolerance=1e-13)
    t = fitted.rating_tables_by_name()["o_orderpriority"]
    rows = [(r.o_orderpriority_Level, round(float(r.Coefficient), 7) + 0.0, round(float(r.Relativity), 7), r.Status) for r in t.itertuples()]
    return spark.createDataFrame(rows, "level string, coefficient double, relativity double, status string")


@query("""WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), {policies},
x AS (SELECT least(4, greatest(0, ceil((o_totalprice - lo) / (hi - lo) * 5) - 1))::BIGINT AS band, frequency, exposure, lo, hi FROM policies, s)
SELECT band, CASE WHEN band = 0 THEN -1e300 ELSE round(any_value(lo + (hi - lo) * band / 5), 4) END AS lower, CASE WHEN band = 4 THEN 1e300 ELSE round(any_value(lo + (hi - lo) * (band + 1) / 5), 4) END AS upper,
round(sum(exposure * frequency) / sum(exposure), 7) AS mean FROM x GROUP BY band""")
def band_review_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of bands of equal width beside their fitted means."""
    df = policies(spark, sf_dir)
    fitted = Plan.frequency("exposure").banded("o_totalprice", equal_width=5).fit(df, "frequency", tolerance=1e-13, check=False)
    t, head = fitted.rating_tables_by_name()["o_totalprice"], float(fitted.model.tables[0].factors[0])
    assert set(t.Band_Interval_Status) == {"ordered_grid"}
    shown = lambda v: -1e300 if v == -math.inf else 1e300 if v == math.inf else round(float(v), 4)
    rows = [(i, shown(r.o_totalprice_Lower), shown(r.o_totalprice_Upper), round(math.exp(head + r.Coefficient), 7)) for i, r in enumerate(t.itertuples())]
    return spark.createDataFrame(rows, "band long, lower double, upper double, mean double")


@query("""WITH {policies}, l AS (SELECT c_mktsegment AS level, ln(sum(claims) / sum(exposure)) AS v, sum(exposure) AS e FROM policies GROUP BY 1), m AS (SELECT sum(v * e) / sum(e) AS mean FROM l)
SELECT level, round(v - mean, 7) + 0.0 AS coefficient FROM l, m UNION ALL SELECT 'intercept', round(mean, 7) FROM m""")
def weighted_mean_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised to the exposure-weighted mean, which the intercept takes up."""
    fitted = Plan.frequency("exposure").categorical("c_mktsegment").fit(policies(spark, sf_dir), "frequency", tolerance=1e-13, normalization="weighted_mean", **FAST)
    rows = [*zip(_levels_of(fitted, "c_mktsegment"), (round(float(f), 7) + 0.0 for f in fitted.model.tables[1].factors)), ("intercept", round(float(fitted.model.tables[0].factors[0]), 7))]
    return spark.createDataFrame(rows, "level string, coefficient double")


# Inference.


@query(_LEVEL_SQL.replace("o_orderstatus", "o_orderpriority").rstrip() + """, t AS (SELECT sum(c * power(ln(c / e), 2)) - power(sum(c * ln(c / e)), 2) / sum(c) AS x FROM l)
SELECT 'o_orderpriority' AS term, round(x, 5) AS statistic, 4::BIGINT AS df, round(exp(-x / 2) * (1 + x / 2), 7) AS p_value FROM t""")
def term_test_of_one_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wald test of a saturated Poisson factor: its statistic is the weighted sum of squares of log rates."""
    got = Plan.frequency("exposure").categorical("o_orderpriority").fit(policies(spark, sf_dir), "frequency", check=False, tolerance=1e-13).term_tests()
    return spark.createDataFrame([(r.term, round(float(r.statistic), 5), int(r.df), round(float(r.p_value), 7)) for r in got.itertuples()], "term string, statistic double, df long, p_value double")


@query("""WITH {policies}, s AS (SELECT DISTINCT o_orderstatus AS level FROM policies), b AS (SELECT o_orderstatus AS level FROM policies GROUP BY 1 ORDER BY sum(exposure) DESC LIMIT 1)
SELECT t AS term, s.level, CASE WHEN s.level = b.level THEN 'reference' ELSE 'aliased' END AS status FROM s, b, (VALUES ('o_orderstatus'), ('again')) AS v(t)""")
def aliased_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two tables that say the same, no contrast can be estimated, in the first one neither."""
    df = policies(spark, sf_dir).withColumn("again", F.col("o_orderstatus"))
    fitted = Plan.frequency("exposure").categorical("o_orderstatus").categorical("again").fit(df, "frequency", check=False)
    rows = [(name, level, status) for name in ("o_orderstatus", "again") for level, status in zip(_levels_of(fitted, name), fitted.rating_tables_by_name()[name]["Status"])]
    assert set(fitted.term_tests()["reason"]) == {"aliased"}
    return spark.createDataFrame(rows, "term string, level string, status string")


@query("""WITH {policies}, l AS (SELECT o_orderstatus AS level, sum(claims) / sum(exposure) AS m FROM policies GROUP BY 1),
d AS (SELECT sum(claims * ln(exposure * m) - exposure * m - lgamma(claims + 1)) AS ll, count(*)::DOUBLE AS n FROM policies JOIN l ON o_orderstatus = level)
SELECT round(ll, 3) AS log_likelihood, round(6 - 2 * ll, 3) AS aic, round(3 * ln(n) - 2 * ll, 3) AS bic FROM d""")
def poisson_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood and criteria of a count model with log exposure as its offset."""
    i = Plan("poisson", "exposure").categorical("o_orderstatus").fit(policies(spark, sf_dir), "claims", check=False, tolerance=1e-13).inference
    return spark.createDataFrame([tuple(round(v, 3) for v in (i.log_likelihood, i.aic, i.bic))], "log_likelihood double, aic double, bic double")


@query("""WITH x AS (SELECT l_quantity AS y, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem), d AS (SELECT sum(power(y - m, 2)) AS dev, count(*)::DOUBLE AS n FROM x)
SELECT round(-0.5 * (n * ln(2 * pi() * dev / n) + n), 3) AS log_likelihood, round(dev / (n - 3), 6) AS dispersion, round(3.0, 6) AS effective_parameters FROM d""")
def gaussian_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Plan("gaussian").categorical("l_returnflag").fit(_read(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity"), "l_quantity", check=False, tolerance=1e-13).inference
    return spark.createDataFrame([(round(i.log_likelihood, 3), round(i.dispersion, 6), round(i.effective_parameters, 6))], "log_likelihood double, dispersion double, effective_parameters double")


@query("""WITH x AS (SELECT CASE WHEN l_linenumber <= 6 THEN l_linenumber ELSE 7 END::DOUBLE AS x, l_quantity AS y FROM lineitem),
r AS (SELECT regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, count(*) AS n FROM x)
SELECT 'l_linenumber' AS term, 1::BIGINT AS power, round(b, 8) AS coefficient, round(3 * b, 8) AS scaled_coefficient, round(3 * sqrt((syy - b * b * sxx) / (n - 2) / sxx), 8) AS standard_error,
round(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx), 6) AS top_z FROM r""")
def variate_line_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear variate: its slope on the values and on [-1, 1], and the slope's error and z."""
    df = _read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("double").alias("l_linenumber"), "l_quantity")
    got = Plan("gaussian").variate("l_linenumber", breaks=[1, 2, 3, 4, 5, 6], values=[1, 2, 3, 4, 5, 6, 7]).fit(df, "l_quantity", check=False, tolerance=1e-13).variate_terms()
    rows = [(r.term, int(r.power), *(round(float(v), 8) for v in (r.coefficient, r.scaled_coefficient, r.standard_error)), round(float(r.top_z), 6)) for r in got.itertuples()]
    return spark.createDataFrame(rows, "term string, power long, coefficient double, scaled_coefficient double, standard_error double, top_z double")


@query("SELECT df::BIGINT AS df, x::DOUBLE AS x, round(exp(-x / 2) * CASE df WHEN 2 THEN 1 WHEN 4 THEN 1 + x / 2 WHEN 6 THEN 1 + x / 2 + x * x / 8 END, 12) AS tail FROM (VALUES (2), (4), (6)) AS d(df), range(1, 31) AS r(x)")
def chi_square_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(df, float(x), round(gamma_upper(df / 2, x / 2), 12)) for df in (2, 4, 6) for x in range(1, 31)], "df long, x double, tail double")


# Penalties and solvers.


@query("""WITH x AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE AS n0, count(*) FILTER (WHERE o_orderstatus <> 'F')::DOUBLE AS n1,
avg(o_totalprice / 1000) FILTER (WHERE o_orderstatus <> 'F') - avg(o_totalprice / 1000) FILTER (WHERE o_orderstatus = 'F') AS d FROM orders),
s AS (SELECT n0 * n1 / (n0 + n1) AS s, n0 + n1 AS n, d FROM x), p(alpha, l1_ratio) AS (VALUES (0.01, 1.0), (0.02, 0.5), (0.5, 0.0), (1000.0, 0.9))
SELECT alpha::DOUBLE AS alpha, l1_ratio::DOUBLE AS l1_ratio, round(sign(s * d) * greatest(abs(s * d) - n * alpha * l1_ratio, 0) / (s + n * alpha * (1 - l1_ratio)), 7) + 0.0 AS coefficient FROM s, p""")
def elastic_net_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A penalised contrast of two levels is the shrunken, soft-thresholded difference of their means."""
    df = _read(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "F").otherwise("other").alias("state"), (F.col("o_totalprice") / 1000).alias("price")).persist()
    plan, rows = Plan("gaussian").categorical("state", base="F"), []
    for alpha, ratio in ((0.01, 1.0), (0.02, 0.5), (0.5, 0.0), (1000.0, 0.9)):
        fitted = plan.fit(df, "price", alpha=alpha, l1_ratio=ratio, tolerance=1e-13, **FAST)
        rows.append((alpha, ratio, round(float(fitted.model.tables[1].factors[1]), 7) + 0.0))
    df.unpersist()
    return spark.createDataFrame(rows, "alpha double, l1_ratio double, coefficient double")


@query("""WITH x AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE AS n0, count(*) FILTER (WHERE o_orderstatus <> 'F')::DOUBLE AS n1 FROM orders)
SELECT round(1 + n0 * n1 / (n0 + n1) / (n0 * n1 / (n0 + n1) + 0.3 * (n0 + n1)), 9) AS effective_parameters, 0.0::DOUBLE AS empty_row FROM x""")
def ridge_effective_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace of a ridge fit's smoother; a row of no data has the reference's factor."""
    df = _read(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("state"), (F.col("o_totalprice") / 1000).alias("price"))
    table = Table("state", "categorical", (Axis("state", "category"),), [(0,), (1,), (7,)])
    fitted = Plan("gaussian").given("state", table).fit(df, "price", check=False, alpha=0.3)
    return spark.createDataFrame([(round(fitted.inference.effective_parameters, 9), float(fitted.model.tables[1].factors[2]))], "effective_parameters double, empty_row double")


_SWEPT = "WITH {policies} SELECT 'priority' AS side, o_orderpriority AS level, round(sum(claims), 3) AS balance FROM policies GROUP BY 2 UNION ALL SELECT 'segment', c_mktsegment, round(sum(claims), 3) FROM policies GROUP BY 2"


def _swept(spark: SparkSession, sf_dir: str, plan: Plan, df: DataFrame, **options) -> DataFrame:
    fitted = plan.fit(df, "frequency", solver="table", max_iterations=500, tolerance=1e-11, **FAST, **options)
    assert fitted.converged and fitted.solver_used == "table"
    scored = scoring.predict(df, fitted.model)
    side = lambda name, c: scored.groupBy(F.lit(name).alias("side"), F.col(c).alias("level")).agg(F.round(F.sum(F.col("exposure") * F.col("predictions")), 3).alias("balance"))
    return side("priority", "o_orderpriority").unionByName(side("segment", "c_mktsegment"))


@query(_SWEPT)
def table_sweep_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact steps of one table after the other end where actual equals expected in every level."""
    df = policies(spark, sf_dir)
    return _swept(spark, sf_dir, Plan.frequency("exposure").categorical("o_orderpriority").categorical("c_mktsegment").banded("o_totalprice", equal_width=4), df, accelerate=False)


@query(_SWEPT)
def accelerated_pair_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a table that nearly aliases another: the two step together, and sweeps are extrapolated."""
    df = policies(spark, sf_dir).withColumn("nearly", F.when(F.col("o_orderkey") % 50 == 0, "1-URGENT").otherwise(F.col("o_orderpriority")))
    return _swept(spark, sf_dir, Plan.frequency("exposure").categorical("o_orderpriority").categorical("nearly").categorical("c_mktsegment"), df)


@query("WITH {policies} SELECT o_orderstatus AS level, round(sum(claims), 4) AS balance FROM policies GROUP BY 1")
def given_table_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of given structure, with codes and a wildcard, fitted anew."""
    df = policies(spark, sf_dir).withColumn("code", F.ascii("o_orderstatus"))
    table = Table("status", "categorical", (Axis("code", "category"),), [(70,), (79,), (WILDCARD,)], np.array([5.0, 6.0, 7.0]))
    fitted = Plan.frequency("exposure").given("status", table).banded("o_totalprice", quantile=3).fit(df, "frequency", tolerance=1e-12, **FAST)
    return scoring.predict(df, fitted.model).groupBy(F.col("o_orderstatus").alias("level")).agg(F.round(F.sum(F.col("exposure") * F.col("predictions")), 4).alias("balance"))


# Review.


@query("""WITH {policies}, x AS (SELECT CASE WHEN o_totalprice <= 150000 THEN 0 ELSE 1 END AS a, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS b, exposure FROM policies),
c AS (SELECT sum(exposure) FILTER (WHERE a = 0 AND b = 0) AS n00, sum(exposure) FILTER (WHERE a = 0 AND b = 1) AS n01, sum(exposure) FILTER (WHERE a = 1 AND b = 0) AS n10, sum(exposure) FILTER (WHERE a = 1 AND b = 1) AS n11 FROM x),
r AS (SELECT abs(n00 * n11 - n01 * n10) / sqrt((n00 + n01) * (n10 + n11) * (n00 + n10) * (n01 + n11)) AS rho FROM c)
SELECT round(rho, 9) AS correlation, round(1 + rho, 9) AS collective_strength FROM r""")
def correlation_of_two_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two tables of two rows, the canonical correlation is phi, and the top eigenvalue one more."""
    df = policies(spark, sf_dir).withColumn("state", F.when(F.col("o_orderstatus") == "F", "F").otherwise("other"))
    got = Plan.frequency("exposure").banded("o_totalprice", breaks=[150000]).categorical("state").check(df, "frequency")
    return spark.createDataFrame([(round(got.correlated_pairs[0][2], 9), round(got.table_conditioning, 9))], "correlation double, collective_strength double")


@query("""SELECT 'Medium' AS severity, 'feature_has_nulls' AS code, 'price is null in ' || count(*) || ' rows' AS message FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT 'Medium', 'constant_feature', 'same has one value only'
UNION ALL SELECT 'Medium', 'non_positive_exposure', 'w is zero or negative in ' || count(*) || ' rows' FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT 'High', 'unmatched_observations', count(*) || ' rows match no row of price' FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT 'Medium', 'empty_levels', '1 rows of price have no exposure'""")
def plan_check_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit of faulty columns: nulls, a constant, weights of zero, a band without data."""
    df = _read(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"), F.lit("x").alias("same"), F.when(F.col("o_orderkey") % 5 != 0, 1.0).otherwise(0.0).alias("w"), F.lit(1.0).alias("y")
    )
    got = Plan.frequency("w").banded("price", breaks=[-1.0, 200000.0]).categorical("same").check(df, "y")
    return spark.createDataFrame([(i.severity, i.code, i.message) for i in got.issues], "severity string, code string, message string")


@query("SELECT count(*) || ' rows match no row of: o_orderpriority' AS message FROM orders WHERE o_orderpriority = '5-LOW'")
def unmatched_rows_stop_a_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tariff()
    m.encodings, m.target, m.exposure, m.role = {"o_orderpriority": PRIORITIES[:4]}, "o_totalprice", None, "none"
    m.tables[2].keys, m.tables[2].factors, m.tables[2].locked = m.tables[2].keys[:4], m.tables[2].factors[:4], m.tables[2].locked[:4]
    try:
        FittedModel(m).refit(_read(spark, sf_dir, "orders").select("o_totalprice", "o_orderpriority"))
        said = "none"
    except ValueError as err:
        said = str(err)
    return spark.createDataFrame([(said,)], "message string")


@query("""SELECT 'bounds_not_ascending' AS code, 'descending' AS of UNION ALL SELECT 'duplicate_bound', 'twice' UNION ALL SELECT 'duplicate_row', 'twice' UNION ALL SELECT 'no_unbounded_band', 'closed'
UNION ALL SELECT 'non_finite_factor', 'infinite' UNION ALL SELECT 'empty_table', 'empty' UNION ALL SELECT 'no_feature_columns', 'bare' UNION ALL SELECT 'missing_factor_column', 'unnamed'""")
def table_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a check of single tables finds."""
    band = lambda *rows: Table("t", "banded", (Axis("x", "band"),), [(b,) for b, _ in rows], np.array([f for _, f in rows], float))
    faulty = {
        "descending": band((2.0, 0), (1.0, 0), (math.inf, 0)), "twice": band((1.0, 0), (1.0, 1), (math.inf, 0)), "closed": band((1.0, 0), (2.0, 0)), "infinite": band((1.0, math.inf), (math.inf, 0)),
        "empty": Table("t", "banded", (Axis("x", "band"),), [], np.zeros(0)), "bare": Table("t", "intercept", (), [()], np.zeros(1)), "unnamed": pd.DataFrame({"x": [1.0]}),
    }
    return spark.createDataFrame([(i.code, name) for name, t in faulty.items() for i in audit.check_table(t)], "code string, `of` string")


@query(f"WITH {{policies}}, {_GROUPS}, c AS (SELECT least(floor(before / tw * 5), 4) AS bin, sum(wy) / sum(w) AS rate FROM o GROUP BY 1) SELECT round(max_by(rate, bin) / min_by(rate, bin), 7) AS lift FROM c")
def lift_of_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual rate of the top bucket over that of the bottom one."""
    v = FittedModel(tariff()).validate(policies(spark, sf_dir), bins=5)
    return spark.createDataFrame([(round(v.lift, 7),)], "lift double")


# Plans, models and files.


@query("""WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), e AS (SELECT [lo + (hi - lo) * i / 5 for i in range(1, 5)] AS e FROM s)
SELECT i::BIGINT AS band, round(CASE WHEN i = 0 THEN e[1] WHEN i < 4 THEN (e[i] + e[i + 1]) / 2 ELSE 2 * e[4] - e[3] END, 5) AS value FROM e, range(0, 5) AS r(i)""")
def variate_midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number that stands for each band of a variate."""
    e = bands.equal_width_edges(_read(spark, sf_dir, "lineitem"), "l_extendedprice", 5)
    return spark.createDataFrame([(i, round(float(v), 5)) for i, v in enumerate(bands.variate_values(e))], "band long, value double")


@query(f"SELECT o_orderkey, round(exp(-1.1::DOUBLE + round(({_BAND_F})::DOUBLE, 1) + round(({_PRIO_F})::DOUBLE, 1)), 10) AS predictions FROM orders")
def rounded_tariff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors rounded to one decimal, half away from zero."""
    m = tariff()
    m = Model([t.rounded(1) for t in m.tables], encodings=m.encodings)
    return scoring.predict(_read(spark, sf_dir, "orders"), m).select("o_orderkey", F.round("predictions", 10).alias("predictions"))


@query(f"WITH {{policies}} SELECT o_orderkey, round({_RATE} * (1 + o_totalprice / 100000), 9) AS expected FROM policies")
def expected_at_any_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = policies(spark, sf_dir).withColumn("years", 1 + F.col("o_totalprice") / 100000)
    return scoring.predict_expected(df, tariff(), "years").select("o_orderkey", F.round("expected", 9).alias("expected"))


@query(f"WITH {{policies}} SELECT o_orderkey, round({_RATE}, 10) AS predictions FROM policies")
def workbook_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tariff written as JSON and read back scores alike, without notes."""
    with tempfile.TemporaryDirectory() as top:
        FittedModel(tariff()).to_workbook("factor").save_json(f"{top}/w.json")
        book = Workbook.load_json(f"{top}/w.json")
    fitted = book.to_model()
    assert not book.notes
    return scoring.predict(policies(spark, sf_dir), fitted.model).select("o_orderkey", F.round("predictions", 10).alias("predictions"))


@query(f"WITH {{policies}} SELECT o_orderkey, round({_RATE}, 10) AS predictions FROM policies")
def workbook_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A foreign tariff of labelled relativities."""
    book = Workbook.from_tables(
        {"price": pd.DataFrame({"o_totalprice": EDGES, "Relativity": np.exp(BAND_FACTORS)}), "priority": pd.DataFrame({"o_orderpriority": PRIORITIES, "Relativity": np.exp(PRIORITY_FACTORS)})},
        family="poisson", base_value=math.exp(-1.1), target="frequency", exposure="exposure",
    )
    return scoring.predict(policies(spark, sf_dir), book.to_model().model).select("o_orderkey", F.round("predictions", 10).alias("predictions"))


@query("SELECT 'locked_row_missing' AS code, 1::BIGINT AS n UNION ALL SELECT 'variate_factors_edited', 1 UNION ALL SELECT 'monotonicity_violated', 1")
def workbook_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What edits of a workbook undo: a locked row, a polynomial, a direction."""
    band = (Axis("x", "band"),)
    locked = Table("locked", "categorical", (Axis("c", "category"),), [(0,), (1,)], np.zeros(2), np.array([True, False]))
    curve = Table("curve", "variate", band, [(1.0,), (2.0,), (math.inf,)], np.array([0.0, 0.1, 0.2]), values=np.array([1.0, 2.0, 3.0]), degree=1)
    steps = Table("steps", "monotone", (Axis("z", "band"),), [(1.0,), (math.inf,)], np.array([0.0, 0.1]), direction="increasing")
    book = FittedModel(Model([Table("intercept", "intercept"), locked, curve, steps])).to_workbook("factor")
    rows = {name: own for name, _, own in book.tables}
    rows["locked"][0][0], rows["curve"][1][-1], rows["steps"][1][-1] = 5, 0.7, -0.3
    book.to_model()
    return spark.createDataFrame([(i.code, 1) for i in book.notes], "code string, n long")


@query("WITH {policies} SELECT o_orderpriority AS level, round(sum(claims), 4) AS balance FROM policies GROUP BY 1")
def plan_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan written as JSON and read back fits alike; its encoding comes from another fit."""
    df = policies(spark, sf_dir)
    first = Plan.frequency("exposure").categorical("o_orderpriority").fit(df, "frequency", **FAST)
    plan = Plan.frequency("exposure").with_encoding(first).categorical("o_orderpriority").banded("c_acctbal", breaks=[0, 5000]).interaction(["o_orderstatus", "o_totalprice"], [None, [100000]])
    again = Plan.from_json(plan.to_json())
    assert again == plan
    return scoring.predict(df, again.fit(df, "frequency", **FAST).model).groupBy(F.col("o_orderpriority").alias("level")).agg(F.round(F.sum(F.col("exposure") * F.col("predictions")), 4).alias("balance"))


@query("SELECT n_regionkey::BIGINT AS code, r_name AS region, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def frame_from_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pandas frame with a category and an index, as a distributed one."""
    data = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_regionkey", "r_name").toPandas()
    data["r_name"] = data["r_name"].astype("category")
    df = from_pandas(spark, data.set_index("n_regionkey"), index_column="n_regionkey")
    return df.groupBy(F.col("n_regionkey").cast("long").alias("code"), F.col("r_name").alias("region")).agg(F.count("*").alias("nations"))


@query("""SELECT CASE WHEN l_returnflag = 'R' AND l_quantity <= 30 THEN 2 WHEN l_returnflag = 'A' THEN 3 WHEN l_quantity <= 20 THEN 0 ELSE 1 END::BIGINT AS row, count(*) AS n FROM lineitem GROUP BY 1""")
def reference_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain rule of binding, row by row of the table, for every distinct pair of values."""
    axes, codes = (Axis("l_returnflag", "category"), Axis("l_quantity", "band")), {"A": 0, "N": 1, "R": 2}
    table = Table("t", "interaction", axes, [(WILDCARD, 20.0), (WILDCARD, math.inf), (2, 30.0), (0, math.inf)], np.zeros(4))
    found: dict[int, int] = {}
    for r in _read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_quantity").count().collect():
        row = scan(table, (codes[r.l_returnflag], r.l_quantity))
        found[row] = found.get(row, 0) + r["count"]
    return spark.createDataFrame(list(found.items()), "row long, n long")


@query(f"SELECT count(*) AS rows_checked, 0.0::DOUBLE AS largest_difference, 3::BIGINT AS estimated_tables, round(sum(exp({_TREES_SQL})), 6) AS total FROM lineitem")
def booster_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A booster converted with a check of every row, saved, and read back."""
    df = _read(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_linenumber").withColumn("raw", F.expr(f"exp(cast({_TREES_SQL.replace('::DOUBLE', '')} as double))"))
    got = boosting.from_booster(TREES, df, expected="raw")
    with tempfile.TemporaryDirectory() as top:
        got.save(top)
        model = Workbook.load_json(f"{top}/workbook.json").to_model().model
        with open(f"{top}/conversion.json") as f:
            sizes = json.load(f)
    total = scoring.predict(df, model).agg(F.round(F.sum("predictions"), 6)).first()[0]
    return spark.createDataFrame([(sizes["rows_checked"], round(sizes["largest_difference"], 9), sizes["estimated_tables"], total)], "rows_checked long, largest_difference double, estimated_tables long, total double")


@query("SELECT * FROM (VALUES ('multiclass models can''t be converted'), ('averaged models, such as random forests, can''t be converted'), ('only a sigmoid of 1 can be converted'), ('objective lambdarank can''t be converted')) AS v(message)")
def conversion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosters that tables can't express are refused."""
    said = []
    for more in ({"num_class": 3}, {"average_output": True}, {"objective": "binary sigmoid:2"}, {"objective": "lambdarank"}):
        try:
            boosting.from_lightgbm(json.dumps({**TREES, **more}))
        except ValueError as err:
            said.append((str(err).split(";")[0],))
    return spark.createDataFrame(said, "message string")


@query("SELECT 'rate' AS kind, 'exposure' AS role, 'o_totalprice,o_orderpriority' AS columns UNION ALL SELECT 'count', 'offset', 'o_totalprice,o_orderpriority,exposure' UNION ALL SELECT 'response', 'none', 'o_totalprice,o_orderpriority'")
def prediction_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model's predictions are, and the columns that scoring reads."""
    rows = []
    for role, name in (("weight", "exposure"), ("offset", "offset"), ("none", "none")):
        m = tariff("offset" if role == "offset" else "weight")
        if role == "none":
            m = Model(m.tables, encodings=m.encodings, target="frequency")
        rows.append((scoring.kind_of(m), name, ",".join(scoring.input_schema(m)["columns"])))
    return spark.createDataFrame(rows, "kind string, role string, columns string")


@query("WITH {policies} SELECT sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS unmatched, round(sum(CASE WHEN o_orderstatus = 'F' THEN exp(0.5) WHEN o_orderstatus = 'O' THEN exp(0.25) ELSE 0 END), 6) AS total FROM policies")
def replaced_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and a response given to a model of codes."""
    m = Model([Table("intercept", "intercept"), Table("s", "categorical", (Axis("o_orderstatus", "category"),), [(0,), (1,)], np.array([0.5, 0.25]))])
    fitted = FittedModel(m).with_categories({"o_orderstatus": ["F", "O"]}).with_response("claims", "exposure", "weight")
    assert fitted.prediction_kind == "rate" and fitted.target == "claims"
    got = fitted.predict_diagnostics(policies(spark, sf_dir))
    return got.agg(F.count(F.when(F.col("status") == "unmatched", 1)).alias("unmatched"), F.round(F.sum("predictions"), 6).alias("total"))


@query("WITH {policies} SELECT count(*) FILTER (WHERE o_totalprice > 400000) AS unmatched, 'High' AS severity, 'unmatched_observations' AS code FROM policies")
def validation_finds_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows beyond the last band count as unmatched in a validation, and are its first finding."""
    m = tariff()
    m.tables[1].keys = [(100000.0,), (200000.0,), (300000.0,), (400000.0,)]
    v = validation.validate(policies(spark, sf_dir), m)
    return spark.createDataFrame([(v.unmatched_rows, v.warnings[0].severity, v.warnings[0].code)], "unmatched long, severity string, code string")
