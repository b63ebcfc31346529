"""Registered queries of the rating engine and their SQL equivalents.

Fits are iterative, so their SQL states what holds at the optimum: group means of saturated models, balance of
canonical scores, closed forms of standard errors.  Everything else is plain SQL over literal tables.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bands
from .operators import algebra, audit, boosting, scoring, validation
from .operators.binding import bind
from .operators.fitted import FittedModel
from .operators.oneway import one_way
from .plans.plan import Plan, levels
from .plans.tables import WILDCARD, Axis, Model, Table
from .sources.frames import POLICIES_SQL, policies
from .sources.workbook import Workbook

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
EDGES = [100000.0, 200000.0, 300000.0, math.inf]
BAND_FACTORS = [0.0, 0.02, -0.01, 0.05]
PRIORITY_FACTORS = [0.0, 0.03, -0.02, 0.01, -0.04]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql.replace("{policies}", POLICIES_SQL)
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency_tables(spark, sf_dir)


def tariff(role: str = "weight") -> Model:
    """A literal frequency tariff over the policy view."""
    return Model(
        [
            Table("intercept", "intercept", factors=np.array([-1.1])),
            Table("o_totalprice", "banded", (Axis("o_totalprice", "band"),), [(e,) for e in EDGES], np.array(BAND_FACTORS)),
            Table("o_orderpriority", "categorical", (Axis("o_orderpriority", "category"),), [(i,) for i in range(5)], np.array(PRIORITY_FACTORS)),
        ],
        encodings={"o_orderpriority": PRIORITIES}, target="frequency" if role == "weight" else "claims", exposure="exposure", role=role,
    )


_BAND_ROW = "CASE WHEN o_totalprice <= 100000 THEN 0 WHEN o_totalprice <= 200000 THEN 1 WHEN o_totalprice <= 300000 THEN 2 ELSE 3 END"
_BAND_F = "CASE WHEN o_totalprice <= 100000 THEN 0.0 WHEN o_totalprice <= 200000 THEN 0.02 WHEN o_totalprice <= 300000 THEN -0.01 ELSE 0.05 END"
_PRIO_ROW = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 4 END"
_PRIO_F = "CASE o_orderpriority WHEN '1-URGENT' THEN 0.0 WHEN '2-HIGH' THEN 0.03 WHEN '3-MEDIUM' THEN -0.02 WHEN '4-NOT SPECIFIED' THEN 0.01 ELSE -0.04 END"
_RATE = f"exp(-1.1::DOUBLE + ({_BAND_F})::DOUBLE + ({_PRIO_F})::DOUBLE)"


def _long(c: str) -> Column:
    return F.col(c).cast("long").alias(c)


# Fits.


@query()
def frequency_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating tables of the audited frequency model: bands at quantiles and a category."""
    plan = Plan.frequency("exposure").banded("o_totalprice", quantile=5).categorical("o_orderpriority")
    return plan.fit(policies(spark, sf_dir), "frequency").rating_frame(spark)


def _balance(fitted: FittedModel, df: DataFrame, column: str) -> DataFrame:
    return scoring.predict(df, fitted.model).groupBy(F.col(column).alias("level")).agg(F.round(F.sum(F.col("exposure") * F.col("predictions")), 4).alias("balance"))


@query("WITH {policies} SELECT o_orderpriority AS level, round(sum(claims), 4) AS balance FROM policies GROUP BY 1")
def poisson_score_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected claims by level of a main-effects Poisson fit equal actual ones."""
    df = policies(spark, sf_dir)
    plan = Plan.frequency("exposure").banded("o_totalprice", quantile=5).categorical("o_orderpriority").categorical("c_mktsegment")
    return _balance(plan.fit(df, "frequency", check=False, compute_standard_errors=False), df, "o_orderpriority")


@query("WITH {policies} SELECT o_orderstatus AS level, round(sum(claims), 4) AS balance FROM policies GROUP BY 1")
def poisson_offset_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with log exposure as an offset and counts as the target."""
    df = policies(spark, sf_dir)
    fitted = Plan("poisson", "exposure").categorical("o_orderstatus").banded("o_totalprice", equal_width=6).fit(df, "claims", check=False, compute_standard_errors=False)
    return scoring.predict(df, fitted.model).groupBy(F.col("o_orderstatus").alias("level")).agg(F.round(F.sum("predictions"), 4).alias("balance"))


@query("WITH {policies} SELECT o_orderstatus || '/' || c_mktsegment AS level, round(sum(claims), 4) AS balance FROM policies GROUP BY 1")
def hierarchical_interaction_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main effects with their contrast balance in every cell."""
    df = policies(spark, sf_dir)
    plan = Plan.frequency("exposure").categorical("o_orderstatus").categorical("c_mktsegment").interaction(["o_orderstatus", "c_mktsegment"], [None, None])
    fitted = plan.fit(df, "frequency", check=False, compute_standard_errors=False)
    return _balance(fitted, df.withColumn("cell", F.concat_ws("/", "o_orderstatus", "c_mktsegment")), "cell")


@query("SELECT l_returnflag AS level, round(sum(l_extendedprice / l_quantity), 2) AS balance FROM lineitem GROUP BY 1")
def gaussian_score_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_quantity", "l_discount", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    fitted = Plan("gaussian").banded("l_quantity", breaks=[10, 20, 30, 40]).banded("l_discount", breaks=[0.03, 0.06]).categorical("l_returnflag").fit(df, "price", check=False, compute_standard_errors=False)
    return scoring.predict(df, fitted.model).groupBy(F.col("l_returnflag").alias("level")).agg(F.round(F.sum("predictions"), 2).alias("balance"))


@query("WITH {policies} SELECT c_mktsegment AS level, round(sum(CASE WHEN claims > 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS balance FROM policies GROUP BY 1")
def binomial_score_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = policies(spark, sf_dir).withColumn("claimed", (F.col("claims") > 0).cast("double"))
    fitted = Plan("binomial").banded("o_totalprice", equal_width=5).categorical("c_mktsegment").fit(df, "claimed", check=False, compute_standard_errors=False)
    return scoring.predict(df, fitted.model).groupBy(F.col("c_mktsegment").alias("level")).agg(F.round(F.sum("predictions"), 4).alias("balance"))


@query("WITH {policies} SELECT c_mktsegment AS level, round(sum(claims), 4) AS balance FROM policies WHERE claims > 0 GROUP BY 1")
def gamma_score_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights equal sums of weighted response over mean, by level of a severity fit."""
    df = policies(spark, sf_dir).where("claims > 0").withColumn("severity", F.col("loss") / F.col("claims"))
    fitted = Plan.severity("claims").banded("o_totalprice", quantile=6).categorical("c_mktsegment").fit(df, "severity", check=False, compute_standard_errors=False)
    return scoring.predict(df, fitted.model).groupBy(F.col("c_mktsegment").alias("level")).agg(F.round(F.sum(F.col("claims") * F.col("severity") / F.col("predictions")), 4).alias("balance"))


@query("WITH {policies} SELECT o_orderpriority AS level, round(0.0::DOUBLE, 3) AS balance FROM policies GROUP BY 1")
def tweedie_score_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of a pure premium fit vanishes by level."""
    df = policies(spark, sf_dir)
    fitted = Plan.pure_premium("exposure").banded("o_totalprice", quantile=4).categorical("o_orderpriority").fit(df, "premium", check=False, compute_standard_errors=False, tolerance=1e-12)
    p = F.col("predictions")
    score = F.sum(F.col("exposure") * (F.col("premium") - p) * F.pow(p, -0.5))
    return scoring.predict(df, fitted.model).groupBy(F.col("o_orderpriority").alias("level")).agg((F.round(score, 3) + 0.0).alias("balance"))


def _saturated(fitted: FittedModel, spark: SparkSession, column: str, digits: int) -> DataFrame:
    t, head = fitted.model.tables[1], float(fitted.model.tables[0].factors[0])
    mean = {"identity": lambda v: v, "log": math.exp, "logit": lambda v: 1 / (1 + math.exp(-v))}[fitted.model.link]
    rows = [(fitted.model.encodings[column][k[0]], round(mean(head + float(f)), digits)) for k, f in zip(t.keys, t.factors)]
    return spark.createDataFrame(rows, "level string, mean double")


@query("WITH {policies} SELECT o_orderpriority AS level, round(sum(claims) / sum(exposure), 8) AS mean FROM policies GROUP BY 1")
def saturated_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saturated(Plan.frequency("exposure").categorical("o_orderpriority").fit(policies(spark, sf_dir), "frequency", check=False, compute_standard_errors=False), spark, "o_orderpriority", 8)


@query("WITH {policies} SELECT c_mktsegment AS level, round(sum(loss) / sum(claims), 3) AS mean FROM policies WHERE claims > 0 GROUP BY 1")
def saturated_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = policies(spark, sf_dir).where("claims > 0").withColumn("severity", F.col("loss") / F.col("claims"))
    return _saturated(Plan.severity("claims").categorical("c_mktsegment", base="first").fit(df, "severity", check=False, compute_standard_errors=False, tolerance=1e-12), spark, "c_mktsegment", 3)


@query("WITH {policies} SELECT o_orderstatus AS level, round(sum(loss) / sum(exposure), 3) AS mean FROM policies GROUP BY 1")
def saturated_tweedie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saturated(Plan.pure_premium("exposure").categorical("o_orderstatus").fit(policies(spark, sf_dir), "premium", check=False, compute_standard_errors=False, tolerance=1e-12), spark, "o_orderstatus", 3)


@query("SELECT l_returnflag AS level, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1")
def saturated_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_extendedprice")
    return _saturated(Plan("gaussian").categorical("l_returnflag").fit(df, "l_extendedprice", check=False, compute_standard_errors=False, tolerance=1e-13), spark, "l_returnflag", 4)


@query("SELECT lang AS level, round(avg(quality), 8) AS mean FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def saturated_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    return _saturated(Plan("binomial").categorical("lang").fit(df, "quality", check=False, compute_standard_errors=False, tolerance=1e-13), spark, "lang", 8)


_LEVEL_SQL = """
WITH {policies}, l AS (SELECT o_orderstatus AS level, sum(claims) AS c, sum(exposure) AS e FROM policies GROUP BY 1),
m AS (SELECT p.o_orderstatus AS level, sum(power(exposure * (frequency - c / e), 2)) AS s FROM policies p JOIN l ON p.o_orderstatus = l.level GROUP BY 1),
b AS (SELECT l.level, c, e, s FROM l JOIN m USING (level) ORDER BY e DESC LIMIT 1)
"""


def _errors(fitted: FittedModel, spark: SparkSession, digits: int = 8) -> DataFrame:
    t = fitted.model.tables[1]
    rows = [(fitted.model.encodings["o_orderstatus"][k[0]], round(float(e), digits)) for k, e in zip(t.keys, fitted.inference.errors[1])]
    return spark.createDataFrame(rows, "level string, standard_error double")


@query(_LEVEL_SQL + "SELECT l.level, CASE WHEN l.level = b.level THEN 0.0 ELSE round(sqrt(1 / l.c + 1 / b.c), 8) END AS standard_error FROM l, b")
def model_standard_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(Plan.frequency("exposure").categorical("o_orderstatus").fit(policies(spark, sf_dir), "frequency", check=False), spark)


@query(_LEVEL_SQL + "SELECT l.level, CASE WHEN l.level = b.level THEN 0.0 ELSE round(sqrt(m.s / power(l.c, 2) + b.s / power(b.c, 2)), 8) END AS standard_error FROM l JOIN m USING (level), b")
def robust_standard_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(Plan.frequency("exposure").categorical("o_orderstatus").fit(policies(spark, sf_dir), "frequency", check=False, covariance="robust"), spark)


@query("""WITH {policies}, t AS (SELECT sum(claims) AS c, sum(exposure) AS e FROM policies),
g AS (SELECT o_custkey, sum(exposure * (frequency - t.c / t.e)) AS s FROM policies, t GROUP BY 1)
SELECT 'intercept' AS level, round(sqrt(sum(power(s, 2))) / any_value(t.c), 8) AS standard_error FROM g, t""")
def cluster_standard_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = Plan.frequency("exposure").fit(policies(spark, sf_dir), "frequency", check=False, covariance="cluster", cluster="o_custkey")
    return spark.createDataFrame([("intercept", round(float(fitted.inference.errors[0][0]), 8))], "level string, standard_error double")


@query(_LEVEL_SQL + """SELECT l.level, round(ln(l.c / l.e) - ln(b.c / b.e), 7) + 0.0 AS coefficient,
round(ln(l.c / l.e) - ln(b.c / b.e) - 1.959963984540054 * CASE WHEN l.level = b.level THEN 0 ELSE sqrt(1 / l.c + 1 / b.c) END, 7) + 0.0 AS lower,
round(ln(l.c / l.e) - ln(b.c / b.e) + 1.959963984540054 * CASE WHEN l.level = b.level THEN 0 ELSE sqrt(1 / l.c + 1 / b.c) END, 7) + 0.0 AS upper FROM l, b""")
def coefficient_interval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = Plan.frequency("exposure").categorical("o_orderstatus").fit(policies(spark, sf_dir), "frequency", check=False, tolerance=1e-12)
    got = fitted.coefficient_intervals()
    got = got[got.table == "o_orderstatus"]
    names = [fitted.model.encodings["o_orderstatus"][k[0]] for k in fitted.model.tables[1].keys]
    rows = [(n, *(round(float(v), 7) + 0.0 for v in (r.coefficient, r.lower, r.upper))) for n, r in zip(names, got.itertuples())]
    return spark.createDataFrame(rows, "level string, coefficient double, lower double, upper double")


@query(_LEVEL_SQL + """, n AS (SELECT count(*) AS n FROM policies),
d AS (SELECT sum(power(frequency - c / e, 2) / (c / e) * exposure) AS x,
  2 * sum(exposure * (CASE WHEN frequency > 0 THEN frequency * ln(frequency / (c / e)) ELSE 0 END - (frequency - c / e))) AS dev
  FROM policies p JOIN l ON p.o_orderstatus = l.level)
SELECT n - 3 AS df_residual, round(x, 4) AS pearson, round(dev, 4) AS deviance FROM n, d""")
def fit_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Plan.frequency("exposure").categorical("o_orderstatus").fit(policies(spark, sf_dir), "frequency", check=False, tolerance=1e-12).inference
    return spark.createDataFrame([(int(i.df_residual), round(i.pearson, 4), round(i.deviance, 4))], "df_residual long, pearson double, deviance double")


@query()
def term_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = Plan.frequency("exposure").banded("o_totalprice", quantile=5).categorical("o_orderpriority").fit(policies(spark, sf_dir), "frequency", check=False)
    return spark.createDataFrame(fitted.term_tests("quasi_poisson").drop(columns="reason"))


@query("WITH {policies} SELECT round(sum(claims), 3) AS actual, round(sum(claims), 3) AS expected, 1::BIGINT AS ordered FROM policies")
def monotone_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A monotone fit balances in total and its factors keep their order."""
    df = policies(spark, sf_dir)
    fitted = Plan.frequency("exposure").monotone("o_totalprice", "increasing", quantile=10).fit(df, "frequency", check=False, compute_standard_errors=False)
    ordered = int((np.diff(fitted.model.tables[1].factors) >= -1e-12).all())
    return scoring.predict(df, fitted.model).agg(F.round(F.sum("claims"), 3).alias("actual"), F.round(F.sum(F.col("exposure") * F.col("predictions")), 3).alias("expected"), F.lit(ordered).cast("long").alias("ordered"))


@query("SELECT round(sum(l_extendedprice), 0) AS actual, round(sum(l_extendedprice), 0) AS expected, round(sum(l_extendedprice * l_quantity) / 1000, 0) AS moment FROM lineitem")
def spline_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A natural spline contains straight lines, so totals and first moments balance."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", "l_extendedprice")
    fitted = Plan("gaussian").spline("l_quantity", quantile=5).fit(df, "l_extendedprice", check=False, compute_standard_errors=False, tolerance=1e-13)
    p = F.col("predictions")
    return scoring.predict(df, fitted.model).agg(F.round(F.sum("l_extendedprice"), 0).alias("actual"), F.round(F.sum(p), 0).alias("expected"), F.round(F.sum(p * F.col("l_quantity")) / 1000, 0).alias("moment"))


@query("""WITH x AS (SELECT l_extendedprice AS y, CASE WHEN l_quantity <= 10 THEN 10.0 WHEN l_quantity <= 20 THEN 15.0 WHEN l_quantity <= 30 THEN 25.0 WHEN l_quantity <= 40 THEN 35.0 ELSE 50.0 END::DOUBLE AS v FROM lineitem)
SELECT round(regr_slope(y, v), 5) AS slope, round(regr_intercept(y, v), 3) AS intercept FROM x""")
def variate_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variate of degree one is the regression line through its values."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", "l_extendedprice")
    fitted = Plan("gaussian").variate("l_quantity", breaks=[10, 20, 30, 40], values=[10, 15, 25, 35, 50]).fit(df, "l_extendedprice", check=False, compute_standard_errors=False, tolerance=1e-14)
    t, head = fitted.model.tables[1], float(fitted.model.tables[0].factors[0])
    slope = (t.factors[4] - t.factors[0]) / 40
    return spark.createDataFrame([(round(float(slope), 5), round(float(head + t.factors[0] - slope * 10), 3))], "slope double, intercept double")


@query("""WITH l AS (SELECT l_returnflag AS level, count(*)::DOUBLE AS n, sum(l_quantity) AS s FROM lineitem GROUP BY 1),
t AS (SELECT sum(n) AS n, sum(s) AS s, max(n) AS top FROM l), base AS (SELECT l.* FROM l, t WHERE l.n = t.top),
k AS (SELECT l.*, 0.05 * t.n AS pen FROM l, t WHERE l.level <> (SELECT level FROM base)),
i AS (SELECT (base.s + sum(k.s * k.pen / (k.n + k.pen))) / (base.n + sum(k.n * k.pen / (k.n + k.pen))) AS b0 FROM base, k GROUP BY base.s, base.n)
SELECT level, round((k.s - k.n * b0) / (k.n + k.pen), 8) AS coefficient FROM k, i""")
def ridge_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-factor Gaussian ridge with a free intercept."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_quantity")
    fitted = Plan("gaussian").categorical("l_returnflag").fit(df, "l_quantity", check=False, compute_standard_errors=False, alpha=0.05, tolerance=1e-13)
    t = fitted.model.tables[1]
    rows = [(fitted.model.encodings["l_returnflag"][k[0]], round(float(f), 8)) for k, f in zip(t.keys[1:], t.factors[1:])]
    return spark.createDataFrame(rows, "level string, coefficient double")


@query()
def elastic_net_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan.pure_premium("exposure").banded("o_totalprice", quantile=8).categorical("o_orderpriority").categorical("c_mktsegment")
    return plan.fit(policies(spark, sf_dir), "premium", check=False, alpha=0.01, l1_ratio=0.5).rating_frame(spark)


@query("WITH {policies} SELECT o_orderstatus AS level, round(sum(claims), 4) AS balance FROM policies GROUP BY 1")
def prior_offset_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new factor on top of a fixed prior model balances by its levels."""
    df = policies(spark, sf_dir)
    fitted = Plan.frequency("exposure").offset_model(FittedModel(tariff())).categorical("o_orderstatus").fit(df, "frequency", check=False, compute_standard_errors=False)
    return _balance(fitted, df, "o_orderstatus")


@query("WITH {policies} SELECT o_orderpriority AS level, round(sum(claims), 4) AS balance FROM policies WHERE o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY 1")
def refit_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of one period with factors of a later one."""
    df = policies(spark, sf_dir)
    late = df.where("o_orderdate >= timestamp'2000-01-01'")
    old = Plan.frequency("exposure").banded("o_totalprice", breaks=[150000, 300000]).categorical("o_orderpriority").fit(df.where("o_orderdate < timestamp'2000-01-01'"), "frequency", check=False, compute_standard_errors=False)
    return _balance(old.refit(late, compute_standard_errors=False), late, "o_orderpriority")


# Preparation.


@query("""WITH s AS (SELECT list_sort(list(o_totalprice)) AS v, count(*) AS n FROM orders)
SELECT i::BIGINT AS band, v[ceil(i / 7.0::DOUBLE * n)::BIGINT] AS edge FROM s, range(1, 7) AS r(i)""")
def quantile_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bands.quantile_edges(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_totalprice", 7)
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(e[:-1])], "band long, edge double")


@query("SELECT i::BIGINT AS band, round(lo + (hi - lo) * i / 6, 6) AS edge FROM (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), range(1, 6) AS r(i)")
def equal_width_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bands.equal_width_edges(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_extendedprice", 6)
    return spark.createDataFrame([(i + 1, round(v, 6)) for i, v in enumerate(e[:-1])], "band long, edge double")


@query("""WITH s AS (SELECT list_sort(list(l_quantity)) AS v, count(*) AS n FROM lineitem)
SELECT DISTINCT v[greatest(1, ceil(i / 4.0::DOUBLE * n)::BIGINT)] AS knot FROM s, range(0, 5) AS r(i)""")
def spline_knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in bands.knots(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_quantity", quantile=5)], "knot double")


@query("WITH {policies} SELECT c_mktsegment AS label, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code, round(sum(exposure), 4) AS exposure FROM policies GROUP BY 1")
def encoded_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, found = levels(Plan.frequency("exposure").categorical("c_mktsegment"), policies(spark, sf_dir))
    return spark.createDataFrame([(codes["c_mktsegment"][c], c, round(w, 4)) for c, w in found["c_mktsegment"]], "label string, code long, exposure double")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN round(ln(o_totalprice - 250000), 9) ELSE -1e300 END AS log_exposure FROM orders")
def log_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithm of an exposure, minus infinity at zero and below, shown as -1e300."""
    from .operators.cells import response

    df = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("exposure", F.greatest(F.col("o_totalprice") - 250000, F.lit(0.0)))
    o = response(tariff("offset"))[2]
    return df.select("o_orderkey", F.when(o == float("-inf"), -1e300).otherwise(F.round(o, 9)).alias("log_exposure"))


# Binding.


def _counts(df: DataFrame, t: Table, encodings: dict | None = None) -> DataFrame:
    return bind(df, Model([t], encodings=encodings or {})).groupBy(F.coalesce("_row0", F.lit(-1)).cast("long").alias("row")).agg(F.count("*").alias("n"))


@query(f"SELECT ({_BAND_ROW})::BIGINT AS row, count(*) AS n FROM orders GROUP BY 1")
def bind_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark.read.parquet(f"{sf_dir}/orders.parquet"), tariff().tables[1])


@query("SELECT CASE o_orderpriority WHEN '2-HIGH' THEN 0 WHEN '5-LOW' THEN 1 ELSE 2 END::BIGINT AS row, count(*) AS n FROM orders GROUP BY 1")
def bind_category_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table("p", "categorical", (Axis("o_orderpriority", "category"),), [(1,), (4,), (WILDCARD,)])
    return _counts(spark.read.parquet(f"{sf_dir}/orders.parquet"), t, {"o_orderpriority": PRIORITIES})


@query("""SELECT CASE WHEN l_tax > 0.06 OR l_quantity > 40 THEN -1 ELSE
(CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 25 THEN 1 ELSE 2 END) * 3 + CASE WHEN l_tax <= 0.02 THEN 0 WHEN l_tax <= 0.04 THEN 1 ELSE 2 END END::BIGINT AS row, count(*) AS n FROM lineitem GROUP BY 1""")
def bind_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A complete numeric grid; values past its last bounds match nothing."""
    t = Table("g", "interaction", (Axis("l_quantity", "band"), Axis("l_tax", "band")), [(q, x) for q in (10.0, 25.0, 40.0) for x in (0.02, 0.04, 0.06)])
    return _counts(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), t)


@query("""SELECT CASE WHEN l_returnflag = 'R' AND l_quantity <= 30 THEN 2 WHEN l_returnflag = 'A' THEN 3 WHEN l_quantity <= 20 THEN 0 ELSE 1 END::BIGINT AS row, count(*) AS n FROM lineitem GROUP BY 1""")
def bind_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An irregular table: fewest wildcards first, then the first row."""
    t = Table("m", "given", (Axis("l_quantity", "band"), Axis("l_returnflag", "category")), [(20.0, WILDCARD), (math.inf, WILDCARD), (30.0, 2), (math.inf, 0)])
    return _counts(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), t, {"l_returnflag": ["A", "N", "R"]})


# Scoring.


@query(f"WITH {{policies}} SELECT o_orderkey, round({_RATE}, 10) AS predictions FROM policies")
def score_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.predict(policies(spark, sf_dir), tariff()).select("o_orderkey", F.round("predictions", 10).alias("predictions"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' OR o_totalprice > 400000 THEN 'unmatched' ELSE 'ok' END AS status,
concat_ws(', ', CASE WHEN o_totalprice > 400000 THEN 'o_totalprice' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'o_orderpriority' END) AS unmatched_tables FROM orders""")
def score_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tariff()
    m.tables[1].keys = [(100000.0,), (200000.0,), (300000.0,), (400000.0,)]
    m.encodings = {"o_orderpriority": PRIORITIES[:4]}
    m.tables[2].keys, m.tables[2].factors = m.tables[2].keys[:4], m.tables[2].factors[:4]
    return scoring.predict_diagnostics(spark.read.parquet(f"{sf_dir}/orders.parquet"), m).select("o_orderkey", "status", "unmatched_tables")


@query(f"WITH {{policies}} SELECT o_orderkey, round({_RATE}, 10) AS rate, round({_RATE} * exposure, 10) AS expected_count FROM policies")
def score_rate_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, m = policies(spark, sf_dir), tariff("offset")
    out = scoring.predict_rate(df, m)
    return out.select("o_orderkey", F.round("rate", 10).alias("rate"), F.round(F.col("rate") * F.col("exposure"), 10).alias("expected_count"))


@query(f"""WITH x AS (SELECT o_orderkey, unnest(['intercept', 'o_totalprice', 'o_orderpriority']) AS term, unnest([0::BIGINT, ({_BAND_ROW})::BIGINT, ({_PRIO_ROW})::BIGINT]) AS table_row,
unnest([-1.1::DOUBLE, ({_BAND_F})::DOUBLE, ({_PRIO_F})::DOUBLE]) AS coefficient FROM orders)
SELECT o_orderkey, term, table_row, coefficient, round(exp(coefficient), 10) AS multiplier FROM x""")
def explain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tariff()
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    _, each = scoring.explain(orders, Model(m.tables, encodings=m.encodings), key="o_orderkey")
    return each.select("o_orderkey", "term", _long("table_row"), "coefficient", F.round("multiplier", 10).alias("multiplier"))


@query(f"SELECT o_orderkey, -1.1::DOUBLE AS intercept_component, ({_BAND_F})::DOUBLE AS o_totalprice_component, ({_PRIO_F})::DOUBLE AS o_orderpriority_component FROM orders")
def score_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.predict_components(spark.read.parquet(f"{sf_dir}/orders.parquet"), tariff())
    return out.select("o_orderkey", "intercept_component", "o_totalprice_component", "o_orderpriority_component")


# Review.


@query("SELECT CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 25 THEN 1 WHEN l_quantity <= 60 THEN 2 END::BIGINT AS row, round(sum(l_discount * l_tax) / sum(l_tax), 9) AS l_discount_avg, round(sum(l_tax), 4) AS weight FROM lineitem GROUP BY 1 UNION ALL SELECT 3, 0.0, 0.0")
def one_way_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted means by band; a band without data is kept with zeros."""
    t = Table("l_quantity", "banded", (Axis("l_quantity", "band"),), [(10.0,), (25.0,), (60.0,), (math.inf,)])
    out = one_way(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), t, "l_discount", "l_tax")
    return out.select(_long("row"), F.round("l_discount_avg", 9).alias("l_discount_avg"), F.round("weight", 4).alias("weight"))


@query(f"WITH {{policies}} SELECT ({_BAND_ROW})::BIGINT AS row, count(*) AS n, round(sum(exposure), 4) AS exposure, round(sum(claims), 4) AS actual, round(sum(exposure * {_RATE}), 4) AS expected FROM policies GROUP BY 1")
def actual_vs_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = validation.scored_rows(policies(spark, sf_dir), tariff())
    return s.groupBy(_long("_row1").alias("row")).agg(F.count("*").alias("n"), F.round(F.sum("_w"), 4).alias("exposure"), F.round(F.sum(F.col("_w") * F.col("_y")), 4).alias("actual"), F.round(F.sum(F.col("_w") * F.col("_mu")), 4).alias("expected"))


_GROUPS = f"""g AS (SELECT {_BAND_ROW} AS b, {_PRIO_ROW} AS p, any_value({_RATE}) AS mu, count(*) AS n, sum(exposure) AS w, sum(claims) AS wy FROM policies GROUP BY 1, 2),
h AS (SELECT mu, sum(n) AS n, sum(w) AS w, sum(wy) AS wy FROM g GROUP BY 1),
o AS (SELECT *, sum(w) OVER (ORDER BY mu) - w AS before, sum(wy) OVER (ORDER BY mu) - wy AS ybefore, sum(w) OVER () AS tw, sum(wy) OVER () AS ty FROM h)"""


@query(f"WITH {{policies}}, {_GROUPS} SELECT least(floor(before / tw * 8), 7)::BIGINT AS bin, sum(n)::BIGINT AS n, round(sum(w), 4) AS weight, round(sum(wy), 4) AS actual, round(sum(w * mu), 4) AS expected FROM o GROUP BY 1")
def calibration_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = validation.by_prediction(validation.scored_rows(policies(spark, sf_dir), tariff()))
    total = policies(spark, sf_dir).agg(F.sum("exposure")).first()[0]
    out = validation.calibration(groups, total, 8)
    return out.select("bin", F.col("n").cast("long").alias("n"), *[F.round(c, 4).alias(c) for c in ("weight", "actual", "expected")])


@query(f"WITH {{policies}}, {_GROUPS} SELECT round(1 - sum(w / tw * (2 * ybefore + wy) / ty), 9) AS gini FROM o")
def gini_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = validation.by_prediction(validation.scored_rows(policies(spark, sf_dir), tariff())).persist()
    r = groups.agg(F.sum("w"), F.sum("wy")).first()
    gini = round(validation.gini(groups, r[0], r[1]), 9)
    groups.unpersist()
    return spark.createDataFrame([(gini,)], "gini double")


@query(f"""WITH {{policies}}, s AS (SELECT *, {_RATE} AS mu FROM policies), t AS (SELECT sum(claims) / sum(exposure) AS m FROM policies),
d AS (SELECT 2 * sum(exposure * (CASE WHEN frequency > 0 THEN frequency * ln(frequency / mu) ELSE 0 END - (frequency - mu))) AS dev,
2 * sum(exposure * (CASE WHEN frequency > 0 THEN frequency * ln(frequency / m) ELSE 0 END - (frequency - m))) AS nul, sum(claims) / sum(exposure * mu) AS ae, count(*) AS n FROM s, t)
SELECT n AS n_rows, round(dev, 4) AS deviance, round(nul, 4) AS null_deviance, round(1 - dev / nul, 8) AS pseudo_r2, round(ae, 8) AS ae_ratio FROM d""")
def validation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = FittedModel(tariff()).validate(policies(spark, sf_dir))
    return spark.createDataFrame([(v.n_rows, round(v.deviance, 4), round(v.null_deviance, 4), round(v.pseudo_r2, 8), round(v.ae_ratio, 8))], "n_rows long, deviance double, null_deviance double, pseudo_r2 double, ae_ratio double")


@query()
def plan_check_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan.frequency("exposure").banded("o_totalprice", quantile=20).categorical("o_orderpriority").categorical("c_nationkey").banded("c_acctbal", breaks=[0, 5000])
    got = plan.check(policies(spark, sf_dir), "frequency")
    return spark.createDataFrame([(i.severity, i.code, i.message) for i in got.issues] or [("Low", "none", "no issue")], "severity string, code string, message string")


@query("WITH {policies} SELECT CASE WHEN o_totalprice <= 250000 THEN 0 ELSE 1 END::BIGINT AS row_a, (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END)::BIGINT AS row_b, round(sum(exposure), 4) AS weight FROM policies GROUP BY 1, 2")
def table_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure by rows of two tables: what table correlations are made of."""
    m = Model([Table("a", "banded", (Axis("o_totalprice", "band"),), [(250000.0,), (math.inf,)]), Table("b", "categorical", (Axis("o_orderstatus", "category"),), [(0,), (1,), (2,)])], encodings={"o_orderstatus": ["F", "O", "P"]})
    counts = audit.contingency(bind(policies(spark, sf_dir), m), 0, 1, 2, 3, F.col("exposure"))
    return spark.createDataFrame([(i, j, round(float(counts[i, j]), 4)) for i in range(2) for j in range(3) if counts[i, j]], "row_a long, row_b long, weight double")


@query()
def table_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = Plan.frequency("exposure").banded("o_totalprice", quantile=8).categorical("o_orderpriority").categorical("c_mktsegment").check(policies(spark, sf_dir), "frequency")
    return spark.createDataFrame(got.correlated_pairs, "table_a string, table_b string, correlation double")


# Model algebra.


@query(f"SELECT o_orderkey, round(-1.6::DOUBLE + ({_BAND_F})::DOUBLE + ({_PRIO_F})::DOUBLE + CASE WHEN o_orderstatus = 'F' THEN 0.1 ELSE -0.1 END + CASE WHEN o_totalprice <= 150000 THEN 0.0 ELSE 0.07 END, 10) AS linear_predictor FROM orders")
def combined_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models added, then consolidated into fewer tables."""
    other = Model(
        [Table("intercept", "intercept", factors=np.array([-0.5])), Table("s", "categorical", (Axis("o_orderstatus", "category"),), [(0,), (WILDCARD,)], np.array([0.1, -0.1])), Table("p2", "banded", (Axis("o_totalprice", "band"),), [(150000.0,), (math.inf,)], np.array([0.0, 0.07]))],
        encodings={"o_orderstatus": ["F", "O", "P"]},
    )
    m = algebra.consolidate(algebra.combine(tariff(), other), "analysis")
    out = scoring.predict_linear(spark.read.parquet(f"{sf_dir}/orders.parquet"), m)
    return out.select("o_orderkey", F.round("linear_predictor", 10).alias("linear_predictor"))


#: A small boosted model of three trees over lineitem.
TREES = {
    "objective": "poisson", "num_class": 1, "num_tree_per_iteration": 1, "feature_names": ["l_quantity", "l_discount", "l_linenumber"],
    "tree_info": [
        {"tree_structure": {"split_feature": 0, "threshold": 24.5, "decision_type": "<=", "default_left": True, "missing_type": "NaN", "internal_value": -0.2, "left_child": {"leaf_value": -0.25},
                            "right_child": {"split_feature": 1, "threshold": 0.045, "decision_type": "<=", "default_left": False, "missing_type": "None", "internal_value": -0.15, "left_child": {"leaf_value": -0.18}, "right_child": {"leaf_value": -0.11}}}},
        {"tree_structure": {"split_feature": 2, "threshold": "1||3", "decision_type": "==", "default_left": False, "missing_type": "None", "internal_value": 0.0, "left_child": {"leaf_value": 0.03}, "right_child": {"leaf_value": -0.02}}},
        {"tree_structure": {"leaf_value": 0.005}},
    ],
}
_TREES_SQL = """CASE WHEN l_quantity <= 24.5 THEN -0.25 WHEN l_discount <= 0.045 THEN -0.18 ELSE -0.11 END::DOUBLE + CASE WHEN l_linenumber IN (1, 3) THEN 0.03 ELSE -0.02 END::DOUBLE + 0.005::DOUBLE"""


@query(f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(exp({_TREES_SQL}), 10) AS predictions FROM lineitem")
def converted_booster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees as tables give the trees' predictions in every row."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return scoring.predict(df, boosting.from_lightgbm(json.dumps(TREES), "max")).select("l_orderkey", _long("l_linenumber"), F.round("predictions", 10).alias("predictions"))


@query(f"SELECT count(*) AS n, round(sum(exp({_TREES_SQL})), 6) AS total FROM lineitem")
def converted_booster_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linenumber", "l_quantity", "l_discount")
    return scoring.predict(df, boosting.from_lightgbm(json.dumps(TREES), "analysis")).agg(F.count("*").alias("n"), F.round(F.sum("predictions"), 6).alias("total"))


@query("SELECT 3::BIGINT AS tables")
def estimated_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(boosting.estimate_num_tables(json.dumps(TREES)),)], "tables long")


@query(f"WITH {{policies}} SELECT o_orderkey, round({_RATE}, 10) AS predictions FROM policies")
def workbook_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tariff written as relativities and read back scores alike."""
    import tempfile

    with tempfile.TemporaryDirectory() as top:
        FittedModel(tariff()).to_workbook().save_csv_dir(top)
        m = Workbook.load_csv_dir(top).to_model().model
    return scoring.predict(policies(spark, sf_dir), m).select("o_orderkey", F.round("predictions", 10).alias("predictions"))


from . import closed_forms  # noqa: E402, F401  registers its queries here
