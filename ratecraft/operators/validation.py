"""Validation of a model against actuals: totals, actual to expected, calibration, lift and Gini."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.families import Family
from ..plans.tables import Model
from .cells import response
from .scoring import score

#: Distinct predictions that may be ordered on the driver; more are ordered by range partitions.
FEW = 200_000


@dataclass
class Finding:
    severity: str
    code: str
    message: str


@dataclass
class Validation:
    n_rows: int
    n_scored: int
    unmatched_rows: int
    deviance: float
    null_deviance: float
    pseudo_r2: float
    total_weight: float
    total_actual: float
    total_expected: float
    ae_ratio: float
    lift: float
    gini: float
    calibration: pd.DataFrame
    actual_vs_expected: dict[str, pd.DataFrame]
    warnings: list[Finding] = field(default_factory=list)

    @property
    def is_usable(self) -> bool:
        return not any(f.severity == "High" for f in self.warnings)


def by_prediction(scored: DataFrame) -> DataFrame:
    """(mu, n, w, wy, wmu) of each distinct prediction of a frame with _mu, _y and _w."""
    return scored.groupBy(F.col("_mu").alias("mu")).agg(F.count("*").alias("n"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_y")).alias("wy"), F.sum(F.col("_w") * F.col("_mu")).alias("wmu"))


def running(groups: DataFrame) -> DataFrame:
    """Adds (before, actual_before): sums of w and wy over smaller predictions.

    At most FEW predictions are summed on the driver; more by range partitions, of which only the
    totals, one row each, are broadcast.
    """
    few = groups.limit(FEW + 1).toPandas()
    if len(few) <= FEW:
        few = few.sort_values("mu", kind="stable")
        few["before"], few["actual_before"] = few.w.cumsum() - few.w, few.wy.cumsum() - few.wy
        kinds = ", ".join(f"{c} {t}" for c, t in groups.dtypes) + ", before double, actual_before double"
        return groups.sparkSession.createDataFrame(few, kinds)
    own = groups.repartitionByRange("mu").withColumn("_p", F.spark_partition_id()).persist()
    sums = own.groupBy("_p").agg(F.sum("w").alias("sw"), F.sum("wy").alias("sy"))
    upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_p", F.coalesce(F.sum("sw").over(upto), F.lit(0.0)).alias("bw"), F.coalesce(F.sum("sy").over(upto), F.lit(0.0)).alias("by"))
    within = Window.partitionBy("_p").orderBy("mu").rowsBetween(Window.unboundedPreceding, -1)
    out = own.withColumns({"cw": F.coalesce(F.sum("w").over(within), F.lit(0.0)), "cy": F.coalesce(F.sum("wy").over(within), F.lit(0.0))}).join(F.broadcast(base), "_p")
    return out.withColumn("before", F.col("bw") + F.col("cw")).withColumn("actual_before", F.col("by") + F.col("cy")).drop("_p", "bw", "by", "cw", "cy")


def calibration(groups: DataFrame, total_weight: float, bins: int) -> DataFrame:
    """Equal-exposure buckets of ordered predictions; equal predictions stay together."""
    at = F.least(F.floor(F.col("before") / F.lit(total_weight) * bins), F.lit(bins - 1)).cast("long")
    got = running(groups).groupBy(at.alias("bin")).agg(F.sum("n").alias("n"), F.sum("w").alias("weight"), F.sum("wy").alias("actual"), F.sum("wmu").alias("expected"))
    return got.withColumns({
        "mean_predicted": F.try_divide("expected", "weight"), "actual_rate": F.try_divide("actual", "weight"),
        "expected_rate": F.try_divide("expected", "weight"), "ae_ratio": F.try_divide("actual", "expected"),
    })


def gini(groups: DataFrame, total_weight: float, total_actual: float) -> float:
    """Weighted Gini of the order of predictions; ties advance as one block."""
    if total_weight <= 0 or total_actual == 0:
        return math.nan
    area = F.col("w") / F.lit(total_weight) * (2 * F.col("actual_before") + F.col("wy")) / F.lit(2 * total_actual)
    return 1 - 2 * float(running(groups).agg(F.sum(area)).first()[0])


def actual_vs_expected(scored: DataFrame, model: Model, labels: dict[int, pd.DataFrame]) -> dict[str, pd.DataFrame]:
    """A/E by row of every table but the intercept; rows without data are kept with zeros."""
    out = {}
    for i, t in enumerate(model.tables):
        if not t.axes:
            continue
        got = scored.groupBy(F.col(f"_row{i}").alias("row")).agg(F.count("*").alias("N"), F.sum("_w").alias("Exposure"), F.sum(F.col("_w") * F.col("_y")).alias("Actual"), F.sum(F.col("_w") * F.col("_mu")).alias("Expected")).toPandas()
        full = labels[i].merge(got, on="row", how="left").fillna({"N": 0, "Exposure": 0.0, "Actual": 0.0, "Expected": 0.0})
        full["N"] = full["N"].astype("int64")
        full["AE_Ratio"] = [a / e if e else math.nan for a, e in zip(full["Actual"], full["Expected"])]
        out[t.name] = full
    return out


def scored_rows(df: DataFrame, model: Model) -> DataFrame:
    """Scored rows with _y and _w; the exposure's offset enters the prediction."""
    y, w, _ = response(model)
    return score(df, model).withColumns({"_y": y, "_w": w})


def validate(df: DataFrame, model: Model, *, bins: int = 10, bucket_tolerance: float = 0.1, calibration_tolerance: float = 0.02, thin: float = 0.001, labels: dict[int, pd.DataFrame] | None = None, converged: bool | None = None, status: list[list[str]] | None = None) -> Validation:
    """Validates on the rows that can be scored; what can't is counted and is a High finding."""
    if bins < 1:
        raise ValueError("bins must be 1 at least")
    family = Family(model.family, model.tweedie_power)
    every = scored_rows(df, model).persist()
    ok = every.where("status = 'ok'")
    y, w, mu = F.col("_y"), F.col("_w"), F.col("_mu")
    first = every.agg(
        F.count("*").alias("n"), F.count(F.when(F.col("status") == "ok", 1)).alias("ok"), F.count(F.when(F.col("status") == "unmatched", 1)).alias("lost"), F.count(F.when(F.col("status") == "nonfinite", 1)).alias("odd"),
        F.count(F.when(w < 0, 1)).alias("neg"), F.sum(F.when(F.col("status") == "ok", w)).alias("w"), F.sum(F.when(F.col("status") == "ok", w * y)).alias("wy"), F.sum(F.when(F.col("status") == "ok", w * mu)).alias("wmu"),
        F.sum(F.when((F.col("status") == "ok") & (w > 0), w * family.deviance_column(y, mu))).alias("dev"),
    ).first()
    if not first.n:
        raise ValueError("there are no rows to validate on")
    if first.neg:
        raise ValueError(f"{first.neg} rows have a negative weight")
    if not first.w:
        raise ValueError("the total weight is zero")
    null = float(ok.where(w > 0).agg(F.sum(w * family.deviance_column(y, F.lit(first.wy / first.w)))).first()[0]) if first.wy or family.link == "identity" else math.nan
    groups = by_prediction(ok).persist()
    table = calibration(groups, first.w, bins).orderBy("bin").toPandas()
    rates = table[table.weight > 0].actual_rate.tolist()
    lift = rates[-1] / rates[0] if len(rates) > 1 and rates[0] else math.nan
    g = gini(groups, first.w, first.wy)
    ae = first.wy / first.wmu if first.wmu else math.nan
    frames = {}
    if labels is not None:
        frames = actual_vs_expected(ok, model, labels)
    every.unpersist(), groups.unpersist()
    found: list[Finding] = []
    say = lambda s, c, m: found.append(Finding(s, c, m))
    if first.lost:
        say("High", "unmatched_observations", f"{first.lost} of {first.n} rows match no row of a table")
    if first.odd:
        say("High", "non_finite_predictions", f"{first.odd} rows have no finite prediction")
    if converged is False:
        say("High", "not_converged", "the fit did not converge")
    for t, s in zip(model.tables, status or []):
        if (k := s.count("aliased")):
            say("Medium", "aliased_levels", f"{k} rows of {t.name} can't be told from other tables")
        if (k := s.count("no_data")):
            say("Medium", "unfitted_levels", f"{k} rows of {t.name} had no data in the fit")
    drift = abs(ae - 1) if math.isfinite(ae) else 0.0
    if drift > calibration_tolerance:
        say("High" if drift > 0.1 else "Medium", "calibration_drift", f"actual over expected is {ae:.4f}")
    worst = max((abs(r - 1) for r in table.ae_ratio if r is not None and math.isfinite(r)), default=0.0)
    if worst > bucket_tolerance:
        say("Medium", "bucket_miscalibration", f"a bucket's actual over expected is off by {worst:.1%}")
    if math.isfinite(g) and g < 0.05:
        say("High", "no_discrimination", f"the Gini is {g:.4f}")
    for name, f in frames.items():
        if (k := int((f.N == 0).sum())):
            say("Low", "unseen_levels", f"{k} rows of {name} have no data here")
        if (k := int(((f.Exposure > 0) & (f.Exposure < thin * first.w)).sum())):
            say("Low", "thin_levels", f"{k} rows of {name} hold under {thin:.1%} of the weight")
    for t in model.tables:
        if t.knots is not None:
            say("Low", "spline_support_intervals", f"rows of {t.name} are the spline's support intervals")
    dev = float(first.dev or 0.0)
    if math.isfinite(null) and dev > null:
        say("High", "worse_than_intercept", "the deviance is above that of a constant")
    return Validation(first.n, first.ok, first.lost, dev, null, 1 - dev / null if null else math.nan, first.w, first.wy, first.wmu, ae, lift, g, table, frames, found)
