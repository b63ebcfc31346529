"""Scoring: predictions, row diagnostics and explanations as lazy projections; also over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.families import Family
from ..plans.tables import Model
from .binding import bind, linear_predictor


def _offset(model: Model) -> Column:
    if model.role != "offset" or not model.exposure:
        return F.lit(0.0)
    e = F.col(f"`{model.exposure}`").cast("double")
    return F.when(e > 0, F.ln(e)).otherwise(F.lit(float("-inf")))


def score(df: DataFrame, model: Model, *, offset: bool = True) -> DataFrame:
    """Adds predictions, status (ok, unmatched, nonfinite) and unmatched_tables to every row.

    Predictions are null unless the status is ok.  Nothing is shuffled.
    """
    bound = bind(df, model)
    terms = linear_predictor(bound, model)
    eta = terms[0]
    for t in terms[1:]:
        eta = eta + t
    if offset:
        eta = eta + _offset(model)
    lost = F.concat_ws(", ", *[F.when(F.col(f"_row{i}").isNull(), t.name) for i, t in enumerate(model.tables)])
    made = bound.withColumn("_eta", eta).withColumn("unmatched_tables", lost)
    mu = Family(model.family, model.tweedie_power).mean_column(F.col("_eta"))
    made = made.withColumn("_mu", mu)
    bad = F.col("_mu").isNull() | F.isnan("_mu") | (F.abs("_mu") == float("inf"))
    status = F.when(F.col("unmatched_tables") != "", "unmatched").when(bad, "nonfinite").otherwise("ok")
    return made.withColumn("status", status).withColumn("predictions", F.when(F.col("status") == "ok", F.col("_mu")))


def _internal(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_row") or c in ("_eta", "_mu")]


def predict(df: DataFrame, model: Model, *, strict: bool = True) -> DataFrame:
    """The frame with ``predictions``; a strict one raises on the first row that can't be scored."""
    out = score(df, model)
    p = F.col("predictions")
    if strict:
        why = F.concat(F.lit("a row can't be scored: "), F.col("status"), F.lit(" "), F.col("unmatched_tables"))
        p = F.when(F.col("status") == "ok", p).otherwise(F.raise_error(why).cast("double"))
    out = out.withColumn("predictions", p)
    return out.drop(*_internal(out), "status", "unmatched_tables")


def predict_diagnostics(df: DataFrame, model: Model) -> DataFrame:
    """The frame with predictions, status and unmatched_tables."""
    out = score(df, model)
    return out.drop(*_internal(out))


def kind_of(model: Model) -> str:
    """What predictions are: rate, count or response."""
    if model.family == "poisson" and model.exposure:
        return "rate" if model.role == "weight" else "count"
    return "response"


def predict_rate(df: DataFrame, model: Model) -> DataFrame:
    """``rate``: expected claims for a unit of exposure; for poisson models with an exposure."""
    if kind_of(model) == "response":
        raise ValueError("rates are for poisson models with an exposure")
    out = score(df, model, offset=False)
    out = out.withColumn("rate", F.col("predictions"))
    return out.drop(*_internal(out), "status", "unmatched_tables", "predictions")


def predict_count(df: DataFrame, model: Model) -> DataFrame:
    """``expected_count``: the rate times the row's exposure."""
    out = predict_rate(df, model)
    return out.withColumn("expected_count", F.col("rate") * F.col(f"`{model.exposure}`").cast("double")).drop("rate")


def predict_expected(df: DataFrame, model: Model, exposure: str) -> DataFrame:
    """``expected``: the rate times any column of exposures, which must not be null; for poisson models. Null where no rate can be had."""
    if model.family != "poisson":
        raise ValueError(f"expected counts are for poisson models, not {model.family}")
    if dict(df.dtypes).get(exposure) not in ("float", "double"):
        raise ValueError(f"the exposure {exposure} must be a float or double column")
    out = score(df, model, offset=False)
    e = F.col(f"`{exposure}`").cast("double")
    e = F.when(e.isNull(), F.raise_error(F.lit(f"the exposure {exposure} is null in a row")).cast("double")).otherwise(e)
    return out.withColumn("expected", F.col("predictions") * e).drop(*_internal(out), "status", "unmatched_tables", "predictions")


def explain(df: DataFrame, model: Model, *, key: str) -> tuple[DataFrame, DataFrame]:
    """(summary, contributions): a row for each observation, and one for each observation and term.

    ``key`` names the column that tells observations apart, for a distributed frame has no row numbers.
    """
    bound = score(df, model)
    terms = linear_predictor(bound, model)
    k = F.col(f"`{key}`").alias(key)
    summary = bound.select(k, F.col("_eta").alias("linear_predictor"), F.lit(model.link).alias("link"), "predictions")
    log = model.link == "log"
    each = [
        F.struct(F.lit(t.name).alias("term"), F.lit(t.kind).alias("kind"), F.col(f"_row{i}").alias("table_row"), c.cast("double").alias("coefficient"), (F.exp(c) if log else F.lit(None).cast("double")).alias("multiplier"))
        for i, (t, c) in enumerate(zip(model.tables, terms))
    ]
    if model.role == "offset" and model.exposure:
        o = _offset(model)
        each.append(F.struct(F.lit("exposure").alias("term"), F.lit("offset").alias("kind"), F.lit(None).cast("int").alias("table_row"), o.alias("coefficient"), (F.exp(o) if log else F.lit(None).cast("double")).alias("multiplier")))
    return summary, bound.select(k, F.inline(F.array(*each)))


def input_schema(model: Model) -> dict[str, list[str]]:
    """Predictors, and all columns that scoring reads."""
    return {"predictors": model.predictors, "columns": model.predictors + ([model.exposure] if model.exposure and model.role == "offset" and model.exposure not in model.predictors else [])}


def predict_linear(df: DataFrame, model: Model) -> DataFrame:
    """``linear_predictor`` without an offset; null where unmatched."""
    out = score(df, model, offset=False)
    return out.withColumn("linear_predictor", F.col("_eta")).drop(*_internal(out), "status", "unmatched_tables", "predictions")


def predict_components(df: DataFrame, model: Model) -> DataFrame:
    """A column ``<table>_component`` for each table."""
    bound = bind(df, model)
    terms = linear_predictor(bound, model)
    return bound.withColumns({f"{t.name}_component": c for t, c in zip(model.tables, terms)}).drop(*_internal(bound))


def predict_one(model: Model, values: dict[str, object]) -> float:
    """The prediction for one observation, on the driver; NaN where a table doesn't match."""
    import math

    import numpy as np

    from ..functions.splines import evaluate
    from ..plans.tables import UNSEEN, scan

    eta = 0.0
    for t in model.tables:
        own = []
        for a in t.axes:
            v = values.get(a.name)
            if a.kind == "category":
                labels = model.encodings.get(a.name)
                v = (labels.index(str(v)) if str(v) in labels else UNSEEN) if labels is not None else (UNSEEN if v is None else int(v))
            else:
                v = None if v is None else float(v)
            own.append(v)
        if t.knots is not None:
            if own[0] is None or not math.isfinite(own[0]):
                return math.nan
            eta += float(evaluate(t.knots, t.factors, np.array([own[0]]))[0])
            continue
        r = scan(t, tuple(own))
        if r is None:
            return math.nan
        eta += float(t.factors[r])
    link = model.link
    return eta if link == "identity" else math.exp(eta) if link == "log" else 1 / (1 + math.exp(-eta))
