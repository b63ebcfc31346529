"""Fitted models: what a fit gives, and everything that starts from it."""

from __future__ import annotations

import copy
import math
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.families import Family
from ..plans.plan import Plan
from ..plans.tables import UNSEEN, WILDCARD, Model, Table
from . import inference as inf_ops
from . import scoring, validation
from .binding import bind, linear_predictor
from .cells import collapse, response
from .solve import Fit, Options, fit_cells
from .wide import fit_wide


@dataclass
class FittedModel:
    """A model with factors; fits also hold their plan, diagnostics and inference."""

    model: Model
    plan: Plan | None = None
    resolved: list[dict] = field(default_factory=list)
    fit: Fit | None = None
    options: Options | None = None
    inference: inf_ops.Inference | None = None
    notes: list[str] = field(default_factory=list)

    # State.

    @property
    def was_fitted(self) -> bool:
        return self.fit is not None

    @property
    def converged(self) -> bool | None:
        return None if self.fit is None else self.fit.converged

    @property
    def solver_used(self) -> str | None:
        return None if self.fit is None else self.fit.solver

    @property
    def table_names(self) -> list[str]:
        return [t.name for t in self.model.tables]

    @property
    def family(self) -> str:
        return self.model.family

    @property
    def target(self) -> str | None:
        return self.model.target

    @property
    def prediction_kind(self) -> str:
        return scoring.kind_of(self.model)

    def input_schema(self) -> dict[str, list[str]]:
        return scoring.input_schema(self.model)

    def inference_summary(self) -> dict:
        i = self._inferred()
        return {k: getattr(i, k) for k in ("kind", "dispersion", "df_residual", "effective_parameters", "n", "log_likelihood", "aic", "bic", "deviance", "null_deviance", "pearson")}

    def _inferred(self) -> inf_ops.Inference:
        if self.inference is None:
            raise ValueError("the model has no inference; it wasn't fitted")
        return self.inference

    # Scoring.

    def predict(self, df: DataFrame, strict: bool = True) -> DataFrame:
        return scoring.predict(df, self.model, strict=strict)

    def predict_diagnostics(self, df: DataFrame) -> DataFrame:
        return scoring.predict_diagnostics(df, self.model)

    def predict_rate(self, df: DataFrame) -> DataFrame:
        return scoring.predict_rate(df, self.model)

    def predict_count(self, df: DataFrame) -> DataFrame:
        return scoring.predict_count(df, self.model)

    def predict_expected(self, df: DataFrame, exposure: str) -> DataFrame:
        return scoring.predict_expected(df, self.model, exposure)

    def predict_one(self, values: dict) -> float:
        return scoring.predict_one(self.model, values)

    def explain(self, df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        return scoring.explain(df, self.model, key=key)

    # Tables.

    def rating_tables(self) -> list[pd.DataFrame]:
        return [self.rating_table(i) for i in range(len(self.model.tables))]

    def rating_tables_by_name(self) -> dict[str, pd.DataFrame]:
        return dict(zip(self.table_names, self.rating_tables()))

    def rating_table(self, i: int) -> pd.DataFrame:
        """Features, labels and band review columns, coefficient, error, status and relativity of one table."""
        t = self.model.tables[i]
        out = table_labels(t, self.model)
        out["Rating_Factor"] = t.factors
        out["Coefficient"] = t.factors
        out["Standard_Error"] = self.inference.errors[i] if self.inference else np.full(t.n, math.nan)
        out["Status"] = self.inference.status[i] if self.inference else ["scoring_only"] * t.n
        out["Relativity"] = np.exp(t.factors) if self.model.link == "log" else math.nan
        return out

    def rating_frame(self, spark) -> DataFrame:
        """All rating tables as one distributed frame: (table, row, level, coefficient, relativity, status)."""
        rows = []
        for t, frame in zip(self.model.tables, self.rating_tables()):
            for r in range(t.n):
                rows.append((t.name, r, describe_row(t, r, self.model), float(t.factors[r]), float(np.exp(t.factors[r])) if self.model.link == "log" else None, frame["Status"][r]))
        return spark.createDataFrame(rows, "`table` string, row int, level string, coefficient double, relativity double, status string")

    # Review.

    def validate(self, df: DataFrame, bins: int = 10, **tolerances) -> validation.Validation:
        labels = {i: table_labels(t, self.model).assign(row=range(t.n)) for i, t in enumerate(self.model.tables) if t.axes}
        return validation.validate(df, self.model, bins=bins, labels=labels, converged=self.converged, status=self.inference.status if self.inference else None, **tolerances)

    def term_tests(self, dispersion: str = "model") -> pd.DataFrame:
        return inf_ops.term_tests(self.model, self.fit, self._inferred(), dispersion)

    def coefficient_intervals(self, confidence: float = 0.95, dispersion: str = "model") -> pd.DataFrame:
        return inf_ops.coefficient_intervals(self.model, self.fit, self._inferred(), confidence, dispersion)

    def variate_terms(self) -> pd.DataFrame:
        return inf_ops.variate_terms(self.model, self.fit, self._inferred())

    def report(self, df: DataFrame | None = None, bins: int = 10):
        from .report import report

        return report(self, df, bins)

    # Algebra.

    def refit(self, df: DataFrame, target: str | None = None, *, exposure: str | None = None, exposure_role: str | None = None, **options) -> "FittedModel":
        """New factors for the same tables; options begin at their defaults."""
        m = copy.deepcopy(self.model)
        m.target = target or m.target
        if exposure is not None:
            m.exposure, m.role = exposure, exposure_role or m.role
        if m.target is None:
            raise ValueError("refit needs a target")
        for t in m.tables:
            if not t.fixed:
                t.factors = np.where(t.locked, t.factors, 0.0)
        return fit_model(m, df, Options(**options), plan=self.plan, resolved=self.resolved)

    def combine(self, other: "FittedModel") -> "FittedModel":
        from .algebra import combine

        return FittedModel(combine(self.model, other.model), notes=["combined"])

    __add__ = combine

    def with_response(self, target: str, exposure: str | None = None, exposure_role: str | None = None) -> "FittedModel":
        role = exposure_role or ("none" if exposure is None else "offset" if self.family == "poisson" else "weight")
        return replace(self, model=replace(self.model, target=target, exposure=exposure, role=role))

    def with_categories(self, labels: dict[str, list[str]]) -> "FittedModel":
        return replace(self, model=replace(self.model, encodings={**self.model.encodings, **labels}))

    def to_workbook(self, scale: str | None = None):
        from ..sources.workbook import Workbook

        return Workbook.from_model(self, scale)


def describe_row(t: Table, r: int, model: Model) -> str:
    """A row's features in words."""
    out = []
    for a, k in zip(t.axes, t.keys[r]):
        if a.kind == "category":
            labels = model.encodings.get(a.name)
            out.append("any" if k is None or k == WILDCARD else "unseen" if k == UNSEEN else labels[k] if labels is not None else str(k))
        else:
            out.append("any" if k is None else "missing" if math.isnan(k) else f"<={k:g}")
    return ", ".join(out)


def table_labels(t: Table, model: Model) -> pd.DataFrame:
    """Feature columns; <column>_Level beside codes, and for bands their interval and whether it reads as one."""
    out: dict[str, list] = {}
    for j, a in enumerate(t.axes):
        keys = [k[j] for k in t.keys]
        out[a.name] = keys
        if a.kind == "category":
            if a.name in model.encodings:
                if f"{a.name}_Level" in [x.name for x in t.axes]:
                    raise ValueError(f"column {a.name}_Level stands for a feature already")
                labels = model.encodings[a.name]
                out[f"{a.name}_Level"] = [None if k is None or not 0 <= k < len(labels) else labels[k] for k in keys]
            continue
        if t.knots is not None:
            continue
        bounds = sorted({k for k in keys if k is not None and not math.isnan(k)})
        plain = all(k is not None and not math.isnan(k) for k in keys) and keys == sorted(keys)
        below = dict(zip(bounds, [-math.inf, *bounds]))
        out[f"{a.name}_Lower"] = [below.get(k, math.nan) for k in keys]
        out[f"{a.name}_Upper"] = [math.nan if k is None else k for k in keys]
        out[f"{a.name}_Lower_Inclusive"] = [False] * t.n
        out[f"{a.name}_Upper_Inclusive"] = [True] * t.n
        out["Band_Interval_Status"] = ["ordered_grid" if plain or len(t.axes) > 1 and len(set(t.keys)) == t.n else "requires_match_review"] * t.n
    return pd.DataFrame(out, index=range(t.n))


def fit_model(model: Model, df: DataFrame, options: Options, *, plan: Plan | None = None, resolved: list[dict] | None = None, persist: bool = True) -> FittedModel:
    """Binds, collapses once, solves on cells, and passes over the rows again for inference.

    ``persist`` keeps the bound rows between the passes; a frame that is cached already is bound again instead.
    """
    family = Family(model.family, options.tweedie_power or model.tweedie_power)
    model.tweedie_power = family.power
    options.check(model)
    bound = bind(df, model)
    keep = {f"_row{i}" for i in range(len(model.tables))} | {model.target, model.exposure, options.cluster} | {t.axes[0].name for t in model.tables if t.knots is not None}
    bound = bound.select(*[F.col(f"`{c}`") for c in bound.columns if c in keep])
    if persist:
        bound = bound.persist()
    try:
        cells = collapse(bound, model, family)
        if isinstance(cells, DataFrame):
            try:
                fit = fit_wide(model, cells, family, options)
            finally:
                cells.unpersist()
        else:
            fit = fit_cells(model, cells, family, options)
        for t, f in zip(model.tables, fit.factors):
            t.factors = np.asarray(f, float)
        y, w, o = response(model)
        scored = bound
        if options.compute_standard_errors:
            terms = linear_predictor_bound(bound, model)
            eta = terms[0]
            for t in terms[1:]:
                eta = eta + t
            if model.role == "offset":
                eta = eta + o
            scored = bound.withColumn("_mu", family.mean_column(eta))
            inference = inf_ops.infer(model, fit, family, scored, y, w, o, F.col("_mu"), covariance=options.covariance, cluster=options.cluster, normalization=options.normalization)
        else:
            inference = None
    finally:
        if persist:
            bound.unpersist()
    return FittedModel(model, plan, resolved or [], fit, options, inference)


def linear_predictor_bound(bound: DataFrame, model: Model):
    """Terms from row ids alone, but for splines, which need their column."""
    from .binding import effect

    return [effect(t, F.col(f"_row{i}"), [F.col(f"`{a.name}`").cast("double") for a in t.axes] if t.knots is not None else []) for i, t in enumerate(model.tables)]


def fit_plan(plan: Plan, df: DataFrame, target: str, check: bool = True, **options) -> FittedModel:
    """Audits, builds and fits a plan; a High issue stops it."""
    from .audit import check_plan

    own = needed(plan, df, target, options.get("cluster"))
    kept = own is df and df.is_cached
    if not kept:
        # Levels, quantiles, audit, cells and inference all read this.
        own = own.persist()
    try:
        built = None
        if check:
            audit = check_plan(plan, own, target)
            if not audit.is_fittable:
                raise ValueError("; ".join(f"{i.code}: {i.message}" for i in audit.issues if i.severity == "High"))
            built = (audit.model, audit.resolved)
        model, resolved = built or plan.build(own, target)
        model.target = target
        return fit_model(model, own, Options(**options), plan=plan, resolved=resolved, persist=False)
    finally:
        if not kept:
            own.unpersist()


def needed(plan: Plan, df: DataFrame, target: str, cluster: str | None = None) -> DataFrame:
    """The columns of a frame that a plan, its target and its exposure name."""
    names = {c for t in plan.terms for c in t.columns} | {a[0] for t in plan.terms if t.table for a in t.table["axes"]} | {target, plan.exposure, cluster, *plan.encodings}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in names])
