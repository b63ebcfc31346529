"""A report on a model: findings, verdict, fit summary, validation and tables, also as Markdown."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from .audit import Issue, check_table
from .validation import Validation

_RANK = {"High": 0, "Medium": 1, "Low": 2}


@dataclass
class ModelReport:
    verdict: str
    headline: str
    findings: list[Issue]
    fit_summary: dict
    validation: Validation | None
    table_names: list[str]
    rating_tables: list[pd.DataFrame]
    resolved: list[dict]
    plan_json: str
    fingerprint: str
    notes: list[str] = field(default_factory=list)

    def markdown(self) -> str:
        out = ["# Model report", "", f"**{self.headline}**", "", f"Fingerprint `{self.fingerprint}`", "", "## Findings", ""]
        out += [f"- {f.severity}: {f.code}: {f.message}" for f in self.findings] or ["None."]
        if self.fit_summary:
            out += ["", "## Fit", "", "| | |", "|---|---|", *[f"| {k} | {v} |" for k, v in self.fit_summary.items()]]
        if self.validation:
            v = self.validation
            out += ["", "## Validation", "", "| | |", "|---|---|"]
            out += [f"| {k} | {getattr(v, k)} |" for k in ("n_rows", "n_scored", "unmatched_rows", "deviance", "null_deviance", "pseudo_r2", "total_actual", "total_expected", "ae_ratio", "lift", "gini")]
            out += ["", _markdown(v.calibration)]
        for name, t in zip(self.table_names, self.rating_tables):
            out += ["", f"## Table {name}", "", _markdown(t)]
        return "\n".join([*out, "", "## Plan", "", "```json", self.plan_json, "```", ""])


def _markdown(t: pd.DataFrame) -> str:
    head = [str(c) for c in t.columns]
    rows = [" | ".join(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in t.itertuples(index=False)]
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *[f"| {r} |" for r in rows]])


def fingerprint(model) -> str:
    """Six bytes of a SHA-256 over tables and link."""
    body = [[t.name, [[a.name, a.kind] for a in t.axes], [[repr(k) for k in key] for key in t.keys], [repr(float(f)) for f in t.factors]] for t in model.tables]
    return hashlib.sha256(json.dumps([model.link, body]).encode()).hexdigest()[:12]


def report(fitted, df: DataFrame | None = None, bins: int = 10) -> ModelReport:
    m = fitted.model
    findings = [i for k, t in enumerate(m.tables) for i in check_table(t, intercept=k == 0)]
    validation = None
    if df is not None:
        validation = fitted.validate(df, bins=bins)
        findings += [Issue(f.severity, f.code, f.message) for f in validation.warnings]
    elif fitted.converged is False:
        findings.append(Issue("High", "not_converged", "the fit did not converge"))
    findings.sort(key=lambda f: _RANK[f.severity])
    worst = findings[0].severity if findings else "Low"
    verdict = {"High": "not_usable", "Medium": "usable_with_caveats"}.get(worst, "usable")
    n = len([f for f in findings if f.severity != "Low"])
    headline = {"usable": "Usable.", "usable_with_caveats": f"Usable with caveats: {n} findings.", "not_usable": f"Not usable: {findings[0].message}." if findings else ""}[verdict]
    summary = {}
    if fitted.fit is not None:
        summary = {"family": m.family, "link": m.link, "solver": fitted.solver_used, "iterations": fitted.fit.iterations, "converged": fitted.converged}
        if fitted.inference is not None:
            summary |= fitted.inference_summary()
    return ModelReport(verdict, headline, findings, summary, validation, fitted.table_names, fitted.rating_tables(), fitted.resolved, fitted.plan.to_json() if fitted.plan else "", fingerprint(m))
