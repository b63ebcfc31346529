"""Audits: of a plan against data before fitting, of tables, and of tables against each other."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.families import Family
from ..plans.plan import NUMERIC, Plan, build, category_columns, number_columns
from ..plans.tables import UNSEEN, Model, Table
from .binding import bind

WIDE_TABLE, MANY_LEVELS, THIN_SHARE, NEAR_ALIAS, POOR = 5000, 50, 0.001, 0.999, 10.0
#: Cells that a review takes to the driver.
FEW_CELLS = 500_000


@dataclass
class Issue:
    severity: str
    code: str
    message: str


@dataclass
class PlanCheck:
    issues: list[Issue] = field(default_factory=list)
    resolved: list[dict] = field(default_factory=list)
    model: Model | None = None
    correlated_pairs: list[tuple[str, str, float]] = field(default_factory=list)
    table_conditioning: float | None = None

    @property
    def is_fittable(self) -> bool:
        return not any(i.severity == "High" for i in self.issues)

    @property
    def parameters(self) -> int:
        return sum(t.parameters for t in self.model.tables) if self.model else 0

    @property
    def rows(self) -> int:
        return sum(t.n for t in self.model.tables) if self.model else 0


def contingency(bound: DataFrame, i: int, j: int, n: int, m: int, weight) -> np.ndarray:
    """Weight by rows of two tables, over all observations."""
    got = bound.where(F.col(f"_row{i}").isNotNull() & F.col(f"_row{j}").isNotNull()).groupBy(f"_row{i}", f"_row{j}").agg(F.sum(weight).alias("w")).collect()
    out = np.zeros((n, m))
    for r in got:
        out[r[0], r[1]] = r[2] or 0.0
    return out


def canonical(counts: np.ndarray) -> float:
    """First canonical correlation of two category variables."""
    total = counts.sum()
    if total <= 0:
        return 0.0
    p = counts / total
    r, c = p.sum(1), p.sum(0)
    p, r, c = p[r > 0][:, c > 0], r[r > 0], c[c > 0]
    if min(p.shape) < 2:
        return 0.0
    s = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    return float(min(1.0, np.linalg.svd(s, compute_uv=False)[0]))


def correlations(bound: DataFrame, model: Model, weight, cells: pd.DataFrame | None = None) -> tuple[list[tuple[str, str, float]], float | None]:
    """First canonical correlation of each pair of tables, worst first, and the top eigenvalue of their matrix.

    One aggregation by cells of all tables gives every pair, exactly; ``cells`` has it where it was made already.
    """
    at = [i for i, t in enumerate(model.tables) if t.axes and not t.fixed]
    if len(at) < 2:
        return [], None
    if cells is None:
        cells = bound.groupBy(*[f"_row{i}" for i in at]).agg(F.sum(weight).alias("w")).limit(FEW_CELLS + 1).toPandas()
    few = cells.dropna(subset=[f"_row{i}" for i in at]).fillna({"w": 0.0}) if len(cells) <= FEW_CELLS else None
    pairs, matrix = [], np.eye(len(at))
    for a in range(len(at)):
        for b in range(a):
            n, m = model.tables[at[a]].n, model.tables[at[b]].n
            if few is None:
                counts = contingency(bound, at[a], at[b], n, m, weight)
            else:
                counts = np.bincount((few[f"_row{at[a]}"] * m + few[f"_row{at[b]}"]).astype(int), few["w"], n * m).reshape(n, m)
            rho = canonical(counts)
            matrix[a, b] = matrix[b, a] = rho
            pairs.append((model.tables[at[b]].name, model.tables[at[a]].name, rho))
    return sorted(pairs, key=lambda p: -p[2]), float(np.linalg.eigvalsh(matrix)[-1])


def _reviewed(bound: DataFrame, model: Model) -> tuple[list[int], float, list[np.ndarray], tuple]:
    """Rows without a match and exposure by row, of each table, the whole exposure, and the tables' correlations.

    One aggregation by cells has it all while the cells are few; beyond FEW_CELLS each table, and each pair, is summed by itself.
    """
    n = len(model.tables)
    rows = [f"_row{i}" for i in range(n)]
    cells = bound.groupBy(*rows).agg(F.sum("_w").alias("w"), F.count("*").alias("n")).limit(FEW_CELLS + 1).toPandas()
    if len(cells) <= FEW_CELLS:
        lost = [int(cells["n"][cells[r].isna()].sum()) for r in rows]
        sums = [np.bincount(cells[r].dropna().astype(int), cells["w"][cells[r].notna()].fillna(0.0), t.n) for r, t in zip(rows, model.tables)]
        return lost, float(cells["w"].sum()), sums, correlations(bound, model, F.col("_w"), cells)
    del cells
    kept = bound.persist()
    try:
        got = kept.agg(*[F.count(F.when(F.col(r).isNull(), 1)).alias(f"u{i}") for i, r in enumerate(rows)], F.sum("_w").alias("w")).first()
        sums = []
        for r, t in zip(rows, model.tables):
            held = {x[0]: x[1] or 0.0 for x in kept.where(F.col(r).isNotNull()).groupBy(r).agg(F.sum("_w")).collect()}
            sums.append(np.array([held.get(k, 0.0) for k in range(t.n)]))
        return [got[f"u{i}"] for i in range(n)], got.w or 0.0, sums, correlations(kept, model, F.col("_w"))
    finally:
        kept.unpersist()


def check_plan(plan: Plan, df: DataFrame, target: str) -> PlanCheck:
    """Everything that can be said before a fit: one wide aggregation of columns, then one pass over bound rows."""
    out = PlanCheck()
    say = lambda s, c, m: out.issues.append(Issue(s, c, m))
    types = dict(df.dtypes)
    names = [c for c in [*number_columns(plan), *category_columns(plan)] if c in types]
    gone = [c for c in [*number_columns(plan), *category_columns(plan)] if c not in types]
    if gone:
        say("High", "plan_cannot_prepare", f"columns are missing: {', '.join(gone)}")
    if plan.exposure and plan.exposure not in types:
        say("High", "plan_cannot_prepare", f"the exposure {plan.exposure} is missing")
    if target not in types:
        say("High", "missing_target", f"there is no column {target}")
    elif types[target] not in NUMERIC and types[target] != "boolean" and not types[target].startswith("decimal"):
        say("High", "target_not_numeric", f"{target} is {types[target]}")
    if not out.is_fittable:
        return out
    family = Family(plan.family, plan.tweedie_power)
    y = F.col(f"`{target}`").cast("double")
    num = lambda c: F.col(f"`{c}`").cast("double")
    wide = [F.count("*").alias("n"), F.count(F.when(y.isNull() | F.isnan(y), 1)).alias("y_null"), F.min(y).alias("y_lo"), F.max(y).alias("y_hi")]
    if plan.exposure:
        e = num(plan.exposure)
        wide += [F.count(F.when(e.isNull() | F.isnan(e), 1)).alias("e_null"), F.count(F.when(e <= 0, 1)).alias("e_low"), F.sum(e).alias("w")]
    for i, c in enumerate(names):
        v = F.col(f"`{c}`")
        wide.append(F.count(F.when(v.isNull(), 1)).alias(f"null{i}"))
        wide.append(F.min(v).alias(f"lo{i}"))
        wide.append(F.max(v).alias(f"hi{i}"))
        wide.append(F.count(F.when(F.isnan(num(c)) | (F.abs(num(c)) == math.inf), 1)).alias(f"odd{i}") if types[c] in ("float", "double") else F.lit(0).alias(f"odd{i}"))
    r = df.agg(*wide).first()
    if not r.n:
        say("High", "plan_cannot_prepare", "there are no rows")
        return out
    if r.y_null:
        say("High", "target_has_nulls", f"{target} is null or NaN in {r.y_null} rows")
    if r.y_lo is not None and (why := family.domain_error(r.y_lo, r.y_hi)):
        say("High", "negative_target", why)
    if plan.exposure:
        if r.e_null:
            say("High", "exposure_has_nulls", f"{plan.exposure} is null or NaN in {r.e_null} rows")
        if r.e_low:
            say("High" if plan.exposure_role == "offset" else "Medium", "non_positive_exposure", f"{plan.exposure} is zero or negative in {r.e_low} rows")
    for i, c in enumerate(names):
        if r[f"null{i}"]:
            say("Medium", "feature_has_nulls", f"{c} is null in {r[f'null{i}']} rows")
        if r[f"odd{i}"]:
            say("Medium", "feature_not_finite", f"{c} is NaN or infinite in {r[f'odd{i}']} rows")
        if r[f"lo{i}"] is not None and r[f"lo{i}"] == r[f"hi{i}"]:
            say("Medium", "constant_feature", f"{c} has one value only")
        if c in number_columns(plan) and types[c] not in NUMERIC and not types[c].startswith("decimal"):
            say("High", "plan_cannot_prepare", f"{c} of type {types[c]} isn't numeric")
    if not out.is_fittable:
        return out
    try:
        out.model, out.resolved = build(plan, df, target)
    except ValueError as err:
        text = str(err)
        code = "variate_degree_too_high" if "degree" in text else "bands_cannot_be_cut" if "finite" in text or "knots" in text else "plan_cannot_build"
        say("High", code, text)
        return out
    model = out.model
    for c in plan.encodings:
        if c in types and c in category_columns(plan):
            from .binding import TREE_KEYS, coded

            labels, held = model.encodings[c], df.where(F.col(f"`{c}`").isNotNull())
            if len(labels) > TREE_KEYS:
                known = df.sparkSession.createDataFrame([(v,) for v in labels], "_label string")
                k = held.select(F.col(f"`{c}`").cast("string").alias("_label")).join(known, "_label", "left_anti").count()
            else:
                k = held.where(coded(c, types[c], labels) == UNSEEN).count()
            if k:
                say("Medium", "unencodable_levels", f"{k} rows of {c} have a label outside the encoding")
    for t in model.tables:
        if t.n > WIDE_TABLE:
            say("Medium", "wide_table", f"{t.name} has {t.n} rows")
        if len(t.axes) == 1 and t.axes[0].kind == "category" and t.n > MANY_LEVELS:
            say("Low", "many_levels", f"{t.name} has {t.n} levels")
        if t.knots is not None:
            say("Low", "spline_support", f"{t.name} rests on {t.n} knots from {t.knots[0]:g} to {t.knots[-1]:g}")
    w = F.col(f"`{plan.exposure}`").cast("double") if plan.exposure else F.lit(1.0)
    bound = bind(df, model).select(*[f"_row{i}" for i in range(len(model.tables))], w.alias("_w"))
    lost, total, sums, (out.correlated_pairs, out.table_conditioning) = _reviewed(bound, model)
    for i, t in enumerate(model.tables):
        if lost[i]:
            say("High", "unmatched_observations", f"{lost[i]} rows match no row of {t.name}")
        if not t.axes:
            continue
        held = sums[i]
        empty = int((held <= 0).sum()) if t.knots is None else 0
        thin = int(((held > 0) & (held < THIN_SHARE * total)).sum())
        if empty:
            say("Medium", "empty_levels", f"{empty} rows of {t.name} have no exposure")
        if thin:
            say("Low", "thin_levels", f"{thin} rows of {t.name} hold under {THIN_SHARE:.1%} of the exposure")
    contrast = {t.name: {a.name for a in t.axes} for t in model.tables if t.kind == "interaction_contrast"}
    for a, b, rho in out.correlated_pairs:
        # A contrast knows its own main effects; its reference cells keep the two apart.
        if contrast.get(a, set()) & {x.name for x in model.table(b).axes} or contrast.get(b, set()) & {x.name for x in model.table(a).axes}:
            continue
        if rho > 0.9:
            say("High" if rho > NEAR_ALIAS else "Medium", "near_aliased_tables", f"{a} and {b} correlate at {rho:.4f}")
    if out.table_conditioning is not None and out.table_conditioning > POOR:
        say("Medium", "poorly_conditioned", f"the tables' correlation matrix has a top eigenvalue of {out.table_conditioning:.1f}")
    if out.parameters > r.n:
        say("High", "more_parameters_than_rows", f"{out.parameters} parameters, {r.n} rows")
    return out


def check_table(table: Table | pd.DataFrame, *, intercept: bool = False) -> list[Issue]:
    """Faults of one table; a pandas frame is read as feature columns and Rating_Factor."""
    out: list[Issue] = []
    say = lambda c, m: out.append(Issue("High", c, m))
    if isinstance(table, pd.DataFrame):
        if "Rating_Factor" not in table:
            return [Issue("High", "missing_factor_column", "there is no column Rating_Factor")]
        if not pd.api.types.is_numeric_dtype(table["Rating_Factor"]):
            return [Issue("High", "factor_column_not_numeric", "Rating_Factor isn't numeric")]
        from ..sources.workbook import table_from_frame

        features = [c for c in table if c != "Rating_Factor"]
        for c in features:
            if not (pd.api.types.is_float_dtype(table[c]) or pd.api.types.is_integer_dtype(table[c])):
                say("unreadable_dtype", f"column {c} is {table[c].dtype}")
        if table["Rating_Factor"].isna().any():
            say("null_factor", "a factor is null")
        if out:
            return out
        table = table_from_frame("table", table)
    if not table.n:
        return [Issue("High", "empty_table", "the table has no rows")]
    if not np.isfinite(table.factors).all():
        say("non_finite_factor", "a factor isn't finite")
    if intercept:
        if table.n != 1:
            say("intercept_not_single_row", f"the intercept has {table.n} rows")
        if table.axes:
            say("intercept_has_features", "the intercept has feature columns")
        return out
    if not table.axes:
        say("no_feature_columns", "the table has no feature columns")
    for j, a in enumerate(table.axes):
        own = [k[j] for k in table.keys]
        if any(k is None for k in own):
            say("null_bound" if a.kind == "band" else "null_level", f"{a.name} is null in a row")
        if a.kind == "band" and table.knots is None and None not in own:
            if math.inf not in own:
                say("no_unbounded_band", f"{a.name} has no band up to infinity")
            if len(table.axes) == 1:
                known = [k for k in own if not math.isnan(k)]
                if len(set(known)) < len(known):
                    say("duplicate_bound", f"{a.name} repeats a bound")
                elif known != sorted(known):
                    say("bounds_not_ascending", f"{a.name} isn't in ascending order")
    plain = [tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in k) for k in table.keys]
    if len(set(plain)) < len(plain) and table.axes:
        say("duplicate_row", "two rows have the same features; the later is never used")
    return out
