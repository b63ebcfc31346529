"""Standard errors, dispersion, information criteria, term tests and intervals of a fit."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.families import Family
from ..plans.tables import Model
from .solve import Fit, information


@dataclass
class Inference:
    """Covariance of the parameters, errors by table row, and the fit's summary numbers."""

    covariance: np.ndarray
    kind: str
    dispersion: float
    df_residual: float
    effective_parameters: float
    n: int
    log_likelihood: float | None
    aic: float | None
    bic: float | None
    deviance: float
    null_deviance: float
    pearson: float
    errors: list[np.ndarray]
    status: list[list[str]]
    aliased: np.ndarray
    null_scale: np.ndarray
    null_basis: np.ndarray
    notes: list[str] = field(default_factory=list)


def aliased_columns(h: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """Parameters that those before them determine: vanishing pivots of the information."""
    p = len(h)
    out, kept = np.zeros(p, bool), []
    a = h.astype(float).copy()
    top = float(np.diag(h).max(initial=0)) * 1e-12
    for j in range(p):
        if a[j, j] <= max(tolerance * h[j, j], top):
            out[j] = True
            continue
        kept.append(j)
        a[j + 1 :, j + 1 :] -= np.outer(a[j + 1 :, j], a[j, j + 1 :]) / a[j, j]
    return out


def inverse_of(h: np.ndarray, aliased: np.ndarray) -> np.ndarray:
    """Inverse over the estimable parameters, zero elsewhere."""
    out = np.zeros_like(h)
    at = np.flatnonzero(~aliased)
    if len(at):
        s = np.sqrt(np.diag(h)[at])
        out[np.ix_(at, at)] = np.linalg.inv(h[np.ix_(at, at)] / s[:, None] / s) / s[:, None] / s
    return out


def null_directions(h: np.ndarray, aliased: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale, basis): orthonormal directions of the scaled parameters along which the information vanishes.

    Each aliased parameter gives one: it moves by one and the others move so that no fitted value changes.
    """
    scale = np.sqrt(np.maximum(np.diag(h), 0))
    scale = np.where(scale > 0, scale, 1.0)
    lost, kept = np.flatnonzero(aliased), np.flatnonzero(~aliased)
    if not len(lost):
        return scale, np.zeros((len(h), 0))
    a = h / scale[:, None] / scale
    basis = np.zeros((len(h), len(lost)))
    basis[lost, np.arange(len(lost))] = 1.0
    if len(kept):
        basis[kept] = -np.linalg.solve(a[np.ix_(kept, kept)], a[np.ix_(kept, lost)])
    return scale, np.linalg.qr(basis)[0]


def estimable(contrasts: np.ndarray, scale: np.ndarray, basis: np.ndarray, tolerance: float = 1e-6) -> np.ndarray:
    """Whether each row, a linear function of the parameters, is the same along all null directions."""
    u = contrasts / scale
    size = np.linalg.norm(u, axis=1)
    return np.linalg.norm(u @ basis, axis=1) <= tolerance * np.maximum(size, 1e-300)


def row_scores(family: Family, y: Column, w: Column, mu: Column) -> Column:
    """Each row's score with respect to its linear predictor."""
    return w * (y - mu) if family.name in ("gaussian", "binomial", "poisson") else w * (y - mu) * F.pow(mu, 1 - family.p)


def totals(scored: DataFrame, family: Family, y: Column, w: Column, o: Column, mu: Column) -> dict[str, float]:
    """One pass over the rows: deviance, Pearson statistic and sums for the likelihood."""
    on = lambda e: F.sum(F.when(w > 0, e).otherwise(0.0))
    dev = family.deviance_column(y, mu)
    xlogx = lambda e: F.when(e > 0, e * F.ln(F.when(e > 0, e).otherwise(1.0))).otherwise(0.0)
    half = F.pow(y, 2 - family.power) if family.name == "tweedie" else F.lit(0.0)
    got = scored.agg(
        F.count(F.when(w > 0, 1)).alias("n"), F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.sum(w * mu).alias("wmu"), on(w * dev).alias("deviance"),
        on(w * (y - mu) * (y - mu) / family.variance_column(mu)).alias("pearson"), on(w * F.when(y > 0, y * F.ln(F.when(y > 0, mu).otherwise(1.0))).otherwise(0.0) - w * mu).alias("poisson"),
        on(w * F.ln(F.when(mu > 0, mu).otherwise(1.0))).alias("wlogmu"), on(w * F.ln(F.when(y > 0, y).otherwise(1.0))).alias("wlogy"), on(w * y / F.when(mu != 0, mu).otherwise(1.0)).alias("wymu"),
        on(F.ln(F.when(w > 0, w).otherwise(1.0))).alias("logw"), F.sum(F.when(w > 0, F.exp(o) * w).otherwise(0.0)).alias("wq"),
        on(w * xlogx(y)).alias("wylogy"), on(w * xlogx(1 - y)).alias("wzlogz") if family.name == "binomial" else F.lit(0.0).alias("wzlogz"), on(w * y * y).alias("wyy"), on(w * y * o).alias("wyo"), on(w * half).alias("whalf"),
        on(F.greatest(F.abs(row_scores(family, y, w, mu)), F.abs(row_scores(family, F.lit(0.0), w, mu)))).alias("scores"),
    ).first()
    return {k: (float(v) if v is not None else math.nan) for k, v in got.asDict().items()}


def _log_factorials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One number a partition: the sum of w * lgamma(y + 1) over its rows (y, w)."""
    sums = [math.fsum(w * math.lgamma(y + 1) for y, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist())) for b in batches]
    yield pa.RecordBatch.from_arrays([pa.array([math.fsum(sums)], pa.float64())], ["s"])


def log_likelihood(scored: DataFrame, family: Family, t: dict[str, float], y: Column, w: Column, dispersion: float) -> float | None:
    """Weighted log-likelihood; None for tweedie. Log factorials are summed over distinct responses, on the executors where these are many."""
    if family.name == "gaussian":
        n = t["n"]
        return -0.5 * (n * math.log(2 * math.pi * t["deviance"] / n) + n - t["logw"]) if t["deviance"] > 0 else None
    if family.name == "binomial":
        return -t["deviance"] / 2
    if family.name == "poisson":
        counts = scored.where(w > 0).groupBy(y.alias("y")).agg(F.sum(w).alias("w"))
        # lgamma of distinct responses, which for counts are few.
        few = counts.limit(200_001).collect()
        if len(few) > 200_000:
            few = None
            parts = counts.select(F.col("y").cast("double"), F.col("w").cast("double")).mapInArrow(_log_factorials, "s double")
            return t["poisson"] - math.fsum(r.s for r in parts.toLocalIterator())
        return t["poisson"] - math.fsum(r.w * math.lgamma(r.y + 1) for r in few)
    if family.name == "gamma":
        k = 1 / max(dispersion, 1e-300)
        return k * (-t["wymu"] - t["wlogmu"] + t["wlogy"] + t["w"] * math.log(k)) - t["wlogy"] - t["w"] * math.lgamma(k)
    return None


def null_deviance(scored: DataFrame, family: Family, t: dict[str, float], y: Column, w: Column, o: Column, with_offset: bool) -> float:
    """Deviance of the intercept-only model, with the offset when there is one; from the sums of totals() wherever they suffice."""
    if with_offset and family.p != 1:
        p = family.p
        r = scored.agg(F.sum(F.when(w > 0, w * F.exp(o * (1 - p)) * y).otherwise(0.0)).alias("a"), F.sum(F.when(w > 0, w * F.exp(o * (2 - p))).otherwise(0.0)).alias("b")).first()
        mu = F.exp(o) * (r.a / r.b)
        return float(scored.agg(F.sum(F.when(w > 0, w * family.deviance_column(y, mu)).otherwise(0.0))).first()[0])
    total, wy = t["w"], t["wy"]
    m = wy / total
    if family.name == "gaussian":
        return t["wyy"] - wy * m
    if family.name == "binomial":
        mean = (wy * math.log(m) if wy > 0 else 0.0) + ((total - wy) * math.log(1 - m) if wy < total else 0.0)
        return 2 * (t["wylogy"] + t["wzlogz"] - mean)
    if wy <= 0:
        return 0.0
    if family.p == 1:
        return 2 * (t["wylogy"] - t["wyo"] - wy * math.log(wy / t["wq"])) if with_offset else 2 * (t["wylogy"] - wy * math.log(m))
    if family.p == 2:
        return 2 * (total * math.log(m) - t["wlogy"])
    p = family.p
    return 2 * (t["whalf"] / ((1 - p) * (2 - p)) - m ** (1 - p) * wy / (1 - p) + m ** (2 - p) * total / (2 - p))


def robust_meat(scored: DataFrame, fit: Fit, score: Column) -> np.ndarray:
    """Sum over rows of the outer product of their scores, from partial sums of cells by partition."""
    blocks, sizes, p = fit.blocks, fit.sizes, len(fit.beta)
    cols = [f"_row{b.table}" for b in blocks]
    sums = scored.groupBy(*cols).agg(F.sum(score * score).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meat = np.zeros((p, p))
        for batch in batches:
            if batch.num_rows:
                index = np.zeros((batch.num_rows, len(sizes)), np.int64)
                for k, b in enumerate(blocks):
                    index[:, b.table] = batch.column(k).to_numpy(zero_copy_only=False)
                meat += information(index, sizes, blocks, batch.column(len(blocks)).to_numpy(zero_copy_only=False).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([meat.tobytes()], pa.binary())], ["m"])

    return sum((np.frombuffer(bytes(r.m)).reshape(p, p) for r in sums.mapInArrow(run, "m binary").toLocalIterator()), np.zeros((p, p)))


def cluster_meat(scored: DataFrame, fit: Fit, cluster: str, score: Column) -> tuple[np.ndarray, int]:
    """Sum over clusters of the outer product of their scores, a partition of whole clusters at a time."""
    n_tables = len(fit.sizes)
    p = len(fit.beta)
    blocks = [(b.table, b.map, b.first) for b in fit.blocks]
    cols = [f"_row{i}" for i in range(n_tables)]
    sums = scored.groupBy(F.col(f"`{cluster}`").cast("string").alias("c"), *cols).agg(F.sum(score).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meat, n, open_c, open_s = np.zeros((p, p)), 0, None, np.zeros(p)
        for batch in batches:
            pdf = batch.to_pandas()
            x = np.zeros((len(pdf), p))
            for table, m, first in blocks:
                x[:, first : first + m.shape[1]] = m[pdf[f"_row{table}"].to_numpy()]
            x *= pdf["s"].to_numpy()[:, None]
            edge = np.flatnonzero(np.r_[True, pdf["c"].to_numpy()[1:] != pdf["c"].to_numpy()[:-1]])
            own = np.add.reduceat(x, edge)
            names = pdf["c"].to_numpy()[edge]
            if open_c == names[0]:
                own[0] += open_s
            elif open_c is not None:
                meat += np.outer(open_s, open_s)
                n += 1
            meat += own[:-1].T @ own[:-1]
            n += len(own) - 1
            open_c, open_s = names[-1], own[-1]
        if open_c is not None:
            meat += np.outer(open_s, open_s)
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([meat.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["m", "n"])

    sorted_by = sums.repartition("c").sortWithinPartitions("c")
    meat, n = np.zeros((p, p)), 0
    for r in sorted_by.mapInArrow(run, "m binary, n long").toLocalIterator():
        meat += np.frombuffer(bytes(r.m)).reshape(p, p)
        n += r.n
    return meat, n


def infer(model: Model, fit: Fit, family: Family, scored: DataFrame, y: Column, w: Column, o: Column, mu: Column, *, covariance: str = "model", cluster: str | None = None, errors: bool = True, normalization: str = "base_level") -> Inference:
    """Inference at a fit from one row-level pass, and another for sandwich covariances."""
    t = totals(scored, family, y, w, o, mu)
    fit.judged_by_rows(t["scores"])
    notes: list[str] = []
    h, p = fit.information, len(fit.beta)
    l1, l2 = fit.penalty
    penal = np.zeros(p, bool)
    for b in fit.blocks:
        penal[b.columns] = b.penalised
    aliased = aliased_columns(h)
    null_scale, null_basis = null_directions(h, aliased)
    if l1 > 0:
        effective = float((~penal).sum() + (fit.beta[penal] != 0).sum())
    elif l2 > 0:
        effective = float(np.trace(np.linalg.solve(h + np.diag(np.where(penal, l2, 0.0)), h)))
    else:
        effective = float((~aliased).sum())
    n = int(t["n"])
    df = n - effective
    scale = 1.0 if family.fixed_scale else (t["pearson"] / df if df > 0 else math.nan)
    bread = inverse_of(h, aliased)
    cov = bread * scale
    if covariance != "model" and errors:
        s = row_scores(family, y, w, mu)
        if covariance == "robust":
            meat = robust_meat(scored, fit, s)
        else:
            meat, clusters = cluster_meat(scored.where(w > 0), fit, cluster, s)
            if clusters < 2:
                raise ValueError("cluster covariance needs two clusters of positive weight at least")
        cov = bread @ meat @ bread
    penalised = l1 + l2 > 0
    if penalised:
        notes.append("standard errors of a penalised fit are not reported")
    out_err, out_status = [], []
    for i, tab in enumerate(model.tables):
        b = next((b for b in fit.blocks if b.table == i), None)
        if b is None:
            out_err.append(np.zeros(tab.n))
            out_status.append(["locked"] * tab.n)
            continue
        m = b.map if tab.knots is None else np.vstack([np.zeros(b.map.shape[1]), np.eye(b.map.shape[1])])
        se = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", m, cov[b.columns, b.columns], m), 0))
        held = fit.exposure[i] > 0
        wide = np.zeros((len(m), p))
        wide[:, b.columns] = m
        lost = ~estimable(wide, null_scale, null_basis)
        reference = (np.abs(m).sum(1) == 0) & ~tab.locked
        status = ["locked" if tab.locked[r] else "reference" if reference[r] and tab.axes else "no_data" if not held[r] and tab.knots is None and not tab.degree else "aliased" if lost[r] else "estimated" for r in range(tab.n)]
        se = np.where([s in ("no_data", "aliased") for s in status], np.nan, se)
        if penalised or not errors:
            se = np.full(tab.n, np.nan)
        out_err.append(se)
        out_status.append(status)
    if normalization == "weighted_mean" and not penalised and errors:
        _mean_errors(model, fit, cov, null_scale, null_basis, out_err)
    ll = log_likelihood(scored, family, t, y, w, scale)
    k = effective
    return Inference(
        cov, covariance, scale, df, effective, n, ll, None if ll is None else -2 * ll + 2 * k, None if ll is None else -2 * ll + math.log(max(n, 1)) * k,
        t["deviance"], null_deviance(scored, family, t, y, w, o, model.role == "offset"), t["pearson"], out_err, out_status, aliased, null_scale, null_basis, notes,
    )


def _mean_errors(model: Model, fit: Fit, cov: np.ndarray, null_scale: np.ndarray, null_basis: np.ndarray, errors: list[np.ndarray]) -> None:
    """Errors of contrasts with a table's exposure-weighted mean, and of the intercept that takes the means up."""
    lead = np.zeros(len(fit.beta))
    home = None
    for b in fit.blocks:
        t = model.tables[b.table]
        if not t.axes:
            home = b
            lead[b.columns] = 1.0
        elif not t.degree and t.knots is None and not t.locked.any():
            e = fit.exposure[b.table]
            mean = e @ b.map / max(e.sum(), 1e-300)
            lead[b.columns] += mean
            m = b.map - mean
            wide = np.zeros((len(m), len(lead)))
            wide[:, b.columns] = m
            known = estimable(wide, null_scale, null_basis) & (e > 0)
            errors[b.table] = np.where(known, np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", m, cov[b.columns, b.columns], m), 0)), np.nan)
    if home is not None:
        known = estimable(lead[None, :], null_scale, null_basis)[0]
        errors[home.table] = np.array([math.sqrt(max(float(lead @ cov @ lead), 0)) if known else math.nan])


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a power series below a + 1, Lentz's continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    out, i = d, 0
    while True:
        i += 1
        numerator = -i * (i - a)
        b += 2
        d = 1 / (numerator * d + b or 1e-300)
        c = b + numerator / c or 1e-300
        out *= c * d
        if abs(c * d - 1) < 1e-16 or i > 100_000:
            return front * out


def chi_square_tail(x: float, df: int) -> float:
    """Upper tail of a chi-square; 1 where there is nothing to test."""
    return gamma_upper(df / 2, x / 2) if x > 0 and df > 0 else 1.0


def term_tests(model: Model, fit: Fit, inf: Inference, dispersion: str = "model") -> pd.DataFrame:
    """Wald statistic of each term: (term, statistic, df, p_value, reason); the reason says why there is none.

    A fit that did not converge, penalised and bounded terms, and terms of which a parameter can't be told from others have none.
    """
    if dispersion not in ("model", "quasi_poisson"):
        raise ValueError("dispersion must be model or quasi_poisson")
    scale = 1.0
    if dispersion == "quasi_poisson":
        if model.family != "poisson" or inf.kind != "model":
            raise ValueError("quasi_poisson is for poisson fits with model covariance")
        scale = inf.pearson / inf.df_residual
    out = []
    for b in fit.blocks:
        t = model.tables[b.table]
        if not t.axes:
            continue
        v = inf.covariance[b.columns, b.columns] * scale
        lost = np.linalg.norm(inf.null_basis[b.columns], axis=1) > 1e-8
        why = "not converged" if not fit.converged else "penalised" if sum(fit.penalty) > 0 else "bounded" if b.bounded else "aliased" if lost.any() else None
        if why is None and (np.diag(v) <= 0).any():
            why = "no information"
        if why:
            out.append((t.name, math.nan, b.map.shape[1], math.nan, why))
            continue
        beta = fit.beta[b.columns]
        s = np.sqrt(np.diag(v))
        stat = float((beta / s) @ np.linalg.solve(v / s[:, None] / s, beta / s))
        out.append((t.name, stat, len(beta), chi_square_tail(stat, len(beta)), None))
    return pd.DataFrame(out, columns=["term", "statistic", "df", "p_value", "reason"])


def variate_terms(model: Model, fit: Fit, inf: Inference) -> pd.DataFrame:
    """A row for each power of each variate: (term, power, coefficient, scaled_coefficient, standard_error, top_z).

    ``coefficient`` is that of the raw values' power, ``scaled_coefficient`` that of values moved and scaled to [-1, 1], which the
    error belongs to.  Only the top power's z, given in its row, does not depend on how the basis is centred.
    """
    out = []
    for b in fit.blocks:
        t = model.tables[b.table]
        if not t.degree:
            continue
        lo, hi = float(t.values.min()), float(t.values.max())
        own = fit.beta[b.columns]
        raw = np.polynomial.polynomial.Polynomial([0.0, *own], domain=[lo, hi], window=[-1, 1]).convert(domain=[-1, 1], window=[-1, 1]).coef if hi > lo else np.r_[0.0, own]
        known = (np.linalg.norm(inf.null_basis[b.columns], axis=1) <= 1e-8) & (sum(fit.penalty) == 0)
        se = np.where(known, np.sqrt(np.maximum(np.diag(inf.covariance)[b.columns], 0)), math.nan)
        for k in range(t.degree):
            top = k == t.degree - 1 and math.isfinite(se[k]) and se[k] > 0
            out.append((t.name, k + 1, float(raw[k + 1]) if len(raw) > k + 1 else 0.0, float(own[k]), float(se[k]), float(own[k] / se[k]) if top else math.nan))
    return pd.DataFrame(out, columns=["term", "power", "coefficient", "scaled_coefficient", "standard_error", "top_z"])


def normal_quantile(q: float) -> float:
    """Inverse of the normal distribution, by bisection on erfc."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < q else (lo, mid)
    return (lo + hi) / 2


def coefficient_intervals(model: Model, fit: Fit, inf: Inference, confidence: float = 0.95, dispersion: str = "model") -> pd.DataFrame:
    """Wald interval of each row's coefficient, and of its relativity: status is wald, fixed or unavailable."""
    if not 0 < confidence < 1:
        raise ValueError("confidence must be between 0 and 1")
    widen = math.sqrt(inf.pearson / inf.df_residual) if dispersion == "quasi_poisson" else 1.0
    z = normal_quantile(0.5 + confidence / 2) * widen
    out = []
    for t, f, se, status in zip(model.tables, fit.factors, inf.errors, inf.status):
        for r in range(t.n):
            fixed = status[r] in ("locked", "reference")
            kind = "fixed" if fixed else "wald" if math.isfinite(se[r]) and status[r] == "estimated" and not t.direction else "unavailable"
            half = 0.0 if fixed else z * se[r] if kind == "wald" else math.nan
            lo, hi = f[r] - half, f[r] + half
            out.append((t.name, r, f[r], se[r], lo, hi, math.exp(f[r]), math.exp(lo), math.exp(hi), kind))
    return pd.DataFrame(out, columns=["table", "row", "coefficient", "standard_error", "lower", "upper", "relativity", "relativity_lower", "relativity_upper", "status"])
