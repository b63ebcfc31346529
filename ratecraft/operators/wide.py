"""Fits whose cells are too many for the driver: partial scores and information by partition.

The cells stay where they are, persisted; each Newton step is one pass in which every partition adds up its
part of the log-likelihood, the score and the information of all parameters, and the driver adds up one such sum a partition.  So what
moves grows with the parameters, never with the cells.  Splines evaluate their basis at each cell's own value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.families import ETA_LIMIT, Family
from ..functions.splines import basis, evaluate
from ..plans.tables import Model
from .solve import Block, Fit, Options, _quadratic, design, information, normalize, reference_row, solve_symmetric

#: Parameters whose information, a square matrix, each task may hold.
MOST_PARAMETERS = 3000


def _arrays(batch: pa.RecordBatch, n_tables: int, splines: list[int]) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each table, spline values, a, b, offset, weight) of a batch of cells."""
    get = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
    rows = np.stack([get(f"r{i}").astype(np.int64) for i in range(n_tables)], 1)
    offset = get("o").astype(float) if "o" in batch.schema.names else np.zeros(batch.num_rows)
    return rows, {i: get(f"x{i}").astype(float) for i in splines}, get("a").astype(float), get("b").astype(float), offset, get("w").astype(float)


def pieces(family: Family, a: np.ndarray, b: np.ndarray, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Score, weight and score at a response of 0 of each cell, and their part of the log-likelihood that moves."""
    if family.link == "identity":
        return a - b * eta, b, b * np.abs(eta), float((a * eta - b * eta * eta / 2).sum())
    e = np.clip(eta, -ETA_LIMIT, ETA_LIMIT)
    if family.link == "logit":
        mu = 1 / (1 + np.exp(-e))
        return a - b * mu, b * mu * (1 - mu), b * mu, float((a * e - b * np.logaddexp(0, e)).sum())
    p = family.p
    up, down = a * np.exp((1 - p) * e), b * np.exp((2 - p) * e)
    value = (a * e if p == 1 else up / (1 - p)).sum() - (b * e if p == 2 else down / (2 - p)).sum()
    return up - down, down, down, float(value)


def _summed(cells: DataFrame, run: Callable[[pa.RecordBatch], list[np.ndarray]]) -> list[np.ndarray]:
    """Sums over all batches of the arrays that ``run`` gives for one; a row a task comes to the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] | None = None
        for batch in batches:
            if batch.num_rows:
                own = run(batch)
                total = own if total is None else [x + y for x, y in zip(total, own)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float64).tobytes()], pa.binary()) for x in total], [f"s{i}" for i in range(len(total))])

    n = len(run(_empty(cells)))
    out: list[np.ndarray] | None = None
    schema = ", ".join(f"s{i} binary" for i in range(n))
    few = cells.coalesce(4 * cells.sparkSession.sparkContext.defaultParallelism)
    for r in few.mapInArrow(each, schema).toLocalIterator():
        own = [np.frombuffer(bytes(x)) for x in r]
        out = own if out is None else [x + y for x, y in zip(out, own)]
    return out


def _empty(cells: DataFrame) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array([], kinds[t]) for _, t in cells.dtypes], [c for c, _ in cells.dtypes])


def fit_wide(model: Model, cells: DataFrame, family: Family, options: Options) -> Fit:
    """The fit of fit_cells for any number of cells (r0 .., x.., o, a, b, w), all tables jointly."""
    options.check(model)
    n_tables, splines = len(model.tables), [i for i, t in enumerate(model.tables) if t.knots is not None]
    sizes = np.array([t.n for t in model.tables])
    ends = np.cumsum(sizes)

    def weigh(batch: pa.RecordBatch) -> list[np.ndarray]:
        rows, _, _, _, _, w = _arrays(batch, n_tables, splines)
        return [np.concatenate([np.bincount(rows[:, i], w, n) for i, n in enumerate(sizes)])]

    exposure = np.split(_summed(cells, weigh)[0], ends[:-1])
    blocks, first = [], 0
    for i, t in enumerate(model.tables):
        if t.fixed or t.locked.all():
            continue
        m, bounded = design(t, t.knots, 0 if options.alpha > 0 else reference_row(exposure[i] > 0))
        blocks.append(Block(i, m, first, bool(t.axes) and not t.degree and t.n > 1, bounded))
        first += m.shape[1]
    p = first
    if p > MOST_PARAMETERS:
        raise ValueError(f"{p} parameters over more cells than the driver holds; at most {MOST_PARAMETERS} can be fitted so")
    free = {b.table for b in blocks}
    held = {i: np.where(t.locked, t.factors, 0.0) if i in free else np.asarray(t.factors, float) for i, t in enumerate(model.tables) if i not in free or t.locked.any()}
    knots, factors_of = {i: model.tables[i].knots for i in splines}, {i: model.tables[i].factors for i in splines}
    total = float(exposure[0].sum())
    l1, l2 = total * options.alpha * options.l1_ratio, total * options.alpha * (1 - options.l1_ratio)
    penal, low = np.zeros(p, bool), np.full(p, -np.inf)
    for b in blocks:
        penal[b.columns] = b.penalised
        if b.bounded:
            low[b.columns] = 0.0

    def based(rows: np.ndarray, x: dict[int, np.ndarray], offset: np.ndarray) -> np.ndarray:
        out = offset.copy()
        for i, v in held.items():
            out += evaluate(knots[i], factors_of[i], x[i]) if i in knots and i not in free else v[rows[:, i]]
        return out

    def at(beta: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        """Log-likelihood, size of scores, score and information at parameters."""

        def run(batch: pa.RecordBatch) -> list[np.ndarray]:
            rows, x, a, b, offset, _ = _arrays(batch, n_tables, splines)
            index, local, own = rows.copy(), [], sizes.copy()
            for k in blocks:
                m = k.map
                if k.table in knots:
                    values, index[:, k.table] = np.unique(x[k.table], return_inverse=True)
                    m, own[k.table] = basis(knots[k.table], values)[:, 1:] if len(values) else np.zeros((0, m.shape[1])), len(values)
                local.append(Block(k.table, m, k.first, k.penalised, k.bounded))
            eta = based(rows, x, offset)
            for k in local:
                eta += (k.map @ beta[k.columns])[index[:, k.table]]
            score, weight, zero, value = pieces(family, a, b, eta)
            g = np.concatenate([k.map.T @ np.bincount(index[:, k.table], score, own[k.table]) for k in local]) if len(index) else np.zeros(p)
            h = information(index, own, local, np.maximum(weight, 0)) if len(index) else np.zeros((p, p))
            return [np.array([value, np.maximum(np.abs(score), np.abs(zero)).sum()]), g, h.ravel()]

        head, g, h = _summed(cells, run)
        return float(head[0]), max(float(head[1]), 1e-300), g, h.reshape(p, p)

    def start(batch: pa.RecordBatch) -> list[np.ndarray]:
        rows, x, a, b, offset, _ = _arrays(batch, n_tables, splines)
        base = based(rows, x, offset)
        if family.link == "log":
            e = np.clip(base, -ETA_LIMIT, ETA_LIMIT)
            return [np.array([(a * np.exp((1 - family.p) * e)).sum(), (b * np.exp((2 - family.p) * e)).sum(), 0.0])]
        return [np.array([(a - b * base).sum() if family.link == "identity" else a.sum(), b.sum(), (b * base).sum()])]

    beta = np.zeros(p)
    lead = next((b for b in blocks if not model.tables[b.table].axes), None)
    if lead is not None:
        up, down, moved = _summed(cells, start)[0]
        if family.link == "log":
            beta[lead.first] = np.log(max(up, 1e-300) / max(down, 1e-300))
        elif family.link == "identity":
            beta[lead.first] = up / max(down, 1e-300)
        else:
            m = min(max(up / max(down, 1e-300), 1e-6), 1 - 1e-6)
            beta[lead.first] = np.log(m / (1 - m)) - moved / max(down, 1e-300)
    objective = lambda beta, value: value - l1 * np.abs(beta[penal]).sum() - l2 / 2 * (beta[penal] ** 2).sum()
    value, size, g, h = at(beta)
    now, done, why, most, it, stalled = objective(beta, value), False, np.inf, np.inf, 0, 0
    for it in range(1, options.max_iterations + 1):
        smooth = g - l2 * np.where(penal, beta, 0)
        kkt = smooth.copy()
        kkt[penal] = np.where(beta[penal] != 0, smooth[penal] - l1 * np.sign(beta[penal]), np.sign(smooth[penal]) * np.maximum(np.abs(smooth[penal]) - l1, 0))
        kkt[(beta <= low) & (smooth < 0)] = 0
        most = float(np.abs(kkt).max(initial=0))
        why = most / size
        if why <= options.tolerance:
            done = True
            break
        full = h + np.diag(np.where(penal, l2, 0.0))
        d = _quadratic(full, smooth, beta, np.where(penal, l1, 0.0), low) if l1 > 0 or np.isfinite(low).any() else solve_symmetric(full, smooth)
        step, best = 1.0, None
        for _ in range(30):
            trial = beta + step * d
            got = at(trial)
            new = objective(trial, got[0])
            if np.isfinite(new) and new >= now - 1e-13 * max(1.0, abs(now)):
                best = (trial, got, new)
                break
            step /= 2
        if best is None:
            break
        gain, now = best[2] - now, best[2]
        beta, (value, size, g, h) = best[0], best[1]
        stalled = stalled + 1 if gain <= 1e-15 * max(1.0, abs(now)) else 0
        if stalled >= 12:
            break
    factors = []
    for i, t in enumerate(model.tables):
        own = next((b for b in blocks if b.table == i), None)
        if own is None:
            factors.append(np.asarray(t.factors, float))
        elif t.knots is not None:
            factors.append(np.concatenate([[0.0], beta[own.columns]]))
        else:
            factors.append(np.where(t.locked, t.factors, 0.0) + own.map @ beta[own.columns])
    fit = Fit(factors, blocks, beta, it, done, why, "partitions", np.zeros((0, n_tables), np.int64), sizes, np.zeros(0), h, exposure, (l1, l2), most, options.tolerance)
    normalize(model, fit, options.normalization)
    return fit
