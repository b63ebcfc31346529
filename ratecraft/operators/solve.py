"""Fitting on cells: penalised, bounded Newton steps over linear designs of the tables.

Each free table is a linear map from parameters to its row effects (for a spline, to the effects of
its distinct values): contrasts with row 0, a polynomial basis, cumulative steps for a monotone
table, a cardinal basis for a spline.  Sums over cells give the score and the
information of row effects, pair by pair of tables, and the maps turn them into those of the parameters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..functions.families import ETA_LIMIT, Family
from ..functions.splines import basis
from ..plans.tables import Model, Table
from .cells import Cells


@dataclass
class Options:
    """Fit options. ``alpha`` and ``l1_ratio`` penalise contrasts; ``covariance`` is model, robust or cluster."""

    max_iterations: int = 100
    tolerance: float = 1e-9
    alpha: float = 0.0
    l1_ratio: float = 0.0
    solver: str = "auto"
    normalization: str = "base_level"
    compute_standard_errors: bool = True
    covariance: str = "model"
    cluster: str | None = None
    tweedie_power: float | None = None
    verbose: bool = False
    accelerate: bool = True
    solve_aliased_pairs_jointly: bool = True

    def check(self, model: Model) -> None:
        free = [t for t in model.tables if not t.fixed]
        monotone, spline = any(t.direction for t in free), any(t.knots is not None for t in free)
        partly = any(t.locked.any() and not t.locked.all() for t in free)
        robust = self.covariance != "model"
        rules = [
            (self.alpha < 0, "alpha must not be negative"),
            (not 0 <= self.l1_ratio <= 1, "l1_ratio must be from 0 to 1"),
            (self.solver not in ("auto", "global", "table"), "solver must be auto, global or table"),
            (self.covariance not in ("model", "robust", "cluster"), "covariance must be model, robust or cluster"),
            (self.normalization not in ("base_level", "weighted_mean", "none"), "normalization must be base_level, weighted_mean or none"),
            (self.covariance == "cluster" and not self.cluster, "cluster covariance needs a cluster column"),
            (spline and self.alpha > 0, "splines can't be penalised"),
            (spline and self.solver == "global", "splines need the table solver"),
            (spline and any(t.knots is not None and t.locked.any() for t in free), "a spline's knots can't be locked one by one"),
            (robust and self.alpha > 0, "robust errors of penalised fits aren't defined"),
            (robust and not self.compute_standard_errors, "robust covariance needs standard errors"),
            (robust and self.normalization == "none", "robust covariance needs a normalization"),
            (monotone and self.alpha > 0, "monotone tables can't be penalised"),
            (monotone and self.solver == "global", "monotone tables need the table solver"),
            (monotone and robust, "robust errors of monotone fits aren't defined"),
            (any(t.direction and t.locked.any() for t in free), "a monotone table's rows can't be locked"),
            (monotone and model.link != "log", "monotone tables need a log link"),
            (self.alpha > 0 and self.normalization != "base_level", "a penalty needs base_level normalization"),
            (partly and self.solver == "global" and any(t.locked[0] != t.locked.any() for t in free if t.locked.any() and t.kind != "interaction_contrast"), "the global solver can't lock single rows"),
        ]
        for bad, why in rules:
            if bad:
                raise ValueError(why)


@dataclass
class Block:
    """Columns of one free table: ``map`` is (row effects x parameters)."""

    table: int
    map: np.ndarray
    first: int
    penalised: bool
    bounded: bool = False

    @property
    def columns(self) -> slice:
        return slice(self.first, self.first + self.map.shape[1])


@dataclass
class Fit:
    """What a fit gives: row factors by table, parameters and the pieces that inference needs."""

    factors: list[np.ndarray]
    blocks: list[Block]
    beta: np.ndarray
    iterations: int
    converged: bool
    score: float
    solver: str
    index: np.ndarray
    sizes: np.ndarray
    eta: np.ndarray
    information: np.ndarray
    exposure: list[np.ndarray]
    penalty: tuple[float, float] = (0.0, 0.0)
    most: float = float("inf")
    tolerance: float = 0.0
    notes: list[str] = field(default_factory=list)

    def judged_by_rows(self, size: float) -> None:
        """Takes the sum over rows of the larger of |score| and |score at a response of 0| as the scale of the largest free score."""
        self.score = self.most / max(size, 1e-300)
        self.converged = self.score <= self.tolerance


def contrasts(n: int, fixed: np.ndarray) -> np.ndarray:
    """Unit columns for the rows that are free."""
    return np.eye(n)[:, ~fixed]


def polynomial(values: np.ndarray, degree: int) -> np.ndarray:
    """Powers of the values, centred and scaled to [-1, 1]."""
    lo, hi = float(values.min()), float(values.max())
    z = (values - (lo + hi) / 2) / max((hi - lo) / 2, 1e-300)
    return np.stack([z**k for k in range(1, degree + 1)], 1)


def reference_row(has_data: np.ndarray) -> int:
    """The first row that holds data; the first of all where none does."""
    return int(np.argmax(has_data)) if len(has_data) else 0


def design(t: Table, x: np.ndarray | None, reference: int) -> tuple[np.ndarray, bool]:
    """(map, whether parameters but the first are bounded below by 0); step tables are contrasts with the reference row."""
    if not t.axes:
        return np.ones((1, 1)), False
    if t.knots is not None:
        full = basis(t.knots, x)
        return full[:, 1:], False
    if t.degree:
        return polynomial(t.values, t.degree), False
    if t.direction:
        steps = np.tril(np.ones((t.n, t.n)))[:, 1:]
        return steps if t.direction == "increasing" else -steps, True
    fixed = t.locked.copy()
    if not t.locked.any():
        fixed[reference] = True
    return contrasts(t.n, fixed), False


def row_sums(index: np.ndarray, sizes: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    return [np.bincount(index[:, i], v, n) for i, n in enumerate(sizes)]


def information(index: np.ndarray, sizes: np.ndarray, blocks: list[Block], w: np.ndarray) -> np.ndarray:
    """Parameters' information from cell weights, by cross tables of rows."""
    p = sum(b.map.shape[1] for b in blocks)
    out = np.zeros((p, p))
    for k, b in enumerate(blocks):
        i, n = index[:, b.table], int(sizes[b.table])
        out[b.columns, b.columns] = b.map.T @ (np.bincount(i, w, n)[:, None] * b.map)
        for c in blocks[:k]:
            m = int(sizes[c.table])
            cross = np.bincount(i * m + index[:, c.table], w, n * m).reshape(n, m)
            out[b.columns, c.columns] = b.map.T @ cross @ c.map
            out[c.columns, b.columns] = out[b.columns, c.columns].T
    return out


def _quadratic(h: np.ndarray, g: np.ndarray, beta: np.ndarray, l1: np.ndarray, low: np.ndarray, sweeps: int = 2000) -> np.ndarray:
    """Minimises -g'd + d'Hd/2 + l1'|beta+d| with beta+d >= low, by coordinate descent."""
    b, r = beta.copy(), g.copy()
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(b)):
            if h[j, j] <= 0:
                continue
            z = b[j] + r[j] / h[j, j]
            new = np.sign(z) * max(abs(z) - l1[j] / h[j, j], 0.0)
            new = max(new, low[j])
            if (d := new - b[j]) != 0.0:
                r -= h[:, j] * d
                b[j] = new
                most = max(most, abs(d) * np.sqrt(h[j, j]))
        if most < 1e-13 * max(1.0, float(np.abs(g).max(initial=0))):
            break
    return b - beta


def solve_symmetric(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """H^-1 g, by least squares where H is singular."""
    scale = np.sqrt(np.maximum(np.diag(h), 1e-300))
    a = h / scale[:, None] / scale[None, :]
    try:
        low = np.linalg.cholesky(a)
        if np.diag(low).min() > 1e-6:
            return np.linalg.solve(low.T, np.linalg.solve(low, g / scale)) / scale
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(a, g / scale, rcond=1e-11)[0] / scale


def low_or_curved(model: Model) -> bool:
    """Whether a model has terms that the name of the global solver doesn't stand for."""
    return any(t.direction or t.knots is not None for t in model.tables if not t.fixed)


#: Parameters that are solved for jointly; more go table by table.
MOST_JOINT = 6000
#: Canonical correlation from which two tables are solved together in a sweep.
NEAR_PAIR = 0.9
#: The step of a row without a response, whose best factor is minus infinity.
EMPTY_STEP = -10.0


@dataclass
class Sweeps:
    """The table solver: one table after the other, each at its optimum given the rest.

    A step table under a log link without penalty takes its exact step, the logarithm of actual over expected by row.  Any other
    block, and two nearly aliased tables together, take a damped Newton step.  Every third sweep is followed by a squared extrapolation,
    kept only if the objective doesn't fall.
    """

    index: np.ndarray
    sizes: np.ndarray
    blocks: list[Block]
    eta_of: object
    parts: object
    objective: object
    family: Family
    penal: np.ndarray
    l1: float
    l2: float
    low: np.ndarray
    exact: bool

    def groups(self, weight: np.ndarray, jointly: bool) -> list[list[Block]]:
        """Disjoint pairs of nearly aliased tables, then the other blocks; the intercept comes last."""
        from .audit import canonical

        own = [b for b in self.blocks if b.penalised or not (b.map.shape == (1, 1))]
        rest = [b for b in self.blocks if b not in own]
        pairs: list[list[Block]] = []
        if jointly and not self.l1:
            found = []
            for k, b in enumerate(own):
                for c in own[:k]:
                    n, m = int(self.sizes[b.table]), int(self.sizes[c.table])
                    if min(n, m) > 1:
                        rho = canonical(np.bincount(self.index[:, b.table] * m + self.index[:, c.table], weight, n * m).reshape(n, m))
                        if rho >= NEAR_PAIR:
                            found.append((rho, [c, b] if c.map.shape[1] >= b.map.shape[1] else [b, c]))
            used: set[int] = set()
            for _, pair in sorted(found, key=lambda x: -x[0]):
                if not used & {b.table for b in pair}:
                    used |= {b.table for b in pair}
                    pairs.append(pair)
            own = [b for b in own if b.table not in used]
        return [*pairs, *[[b] for b in own], *[[b] for b in rest]]

    def plain(self, b: Block) -> bool:
        """Whether the block's columns are rows of a step table, or the intercept."""
        return self.family.link == "log" and self.exact and not b.bounded and bool(np.isin(b.map, (0.0, 1.0)).all()) and bool((b.map.sum(1) <= 1).all())

    def step(self, group: list[Block], beta: np.ndarray, score: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """New parameters of one group; the others stay."""
        out = beta.copy()
        if len(group) == 1 and self.plain(group[0]):
            b = group[0]
            i, n = self.index[:, b.table], int(self.sizes[b.table])
            down = np.bincount(i, weight, n) @ b.map
            up = np.bincount(i, score, n) @ b.map + down
            move = np.where(down > 0, np.where(up > 0, np.log(np.maximum(up, 1e-300) / np.maximum(down, 1e-300)), EMPTY_STEP), 0.0)
            out[b.columns] += move
            return np.clip(out, -ETA_LIMIT, ETA_LIMIT)
        at = np.concatenate([np.arange(b.columns.start, b.columns.stop) for b in group])
        local, first = [], 0
        for b in group:
            local.append(Block(b.table, b.map, first, b.penalised, b.bounded))
            first += b.map.shape[1]
        g = np.concatenate([b.map.T @ np.bincount(self.index[:, b.table], score, self.sizes[b.table]) for b in group]) - self.l2 * np.where(self.penal[at], beta[at], 0)
        h = information(self.index, self.sizes, local, np.maximum(weight, 0)) + np.diag(np.where(self.penal[at], self.l2, 0.0))
        h += np.diag(1e-9 * np.diag(h)) if len(group) > 1 else 0.0
        d = _quadratic(h, g, beta[at], np.where(self.penal[at], self.l1, 0.0), self.low[at]) if self.l1 > 0 or np.isfinite(self.low[at]).any() else solve_symmetric(h, g)
        now = self.objective(beta, self.parts(self.eta_of(beta))[2])
        size = 1.0
        for _ in range(40):
            out[at] = beta[at] + size * d
            new = self.objective(out, self.parts(self.eta_of(out))[2])
            if np.isfinite(new) and new >= now - 1e-13 * max(1.0, abs(now)):
                return out
            size /= 2
        return beta

    def sweep(self, beta: np.ndarray, groups: list[list[Block]]) -> np.ndarray:
        for g in groups:
            score, weight, _ = self.parts(self.eta_of(beta))
            beta = self.step(g, beta, score, weight)
        return beta

    def run(self, beta: np.ndarray, gradient, size_of, options: Options) -> tuple[np.ndarray, int, bool, float]:
        """(parameters, sweeps, converged, measure)."""
        _, weight, _ = self.parts(self.eta_of(beta))
        groups = self.groups(np.maximum(weight, 0), options.solve_aliased_pairs_jointly)
        extrapolate = options.accelerate and not np.isfinite(self.low).any()
        past: list[np.ndarray] = []
        why, stalled = np.inf, 0
        for it in range(1, options.max_iterations + 1):
            last, beta = beta, self.sweep(beta, groups)
            eta = self.eta_of(beta)
            score, weight, value = self.parts(eta)
            why = gradient(beta, score)[1] / size_of(eta, score, weight)
            if why <= options.tolerance:
                return beta, it, True, why
            now = self.objective(beta, value)
            stalled = stalled + 1 if float(np.abs(beta - last).max(initial=0)) <= 1e-15 else 0
            if stalled >= 12:
                break
            past.append(beta)
            if extrapolate and len(past) == 3:
                r, v = past[1] - past[0], past[2] - 2 * past[1] + past[0]
                if (length := float(np.linalg.norm(v))) > 0:
                    reach = max(1.0, float(np.linalg.norm(r)) / length)
                    for _ in range(6):
                        trial = past[0] + 2 * reach * r + reach * reach * v
                        new = self.objective(trial, self.parts(self.eta_of(trial))[2])
                        if np.isfinite(new) and new >= now:
                            beta = trial
                            break
                        reach = (reach + 1) / 2
                past = []
        return beta, it, False, why


def fit_cells(model: Model, cells: Cells, family: Family, options: Options) -> Fit:
    """Fits the free tables of a model; fixed tables and locked rows keep their factors."""
    options.check(model)
    n_tables = len(model.tables)
    index, sizes, xs = cells.rows.copy(), np.array([t.n for t in model.tables]), {}
    for i, x in cells.x.items():
        xs[i], index[:, i] = np.unique(x, return_inverse=True)
        sizes[i] = len(xs[i])
    exposure = row_sums(cells.rows, np.array([t.n for t in model.tables]), cells.weight)
    blocks, first = [], 0
    for i, t in enumerate(model.tables):
        if t.fixed or t.locked.all():
            continue
        # A penalty is on contrasts with row 0, whatever it holds.
        m, bounded = design(t, xs.get(i), 0 if options.alpha > 0 else reference_row(exposure[i] > 0))
        blocks.append(Block(i, m, first, bool(t.axes) and not t.degree and t.n > 1, bounded))
        first += m.shape[1]
    base = cells.offset.copy()
    start = [np.array(t.factors) for t in model.tables]
    for i, t in enumerate(model.tables):
        own = next((b for b in blocks if b.table == i), None)
        if own is None or t.locked.any():
            value = np.where(t.locked | t.fixed, t.factors, 0.0) if own is not None else t.factors
            if t.knots is not None:
                from ..functions.splines import evaluate

                value = evaluate(t.knots, t.factors, xs[i])
            base += value[index[:, i]]
    p = first
    beta = np.zeros(p)
    total = float(cells.weight.sum())
    l1, l2 = total * options.alpha * options.l1_ratio, total * options.alpha * (1 - options.l1_ratio)
    penal = np.zeros(p, bool)
    low = np.full(p, -np.inf)
    for b in blocks:
        penal[b.columns] = b.penalised
        if b.bounded:
            low[b.columns] = 0.0
    a, bb, power = cells.a, cells.b, family.p

    def eta_of(beta: np.ndarray) -> np.ndarray:
        out = base.copy()
        for b in blocks:
            out += (b.map @ beta[b.columns])[index[:, b.table]]
        return out

    def parts(eta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Score and weight of each cell, and the part of the log-likelihood that moves."""
        if family.link == "identity":
            return a - bb * eta, bb, float((a * eta - bb * eta * eta / 2).sum())
        e = np.clip(eta, -ETA_LIMIT, ETA_LIMIT)
        if family.link == "logit":
            mu = 1 / (1 + np.exp(-e))
            return a - bb * mu, bb * mu * (1 - mu), float((a * e - bb * np.logaddexp(0, e)).sum())
        up, down = a * np.exp((1 - power) * e), bb * np.exp((2 - power) * e)
        value = (a * e if power == 1 else up / (1 - power)).sum() - (bb * e if power == 2 else down / (2 - power)).sum()
        return up - down, down, float(value)

    def objective(beta: np.ndarray, value: float) -> float:
        return value - l1 * np.abs(beta[penal]).sum() - l2 / 2 * (beta[penal] ** 2).sum()

    intercept = next((b for b in blocks if not model.tables[b.table].axes), None)
    if intercept is not None:
        beta[intercept.first] = _null_start(family, a, bb, base)
    solver = options.solver
    if solver == "auto":
        solver = "global" if p <= MOST_JOINT else "table"
    eta = eta_of(beta)
    score, weight, value = parts(eta)
    now, done, why, it = objective(beta, value), False, np.inf, 0

    def gradient(beta: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, float]:
        """The smooth part's gradient, and the largest free score."""
        g = np.concatenate([b.map.T @ np.bincount(index[:, b.table], score, sizes[b.table]) for b in blocks]) if blocks else np.zeros(0)
        smooth = g - l2 * np.where(penal, beta, 0)
        kkt = smooth.copy()
        kkt[penal] = np.where(beta[penal] != 0, smooth[penal] - l1 * np.sign(beta[penal]), np.sign(smooth[penal]) * np.maximum(np.abs(smooth[penal]) - l1, 0))
        kkt[(beta <= low) & (smooth < 0)] = 0
        return smooth, float(np.abs(kkt).max(initial=0))

    def size_of(eta: np.ndarray, score: np.ndarray, weight: np.ndarray) -> float:
        """Sum over cells of the larger of |score| and |score at a response of 0|.

        The same sum over rows is at least as large, so what has converged by this measure has by that of rows.
        """
        zero = weight if family.link == "log" else bb * np.abs(eta) if family.link == "identity" else bb / (1 + np.exp(-np.clip(eta, -ETA_LIMIT, ETA_LIMIT)))
        return max(float(np.maximum(np.abs(score), np.abs(zero)).sum()), 1e-300)

    most = np.inf
    if solver == "table":
        problem = Sweeps(index, sizes, blocks, eta_of, parts, objective, family, penal, l1, l2, low, exact=l1 + l2 == 0)
        beta, it, done, why = problem.run(beta, gradient, size_of, options)
        most = gradient(beta, parts(eta_of(beta))[0])[1]
    stalled = 0
    for it in range(1, options.max_iterations + 1) if solver != "table" else ():
        smooth, most = gradient(beta, score)
        why = most / size_of(eta, score, weight)
        if why <= options.tolerance:
            done = True
            break
        h = information(index, sizes, blocks, np.maximum(weight, 0)) + np.diag(np.where(penal, l2, 0.0))
        if l1 > 0 or np.isfinite(low).any():
            d = _quadratic(h, smooth, beta, np.where(penal, l1, 0.0), low)
        else:
            d = solve_symmetric(h, smooth)
        step, best = 1.0, None
        for _ in range(30):
            trial = beta + step * d
            eta = eta_of(trial)
            s2, w2, v2 = parts(eta)
            new = objective(trial, v2)
            if np.isfinite(new) and new >= now - 1e-13 * max(1.0, abs(now)):
                best = (trial, s2, w2, new)
                break
            step /= 2
        if best is None:
            break
        gain = best[3] - now
        beta, score, weight, now = best
        stalled = stalled + 1 if gain <= 1e-15 * max(1.0, abs(now)) else 0
        if stalled >= 12:
            break
        if options.verbose:
            print(f"iteration {it}: objective {now:.12g}, score {why:.3g}")
    eta = eta_of(beta)
    score, weight, _ = parts(eta)
    factors = []
    for i, t in enumerate(model.tables):
        own = next((b for b in blocks if b.table == i), None)
        if own is None:
            factors.append(start[i])
        elif t.knots is not None:
            factors.append(np.concatenate([[0.0], beta[own.columns]]))
        else:
            factors.append(np.where(t.locked, t.factors, 0.0) + own.map @ beta[own.columns])
    fit = Fit(factors, blocks, beta, it, done, why, solver if solver == "table" or options.solver != "auto" or not low_or_curved(model) else "joint", index, sizes, eta, information(index, sizes, blocks, np.maximum(weight, 0)) if blocks else np.zeros((0, 0)), exposure, (l1, l2), most, options.tolerance)
    normalize(model, fit, options.normalization)
    return fit


def _null_start(family: Family, a: np.ndarray, b: np.ndarray, base: np.ndarray) -> float:
    """The intercept of the model without other terms."""
    if family.link == "identity":
        return float((a - b * base).sum() / max(b.sum(), 1e-300))
    if family.link == "logit":
        m = min(max(float(a.sum() / max(b.sum(), 1e-300)), 1e-6), 1 - 1e-6)
        return float(np.log(m / (1 - m)) - np.average(base, weights=b))
    e = np.clip(base, -ETA_LIMIT, ETA_LIMIT)
    up, down = float((a * np.exp((1 - family.p) * e)).sum()), float((b * np.exp((2 - family.p) * e)).sum())
    return float(np.log(max(up, 1e-300) / max(down, 1e-300)))


def normalize(model: Model, fit: Fit, mode: str) -> None:
    """Moves each free table's level into the intercept; base rows, or exposure-weighted means, become 0."""
    home = next((i for i, t in enumerate(model.tables) if not t.axes and not t.fixed and not t.locked.any()), None)
    if home is None or mode == "none":
        return
    for i, t in enumerate(model.tables):
        if i == home or t.fixed or t.locked.any() or not t.axes:
            continue
        e = fit.exposure[i]
        if mode == "weighted_mean":
            if t.degree or t.knots is not None or e.sum() <= 0:
                continue
            shift = float((fit.factors[i] * e).sum() / e.sum())
        else:
            base = reference_row(e > 0) if not t.direction and not sum(fit.penalty) else 0
            shift = 0.0 if t.knots is not None or t.degree else float(fit.factors[i][base])
        fit.factors[i] = fit.factors[i] - shift
        fit.factors[home] = fit.factors[home] + shift
