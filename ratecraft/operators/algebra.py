"""Models as sums of tables: composition, and merging of tables over the same or nested columns."""

from __future__ import annotations

import copy
import itertools
import math

import numpy as np

from ..plans.tables import UNSEEN, WILDCARD, Axis, Model, Table
from .binding import scanner


def merge_encodings(a: dict[str, list[str]], b: dict[str, list[str]]) -> tuple[dict[str, list[str]], dict[str, dict[int, int]]]:
    """The union of labels by column, and the new code of each of b's codes; a's codes stay."""
    out, moved = {c: list(v) for c, v in a.items()}, {}
    for c, labels in b.items():
        own = out.setdefault(c, [])
        at = {label: i for i, label in enumerate(own)}
        for label in labels:
            if label not in at:
                at[label] = len(own)
                own.append(label)
        moved[c] = {i: at[label] for i, label in enumerate(labels)}
    return out, moved


def recode(t: Table, moved: dict[str, dict[int, int]]) -> Table:
    out = copy.deepcopy(t)
    for j, a in enumerate(t.axes):
        if a.kind == "category" and a.name in moved:
            out.keys = [(*k[:j], moved[a.name].get(k[j], k[j]) if k[j] is not None else None, *k[j + 1 :]) for k in out.keys]
    return out


def combine(a: Model, b: Model) -> Model:
    """The model whose linear predictor is the sum of both: intercepts add, other tables stand side by side."""
    if a.link != b.link:
        raise ValueError(f"models with links {a.link} and {b.link} can't be combined")
    for c in {x.name for t in a.tables for x in t.axes if x.kind == "category"} & {x.name for t in b.tables for x in t.axes if x.kind == "category"}:
        if (c in a.encodings) != (c in b.encodings):
            raise ValueError(f"column {c} has labels in one model and codes in the other")
    encodings, moved = merge_encodings(a.encodings, b.encodings)
    head = copy.deepcopy(a.tables[0])
    head.factors = head.factors + b.tables[0].factors
    tables, names = [head], {head.name}
    for t in [*a.tables[1:], *[recode(t, moved) for t in b.tables[1:]]]:
        t = copy.deepcopy(t)
        base, k = t.name, 2
        while t.name in names:
            t.name, k = f"{base}_{k}", k + 1
        names.add(t.name)
        tables.append(t)
    return Model(tables, a.family, a.link, encodings, a.target, a.exposure, a.role, a.tweedie_power)


def axis_values(tables: list[Table], axis: Axis) -> list:
    """All values that any table has on an axis: ascending numbers with NaN last, codes with the wildcard last."""
    found = {k[t.axes.index(axis)] for t in tables if axis in t.axes for k in t.keys}
    if axis.kind == "category":
        found = {WILDCARD if v is None else v for v in found}
        return [*sorted(v for v in found if v != WILDCARD), *([WILDCARD] if WILDCARD in found else [])]
    nan = any(v is not None and math.isnan(v) for v in found)
    plain = sorted(v for v in found if v is not None and not math.isnan(v))
    return [*plain, *([math.nan] if nan else [])]


def expand(tables: list[Table], name: str | None = None, most: int = 5_000_000) -> Table:
    """One table over the product of all axis values whose factors are the sums of look-ups."""
    if any(t.knots is not None for t in tables):
        raise ValueError("splines can't be expanded")
    axes = sorted({a for t in tables for a in t.axes}, key=lambda a: (a.kind != "band", [x for t in tables for x in t.axes].index(a)))
    values = [axis_values(tables, a) for a in axes]
    if math.prod(map(len, values)) > most:
        raise ValueError(f"the product of the tables has more than {most} rows")
    total = np.zeros(tuple(map(len, values)))
    for t in tables:
        at = [axes.index(a) for a in t.axes]
        # The wildcard of the product stands for codes that no table lists.
        own = [np.array([UNSEEN if v == WILDCARD else v for v in values[j]], np.int64) if axes[j].kind == "category" else np.array(values[j], float) for j in at]
        if not at:
            total += float(t.factors[0])
            continue
        rows = scanner(t)([g.ravel() for g in np.meshgrid(*own, indexing="ij")])
        found = np.where(rows >= 0, np.asarray(t.factors, float)[rows], math.nan).reshape([len(v) for v in own])
        # The table's own product, turned to the order of all axes, is added along those that it lacks.
        total += np.transpose(found, np.argsort(at)).reshape([len(values[j]) if j in at else 1 for j in range(len(axes))])
    keys, total = list(itertools.product(*values)), total.ravel()
    return Table(name or " + ".join(t.name for t in tables), "combined", tuple(axes), keys, total)


def consolidate(model: Model, mode: str = "max") -> Model:
    """Merges tables: "analysis" those over the same columns, "max" also those whose columns are among another's, until none is left.

    Merged tables lose locks, offsets and variates; splines stay apart.  Feature-less tables go into the intercept.
    """
    if mode not in ("max", "analysis"):
        raise ValueError("consolidation must be max or analysis")
    head = copy.deepcopy(model.tables[0])
    rest = [t for t in model.tables[1:] if t.axes and t.knots is None]
    apart = [t for t in model.tables[1:] if t.knots is not None]
    for t in model.tables[1:]:
        if not t.axes:
            head.factors = head.factors + t.factors
    groups: list[tuple[set, list[Table]]] = []
    for t in rest:
        own = set(t.axes)
        home = next((g for g in groups if g[0] == own), None)
        if home:
            home[1].append(t)
        else:
            groups.append((own, [t]))
    if mode == "max":
        changed = True
        while changed:
            changed = False
            for i, j in itertools.permutations(range(len(groups)), 2):
                if groups[i][0] <= groups[j][0]:
                    groups[j][1].extend(groups[i][1])
                    del groups[i]
                    changed = True
                    break
    made = [copy.deepcopy(g[0]) if len(g) == 1 else expand(g) for _, g in groups]
    return Model([head, *made, *copy.deepcopy(apart)], model.family, model.link, model.encodings, model.target, model.exposure, model.role, model.tweedie_power)
