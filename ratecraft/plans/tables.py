"""Rating tables: a model is an ordered list of lookup tables whose factors add up."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np

#: Category code that matches any value, and the code of a label that the encoding lacks.
WILDCARD, UNSEEN = -999, -(2**31)
LINKS = {"gaussian": "identity", "binomial": "logit", "poisson": "log", "gamma": "log", "tweedie": "log"}


@dataclass(frozen=True)
class Axis:
    """A feature of a table: a ``band`` has inclusive upper bounds, a ``category`` integer codes."""

    name: str
    kind: str


@dataclass
class Table:
    """Keys by row, one value for each axis, and a factor on the link scale for each row.

    ``None`` in a key doesn't constrain; a NaN bound matches missing numbers only.  ``values`` and ``degree``
    make a variate, ``direction`` a monotone table, ``knots`` a natural spline whose factors stand at the knots.
    """

    name: str
    kind: str
    axes: tuple[Axis, ...] = ()
    keys: list[tuple] = field(default_factory=lambda: [()])
    factors: np.ndarray | None = None
    locked: np.ndarray | None = None
    fixed: bool = False
    values: np.ndarray | None = None
    degree: int = 0
    direction: str | None = None
    knots: np.ndarray | None = None

    def __post_init__(self) -> None:
        n = len(self.keys)
        self.factors = np.zeros(n) if self.factors is None else np.asarray(self.factors, float)
        self.locked = np.zeros(n, bool) if self.locked is None else np.asarray(self.locked, bool)

    @property
    def n(self) -> int:
        return len(self.keys)

    @property
    def parameters(self) -> int:
        if self.fixed:
            return 0
        if not self.axes:
            return 1
        if self.degree:
            return self.degree
        if self.locked.any():
            return int((~self.locked).sum())
        return self.n - 1

    def wildcards(self, i: int) -> int:
        return sum(a.kind == "category" and k == WILDCARD for a, k in zip(self.axes, self.keys[i]))

    def rounded(self, digits: int) -> "Table":
        """Factors rounded half away from zero."""
        scaled = self.factors * 10.0**digits
        return replace(self, factors=np.sign(scaled) * np.floor(np.abs(scaled) + 0.5) / 10.0**digits)


def matches(table: Table, i: int, values: tuple) -> bool:
    """Whether row i holds for one observation: the plain rule that all binding must equal."""
    for axis, key, x in zip(table.axes, table.keys[i], values):
        if key is None:
            continue
        if axis.kind == "category":
            if key != WILDCARD and (x is None or key != x):
                return False
        else:
            missing = x is None or math.isnan(x)
            if math.isnan(key) != missing or (not missing and not x <= key):
                return False
    return True


def scan(table: Table, values: tuple) -> int | None:
    """Row of one observation by full scan: fewest wildcards, then the first row."""
    # A missing category takes part through the unseen code only.
    if any(a.kind == "category" and x is None for a, x in zip(table.axes, values)):
        return None
    found = [(table.wildcards(i), i) for i in range(table.n) if matches(table, i, values)]
    return min(found)[1] if found else None


@dataclass
class Model:
    """Tables (the first is the intercept), link, and how its columns are read."""

    tables: list[Table]
    family: str = "poisson"
    link: str = "log"
    encodings: dict[str, list[str]] = field(default_factory=dict)
    target: str | None = None
    exposure: str | None = None
    role: str = "none"
    tweedie_power: float = 1.5

    @property
    def predictors(self) -> list[str]:
        out: list[str] = []
        for t in self.tables:
            out += [a.name for a in t.axes if a.name not in out]
        return out

    def table(self, name: str) -> Table:
        return next(t for t in self.tables if t.name == name)
