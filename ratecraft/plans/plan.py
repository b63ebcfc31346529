"""Plans: declared terms that become tables once the data has said where bands and levels lie."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands
from ..functions.families import Family
from .tables import LINKS, Axis, Model, Table

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
INTEGER = ("tinyint", "smallint", "int", "bigint", "boolean")
#: Levels of a category at most.
MAX_LEVELS = 100_000


@dataclass(frozen=True)
class Term:
    """One declared term; which fields count depends on its kind."""

    kind: str
    name: str
    columns: tuple[str, ...]
    breaks: tuple | None = None
    quantile: int | None = None
    equal_width: int | None = None
    base: str | None = None
    direction: str | None = None
    degree: int = 1
    values: tuple[float, ...] | None = None
    table: dict | None = None


@dataclass(frozen=True)
class Plan:
    """A model declaration; every method returns a new plan."""

    family: str
    exposure: str | None = None
    exposure_role: str | None = None
    tweedie_power: float = 1.5
    terms: tuple[Term, ...] = ()
    encodings: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        Family(self.family, self.tweedie_power)
        role = self.exposure_role or ("none" if self.exposure is None else "offset" if self.family == "poisson" else "weight")
        if role not in ("none", "offset", "weight"):
            raise ValueError("exposure_role must be offset or weight")
        if role != "none" and self.exposure is None:
            raise ValueError("an exposure role needs an exposure column")
        object.__setattr__(self, "exposure_role", role)

    @staticmethod
    def frequency(exposure: str) -> "Plan":
        """Poisson claim rates weighted by exposure."""
        return Plan("poisson", exposure, "weight")

    @staticmethod
    def severity(claim_count: str) -> "Plan":
        """Gamma mean claims weighted by their number."""
        return Plan("gamma", claim_count, "weight")

    @staticmethod
    def pure_premium(exposure: str) -> "Plan":
        """Tweedie loss rates weighted by exposure."""
        return Plan("tweedie", exposure, "weight")

    def _add(self, term: Term) -> "Plan":
        if any(t.name == term.name for t in self.terms) or term.name == "intercept":
            raise ValueError(f"there is a table {term.name} already")
        return replace(self, terms=(*self.terms, term))

    @staticmethod
    def _one(**given) -> None:
        if sum(v is not None for v in given.values()) != 1:
            raise ValueError(f"give one of {', '.join(given)}")

    def banded(self, column: str, breaks=None, quantile: int | None = None, equal_width: int | None = None) -> "Plan":
        self._one(breaks=breaks, quantile=quantile, equal_width=equal_width)
        return self._add(Term("banded", column, (column,), None if breaks is None else tuple(breaks), quantile, equal_width))

    def categorical(self, column: str, base: str | None = None) -> "Plan":
        """``base`` is a level, "first" or (the default) the level of most exposure."""
        return self._add(Term("categorical", column, (column,), base=base))

    def variate(self, column: str, breaks=None, quantile: int | None = None, equal_width: int | None = None, degree: int = 1, values=None) -> "Plan":
        self._one(breaks=breaks, quantile=quantile, equal_width=equal_width)
        if not 1 <= degree <= 8:
            raise ValueError("degree must be from 1 to 8")
        return self._add(Term("variate", column, (column,), None if breaks is None else tuple(breaks), quantile, equal_width, degree=degree, values=None if values is None else tuple(values)))

    def monotone(self, column: str, direction: str, breaks=None, quantile: int | None = None, equal_width: int | None = None) -> "Plan":
        self._one(breaks=breaks, quantile=quantile, equal_width=equal_width)
        if direction not in ("increasing", "decreasing"):
            raise ValueError("direction must be increasing or decreasing")
        if self.family not in ("poisson", "gamma", "tweedie"):
            raise ValueError("monotone tables are for poisson, gamma and tweedie")
        return self._add(Term("monotone", column, (column,), None if breaks is None else tuple(breaks), quantile, equal_width, direction=direction))

    def spline(self, column: str, knots=None, quantile: int | None = None, equal_width: int | None = None) -> "Plan":
        if knots is None and equal_width is None:
            quantile = quantile or 5
        return self._add(Term("spline", column, (column,), None if knots is None else tuple(knots), quantile, equal_width))

    def interaction(self, columns, breaks) -> "Plan":
        """``breaks`` has for each column its breaks, or None where it is a category."""
        if len(columns) < 2 or len(columns) != len(breaks):
            raise ValueError("an interaction needs two columns at least, and breaks or None for each")
        return self._add(Term("interaction", " x ".join(columns), tuple(columns), tuple(None if b is None else tuple(b) for b in breaks)))

    def given(self, name: str, table: Table) -> "Plan":
        """A table of given structure whose factors are fitted anew."""
        return self._add(Term("given", name, tuple(a.name for a in table.axes), table=_dump(table)))

    def offset(self, name: str, table: Table) -> "Plan":
        """A table whose factors are fixed."""
        return self._add(Term("offset", name, tuple(a.name for a in table.axes), table=_dump(table)))

    def offset_model(self, model, prefix: str = "prior") -> "Plan":
        """All tables of a fitted model as offsets, with its encodings."""
        out = self
        for t in model.model.tables:
            out = out.offset(f"{prefix}.{t.name}", t)
        return replace(out, encodings={**out.encodings, **model.model.encodings})

    def with_encoding(self, source) -> "Plan":
        """Takes the label codes of a fitted model."""
        return replace(self, encodings={**self.encodings, **source.model.encodings})

    @property
    def term_names(self) -> list[str]:
        return [t.name for t in self.terms]

    def to_json(self) -> str:
        return json.dumps({**asdict(self), "terms": [{k: v for k, v in asdict(t).items() if v is not None} for t in self.terms]}, default=str)

    @staticmethod
    def from_json(text: str) -> "Plan":
        got = json.loads(text)
        tup = lambda v: tuple(tup(x) for x in v) if isinstance(v, list) else v
        got["terms"] = tuple(Term(**{k: tup(v) if k in ("columns", "breaks", "values") else v for k, v in t.items()}) for t in got["terms"])
        return Plan(**got)

    # What the data decides.

    def check(self, df: DataFrame, target: str):
        from ..operators.audit import check_plan

        return check_plan(self, df, target)

    def build(self, df: DataFrame, target: str | None = None) -> tuple[Model, list[dict]]:
        """The model with zero factors, and what was resolved for each term."""
        return build(self, df, target)

    def fit(self, df: DataFrame, target: str, **options):
        from ..operators.fitted import fit_plan

        return fit_plan(self, df, target, **options)


def _dump(t: Table) -> dict:
    num = lambda v: None if v is None else (v if isinstance(v, int) else repr(float(v)))
    return {
        "kind": t.kind, "axes": [[a.name, a.kind] for a in t.axes], "keys": [[num(k) for k in key] for key in t.keys], "factors": [repr(float(f)) for f in t.factors],
        "locked": [bool(x) for x in t.locked], "degree": t.degree, "values": None if t.values is None else [repr(float(v)) for v in t.values],
        "direction": t.direction, "knots": None if t.knots is None else [repr(float(v)) for v in t.knots],
    }


def _load(name: str, d: dict, fixed: bool) -> Table:
    axes = tuple(Axis(n, k) for n, k in d["axes"])
    keys = [tuple(None if k is None else (int(k) if a.kind == "category" else float(k)) for k, a in zip(key, axes)) for key in d["keys"]]
    arr = lambda v: None if v is None else np.array([float(x) for x in v])
    return Table(name, "offset" if fixed else d["kind"], axes, keys, arr(d["factors"]), np.array(d["locked"], bool), fixed, arr(d["values"]), d["degree"], d["direction"], arr(d["knots"]))


def category_columns(plan: Plan) -> list[str]:
    out: list[str] = []
    for t in plan.terms:
        own = [t.columns[0]] if t.kind == "categorical" else [c for c, b in zip(t.columns, t.breaks) if b is None] if t.kind == "interaction" else [a for a, k in t.table["axes"] if k == "category"] if t.table else []
        out += [c for c in own if c not in out]
    return out


def number_columns(plan: Plan) -> list[str]:
    out: list[str] = []
    for t in plan.terms:
        own = [c for c, b in zip(t.columns, t.breaks) if b is not None] if t.kind == "interaction" else [a for a, k in t.table["axes"] if k == "band"] if t.table else [] if t.kind == "categorical" else list(t.columns)
        out += [c for c in own if c not in out]
    return out


def weight_column(plan: Plan):
    return F.col(f"`{plan.exposure}`").cast("double") if plan.exposure else F.lit(1.0)


def levels(plan: Plan, df: DataFrame) -> tuple[dict[str, list[str]], dict[str, list[tuple[int, float]]]]:
    """Encodings of text columns, and (code, exposure) of every category's levels."""
    encodings, found = {c: list(v) for c, v in plan.encodings.items()}, {}
    types = dict(df.dtypes)
    names, each = category_columns(plan), None
    for i, c in enumerate(names):
        if c not in types:
            raise ValueError(f"column {c} is missing")
        kind = types[c]
        if kind not in (*INTEGER, "string"):
            raise ValueError(f"column {c} of type {kind} can't be a category; cast it to string or integer")
        v = F.col(f"`{c}`") if kind == "string" else F.col(f"`{c}`").cast("int")
        own = df.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.sum(weight_column(plan)).alias("w")).limit(MAX_LEVELS + 1).select(F.lit(i).alias("i"), F.col("v").cast("string").alias("v"), "w")
        each = own if each is None else each.unionByName(own)
    # One job has the levels of all columns.
    rows: list[list] = [[] for _ in names]
    for r in each.collect() if each is not None else ():
        rows[r.i].append(r)
    for c, got in zip(names, rows):
        if len(got) > MAX_LEVELS:
            raise ValueError(f"column {c} has more than {MAX_LEVELS} levels")
        if types[c] == "string":
            encodings.setdefault(c, sorted({r.v for r in got}, key=str.encode))
            code = {label: i for i, label in enumerate(encodings[c])}
            found[c] = sorted((code[r.v], r.w or 0.0) for r in got if r.v in code)
        else:
            found[c] = sorted((int(r.v), r.w or 0.0) for r in got)
    return encodings, found


def _base_first(codes: list[tuple[int, float]], base: str | None, encoding: list[str] | None, column: str) -> list[int]:
    """Codes with the base level first and the rest ascending; of equal exposures the highest code leads."""
    own = [c for c, _ in codes]
    if not own:
        raise ValueError(f"column {column} has no levels")
    if base is None:
        lead = max(codes, key=lambda x: (x[1], x[0]))[0]
    elif base == "first":
        lead = own[0]
    else:
        lead = encoding.index(base) if encoding is not None and base in encoding else int(base) if encoding is None else -1
        if lead not in own:
            raise ValueError(f"column {column} has no level {base}")
    return [lead, *[c for c in own if c != lead]]


def build(plan: Plan, df: DataFrame, target: str | None = None) -> tuple[Model, list[dict]]:
    encodings, found = levels(plan, df)
    tables, resolved = [Table("intercept", "intercept")], []
    positive = df if plan.exposure is None else df.where(weight_column(plan) > 0)
    edges_of: dict[str, list[float]] = {}
    monotone = [t.columns[0] for t in plan.terms if t.kind == "monotone"]
    for c in monotone:
        if sum(c in t.columns for t in plan.terms) > 1:
            raise ValueError(f"a monotone column, {c}, can't enter another term")

    cut: dict[str, list[int]] = {}
    for t in plan.terms:
        if t.kind in ("banded", "monotone", "variate") and t.quantile is not None:
            cut.setdefault(t.columns[0], []).append(t.quantile)
    quantiles = bands.quantile_edges_of(df, cut)

    def edges(t: Term) -> list[float]:
        c = t.columns[0]
        return bands.explicit_edges(list(t.breaks)) if t.breaks is not None else quantiles[c, t.quantile] if t.quantile is not None else bands.equal_width_edges(df, c, t.equal_width)

    for t in plan.terms:
        c = t.columns[0] if t.columns else ""
        note: dict = {"term": t.name, "kind": t.kind}
        if t.kind in ("banded", "monotone", "variate"):
            e = edges(t)
            edges_of[c] = e
            table = Table(t.name, t.kind, (Axis(c, "band"),), [(x,) for x in e], direction=t.direction)
            if t.kind == "variate":
                table.values, table.degree = np.array(t.values, float) if t.values is not None else bands.variate_values(e), t.degree
                if len(table.values) != table.n:
                    raise ValueError(f"variate {c} needs {table.n} values")
                if t.degree >= len(set(table.values.tolist())):
                    raise ValueError(f"variate {c} of degree {t.degree} needs more distinct values")
            note["edges"] = e
        elif t.kind == "spline":
            k = bands.knots(positive, c, explicit=list(t.breaks) if t.breaks is not None else None, quantile=t.quantile, equal_width=t.equal_width)
            table = Table(t.name, "spline", (Axis(c, "band"),), [(x,) for x in k], knots=np.array(k))
            note["knots"] = k
        elif t.kind == "categorical":
            order = _base_first(found[c], t.base, encodings.get(c), c)
            table = Table(t.name, "categorical", (Axis(c, "category"),), [(x,) for x in order])
            note["base"] = encodings[c][order[0]] if c in encodings else order[0]
        elif t.kind == "interaction":
            axes, values = [], []
            for col, b in zip(t.columns, t.breaks):
                if b is None:
                    main = next((m for m in plan.terms if m.kind == "categorical" and m.columns == (col,)), None)
                    axes.append(Axis(col, "category"))
                    values.append(_base_first(found[col], main.base if main else None, encodings.get(col), col))
                else:
                    axes.append(Axis(col, "band"))
                    values.append(bands.explicit_edges(list(b)))
            cells: list[tuple] = [()]
            for own in values:
                cells = [(*p, v) for p in cells for v in own]
            table = Table(t.name, "interaction", tuple(axes), cells)
            mains = [any(m.columns == (col,) and (m.kind == "categorical" if a.kind == "category" else m.kind == "banded" and edges_of.get(col) == own) for m in plan.terms) for col, a, own in zip(t.columns, axes, values)]
            if len(axes) == 2 and all(mains):
                # Both main effects stand on their own, so the cells of either reference add nothing.
                table.kind = "interaction_contrast"
                table.locked = np.array([k[0] == values[0][0] or k[1] == values[1][0] for k in cells])
        else:
            table = _load(t.name, t.table, t.kind == "offset")
        note["rows"], note["parameters"] = table.n, table.parameters
        resolved.append(note)
        tables.append(table)
    model = Model(tables, plan.family, LINKS[plan.family], encodings, target, plan.exposure, plan.exposure_role, plan.tweedie_power)
    return model, resolved
