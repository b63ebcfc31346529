"""Row binding: the table row that each observation belongs to, as a Catalyst expression.

A row matches when every category is equal or a wildcard and every number is at most its
bound; the fewest wildcards win, then the first row.  Single sorted bands and categories become balanced
decision trees, complete grids one tree for each axis and an array look-up, and other tables a chain of
cases in order of preference.  None of these shuffles or leaves whole-stage code generation.
Labels and codes too many for a tree are looked up by a join on equality, broadcast where their counted number allows.  Irregular
tables too long for a chain are scanned in vectors, once for each distinct place of an observation among the table's bounds and codes.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import UNSEEN, WILDCARD, Model, Table

#: Rows of the longest chain of cases, keys of the largest tree, and of the largest that is broadcast.
CHAIN_ROWS, TREE_KEYS, BROADCAST_ROWS = 400, 1_000, 200_000
#: Places of observations whose row is kept in mind by one worker.
MEMO = 500_000


def _tree(keys: Sequence, leaf: Callable[[int], Column], at_most: Callable[[object], Column]) -> Column:
    """The leaf of the first key that the value doesn't exceed, or of the last one."""

    def build(lo: int, hi: int) -> Column:
        if lo == hi:
            return leaf(lo)
        mid = (lo + hi) // 2
        return F.when(at_most(keys[mid]), build(lo, mid)).otherwise(build(mid + 1, hi))

    return build(0, len(keys) - 1)


def missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def lower_bound(x: Column, edges: Sequence[float]) -> Column:
    """Index of the first of ascending edges that x doesn't exceed; null past the last, and for null and NaN."""
    tree = _tree(edges, lambda i: F.lit(i), lambda e: x <= float(e))
    return F.when(~missing(x) & (x <= float(edges[-1])), tree)


def look_up(x: Column, keys: Sequence, rows: Sequence[int], default: int | None) -> Column:
    """The row of the key that x equals, else the default."""
    order = sorted(range(len(keys)), key=lambda i: keys[i].encode() if isinstance(keys[i], str) else keys[i])
    other = F.lit(default).cast("int")
    if not order:
        return other
    hit = lambda i: F.when(x == F.lit(keys[order[i]]), F.lit(rows[order[i]])).otherwise(other)
    return F.when(x.isNull(), F.lit(None).cast("int")).otherwise(_tree([keys[i] for i in order], hit, lambda k: x <= F.lit(k)))


def coded(column: str, dtype: str, encoding: list[str] | None) -> Column:
    """Category code of a column: its place among the encoding's labels, or the integer itself.

    Unknown labels and nulls get the unseen code, which only wildcards match.
    """
    c = F.col(f"`{column}`")
    if encoding is not None:
        return F.coalesce(look_up(c.cast("string"), encoding, range(len(encoding)), UNSEEN), F.lit(UNSEEN))
    if dtype in ("tinyint", "smallint", "int", "bigint", "boolean"):
        return F.coalesce(c.try_cast("int"), F.lit(UNSEEN))
    raise ValueError(f"column {column} of type {dtype} can't be a category; cast it to string or integer")


def feature_columns(model: Model, df: DataFrame, known: dict[str, Column] | None = None) -> dict[str, Column]:
    """The numeric or coded column of each feature, after checks of presence and type; ``known`` has codes that were looked up already."""
    types, out = dict(df.dtypes), {}
    for t in model.tables:
        for a in t.axes:
            if a.name not in types:
                raise ValueError(f"column {a.name}, which table {t.name} reads, is missing")
            kind = types[a.name]
            if a.kind == "category":
                got = known[a.name] if known and a.name in known else coded(a.name, kind, model.encodings.get(a.name))
            elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
                got = F.col(f"`{a.name}`").cast("double")
            else:
                raise ValueError(f"column {a.name} of type {kind} isn't numeric")
            out[f"{a.kind}:{a.name}"] = got
    return out


def _sorted_band(t: Table) -> bool:
    if len(t.axes) != 1 or t.axes[0].kind != "band":
        return False
    k = [x[0] for x in t.keys]
    return all(x is not None and not math.isnan(x) for x in k) and all(a <= b for a, b in zip(k, k[1:]))


def _grid(t: Table) -> list[list] | None:
    """Distinct values of each axis, when the rows are exactly their product and a first match is the cell's row."""
    if len(t.axes) < 2:
        return None
    values = []
    for j, axis in enumerate(t.axes):
        own = {k[j] for k in t.keys if not (isinstance(k[j], float) and math.isnan(k[j]))}
        if None in own or WILDCARD in own or any(isinstance(k[j], float) and math.isnan(k[j]) for k in t.keys):
            return None
        values.append(sorted(own))
    if math.prod(map(len, values)) != t.n or len(set(t.keys)) != t.n:
        return None
    # A larger bound must never stand before a smaller one of the same other values.
    place = {k: i for i, k in enumerate(t.keys)}
    for j, axis in enumerate(t.axes):
        if axis.kind == "band":
            for k, i in place.items():
                at = values[j].index(k[j])
                if at and place[(*k[:j], values[j][at - 1], *k[j + 1 :])] > i:
                    return None
    return values


def row_of(t: Table, x: Sequence[Column]) -> Column:
    """The table's row, 0-based int, or null where none matches."""
    if t.knots is not None:
        v = x[0]
        return F.when(~missing(v) & (F.abs(v) != math.inf), lower_bound_floor(v, [float(k) for k in t.knots[1:-1]]))
    if not t.axes:
        return F.lit(0)
    if _sorted_band(t):
        first: dict[float, int] = {}
        for i, (k,) in enumerate(t.keys):
            first.setdefault(float(k), i)
        edges, rows = list(first), list(first.values())
        if len(edges) > TREE_KEYS * 10:
            raise LookupError("too many bounds for an expression")
        if rows == list(range(len(rows))):
            return lower_bound(x[0], edges)
        return F.when(~missing(x[0]) & (x[0] <= edges[-1]), _tree(edges, lambda i: F.lit(rows[i]), lambda e: x[0] <= float(e)))
    if len(t.axes) == 1 and t.axes[0].kind == "category":
        rows, wild = _rows_of_codes(t)
        if len(rows) > TREE_KEYS:
            raise LookupError("too many codes for an expression")
        return look_up(x[0], list(rows), list(rows.values()), wild)
    if (grid := _grid(t)) is not None:
        if any(len(own) > (TREE_KEYS if a.kind == "category" else TREE_KEYS * 10) for own, a in zip(grid, t.axes)):
            raise LookupError("too many keys of an axis for an expression")
        cell, place = F.lit(0), {k: i for i, k in enumerate(t.keys)}
        for v, own, axis in zip(x, grid, t.axes):
            at = lower_bound(v, own) if axis.kind == "band" else look_up(v, own, range(len(own)), None)
            cell = cell * len(own) + at
        order = [place[k] for k in _product(grid)]
        # One text, read once when the plan is made, stands for a long array.
        return cell if order == list(range(t.n)) else F.get(F.from_json(F.lit(json.dumps(order)), "array<int>"), cell)
    if t.n > CHAIN_ROWS:
        raise LookupError("too many rows for an expression")
    out: Column | None = None
    for i in sorted(range(t.n), key=lambda i: (t.wildcards(i), i)):
        hit = _holds(t, i, x)
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out


def _rows_of_codes(t: Table) -> tuple[dict[int, int], int | None]:
    """The first row of each code, and that of all others."""
    rows: dict[int, int] = {}
    for i, (k,) in enumerate(t.keys):
        rows.setdefault(WILDCARD if k is None else int(k), i)
    wild = rows.pop(WILDCARD, None)
    return rows, wild


def lower_bound_floor(x: Column, edges: Sequence[float]) -> Column:
    """Number of ascending edges that are at most x."""
    if not edges:
        return F.lit(0)
    build = lambda lo, hi: F.lit(lo) if lo == hi else F.when(x < float(edges[(lo + hi) // 2]), build(lo, (lo + hi) // 2)).otherwise(build((lo + hi) // 2 + 1, hi))
    return build(0, len(edges))


def _product(values: list[list]) -> list[tuple]:
    out: list[tuple] = [()]
    for own in values:
        out = [(*p, v) for p in out for v in own]
    return out


def _holds(t: Table, i: int, x: Sequence[Column]) -> Column:
    cond = F.lit(True)
    for v, k, axis in zip(x, t.keys[i], t.axes):
        if k is None:
            continue
        if axis.kind == "category":
            if k != WILDCARD:
                cond = cond & (v == int(k))
        else:
            cond = cond & (missing(v) if math.isnan(k) else ~missing(v) & (v <= float(k)))
    return cond


def _looked_up(df: DataFrame, key: Column, rows: dict, default: int | None, out: str) -> DataFrame:
    """Adds the int of each key by a join on equality; null keys stay null, others that are not there get the default."""
    kind = "string" if all(isinstance(k, str) for k in rows) else "int"
    pairs = df.sparkSession.createDataFrame(list(rows.items()), f"_key {kind}, _value int")
    if len(rows) <= BROADCAST_ROWS:
        pairs = F.broadcast(pairs)
    asked = df.withColumn("_asked", key.cast(kind))
    value = F.when(F.col("_asked").isNotNull(), F.coalesce("_value", F.lit(default).cast("int")))
    return asked.join(pairs, F.col("_asked") == F.col("_key"), "left").withColumn(out, value).drop("_asked", "_key", "_value")


def scanner(t: Table) -> Callable[[list[np.ndarray]], np.ndarray]:
    """A function from columns of values (NaN for missing numbers) to rows, -1 for none, for tables of any form.

    A row depends only on the place of each value among the table's own bounds and codes, so the table is scanned once for each
    distinct tuple of places.
    """
    order = sorted(range(t.n), key=lambda i: (t.wildcards(i), i))
    axes = []
    for j, a in enumerate(t.axes):
        own = [t.keys[i][j] for i in order]
        free = np.array([k is None or (a.kind == "category" and k == WILDCARD) for k in own])
        gone = np.array([not f and a.kind == "band" and math.isnan(k) for k, f in zip(own, free)])
        known = np.array(sorted({k for k, f, g in zip(own, free, gone) if not f and not g}), float if a.kind == "band" else np.int64)
        place = np.array([-1 if f or g else int(np.searchsorted(known, k)) for k, f, g in zip(own, free, gone)])
        axes.append((a.kind, known, free, gone, place))
    rows, memo = np.array(order), {}

    def first(places: tuple[int, ...]) -> int:
        hit = np.ones(len(rows), bool)
        for (kind, known, free, gone, place), p in zip(axes, places):
            if kind == "category":
                hit &= free | (place == p)
            else:
                # One past the last place but one stands for a missing number.
                hit &= free | (gone if p > len(known) else ~gone & (place >= p))
        at = int(hit.argmax()) if len(hit) else 0
        return int(rows[at]) if len(hit) and hit[at] else -1

    def run(values: list[np.ndarray]) -> np.ndarray:
        places = []
        for (kind, known, *_), v in zip(axes, values):
            if kind == "category":
                at = np.minimum(np.searchsorted(known, v), max(len(known) - 1, 0))
                places.append(np.where(known[at] == v, at, len(known)) if len(known) else np.zeros(len(v), np.int64))
            else:
                places.append(np.where(np.isnan(v), len(known) + 1, np.searchsorted(known, v, "left")))
        distinct, back = np.unique(np.stack(places, 1), axis=0, return_inverse=True)
        if len(memo) > MEMO:
            memo.clear()
        out = np.empty(len(distinct), np.int64)
        for i, p in enumerate(map(tuple, distinct.tolist())):
            if p not in memo:
                memo[p] = first(p)
            out[i] = memo[p]
        return out[back.ravel()]

    return run


def _scanned(t: Table, x: Sequence[Column]) -> Column:
    """Binding of long irregular tables by an Arrow-batched function, without a join or a shuffle."""
    kinds = [a.kind for a in t.axes]
    run = scanner(t)

    def rows(*columns: pd.Series) -> pd.Series:
        got = run([c.to_numpy(np.int64) if k == "category" else c.to_numpy(float, na_value=np.nan) for c, k in zip(columns, kinds)])
        return pd.Series(got, dtype="Int32").where(got >= 0)

    # A null category takes part in no row, not even that of a wildcard.
    codes = [v for v, k in zip(x, kinds) if k == "category"]
    lost = F.lit(False)
    for c in codes:
        lost = lost | c.isNull()
    given = [F.coalesce(v, F.lit(UNSEEN)) if k == "category" else v for v, k in zip(x, kinds)]
    return F.when(~lost, F.pandas_udf(rows, "int")(*given))


def bind(df: DataFrame, model: Model, prefix: str = "_row") -> DataFrame:
    """Adds an int column ``_row<i>`` for each table, null where no row matches."""
    types, known, out = dict(df.dtypes), {}, df
    for c in dict.fromkeys(a.name for t in model.tables for a in t.axes if a.kind == "category"):
        labels = model.encodings.get(c)
        if labels is not None and len(labels) > TREE_KEYS and c in types:
            out = _looked_up(out, F.col(f"`{c}`").cast("string"), {v: i for i, v in reversed(list(enumerate(labels)))}, UNSEEN, f"_code_{c}")
            known[c] = F.coalesce(F.col(f"`_code_{c}`"), F.lit(UNSEEN))
    features = feature_columns(model, df, known)
    simple, late = {}, []
    for i, t in enumerate(model.tables):
        x = [features[f"{a.kind}:{a.name}"] for a in t.axes]
        try:
            simple[f"{prefix}{i}"] = row_of(t, x).cast("int")
        except LookupError:
            if len(t.axes) == 1 and t.axes[0].kind == "category":
                late.append((f"{prefix}{i}", t, x[0]))
            else:
                simple[f"{prefix}{i}"] = _scanned(t, x)
    out = out.withColumns(simple)
    for name, t, x in late:
        rows, wild = _rows_of_codes(t)
        out = _looked_up(out, x, rows, wild, name)
    return out.drop(*[f"_code_{c}" for c in known])


def effect(t: Table, row: Column, x: Sequence[Column]) -> Column:
    """The table's term of the linear predictor at a bound row; null where the row is."""
    if t.knots is not None:
        from ..functions.splines import expression

        return expression(x[0], t.knots, t.factors)
    if not t.axes:
        return F.lit(float(t.factors[0]))
    if t.n > TREE_KEYS:
        # One text, read once when the plan is made, in place of a literal for each row.
        values = F.from_json(F.lit(json.dumps([float(v) for v in t.factors])), "array<double>")
    else:
        values = F.array(*[F.lit(float(v)) for v in t.factors])
    return F.get(values, row)


def linear_predictor(df: DataFrame, model: Model, prefix: str = "_row") -> list[Column]:
    """The terms of bound rows, table by table."""
    return [effect(t, F.col(f"{prefix}{i}"), [F.col(f"`{a.name}`").cast("double") for a in t.axes] if t.knots is not None else []) for i, t in enumerate(model.tables)]


def scan_rows(t: Table, values: list[tuple]) -> np.ndarray:
    """Rows by plain scan, -1 for none; what all forms of binding must equal."""
    from ..plans.tables import scan

    return np.array([-1 if (r := scan(t, v)) is None else r for v in values])
