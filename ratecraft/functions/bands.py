"""Band edges, knots and variate values from explicit numbers or column statistics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slices that a pass divides a range of values into.
SLICES = 4096


def explicit_edges(breaks: list[float]) -> list[float]:
    """Sorted distinct finite breaks, and an open last band."""
    return [*sorted({float(b) for b in breaks if math.isfinite(b)}), math.inf]


def nearest_ranks(n_bands: int, n_rows: int) -> list[int]:
    """1-based ranks of the inner quantiles; the rank is taken in floating point."""
    return [max(1, math.ceil(i / n_bands * n_rows)) for i in range(1, n_bands)]


def _finite(column: str):
    """The column as a double, null where it is not finite."""
    x = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != math.inf), x)


def quantiles_at(df: DataFrame, wanted: dict[str, list[float]], by_rank) -> dict[str, list[float]]:
    """Values of columns at ranks, exactly; all columns share each pass.

    ``by_rank`` maps (number of rows, entry of wanted) to a 1-based rank.  Null, NaN and infinite values
    don't count.  A first pass has counts and ranges.  Each further one counts, between the least and the largest
    value that a rank can have, the rows of SLICES slices of that range, with the least and largest value in each; the rank's slice
    is the next range, until it holds one value.  So every pass is an aggregation to a bounded number of rows.
    """
    columns = list(wanted)
    if not columns:
        return {}
    r = df.agg(*[f(_finite(c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    found: dict[tuple[int, int], float] = {}
    #: (column, lo, hi) of a range to the rows before it and the ranks sought in it.
    open_: dict[tuple[int, float, float], tuple[int, list[int]]] = {}
    ranks = {}
    for i, c in enumerate(columns):
        n = r[f"n{i}"]
        ranks[c] = [min(n, by_rank(n, e)) for e in wanted[c]] if n else []
        if ranks[c]:
            open_[i, r[f"lo{i}"], r[f"hi{i}"]] = (0, sorted(set(ranks[c])))
    while open_:
        for (i, lo, hi), (_, own) in list(open_.items()):
            if lo == hi:
                found |= {(i, k): lo for k in own}
                del open_[i, lo, hi]
        if not open_:
            break
        asked = list(open_)
        per_column = []
        for i in sorted({i for i, _, _ in asked}):
            x, part = _finite(columns[i]), None
            for k, (j, lo, hi) in enumerate(asked):
                if j == i:
                    # A slice's number never falls as the value rises; halves are taken where the difference isn't finite.
                    share = (x - lo) / (hi - lo) if math.isfinite(hi - lo) else (x / 2 - lo / 2) / (hi / 2 - lo / 2)
                    at = F.least(F.lit(SLICES - 1), F.floor(share * SLICES)).cast("int")
                    hit = F.struct(F.lit(k).alias("k"), at.alias("at"), x.alias("x"))
                    part = F.when(x.between(lo, hi), hit) if part is None else part.when(x.between(lo, hi), hit)
            per_column.append(part)
        each = df.select(F.inline(F.filter(F.array(*per_column), lambda s: s.isNotNull())))
        counted = sorted(each.groupBy("k", "at").agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect(), key=lambda s: (s.k, s["at"]))
        new: dict[tuple[int, float, float], tuple[int, list[int]]] = {}
        upto = {k: open_[a][0] for k, a in enumerate(asked)}
        for s in counted:
            before, upto[s.k] = upto[s.k], upto[s.k] + s.c
            here = [q for q in open_[asked[s.k]][1] if before < q <= upto[s.k]]
            if here:
                new[asked[s.k][0], s.lo, s.hi] = (before, here)
        open_ = new
    return {c: [found[i, q] for q in ranks[c]] for i, c in enumerate(columns)}


def quantile_edges_of(df: DataFrame, wanted: dict[str, list[int]]) -> dict[tuple[str, int], list[float]]:
    """Nearest-rank quantile bands of columns for each number of bands, over finite values, rows of no weight included."""
    for c, counts in wanted.items():
        if min(counts) < 1:
            raise ValueError(f"quantile bands of {c} need a count of one at least")
    entries = {c: [(n, i) for n in counts for i in range(1, n + 1)] for c, counts in wanted.items()}
    got = quantiles_at(df, entries, lambda total, e: max(1, math.ceil(e[1] / e[0] * total)))
    out = {}
    for c, counts in wanted.items():
        if not got[c]:
            raise ValueError(f"column {c} has no finite values")
        at = dict(zip(entries[c], got[c]))
        out |= {(c, n): explicit_edges([at[n, i] for i in range(1, n)]) for n in counts}
    return out


def quantile_edges(df: DataFrame, column: str, n: int) -> list[float]:
    return quantile_edges_of(df, {column: [n]})[column, n]


def equal_width_edges(df: DataFrame, column: str, n: int) -> list[float]:
    if n < 1:
        raise ValueError(f"bands of equal width of {column} need a count of one at least")
    lo, hi = finite_range(df, column)
    return explicit_edges([lo + (hi - lo) * i / n for i in range(1, n)])


def finite_range(df: DataFrame, column: str) -> tuple[float, float]:
    x = F.col(column).cast("double")
    r = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)).agg(F.min(x), F.max(x)).first()
    if r[0] is None:
        raise ValueError(f"column {column} has no finite values")
    return float(r[0]), float(r[1])


def knots(df: DataFrame, column: str, *, explicit: list[float] | None = None, quantile: int | None = None, equal_width: int | None = None) -> list[float]:
    """Knots of a spline; statistics are over the rows given, which should have positive weight."""
    n = equal_width if equal_width is not None else quantile if quantile is not None else 5
    if explicit is None and n < 2:
        raise ValueError(f"a spline over {column} needs two distinct knots at least")
    if explicit is not None:
        out = [float(k) for k in explicit]
        if any(b <= a for a, b in zip(out, out[1:])):
            raise ValueError("knots must ascend")
    elif equal_width is not None:
        lo, hi = finite_range(df, column)
        out = sorted({lo + (hi - lo) * i / (n - 1) for i in range(n)})
    else:
        got = quantiles_at(df, {column: list(range(n))}, lambda total, i: max(1, math.ceil(i / (n - 1) * total)))[column]
        out = sorted(set(got))
    if len(out) < 2:
        raise ValueError(f"a spline over {column} needs two distinct knots at least")
    return out


def variate_values(edges: list[float]) -> np.ndarray:
    """A number for each band: the first bound, midpoints, and past the last finite bound by the width before it."""
    finite = [e for e in edges if math.isfinite(e)]
    if not finite:
        raise ValueError("a variate needs a finite bound")
    out = [finite[0], *((a + b) / 2 for a, b in zip(finite, finite[1:]))]
    if len(edges) > len(finite):
        out.append(finite[-1] + (finite[-1] - finite[-2] if len(finite) > 1 else 0.5 * max(abs(finite[0]), 1.0)))
    return np.array(out[: len(edges)])
