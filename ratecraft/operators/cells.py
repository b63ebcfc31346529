"""Cell collapse: one aggregation of the data to sums for each tuple of bound rows.

With q = exp(offset) and weight a, a log-link fit of variance power p needs only
A = sum(a q^(1-p) y) and B = sum(a q^(2-p)) of each cell, the identity link A = sum(a (y - offset)) and
B = sum(a), and the logit link, without an offset, A = sum(a y) and B = sum(a).  Everything iterative then runs
on cells.  Splines put their column in the key, logit models their offset.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.families import Family
from ..plans.tables import Model

#: Cells that may come to the driver; more stay on the executors, where partial sums are taken of them.
MAX_CELLS = 2_000_000


@dataclass
class Cells:
    """Row of each table (cells x tables), sums A and B, offset of the key, spline values, and row counts."""

    rows: np.ndarray
    a: np.ndarray
    b: np.ndarray
    offset: np.ndarray
    x: dict[int, np.ndarray]
    weight: np.ndarray
    n_positive: np.ndarray


def response(model: Model) -> tuple[Column, Column, Column]:
    """(target, weight, offset) as doubles."""
    y = F.col(f"`{model.target}`").cast("double")
    e = F.col(f"`{model.exposure}`").cast("double") if model.exposure else None
    w = e if e is not None and model.role == "weight" else F.lit(1.0)
    o = F.when(e > 0, F.ln(e)).otherwise(F.lit(float("-inf"))) if e is not None and model.role == "offset" else F.lit(0.0)
    return y, w, o


def collapse(bound: DataFrame, model: Model, family: Family) -> Cells | DataFrame:
    """Cells of a bound frame; raises where any row is unmatched or a number is unusable.

    More than MAX_CELLS are returned as a persisted frame, which the caller unpersists.
    """
    y, w, o = response(model)
    n = len(model.tables)
    keys = [F.col(f"_row{i}").alias(f"r{i}") for i in range(n)]
    splines = [i for i, t in enumerate(model.tables) if t.knots is not None]
    keys += [F.col(f"`{model.tables[i].axes[0].name}`").cast("double").alias(f"x{i}") for i in splines]
    if family.link == "logit" and model.role == "offset":
        keys.append(o.alias("o"))
    zero = F.lit(0.0)
    if family.link == "log":
        q = lambda e: F.exp(o * e) if e and model.role == "offset" else F.lit(1.0)
        a, b = w * q(1 - family.p) * y, w * q(2 - family.p)
    elif family.link == "identity":
        a, b = w * (y - o), w
    else:
        a, b = w * y, w
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    e = F.col(f"`{model.exposure}`").cast("double") if model.exposure else F.lit(1.0)
    # What can't be fitted is counted in the same pass.
    audit = [F.count("*").alias("c_all"), F.count(F.when(odd(y), 1)).alias("c_y"), F.count(F.when(odd(e), 1)).alias("c_e"), F.count(F.when(e < 0, 1)).alias("c_neg"), F.count(F.when(e <= 0, 1)).alias("c_zero"), F.min(y).alias("c_lo"), F.max(y).alias("c_hi")]
    got = bound.groupBy(*keys).agg(
        *audit,
        F.sum(F.when(w > 0, a).otherwise(zero)).alias("a"), F.sum(F.when(w > 0, b).otherwise(zero)).alias("b"), F.sum(w).alias("w"), F.count(F.when(w > 0, 1)).alias("n")
    )
    few = got.limit(MAX_CELLS + 1).toPandas()
    if len(few) > MAX_CELLS:
        del few
        return _many(got.persist(), bound, model, family)
    few = few.sort_values([k for k in few.columns if k[0] in "rx"], kind="stable")
    check_data(few, model, family)
    rows = few[[f"r{i}" for i in range(n)]]
    if rows.isna().any().any():
        _unmatched(bound, [model.tables[i].name for i in range(n) if rows[f"r{i}"].isna().any()], n)
    x = {i: few[f"x{i}"].to_numpy(float) for i in splines}
    offset = few["o"].to_numpy(float) if "o" in few else np.zeros(len(few))
    return Cells(rows.to_numpy(np.int64), few["a"].to_numpy(float), few["b"].to_numpy(float), offset, x, few["w"].to_numpy(float), few["n"].to_numpy(np.int64))


def _unmatched(bound: DataFrame, lost: list[str], n: int) -> None:
    count = int(bound.where(" or ".join(f"_row{i} is null" for i in range(n))).count())
    raise ValueError(f"{count} rows match no row of: {', '.join(lost)}")


def _many(cells: DataFrame, bound: DataFrame, model: Model, family: Family) -> DataFrame:
    """The checks of collapse() for cells that stay on the executors, in one pass over them."""
    n = len(model.tables)
    sums = [F.sum(c).alias(c) for c in ("c_all", "c_y", "c_e", "c_neg", "c_zero", "w")]
    r = cells.agg(*sums, F.min("c_lo").alias("c_lo"), F.max("c_hi").alias("c_hi"), *[F.count(F.when(F.col(f"r{i}").isNull(), 1)).alias(f"u{i}") for i in range(n)]).first()
    try:
        check_data(pd.DataFrame([{k: r[k] for k in ("c_all", "c_y", "c_e", "c_neg", "c_zero", "w", "c_lo", "c_hi")}]), model, family)
        if any(r[f"u{i}"] for i in range(n)):
            _unmatched(bound, [t.name for i, t in enumerate(model.tables) if r[f"u{i}"]], n)
    except ValueError:
        cells.unpersist()
        raise
    return cells.drop(*[c for c in cells.columns if c.startswith("c_")], "n")


def check_data(cells: pd.DataFrame, model: Model, family: Family) -> None:
    """Raises on targets, exposures and weights that can't be fitted."""
    c = lambda name: int(cells[f"c_{name}"].sum())
    if not c("all"):
        raise ValueError("there are no rows to fit")
    if c("y"):
        raise ValueError(f"the target {model.target} is null or not finite in {c('y')} rows")
    if c("e"):
        raise ValueError(f"the exposure {model.exposure} is null or not finite in {c('e')} rows")
    if c("neg"):
        raise ValueError(f"the exposure {model.exposure} is negative in {c('neg')} rows")
    if model.role == "offset" and c("zero"):
        raise ValueError(f"the exposure {model.exposure} is zero in {c('zero')} rows, so its logarithm can't be an offset")
    if not cells["w"].sum() > 0:
        raise ValueError("the total weight is zero")
    if why := family.domain_error(cells["c_lo"].min(), cells["c_hi"].max()):
        raise ValueError(why)
