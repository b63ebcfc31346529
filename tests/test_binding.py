"""Every form of binding equals the plain scan, also for missing, infinite and unseen values."""

import itertools
import math
import random

import pytest

from ratecraft.operators import binding
from ratecraft.operators.binding import bind, scan_rows
from ratecraft.plans.tables import UNSEEN, WILDCARD, Axis, Model, Table

INF, NAN = math.inf, math.nan
X, Y, C, D = Axis("x", "band"), Axis("y", "band"), Axis("c", "category"), Axis("d", "category")
NUMBERS = [None, NAN, -INF, INF, -1.0, -0.0, 0.0, 10.0, 10.000001, 25.0, 25.1, 50.0, 51.0]
CODES = [None, 0, 1, 2, 3, 7, -5]

TABLES = {
    "constant": Table("t", "intercept"),
    "sorted": Table("t", "banded", (X,), [(10.0,), (25.0,), (50.0,)]),
    "open": Table("t", "banded", (X,), [(0.0,), (25.0,), (INF,)]),
    "repeated": Table("t", "banded", (X,), [(10.0,), (10.0,), (50.0,)]),
    "missing row": Table("t", "banded", (X,), [(10.0,), (NAN,), (INF,)]),
    "unsorted": Table("t", "banded", (X,), [(50.0,), (10.0,), (INF,)]),
    "codes": Table("t", "categorical", (C,), [(2,), (0,), (7,)]),
    "codes and others": Table("t", "categorical", (C,), [(2,), (WILDCARD,), (0,)]),
    "grid": Table("t", "interaction", (X, Y), list(itertools.product([10.0, 25.0, INF], [0.0, 50.0]))),
    "shuffled grid": Table("t", "interaction", (X, Y), [(25.0, 0.0), (10.0, 0.0), (10.0, 50.0), (25.0, 50.0)]),
    "code grid": Table("t", "interaction", (X, C), list(itertools.product([10.0, INF], [0, 1, 2]))),
    "mixed": Table("t", "given", (X, C, D), [(10.0, WILDCARD, 1), (25.0, 1, WILDCARD), (INF, 1, 1), (INF, WILDCARD, WILDCARD), (NAN, 2, WILDCARD)]),
    "free cells": Table("t", "given", (X, Y), [(None, 0.0), (10.0, None), (INF, INF)]),
}


def observations(t):
    domains = [NUMBERS if a.kind == "band" else CODES for a in t.axes]
    every = list(itertools.product(*domains))
    return every if len(every) <= 700 else random.Random(3).sample(every, 700)


def rows_by_spark(spark, t, values):
    names = [a.name for a in t.axes]
    schema = ", ".join(["i int", *[f"{a.name} {'double' if a.kind == 'band' else 'int'}" for a in t.axes]])
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], schema)
    got = {r.i: r["_row0"] for r in bind(df, Model([t])).collect()}
    assert len(names) == len(t.axes)
    return [-1 if got[i] is None else got[i] for i in range(len(values))]


@pytest.mark.parametrize("name", TABLES)
def test_equals_scan(spark, name):
    t = TABLES[name]
    values = observations(t) if t.axes else [()]
    # As in preparation, a missing code is the unseen one.
    prepared = [tuple(UNSEEN if a.kind == "category" and v is None else v for a, v in zip(t.axes, row)) for row in values]
    assert rows_by_spark(spark, t, values) == scan_rows(t, prepared).tolist()


@pytest.mark.parametrize("name", ["mixed", "free cells", "unsorted"])
def test_joined_binding_equals_scan(spark, name, monkeypatch):
    monkeypatch.setattr(binding, "CHAIN_ROWS", 0)
    test_equals_scan(spark, name)


@pytest.mark.parametrize("name", [n for n in TABLES if n != "constant"])
def test_long_tables_equal_scan(spark, name, monkeypatch):
    """As if every table, tree and array were too long for an expression."""
    monkeypatch.setattr(binding, "CHAIN_ROWS", 0)
    monkeypatch.setattr(binding, "TREE_KEYS", 0)
    test_equals_scan(spark, name)


@pytest.mark.parametrize("most", [200_000, 10])
def test_many_labels_and_factors(spark, monkeypatch, most):
    """Labels, codes and factors by the thousand: joins on equality, broadcast or not, and one text for the factors."""
    from ratecraft.operators.scoring import predict_linear

    monkeypatch.setattr(binding, "BROADCAST_ROWS", most)
    labels = [f"l{i:05d}" for i in range(3000)]
    t = Table("c", "categorical", (C,), [(i,) for i in reversed(range(2500))] + [(WILDCARD,)], [i / 7 for i in range(2501)])
    t.factors = __import__("numpy").array(t.factors)
    rows = [(i, v) for i, v in enumerate([*labels[::100], "new", None])]
    df = spark.createDataFrame(rows, "i int, c string")
    m = Model([Table("intercept", "intercept"), t], link="identity", family="gaussian", encodings={"c": labels})
    got = {r.i: r.linear_predictor for r in predict_linear(df, m).collect()}
    for i, v in rows:
        code = labels.index(v) if v in labels else None
        row = 2499 - code if code is not None and code < 2500 else 2500
        assert got[i] == row / 7
    assert set(bind(df, m).columns) == {"i", "c", "_row0", "_row1"}
    long = bind(df, m)._jdf.queryExecution().executedPlan().toString()
    assert most == 10 or "BroadcastHashJoin" in long and "Exchange hashpartitioning" not in long


def test_long_irregular_tables_neither_join_nor_shuffle(spark):
    rng = random.Random(5)
    keys = [(rng.uniform(0, 100), rng.choice([0, 1, 2, 3, WILDCARD]), rng.uniform(0, 100)) for _ in range(1200)]
    t = Table("t", "given", (X, C, Y), keys)
    values = [(rng.choice([None, NAN, rng.uniform(-5, 120)]), rng.choice([None, 0, 1, 2, 9]), rng.uniform(-5, 120)) for _ in range(400)]
    prepared = [(x, UNSEEN if c is None else c, y) for x, c, y in values]
    assert rows_by_spark(spark, t, values) == scan_rows(t, prepared).tolist()
    df = spark.range(10).selectExpr("cast(id as double) x", "cast(id as int) c", "cast(id as double) y")
    plan = bind(df, Model([t]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_random_tables(spark):
    rng = random.Random(11)
    for _ in range(6):
        keys = [(rng.choice([10.0, 25.0, 50.0, INF, NAN]), rng.choice([0, 1, 2, WILDCARD])) for _ in range(rng.randint(1, 9))]
        t = Table("t", "given", (X, C), keys)
        values = observations(t)
        prepared = [(x, UNSEEN if c is None else c) for x, c in values]
        assert rows_by_spark(spark, t, values) == scan_rows(t, prepared).tolist(), keys


def test_labels(spark):
    t = Table("t", "categorical", (C,), [(1,), (0,), (WILDCARD,)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["é", "b", "z", None])], "i int, c string")
    got = {r.i: r["_row0"] for r in bind(df, Model([t], encodings={"c": ["b", "é"]})).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2}


def test_wrong_columns(spark):
    df = spark.createDataFrame([("a", 1.5)], "s string, f double")
    with pytest.raises(ValueError, match="missing"):
        bind(df, Model([TABLES["sorted"]]))
    with pytest.raises(ValueError, match="isn't numeric"):
        bind(df, Model([Table("t", "banded", (Axis("s", "band"),), [(1.0,)])]))
    with pytest.raises(ValueError, match="can't be a category"):
        bind(df, Model([Table("t", "categorical", (Axis("f", "category"),), [(1,)])]))


def test_no_shuffle(spark):
    df = spark.range(10).selectExpr("cast(id as double) x", "cast(id as int) c")
    plan = bind(df, Model([TABLES["sorted"], TABLES["code grid"]]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
