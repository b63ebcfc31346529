"""Explanations cover every order."""

import glob
import os

import duckdb
import pytest

from ratecraft import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_order_is_explained(spark):
    """The rows of the query's SQL, over all orders."""
    duck = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = duck.execute(catalog.oracle_sql()["explain_rows"]).df()
    got = catalog.queries()["explain_rows"](spark, SF).toPandas()
    assert got.o_orderkey.nunique() == duck.execute("select count(*) from orders").fetchone()[0]
    order = ["o_orderkey", "term"]
    got, want = (f[sorted(f.columns)].sort_values(order).reset_index(drop=True) for f in (got, want))
    assert got.equals(want)
