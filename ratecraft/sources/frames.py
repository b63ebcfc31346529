"""Frames: pandas input with checks, and the policy view of the order tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_pandas(spark: SparkSession, data: pd.DataFrame, *, index_column: str | None = None) -> DataFrame:
    """A Spark frame of a pandas one: categories become their labels, missing values nulls.

    Column names must be distinct strings; an index is kept only under ``index_column``, and category labels must all be of one kind, not floats.
    """
    if isinstance(data.columns, pd.MultiIndex) or isinstance(data.index, pd.MultiIndex):
        raise ValueError("a MultiIndex can't be converted; reset or flatten it")
    if len(set(data.columns)) != len(data.columns) or not all(isinstance(c, str) for c in data.columns):
        raise ValueError("column names must be distinct strings")
    out = data.copy()
    if index_column is not None:
        if index_column in out.columns:
            raise ValueError(f"there is a column {index_column} already")
        out.insert(0, index_column, data.index)
    for c in out.columns:
        if isinstance(out[c].dtype, pd.CategoricalDtype):
            kinds = {type(x) for x in out[c].cat.categories}
            if len(kinds) > 1 or float in kinds:
                raise ValueError(f"categories of {c} must be labels of one kind, not floats")
            values = out[c].astype(object)
            out[c] = values.where(values.notna(), None)
    return spark.createDataFrame(out.reset_index(drop=True))


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each order with lines: exposure (lines), claims (returned lines), loss (their price), and its customer.

    Lines are summed by order before any join, so only one row an order meets orders and customers.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(
        F.count("*").cast("double").alias("exposure"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("double").alias("claims"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0.0)).alias("loss"),
    )
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    out = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return out.drop("l_orderkey", "c_custkey").withColumn("frequency", F.col("claims") / F.col("exposure")).withColumn("premium", F.col("loss") / F.col("exposure"))


#: The policy view as a DuckDB common table expression.
POLICIES_SQL = """policies AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, c_mktsegment, c_acctbal, c_nationkey,
         exposure, claims, loss, claims / exposure AS frequency, loss / exposure AS premium
  FROM orders JOIN (
    SELECT l_orderkey, count(*)::DOUBLE AS exposure, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::DOUBLE AS claims,
           sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS loss
    FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
  JOIN customer ON o_custkey = c_custkey)"""
